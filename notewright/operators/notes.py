"""Notes: validation, grounding of quotes, folding of slugs, ordered merge, links, similar and matching titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, folded, initials, pages, squeeze, strip, token_set
from ..session import cut
from .skew import HOT_ROWS, hot_keys, join_by_key, salted_join

#: Note types with their section, and the closed lists of the other fields.
SECTIONS = {"Concept": "concepts", "Framework": "frameworks", "Principle": "principles", "Entity": "entities", "Method": "methods", "AntiPattern": "anti-patterns"}
CONFIDENCE, STATUS = ("low", "medium", "high"), ("established", "contested", "insufficient")
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
#: Words that do not count in titles (similarity) and in file names (matching).
TITLE_STOP = ("the", "a", "an", "of", "and", "or", "to", "in", "is", "for", "with", "that", "as", "by", "on")
FILE_STOP = ("the", "of", "a", "an", "and", "for", "with", "to", "in", "on", "guide", "introduction")


def one_note(notes: DataFrame) -> DataFrame:
    """One row per ord: first arrival, first deletion; copies agree in the rest."""
    keep = [c for c in notes.columns if c not in ("ord", "loaded_at", "deleted_at")]
    got = notes.filter("ord is not null").groupBy("ord").agg(F.min_by(F.struct(*keep), "loaded_at").alias("n"), F.min("loaded_at").alias("loaded_at"), F.min("deleted_at").alias("deleted_at"))
    return got.select("ord", "n.*", "loaded_at", "deleted_at")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def canonical_type(type_: Column) -> Column:
    """The note type as SECTIONS writes it, whatever its case; null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k in SECTIONS for x in (k.lower(), k)]), F.lower(type_))


def validated(notes: DataFrame) -> DataFrame:
    """Adds canonical type, defaulted confidence and status, and ``errors``, the names of broken rules in order."""
    canon = canonical_type(F.col("type"))
    conf, stat = (F.coalesce(blank_to_null(F.col(c)), F.lit(default)) for c, default in (("confidence", "medium"), ("status", "established")))
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    rules = [
        (canon.isNull(), "type"), (~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)), "slug"), (blank("title"), "title"), (blank("description"), "description"), (blank("body"), "body"),
        (~conf.isin(*CONFIDENCE), "confidence"), (~stat.isin(*STATUS), "status"), (F.coalesce(F.size("citations"), F.lit(0)) < 1, "citations"),
        (F.coalesce(F.exists("citations", lambda c: c["chapter"].isNull() | (F.coalesce(strip(c["quote"]), F.lit("")) == "")), F.lit(False)), "citation"),
    ]
    return notes.withColumns({"canonical_type": canon, "confidence": conf, "status": stat, "errors": F.array_compact(F.array(*[F.when(r, F.lit(n)) for r, n in rules]))})


def ground(notes: DataFrame, sources: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(ord, pos, source, chapter, quote, at, page, folio): where each citation's normalized quote first stands in its normalized source.

    ``at`` is the 1-based place, null if the quote is blank, the source
    unknown, or the quote not in it. The quote and the source are normalized
    once each, both as whole texts: NFKC, full case folding, white space
    squeezed. (The reference composes the quote only, and so loses quotes with
    decomposed accents.) Page and folio follow from the form feeds before the
    place.
    """
    c = notes.select("ord", F.posexplode("citations").alias("pos", "c")).filter("c is not null").select("ord", "pos", F.col("c.source").alias("source"), F.col("c.chapter").alias("chapter"), F.col("c.quote").alias("quote"))
    c = c.withColumn("needle", squeeze(folded(F.col("quote"))))
    # pages are normalized one by one: joined by blanks they are the normalized text, and their starts tell a place's page
    by_page = sources.select(F.col("slug").alias("source"), "page_offset", F.transform(pages(folded(F.col("raw"))), squeeze).alias("p"))
    none = F.array().cast("array<struct<page:int,start:int>>")
    zero = F.struct(F.lit(0).alias("page"), F.lit(1).alias("start"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.struct((acc["page"] + 1).alias("page"), acc["start"].alias("start"))
        return F.struct((acc["page"] + 1).alias("page"), (acc["start"] + F.when(x == "", 0).otherwise(F.length(x) + 1)).alias("start"), F.when(x == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(at))).alias("out"))

    s = by_page.select("source", "page_offset", F.array_join(F.filter("p", lambda x: x != ""), " ").alias("norm"), F.aggregate("p", zero, step, lambda acc: acc["out"]).alias("starts"))
    per = c.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("source is not null")
    got = salted_join(c, s, ["source"], per, ["ord", "pos"], rows=hot_rows)
    at = F.when(F.col("needle") != "", F.instr(F.col("norm"), F.col("needle"))).cast("long")
    hit = got.withColumn("at", F.when(at > 0, at))
    page = F.try_element_at(F.filter("starts", lambda x: x["start"] <= F.col("at")), F.lit(-1))["page"]
    hit = hit.withColumn("page", page)
    folio = F.when(F.col("page_offset").isNull(), F.concat(F.col("page").cast("string"), F.lit(" (pdf)"))).otherwise(F.greatest(F.lit(1), F.col("page") - F.col("page_offset")).cast("string"))
    return hit.select("ord", "pos", "source", "chapter", "quote", "at", "page", F.when(F.col("page").isNotNull(), folio).alias("folio"))


def drop_stats(grounded: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: citations that are not in their source, notes left without any."""
    per = notes.select("ord").join(grounded.groupBy("ord").agg(F.count("at").alias("kept"), F.count(F.lit(1)).alias("all")), "ord", "left")
    return per.agg(F.coalesce(F.sum(F.col("all") - F.col("kept")), F.lit(0)).alias("citations_dropped"), F.count_if(F.coalesce("kept", F.lit(0)) == 0).alias("notes_dropped"))


def fold_edges(slugs: DataFrame) -> DataFrame:
    """(slug, target) from one column of slugs: a plural folds into its singular, else an acronym into the least slug with those initials."""
    one = slugs.select("slug").filter("slug is not null").distinct()
    plural = one.join(one.select(F.concat("slug", F.lit("s")).alias("slug"), F.col("slug").alias("singular")), "slug", "left")
    spelled = one.filter(F.contains(F.col("slug"), F.lit("-"))).select(initials(F.col("slug")).alias("slug"), F.col("slug").alias("long")).filter(F.length("slug") >= 2).groupBy("slug").agg(F.min("long").alias("expansion"))
    acronym = F.when(~F.contains(F.col("slug"), F.lit("-")) & (F.length("slug") >= 2), F.col("expansion"))
    return plural.join(spelled, "slug", "left").select("slug", F.coalesce("singular", acronym).alias("target")).filter("target is not null and target <> slug")


def fold_roots(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(slug, root) by pointer jumping: every round doubles the distance followed; cycles end at their least slug."""
    now = cut(edges.select("slug", F.col("target").alias("root")))
    for _ in range(max_rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.slug"), "left").select(F.col("a.slug").alias("slug"), F.col("a.root").alias("was"), F.coalesce(F.when(F.col("b.root") == F.col("a.slug"), F.least("a.slug", "a.root")).otherwise(F.col("b.root")), "a.root").alias("root"))
        done = cut(step)
        now = done.select("slug", "root")
        if not done.filter("was <> root").head(1):
            break
    else:
        raise RuntimeError(f"not stable after {max_rounds} rounds")
    return now.filter("slug <> root")


def alias_index(notes: DataFrame) -> DataFrame:
    """(vault, key, slug): whom a trimmed, case-folded slug or alias names; slugs go before aliases, then the earliest note."""
    fold = lambda c: F.replace(F.lower(strip(c)), F.lit("ß"), F.lit("ss"))
    names = F.concat(F.array(F.struct(F.lit(0).alias("prio"), F.col("slug").alias("name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(1).alias("prio"), a.alias("name"))))
    rows = notes.filter("slug is not null").select("vault", "slug", "ord", F.explode(names).alias("n")).select("vault", fold(F.col("n.name")).alias("key"), "slug", F.struct("n.prio", "ord").alias("rank"))
    return rows.filter("key <> ''").groupBy("vault", "key").agg(F.min_by("slug", "rank").alias("slug"))


def related_links(notes: DataFrame, index: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct (vault, src, dst), both ways: resolved ``related`` entries without links of a note to itself or to nothing."""
    fold = F.replace(F.lower(strip(F.col("ref"))), F.lit("ß"), F.lit("ss"))
    refs = notes.filter("slug is not null").select("vault", F.col("slug").alias("src"), F.explode("related").alias("ref")).select("vault", "src", fold.alias("key")).distinct()
    got = join_by_key(refs, index.withColumnRenamed("slug", "dst"), ["vault", "key"]).filter("src <> dst").select("vault", "src", "dst")
    return got.unionByName(got.select("vault", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def merged(notes: DataFrame, grounded: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per vault and canonical slug, merged in the order of ord.

    Notes without a citation found in its source are left out. Identity fields
    come from the last note after the first that carries the canonical slug
    itself, else from the first; the body is the longest, the earliest of
    equals; tags and aliases are united in order, with folded slugs as
    aliases; citations are those of the first note and every new (source,
    chapter, quote) after it; ``related`` holds the distinct entries, sorted.
    Lists are united as rows, one per entry, so that the notes of one slug
    never gather in one task, only their distinct entries.
    """
    kept = grounded.filter("at is not null").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "chapter", "quote", "folio"))).alias("g"))
    key, empty = ["vault", "canonical"], F.array().cast("array<string>")
    rows = cut(notes.join(kept, "ord").join(roots.withColumnRenamed("root", "target"), "slug", "left").withColumn("canonical", F.coalesce("target", "slug")))
    named = F.col("slug") == F.col("canonical")
    fields = F.struct("type", "title", "description", "confidence", "status")
    size = F.struct(F.coalesce(F.length("body"), F.lit(-1)), -F.col("ord"))
    per = rows.groupBy(*key).agg(
        F.min("ord").alias("first"), F.min_by(fields, "ord").alias("of_first"), F.max(F.when(named, F.col("ord"))).alias("last"), F.max_by(fields, F.when(named, F.col("ord"))).alias("of_last"),
        F.max_by("body", size).alias("body"), F.count(F.lit(1)).alias("n"),
    )
    # every entry of every list with its place; those of the first note stay, of the others each new one once
    none = F.lit(None).cast("struct<source:string,chapter:int,quote:string,folio:string>")
    entry = lambda kind, v, c, i: F.struct(F.lit(kind).alias("kind"), v.alias("v"), c.alias("c"), i.cast("int").alias("i"))
    own = F.when(~named, F.array("slug")).otherwise(empty)
    of = lambda kind, xs: F.transform(xs, lambda x, i: entry(kind, x, none, i))
    cited = F.transform("g", lambda x, i: entry("citations", F.lit(None).cast("string"), F.struct(x["source"].alias("source"), x["chapter"].alias("chapter"), x["quote"].alias("quote"), x["folio"].alias("folio")), i))
    every = F.concat(of("tags", F.coalesce("tags", empty)), of("aliases", F.concat(F.coalesce("aliases", empty), own)), of("related", F.coalesce("related", empty)), cited)
    each = rows.select(*key, "ord", F.explode(every).alias("e")).select(*key, "ord", "e.*").join(per.select(*key, "first"), key)
    per_value = each.groupBy(*key, "kind", "v", "c").agg(F.collect_list(F.when(F.col("ord") == F.col("first"), F.struct("ord", "i"))).alias("kept"), F.min(F.struct("ord", "i")).alias("new"))
    place = F.explode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array("new")))
    placed = per_value.select(*key, "kind", "v", "c", place.alias("at")).withColumn("x", F.struct("at", "v", "c"))
    lists = placed.groupBy(*key).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))).alias(k) for k in ("tags", "aliases", "related", "citations")])
    values = lambda k: F.coalesce(F.transform(k, lambda x: x["v"]), empty).alias(k)
    got = per.withColumn("i", F.when(F.col("last") > F.col("first"), F.col("of_last")).otherwise(F.col("of_first"))).join(lists, key, "left")
    return got.select(
        "vault", F.col("canonical").alias("slug"), "i.type", "i.title", "i.description", "i.confidence", "i.status", "body", values("tags"), values("aliases"),
        F.array_sort(F.array_distinct(F.coalesce(F.transform("related", lambda x: x["v"]), empty))).alias("related"), F.transform("citations", lambda x: x["c"]).alias("citations"), F.col("n").alias("occurrences"), (F.col("n") > 1).alias("merged"),
    )


def title_tokens(notes: DataFrame) -> DataFrame:
    """(vault, ord, slug, body_len, t): the token set of title and description."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return notes.select("vault", "ord", "slug", F.coalesce(F.length("body"), F.lit(0)).alias("body_len"), token_set(text, TITLE_STOP).alias("t"))


def similar_titles(notes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(vault, ord_a, ord_b, similarity): notes of one vault with other slugs whose title tokens have that Jaccard similarity.

    Tokens are ranked rare first over all notes; a pair must share a token of
    both prefixes, so only prefix tokens are joined, with a check of sizes,
    and pairs are verified on whole sets.
    """
    t = cut(title_tokens(notes).filter("size(t) > 0"))
    each = t.select("vault", "ord", F.size("t").alias("n"), F.explode("t").alias("x"))
    counts = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = join_by_key(each, counts, ["x"], "inner", hot_keys(counts, ["x"], "df")).selectExpr("vault", "ord", "n", "x", "row_number() over (partition by vault, ord order by df, x) as r")
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("vault", "ord", "n", "x")
    a, b = (prefix.select("vault", "x", F.col("ord").alias(f"ord_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    near = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9) & (F.col("ord_a") < F.col("ord_b"))
    pairs = a.join(b, ["vault", "x"]).filter(near).select("vault", "ord_a", "ord_b").distinct()
    side = lambda s: t.select(F.col("ord").alias(f"ord_{s}"), F.col("t").alias(f"t_{s}"), F.col("slug").alias(f"slug_{s}"))
    both = pairs.join(side("a"), "ord_a").join(side("b"), "ord_b").filter("slug_a <> slug_b")
    inter = F.size(F.array_intersect("t_a", "t_b"))
    return both.select("vault", "ord_a", "ord_b", (inter / (F.size("t_a") + F.size("t_b") - inter)).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def winners(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """(vault, ord_a, ord_b, winner, loser): the slug of the longer body, the lesser slug of equals."""
    side = lambda s: notes.select(F.col("ord").alias(f"ord_{s}"), F.col("slug").alias(f"s_{s}"), F.coalesce(F.length("body"), F.lit(0)).alias(f"l_{s}"))
    got = pairs.select("vault", "ord_a", "ord_b").join(side("a"), "ord_a").join(side("b"), "ord_b")
    a_wins = (F.col("l_a") > F.col("l_b")) | ((F.col("l_a") == F.col("l_b")) & (F.col("s_a") < F.col("s_b")))
    return got.select("vault", "ord_a", "ord_b", F.when(a_wins, F.col("s_a")).otherwise(F.col("s_b")).alias("winner"), F.when(a_wins, F.col("s_b")).otherwise(F.col("s_a")).alias("loser"))


def merges(won: DataFrame) -> DataFrame:
    """(vault, loser, winner): the last verdict per loser."""
    return won.groupBy("vault", "loser").agg(F.max_by("winner", F.struct("ord_a", "ord_b")).alias("winner"))


def apply_merges(notes: DataFrame, folded: DataFrame) -> DataFrame:
    """Notes under their merge's winning slug, with the old slug among the sorted aliases."""
    m = folded.select("vault", F.col("loser").alias("slug"), "winner")
    got = notes.join(m, ["vault", "slug"], "left")
    aliases = F.when(F.col("winner").isNotNull(), F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("slug")))).otherwise(F.col("aliases"))
    return got.select("ord", "vault", F.coalesce("winner", "slug").alias("slug"), aliases.alias("aliases"))


def match_files(slugs: DataFrame, files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(slug, source, score, ambiguous): the file whose name holds the largest share of a slug's tokens, if no other ties with it.

    Tokens are ranked rare first over slugs and files. A file that holds the
    share ``threshold`` of a slug's tokens holds one of its rarest tokens, as
    many as may be missing and one; only those meet file names, so a word
    common to all names pairs nothing, and whole sets are compared afterwards.
    Slugs that no file reaches still get the best share as their ``score``:
    they alone meet the distinct token sets of the files, by token.
    """
    toks = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) >= 3) & ~t.isin(*FILE_STOP))
    s = slugs.select("slug").distinct().withColumn("t", toks(F.col("slug")))
    f = files.select("name").distinct().withColumn("ft", F.array_distinct(toks(F.col("name"))))
    f_each = f.select("name", F.explode("ft").alias("x"))
    df = f_each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    each = s.select("slug", F.size("t").alias("n"), F.explode("t").alias("x")).groupBy("slug", "n", "x").agg(F.count(F.lit(1)).alias("k"))
    ranked = each.join(df, "x", "left").selectExpr("slug", "n", "x", "k", "sum(k) over (partition by slug order by coalesce(df, 0), x) - k as before")
    # tokens before this one may all be missing only while enough are left behind them
    prefix = ranked.filter((F.col("n") - F.col("before")) >= F.ceil(F.col("n") * threshold - 1e-9)).select("slug", "x")
    met = prefix.join(f_each, "x").select("slug", "name").distinct()
    held = F.size(F.filter("t", lambda x: F.array_contains("ft", x)))
    scored = met.join(s, "slug").join(f, "name").select("slug", "name", (held / F.size("t")).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("slug").agg(F.max(F.struct("score", "name")).alias("b"))
    ties = scored.join(best, "slug").filter(F.col("score") == F.col("b.score")).groupBy("slug").agg(F.count(F.lit(1)).alias("ties"))
    got = s.select("slug").join(best, "slug", "left").join(ties, "slug", "left")
    sets = f.select("ft").distinct().withColumn("id", F.xxhash64("ft")).select("id", F.explode("ft").alias("x"))
    below = each.join(best, "slug", "left_anti").join(sets, "x").groupBy("slug", "id").agg((F.sum("k") / F.max("n")).alias("share")).groupBy("slug").agg(F.max("share").alias("share"))
    got = got.join(below, "slug", "left")
    sure = F.col("ties") == 1
    return got.select("slug", F.when(sure, F.col("b.name")).alias("source"), F.round(F.coalesce("b.score", "share", F.lit(0.0)), 3).alias("score"), F.coalesce(F.col("ties") > 1, F.lit(False)).alias("ambiguous"))


def section_counts(notes: DataFrame) -> DataFrame:
    """(section, notes) for every section, also empty ones."""
    dim = notes.sparkSession.createDataFrame(list(SECTIONS.items()), "canonical_type string, section string")
    n = notes.groupBy("canonical_type").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "canonical_type", "left").select("section", F.coalesce("n", F.lit(0)).alias("notes"))


def unite(frames: list[DataFrame]) -> DataFrame:
    """All rows of several note tables, as from several books."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
