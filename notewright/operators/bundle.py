"""Markdown bundles: rendering notes to files, reading files, linting and scoring them.

A bundle is a table (bundle, rel, text): the name of the bundle, the file's
path in it, and its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, let, norm, squeeze, strip, text_lines
from ..session import cut
from .notes import SECTIONS, canonical_type

#: Reserved names, exempt types, categories and patterns of the file format.
RESERVED, EXEMPT, VERSION_KEY = ("index.md", "log.md"), ("source", "moc", "schema"), "okf_version"
LINK = r"\[[^\]]*\]\(([^)]+)\)"
DATE_HEADING = r"^#{2,3}\s+(\d{4}-\S*)\s*$"
CITATIONS = r"(?i)^#{1,6}\s+citations\b"
RELATED = r"(?i)^##\s+Related\b"
EXTERNAL = r"^(https?://|mailto:|#)"
MIN_COVERAGE, EPSILON = 0.8, 1e-9
#: Entries of a listing that one file holds; longer listings go on in ``index-2.md`` and so on.
PAGE = 10_000


# --- rendering ------------------------------------------------------------------


def yaml_scalar(c: Column) -> Column:
    """A double-quoted scalar with JSON escapes."""
    j = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    return F.substr(j, F.lit(6), F.length(j) - 6)


def section_of(type_: Column) -> Column:
    """Section of a note type, without regard to case; notes without a known type go to concepts."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), canonical_type(type_)), F.lit("concepts"))


def rendered(merged: DataFrame, links: DataFrame, titles: DataFrame, timestamp: str) -> DataFrame:
    """(bundle, rel, text) of merged notes: front matter, title, body, related links, numbered citations.

    ``links`` are (vault, src, dst), ``titles`` (source, source_title). Links
    to notes that are not in ``merged`` are left out; listings are sorted.
    """
    notes = merged.drop("related").withColumn("section", section_of(F.col("type")))
    index = notes.select("vault", F.col("slug").alias("dst"), F.col("title").alias("dt"), F.col("description").alias("dd"), F.col("section").alias("ds"))
    line = F.concat(F.lit("- ["), F.coalesce("dt", F.lit("")), F.lit("](/"), "ds", F.lit("/"), "dst", F.lit(".md) — "), F.coalesce("dd", F.lit("")))
    rel = links.join(index, ["vault", "dst"]).groupBy("vault", F.col("src").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("dst", line.alias("line")))).alias("related"))
    cited = notes.select("vault", "slug", F.posexplode("citations").alias("pos", "c")).select("vault", "slug", "pos", "c.*").join(titles, "source", "left")
    ref = F.when(F.col("folio").isNotNull(), F.format_string("[Ch %s, p.%s]", F.coalesce(F.col("chapter").cast("string"), F.lit("None")), F.col("folio"))).otherwise(F.format_string("[Ch %s]", F.coalesce(F.col("chapter").cast("string"), F.lit("None"))))
    cite = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), ref, F.lit(' "'), "quote", F.lit('" — ['), F.coalesce("source_title", "source"), F.lit("](/references/"), "source", F.lit(".md)"))
    cites = cited.groupBy("vault", "slug").agg(F.array_sort(F.collect_list(F.struct("pos", cite.alias("line")))).alias("cites"))
    got = notes.join(rel, ["vault", "slug"], "left").join(cites, ["vault", "slug"], "left")
    head = F.concat(
        F.array(F.lit("---"), F.concat(F.lit("type: "), "type"), F.concat(F.lit("title: "), yaml_scalar(F.col("title"))), F.concat(F.lit("description: "), yaml_scalar(F.col("description"))), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), F.lit(f"timestamp: {timestamp}")),
        F.when(F.col("merged"), F.array(F.lit(f"updated: {timestamp}"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("aliases") > 0, F.array(F.concat(F.lit("aliases: ["), F.array_join("aliases", ", "), F.lit("]")))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("confidence: "), F.coalesce("confidence", F.lit("medium"))), F.lit("contested: false"), F.concat(F.lit("status: "), F.coalesce("status", F.lit("established"))), F.lit("---")),
    )
    related = F.when(F.col("related").isNotNull(), F.concat(F.array(F.lit("## Related")), F.transform("related", lambda x: x["line"]), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    tail = F.concat(F.array(F.lit("# Citations")), F.coalesce(F.transform("cites", lambda x: x["line"]), F.array().cast("array<string>")))
    parts = F.concat(head, F.array(F.lit(""), F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.lit(""), strip(F.coalesce("body", F.lit(""))), F.lit("")), related, tail)
    text = F.concat(F.regexp_replace(F.array_join(parts, "\n"), r"\s+$", ""), F.lit("\n"))
    return got.select(F.col("vault").alias("bundle"), F.concat("section", F.lit("/"), "slug", F.lit(".md")).alias("rel"), text.alias("text"))


def heading_of(section: Column) -> Column:
    """A section's name as a heading: ``anti-patterns`` is Anti Patterns."""
    return F.initcap(F.replace(section, F.lit("-"), F.lit(" ")))


def paged(rows: DataFrame, keys: list[str], order: list[str], line: Column, page: int = PAGE) -> DataFrame:
    """(keys, page, lines) of ordered lines, at most ``page`` of them a row, so that no listing gathers as a whole."""
    numbered = rows.select(*keys, *order, line.alias("line")).selectExpr("*", f"row_number() over (partition by {', '.join(keys)} order by {', '.join(order)}, line) as n")
    item = F.struct("n", "line")
    per = numbered.groupBy(*keys, (F.floor((F.col("n") - 1) / page) + 1).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return per.select(*keys, "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def index_name(page: Column) -> Column:
    return F.when(page == 1, "index.md").otherwise(F.concat(F.lit("index-"), page.cast("string"), F.lit(".md")))


def section_indexes(merged: DataFrame, page: int = PAGE) -> DataFrame:
    """(bundle, rel, text) of one sorted listing per section, of the notes that :func:`rendered` writes there."""
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("](/"), "section", F.lit("/"), "slug", F.lit(".md) — "), F.coalesce("description", F.lit("")))
    per = paged(merged.withColumn("section", section_of(F.col("type"))), ["vault", "section"], ["slug"], line, page)
    text = F.concat(F.lit("# "), heading_of(F.col("section")), F.lit("\n\n"), "lines", F.lit("\n"))
    return per.select(F.col("vault").alias("bundle"), F.concat("section", F.lit("/"), index_name(F.col("page"))).alias("rel"), text.alias("text"))


# --- reading ----------------------------------------------------------------------


def front_matter(text: Column) -> Column:
    """ARRAY<STRUCT<k, v>> of a leading ``---`` block, in order; null without one or if it is not closed."""

    def body(ls: Column) -> Column:
        rest = F.slice(ls, F.lit(2), F.greatest(F.lit(0), F.size(ls) - 1))
        end = F.array_position(F.transform(rest, lambda x: strip(x) == "---"), True).cast("int")
        keep = F.filter(F.slice(rest, F.lit(1), F.greatest(F.lit(0), end - 1)), lambda x: (x != "") & ~x.rlike(r"^\s") & F.contains(x, F.lit(":")))
        pair = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(strip(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("v"))
        return F.when((F.size(ls) > 0) & (strip(F.try_element_at(ls, F.lit(1))) == "---") & (end > 0), F.transform(keep, pair))

    return let(text_lines(text), body)


def field(entries: Column, key: str) -> Column:
    """The last value of a key."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def parsed(bundle: DataFrame) -> DataFrame:
    """Adds name, fields, note_type, reserved and atomic."""
    name = F.regexp_extract("rel", "[^/]*$", 0)
    got = bundle.withColumn("name", name).withColumn("fields", front_matter(F.col("text")))
    got = got.withColumn("note_type", F.coalesce(strip(field(F.col("fields"), "type")), F.lit(""))).withColumn("reserved", F.col("name").isin(*RESERVED))
    return got.withColumn("atomic", ~F.col("reserved") & (F.col("note_type") != "") & ~F.lower("note_type").isin(*EXEMPT))


def is_cited(text: Column) -> Column:
    """A citations heading, and after it a line with a chapter reference."""

    def body(ls: Column) -> Column:
        heads = F.transform(ls, lambda x: x.rlike(CITATIONS))
        first = F.array_position(heads, True).cast("int")
        after = F.slice(ls, F.greatest(F.lit(1), first), F.size(ls))
        return (first > 0) & F.exists(after, lambda x: x.rlike(r"\[Ch\b") & ~x.rlike(CITATIONS))

    return F.coalesce(let(text_lines(text), body), F.lit(False))


def resolve(rel: Column, target: Column) -> Column:
    """Path of a link target inside the bundle, from its root (``/``) or the file's folder; null if it leaves the bundle."""
    joined = F.when(target.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(F.concat(F.regexp_replace(rel, "[^/]*$", ""), target))

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.lit(None).cast("array<string>"))
        return F.when((x == "") | (x == "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def links(bundle: DataFrame) -> DataFrame:
    """(bundle, rel, line_no, target, path) of every link to an .md file, with 1-based lines; repeated links stay."""
    rows = bundle.select("bundle", "rel", F.posexplode(text_lines(F.col("text"))).alias("i", "line")).filter(F.contains(F.col("line"), F.lit("](")))
    each = rows.select("bundle", "rel", (F.col("i") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(LINK), 1)).alias("raw"))
    first = F.regexp_extract(strip(F.col("raw")), r"^\S+", 0)
    target = F.regexp_replace(first, "#.*$", "")
    got = each.withColumn("target", target).filter(~first.rlike(EXTERNAL) & target.endswith(".md"))
    return got.select("bundle", "rel", "line_no", "target", resolve(F.col("rel"), F.col("target")).alias("path"))


def dangling(bundle: DataFrame) -> DataFrame:
    """Links whose path is no file of the bundle."""
    files = bundle.select("bundle", F.col("rel").alias("path")).distinct()
    return links(bundle).join(files, ["bundle", "path"], "left_anti")


def related_lines(bundle: DataFrame) -> DataFrame:
    """(bundle, rel, line_no) of the lines of ``## Related`` sections, up to the next first- or second-level heading."""
    rows = bundle.select("bundle", "rel", F.posexplode(text_lines(F.col("text"))).alias("i", "line"))
    mark = rows.select("bundle", "rel", (F.col("i") + 1).alias("line_no"), F.when(F.col("line").rlike(r"^#{1,2}\s"), F.col("line").rlike(RELATED)).alias("open"))
    state = mark.selectExpr("*", "last(open, true) over (partition by bundle, rel order by line_no) as inside")
    return state.filter("inside and open is null").select("bundle", "rel", "line_no")


def related_targets(bundle: DataFrame) -> DataFrame:
    """(bundle, rel, line_no, path) of existing files linked from the related section of atomic notes."""
    notes = parsed(bundle).filter("atomic").select("bundle", "rel", "text")
    files = bundle.select("bundle", F.col("rel").alias("path")).distinct()
    return links(notes).join(related_lines(notes), ["bundle", "rel", "line_no"]).join(files, ["bundle", "path"], "left_semi").select("bundle", "rel", "line_no", "path")


def note_parts(bundle: DataFrame) -> DataFrame:
    """(bundle, rel, title, body, quotes) of every file: its first first-level heading, the text up to the next heading, and the first quoted passage of each line under a citations heading."""
    rows = bundle.select("bundle", "rel", F.posexplode(text_lines(F.col("text"))).alias("n", "line"))
    top = F.regexp_extract("line", r"^#\s+(.+)$", 1)
    rows = rows.withColumn("h1", F.when(top != "", F.col("n"))).selectExpr("*", "min(h1) over (partition by bundle, rel) as first")
    mark = F.when(F.col("n") == F.col("first"), "body").when(F.col("line").rlike(r"^#{1,6}\s"), F.when(F.col("line").rlike(CITATIONS), "citations").otherwise(""))
    state = rows.withColumn("mark", mark).selectExpr("*", "last(mark, true) over (partition by bundle, rel order by n) as part")
    held = F.col("mark").isNull()
    quote = F.regexp_extract("line", '"([^"]+)"', 1)
    per = state.groupBy("bundle", "rel").agg(
        F.coalesce(F.max(F.when(F.col("n") == F.col("first"), strip(top))), F.lit("")).alias("title"),
        F.array_sort(F.collect_list(F.when(held & (F.col("part") == "body"), F.struct("n", "line")))).alias("b"),
        F.array_sort(F.collect_list(F.when(held & (F.col("part") == "citations") & (quote != ""), F.struct("n", quote.alias("q"))))).alias("q"),
    )
    return per.select("bundle", "rel", "title", strip(F.array_join(F.transform("b", lambda x: x["line"]), "\n")).alias("body"), F.transform("q", lambda x: x["q"]).alias("quotes"))


# --- lint -------------------------------------------------------------------------


def _finding(df: DataFrame, level: Column | str, line: Column, category: str, message: Column) -> DataFrame:
    level = F.lit(level) if isinstance(level, str) else level
    return df.select("bundle", level.alias("level"), F.col("rel").alias("path"), line.cast("int").alias("line"), F.lit(category).alias("category"), message.alias("message"))


def coverage(bundle: DataFrame) -> DataFrame:
    """(bundle, atomic, cited, coverage): share of atomic notes with a grounded citation, 1 without any."""
    p = parsed(bundle)
    per = p.groupBy("bundle").agg(F.count_if("atomic").alias("atomic"), F.count_if(F.col("atomic") & is_cited(F.col("text"))).alias("cited"))
    return per.withColumn("coverage", F.when(F.col("atomic") > 0, F.col("cited") / F.col("atomic")).otherwise(1.0))


def _facts(bundle: DataFrame) -> DataFrame:
    """What lint asks of every file, from one pass over its lines and without its text; written to the shared folder."""
    first = lambda raw: F.regexp_extract(strip(raw), r"^\S+", 0)
    target = lambda raw: F.regexp_replace(first(raw), "#.*$", "")

    def of(ls: Column) -> Column:
        heads = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.rlike(r"^#{1,2}\s").alias("head"), x.rlike(RELATED).alias("related"))), lambda h: h["head"])

        def with_heads(hs: Column) -> Column:
            def line(x: Column, i: Column) -> Column:
                inside = ~x.rlike(r"^#{1,2}\s") & F.coalesce(F.try_element_at(F.filter(hs, lambda h: h["i"] < i), F.lit(-1))["related"], F.lit(False))
                raws = F.filter(F.regexp_extract_all(x, F.lit(LINK), 1), lambda r: ~first(r).rlike(EXTERNAL) & target(r).endswith(".md"))
                return F.when(F.contains(x, F.lit("](")), F.transform(raws, lambda r: F.struct((i + 1).alias("line_no"), target(r).alias("target"), resolve(F.col("rel"), target(r)).alias("path"), inside.alias("related"))))

            dates = F.filter(F.transform(ls, lambda x, i: F.struct((i + 1).alias("n"), F.regexp_extract(x, DATE_HEADING, 1).alias("d"))), lambda d: d["d"] != "")
            return F.struct(F.flatten(F.array_compact(F.transform(ls, line))).alias("links"), F.when(F.col("name") == "log.md", dates).alias("dates"), (strip(F.try_element_at(ls, F.lit(1))) == "---").alias("opens"), F.exists(ls, lambda x: x.rlike(CITATIONS)).alias("section"))

        return let(heads, with_heads)

    only_version = F.coalesce((F.col("rel") == "index.md") & (F.array_distinct(F.transform("fields", lambda e: e["k"])) == F.array(F.lit(VERSION_KEY))), F.lit(False))
    p = parsed(bundle).withColumn("f", let(text_lines(F.coalesce("text", F.lit(""))), of))
    facts = p.select("bundle", "rel", "name", "note_type", "reserved", "atomic", "f.links", "f.dates", (F.col("f.section") & ~F.col("reserved")).alias("section"), (F.col("atomic") & is_cited(F.col("text"))).alias("cited"), ((F.col("name") == "index.md") & F.col("f.opens") & ~only_version).alias("fronted"))
    return cut(facts)


def _covered(facts: DataFrame) -> DataFrame:
    per = facts.groupBy("bundle").agg(F.count_if("atomic").alias("atomic"), F.count_if("cited").alias("cited"))
    return per.withColumn("coverage", F.when(F.col("atomic") > 0, F.col("cited") / F.col("atomic")).otherwise(1.0))


def lint(bundle: DataFrame, allow_dangling: bool = False, min_coverage: float = MIN_COVERAGE, strict_links: bool = False) -> DataFrame:
    """All findings of bundles: (bundle, level, path, line, category, message)."""
    return _findings(_facts(bundle), allow_dangling, min_coverage, strict_links)


def _findings(p: DataFrame, allow_dangling: bool = False, min_coverage: float = MIN_COVERAGE, strict_links: bool = False) -> DataFrame:
    none = F.lit(None)
    missing = _finding(p.filter("not reserved and note_type = ''"), "error", F.lit(1), "missing-type", F.lit("the front matter names no type"))
    reserved = _finding(p.filter("fronted"), "error", F.lit(1), "reserved-file", F.lit("a listing file has front matter; the root's own may have the version key alone"))
    dated = p.select("bundle", "rel", F.explode("dates").alias("x")).select("bundle", "rel", "x.*").withColumn("day", F.when(F.col("d").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("d", "yyyy-MM-dd")))
    bad = _finding(dated.filter("day is null"), "error", F.col("n"), "log-format", F.concat(F.lit("no such day: "), "d"))
    order = dated.filter("day is not null").selectExpr("*", "lag(day) over (partition by bundle, rel order by n) as before").filter("day > before")
    order = _finding(order, "error", F.col("n"), "log-format", F.format_string("%s stands below the older %s", F.col("day").cast("string"), F.col("before").cast("string")))
    # the kind of file each link leads to, if any
    kinds = p.groupBy("bundle", F.col("rel").alias("path")).agg(F.max("atomic").alias("to_note"))
    led = p.select("bundle", "rel", "atomic", F.explode("links").alias("x")).select("bundle", "rel", "atomic", "x.*").join(kinds, ["bundle", "path"], "left")
    loose = _finding(led.filter("to_note is null"), "warning" if allow_dangling else "error", F.col("line_no"), "dangling-link", F.concat(F.lit("leads nowhere: "), "target"))
    uncited = _finding(p.filter("atomic and not cited"), "error", none, "coverage", F.lit("cites no chapter"))
    low = _covered(p).filter((F.col("atomic") > 0) & (F.col("coverage") < min_coverage - EPSILON)).withColumn("rel", F.lit("."))
    gate = _finding(low, "error", none, "coverage", F.format_string("%d of %d notes cite a chapter, too few", F.col("cited"), F.col("atomic")))
    t = led.filter("atomic and related and to_note is not null").select("bundle", "rel", "line_no", "path", "to_note")
    edges = t.select("bundle", F.col("rel").alias("path"), F.col("path").alias("rel")).distinct()
    back = _finding(t.filter("to_note").join(edges, ["bundle", "rel", "path"], "left_anti"), "error" if strict_links else "warning", F.col("line_no"), "reciprocity", F.concat(F.lit("no link back from "), "path"))
    out = missing
    for f in (reserved, bad, order, loose, uncited, gate, back):
        out = out.unionByName(f)
    return out


def lint_summary(bundle: DataFrame, **options) -> DataFrame:
    """One row per bundle: files, notes, notes with a citations section, atomic, cited, dangling links, links without one back, errors and warnings."""
    p = _facts(bundle)
    per = p.groupBy("bundle").agg(F.count(F.lit(1)).alias("md_files"), F.count_if(~F.col("reserved")).alias("concept_notes"), F.count_if("section").alias("with_citations"), F.count_if("atomic").alias("atomic"), F.count_if("cited").alias("cited"))
    found = _findings(p, **options).groupBy("bundle").agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"),
        F.count_if(F.col("category") == "dangling-link").alias("dangling"), F.count_if(F.col("category") == "reciprocity").alias("one_way"),
    )
    return per.join(found, "bundle", "left").na.fill(0, ["errors", "warnings", "dangling", "one_way"])


# --- scoring ----------------------------------------------------------------------


def bundle_notes(bundle: DataFrame) -> DataFrame:
    """(bundle, rel, slug, keys, text) of atomic notes; :func:`note_parts` gives title, body and quotes."""
    p = parsed(bundle).filter("atomic and fields is not null")
    slug = F.regexp_replace("name", r"\.[^.]*$", "")
    inner = F.regexp_replace(strip(F.coalesce(field(F.col("fields"), "aliases"), F.lit(""))), r"^[\[\]]+|[\[\]]+$", "")
    aliases = F.filter(F.transform(F.split(inner, ","), strip), lambda x: x != "")
    return p.select("bundle", "rel", slug.alias("slug"), F.array_distinct(F.transform(F.concat(F.array(slug), aliases), norm)).alias("keys"), "text")


def match_gold(notes: DataFrame, gold: DataFrame) -> DataFrame:
    """(bundle, concept, slug): the note of each gold concept, by its first key that names one, and that key's first note; slug null without one.

    ``gold`` is (bundle, concept, keys), or rows (bundle, concept, p, k) with the keys k in the order of p.
    """
    rows = gold.select("bundle", "concept", F.posexplode("keys").alias("p", "k")) if "keys" in gold.columns else gold
    g = rows.select("bundle", "concept", "p", norm(F.col("k")).alias("key"))
    n = notes.select("bundle", "slug", F.col("rel"), F.explode("keys").alias("key")).groupBy("bundle", "key").agg(F.min_by("slug", "rel").alias("slug"))
    hit = g.join(n, ["bundle", "key"]).groupBy("bundle", "concept").agg(F.min_by("slug", "p").alias("slug"))
    return gold.select("bundle", "concept").distinct().join(hit, ["bundle", "concept"], "left")


def ratio(found: Column, total: Column) -> Column:
    """Share of found ones; 1 of none."""
    return F.when(total > 0, found / total).otherwise(1.0)


def concept_recall(matched: DataFrame) -> DataFrame:
    return matched.groupBy("bundle").agg(F.count("slug").alias("found"), F.count(F.lit(1)).alias("concepts")).withColumn("recall", ratio(F.col("found"), F.col("concepts")))


def link_recall(matched: DataFrame, gold_links: DataFrame, edges: DataFrame) -> DataFrame:
    """Per bundle: gold links (bundle, a, b) whose two notes are linked in either direction."""
    ends = gold_links
    for c in ("a", "b"):
        ends = ends.join(matched.select("bundle", F.col("concept").alias(c), F.col("slug").alias(f"{c}_slug")), ["bundle", c], "left")
    both = edges.select("bundle", "src", "dst").unionByName(edges.select("bundle", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("hit", F.lit(1))
    got = ends.join(both.toDF("bundle", "a_slug", "b_slug", "hit"), ["bundle", "a_slug", "b_slug"], "left")
    return got.groupBy("bundle").agg(F.count("hit").alias("linked"), F.count(F.lit(1)).alias("links")).withColumn("recall", ratio(F.col("linked"), F.col("links")))


def fact_coverage(matched: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Per bundle: facts (bundle, concept, anchor) whose anchor stands in the note of their concept (texts: bundle, slug, text), both in the comparison form; blank anchors ask nothing."""
    asked = facts.filter(F.coalesce(strip(F.col("anchor")), F.lit("")) != "").join(matched, ["bundle", "concept"], "left").join(texts.select("bundle", "slug", "text"), ["bundle", "slug"], "left")
    hit = F.contains(squeeze(folded(F.col("text"))), squeeze(folded(F.col("anchor"))))
    per = asked.withColumn("hit", F.coalesce(hit, F.lit(False))).groupBy("bundle").agg(F.count_if("hit").alias("found"), F.count(F.lit(1)).alias("facts"))
    return per.withColumn("coverage", ratio(F.col("found"), F.col("facts")))
