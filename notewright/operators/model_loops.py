"""Work around a model: prompts, replies, verdicts, resumable runs and loops until nothing new comes.

The model is a function from a column of prompts to a column
STRUCT<text STRING, cost_usd DOUBLE, error STRING> that the caller passes to
:func:`ask`; nothing here calls out by itself, and :func:`echo_model` answers
offline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip, token_set
from ..session import cut, drop_cut

VERDICTS = ("supported", "overreach", "unsupported")


def json_body(reply: Column) -> Column:
    """The JSON of a reply: without a fence, from the first brace to the last."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), "^```(json)?", ""), "```$", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def parse_same(reply: Column) -> Column:
    """``same`` of a reply; false if it isn't clear."""
    return F.coalesce(F.get_json_object(json_body(reply), "$.same") == "true", F.lit(False))


def parse_verdicts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(slug, verdict, reason): the last verdict a slug gets in a reply; unknown ones are ``unsupported``."""
    items = F.from_json(F.get_json_object(json_body(F.col(reply)), "$.verdicts"), "array<struct<slug string, verdict string, reason string>>")
    rows = replies.select("reply_id", F.posexplode(items).alias("pos", "v")).select("reply_id", "pos", "v.*")
    status = F.lower(strip(F.coalesce("verdict", F.lit(""))))
    rows = rows.select("slug", F.struct("reply_id", "pos").alias("at"), F.when(status.isin(*VERDICTS), status).otherwise("unsupported").alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"))
    return rows.groupBy("slug").agg(F.max_by("verdict", "at").alias("verdict"), F.max_by("reason", "at").alias("reason"))


def offline_verdict(body: Column, quotes: Column) -> Column:
    """By the share of the body's tokens found in the quotes: 0.8 supports it, 0.5 is overreach."""
    t = token_set(F.coalesce(body, F.lit("")))
    share = F.size(F.array_intersect(t, token_set(F.array_join(quotes, " ")))) / F.greatest(F.size(t), F.lit(1))
    return F.when(share >= 0.8, "supported").when(share >= 0.5, "overreach").otherwise("unsupported")


def tally(expected: DataFrame, verdicts: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """Verdicts of all expected notes per ``by`` (else the first key); a missing one counts as unsupported."""
    got = expected.join(verdicts, keys, "left").withColumn("verdict", F.coalesce("verdict", F.lit("unsupported")))
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    per = got.groupBy(by or keys[0]).agg(F.count(F.lit(1)).alias("total"), *counts)
    return per.withColumn("faithfulness", F.when(F.col("total") > 0, F.col("supported") / F.col("total")).otherwise(1.0))


#: Notes a part of a vault holds in about; only within a part are notes numbered one after the other.
PART = 10_000
#: Characters of an error and of a quote, and entries of a list, that a report shows.
SHOWN_ERROR, SHOWN_QUOTE, SHOWN_ITEMS = 200, 60, 12

Model = Callable[[Column], Column]


def ask(df: DataFrame, prompt: Column, model: Model) -> DataFrame:
    """Adds reply, cost_usd and error; a reply with an error counts as none, its cost as spent."""
    got = df.withColumn("_a", model(prompt))
    failed = F.coalesce(F.col("_a.error"), F.lit("")) != ""
    return got.select(*df.columns, F.when(~failed, F.col("_a.text")).alias("reply"), F.coalesce(F.col("_a.cost_usd"), F.lit(0.0)).alias("cost_usd"), F.when(failed, F.left(F.col("_a.error"), F.lit(SHOWN_ERROR))).alias("error"))


def echo_model(reply: Callable[[Column], Column], cost: float = 0.0) -> Model:
    """An offline model whose text is an expression of the prompt."""
    return lambda prompt: F.struct(reply(prompt).alias("text"), F.lit(cost).alias("cost_usd"), F.lit(None).cast("string").alias("error"))


# --- prompts: the data in marked blocks, the form of the answer last ---


def _asking(task: str, blocks: Column, answer: str) -> Column:
    return F.concat(F.lit(task + "\n\n"), blocks, F.lit("\n\nAnswer with this JSON and nothing else: " + answer))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def note_prompt(text: Column, source: Column, chapter: Column) -> Column:
    """Asks for the notes of a chunk."""
    block = F.concat(F.lit("<source>"), _text(source), F.lit("</source>\n<chapter>"), _text(chapter), F.lit("</chapter>\n<passage>\n"), _text(text), F.lit("\n</passage>"))
    return _asking("Write one note for each idea of the passage. Quote the passage word by word for every claim.", block,
                   '{"notes": [{"type": "", "slug": "", "title": "", "description": "", "body": "", "citations": [{"chapter": 0, "quote": "", "source": ""}]}]}')


def gap_prompt(text: Column, known: Column) -> Column:
    """Asks for what the notes known so far (an array of slugs) leave out of a chunk."""
    block = F.concat(F.lit("<known>"), F.array_join(F.array_sort(known), " "), F.lit("</known>\n<passage>\n"), _text(text), F.lit("\n</passage>"))
    return _asking("Name the ideas of the passage that no known note covers; none is a good answer.", block, '{"notes": []}')


def same_prompt(title_a: Column, about_a: Column, title_b: Column, about_b: Column) -> Column:
    """Asks whether two notes are about one thing."""
    block = F.concat(F.lit("<one>"), _text(title_a), F.lit(": "), _text(about_a), F.lit("</one>\n<other>"), _text(title_b), F.lit(": "), _text(about_b), F.lit("</other>"))
    return _asking("Are these two notes about the very same thing?", block, '{"same": true}')


def judge_batches(notes: DataFrame, size: int = 10, part: int = PART) -> DataFrame:
    """(vault, part, batch, ords, prompt): notes in groups of ``size``, numbered within parts of a vault of about ``part`` notes each."""
    per = notes.groupBy("vault").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    with_parts = notes.join(per.select(F.col("vault").alias("_v"), "parts"), F.col("vault").eqNullSafe(F.col("_v"))).drop("_v")
    rows = with_parts.withColumn("part", F.pmod("ord", F.col("parts"))).selectExpr("*", f"cast(floor((row_number() over (partition by vault, part order by ord) - 1) / {size}) as int) as batch")
    quotes = F.transform(F.coalesce("citations", F.array().cast("array<struct<chapter:int,quote:string,source:string>>")), lambda c: F.concat(F.lit("<quote>"), _text(c["quote"]), F.lit("</quote>")))
    block = F.concat(F.lit('<note slug="'), _text(F.col("slug")), F.lit('">\n'), _text(F.col("title")), F.lit("\n"), _text(F.col("body")), F.lit("\n"), F.array_join(quotes, "\n"), F.lit("\n</note>"))
    grouped = rows.select("vault", "part", "batch", F.struct("ord", block.alias("b")).alias("x")).groupBy("vault", "part", "batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    prompt = _asking("Compare every note with its quotes: are they enough for all it says (supported), for most of it (overreach), or not for its core (unsupported)?",
                     F.array_join(F.transform("x", lambda x: x["b"]), "\n"), '{"verdicts": [{"slug": "", "verdict": "", "reason": ""}]}')
    return grouped.select("vault", "part", "batch", F.transform("x", lambda x: x["ord"]).alias("ords"), prompt.alias("prompt"))


def verify(notes: DataFrame, model: Model, size: int = 10, floor: float = 0.0) -> DataFrame:
    """Per vault: verdicts of all notes, their cost, and whether the vault passes (none unsupported, faithfulness of at least ``floor``).

    A note that no reply names counts as unsupported; within a batch a slug's
    last verdict holds.
    """
    asked = ask(judge_batches(notes, size), F.col("prompt"), model).withColumn("reply_id", F.concat_ws("/", F.coalesce("vault", F.lit("")), "part", "batch"))
    asked = cut(asked.select("vault", "reply_id", "ords", "reply", "cost_usd"))
    items = F.from_json(F.get_json_object(json_body(F.col("reply")), "$.verdicts"), "array<struct<slug string, verdict string>>")
    said = asked.select("reply_id", F.posexplode(items).alias("pos", "v")).select("reply_id", F.col("v.slug").alias("slug"), F.struct("pos", F.lower(strip(F.col("v.verdict"))).alias("v")).alias("p"))
    last = said.groupBy("reply_id", "slug").agg(F.max("p").alias("p")).select("reply_id", "slug", F.when(F.col("p.v").isin(*VERDICTS), F.col("p.v")).otherwise("unsupported").alias("verdict"))
    expected = asked.select("vault", "reply_id", F.explode("ords").alias("ord")).join(notes.select("ord", "slug"), "ord")
    per = tally(expected, last, ["reply_id", "slug"], by="vault")
    cost = asked.groupBy(F.col("vault").alias("_v")).agg(F.sum("cost_usd").alias("cost_usd"))
    got = per.join(cost, F.col("vault").eqNullSafe(F.col("_v"))).drop("_v")
    return got.withColumn("ok", (F.col("unsupported") == 0) & (F.col("faithfulness") >= floor))


def notes_of(reply: Column) -> Column:
    """ARRAY of the notes in a reply: an object with ``notes``, or a bare list."""
    kind = "array<struct<type string, slug string, title string, description string, body string, citations array<struct<chapter int, quote string, source string>>>>"
    bare = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.get_json_object(json_body(reply), "$.notes"), kind), F.from_json(F.when(strip(F.regexp_replace(strip(reply), "^```(json)?", "")).startswith("["), bare), kind), F.array().cast(kind))


def build(chunks: DataFrame, model: Model, default_source: str | None = None) -> DataFrame:
    """(id, notes, cost_usd, error) of chunks (id, source, chapter, text); a chunk without a source belongs to the default one."""
    source = F.coalesce(blank_to_null(F.col("source")), F.lit(default_source))
    asked = ask(chunks.withColumn("source", source), note_prompt(F.col("text"), F.col("source"), F.col("chapter")), model)
    return asked.select("id", notes_of(F.coalesce("reply", F.lit(""))).alias("notes"), "cost_usd", "error")


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Per group (or one row): chunks done and failed, notes, cost, and the first failures in order of id, shortened."""
    shown = F.slice(F.array_sort(F.collect_list(F.when(F.col("_k") <= SHOWN_ITEMS, F.struct("id", "error")))), 1, SHOWN_ITEMS)
    part = f"partition by {', '.join(by)}, error is null" if by else "partition by error is null"
    # failures alone are numbered
    failed = results.filter("error is not null").selectExpr("*", f"row_number() over ({part} order by id) as _k")
    rows = results.filter("error is null").withColumn("_k", F.lit(None).cast("int")).unionByName(failed)
    return rows.groupBy(*by).agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("notes"))), F.lit(0)).alias("notes"),
                                 F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.transform(shown, lambda x: F.concat(x["id"].cast("string"), F.lit(": "), x["error"])).alias("failures"))


def cover(chunks: DataFrame, known: DataFrame, model: Model, max_rounds: int = 3) -> tuple[DataFrame, float]:
    """(new notes (id, slug), cost): every chunk is asked for what is missing until it brings nothing new, at most ``max_rounds`` times.

    A chunk that is dry is not asked again. What one round brings is known to
    the next; of equal slugs in one round the least id's counts. ``known`` is
    (id, slug): the notes already built from each chunk.
    """
    have, todo, found, cost = known.select("id", "slug"), chunks.select("id", "text"), None, 0.0
    for _ in range(max_rounds):
        per = have.groupBy("id").agg(F.collect_set("slug").alias("k"))  # as many as a chunk has notes
        asked = cut(ask(todo.join(per, "id", "left"), gap_prompt(F.col("text"), F.coalesce("k", F.array().cast("array<string>"))), model))
        cost += asked.agg(F.sum("cost_usd")).first()[0] or 0.0
        said = asked.select("id", F.explode(notes_of(F.coalesce("reply", F.lit("")))).alias("n")).select("id", F.col("n.slug").alias("slug")).filter("slug is not null and slug <> ''")
        fresh = cut(said.groupBy("slug").agg(F.min("id").alias("id")).join(have.select("slug").distinct(), "slug", "left_anti").select("id", "slug"))
        drop_cut(asked)
        if not fresh.head(1):
            break
        found = fresh if found is None else found.unionByName(fresh)
        have = have.unionByName(fresh)
        todo = todo.join(fresh.select("id").distinct(), "id", "left_semi")
    return (found if found is not None else fresh), cost


def arbitrate(pairs: DataFrame, notes: DataFrame, model: Model) -> DataFrame:
    """Pairs (vault, ord_a, ord_b) whose notes a model calls the same, with the cost of asking."""
    side = lambda s: notes.select(F.col("ord").alias(f"ord_{s}"), F.col("title").alias(f"t_{s}"), F.col("description").alias(f"d_{s}"))
    both = pairs.select("vault", "ord_a", "ord_b").join(side("a"), "ord_a").join(side("b"), "ord_b")
    asked = ask(both, same_prompt(F.col("t_a"), F.col("d_a"), F.col("t_b"), F.col("d_b")), model)
    return asked.filter(parse_same(F.coalesce("reply", F.lit("")))).select("vault", "ord_a", "ord_b", "cost_usd")


def pending(plan: DataFrame, journal: DataFrame, limit: int | None = None) -> DataFrame:
    """Planned rows whose id is not in the journal, in order of id up to ``limit``."""
    left = plan.join(journal.select("id").distinct(), "id", "left_anti")
    return left if limit is None else left.orderBy("id").limit(limit)


def next_ids(plan: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """New plan rows with ids after the largest one."""
    start = plan.agg(F.max("id")).first()[0]
    start = -1 if start is None else start
    # ids follow the order; ranges are numbered apart and offset by the sizes before them
    n = int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = cut(fresh.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in part.groupBy("_p").count().collect()}  # one row a range
    before, at = [], start + 1
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    off = F.broadcast(part.sparkSession.createDataFrame(before, "_p int, _o long"))
    return part.join(off, "_p").withColumn("id", (F.col("_o") + F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)).cast("int")).drop("_p", "_o", "_i")


def until_dry(known: DataFrame, propose: Callable[[DataFrame, int], DataFrame], keys: list[str], max_rounds: int = 3) -> tuple[DataFrame, int]:
    """All rows that ``propose(known so far, round)`` brings before a round brings nothing new, and the number of rounds."""
    have, found, rounds = known.select(*keys).distinct(), None, 0
    for rounds in range(1, max_rounds + 1):
        fresh = cut(propose(have, rounds).dropDuplicates(keys).join(have, keys, "left_anti"))
        if not fresh.head(1):
            break
        found = fresh if found is None else found.unionByName(fresh)
        have = cut(have.unionByName(fresh.select(*keys)))
    return (found if found is not None else fresh), rounds


def cost_estimate(df: DataFrame, by: str, words: str = "words", chapters: str = "chapters") -> DataFrame:
    """Tokens a full run reads and writes, per group: input 1.3 a word, output 1000 a chapter and 8500 once."""
    return df.groupBy(by).agg((F.sum(words) * 1.3).alias("input_tokens"), (F.sum(chapters) * 1000 + 8500).alias("output_tokens"))
