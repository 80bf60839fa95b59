"""Where content comes from: extraction metadata, figures, archived sources, and gates on what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, name_key, strip
from .books import metrics, remap_citations, structure
from .notes import match_files

#: Reading methods whose page breaks tell physical pages; formats' names of their units.
PAGED_METHODS = ("pdftotext", "pypdf", "pdfminer")
UNIT = {"pdf": "pages", "epub": "spine_items"}


def recorded_mode(fmt: Column, requested: Column, method: Column) -> Column:
    """``technical`` only for a PDF that a layout-aware reader read; one that fell back is ``text``."""
    return F.when((fmt == "pdf") & (requested == "technical") & (method != "docling"), "text").otherwise(requested)


def metadata(extracted: DataFrame, sizes: DataFrame, requested: str = "text") -> DataFrame:
    """One row per read file (path, format, sha256, text, method, units) with its counts, structure and recorded mode; sizes are (path, length).

    Files without text are left out. ``unit`` names what ``units`` counts.
    """
    ok = extracted.filter("text is not null")
    found = structure(ok.select(F.col("path").alias("slug"), F.col("text").alias("raw")))
    got = metrics(ok).join(found.withColumnRenamed("id", "path"), "path").join(sizes.select("path", "length"), "path", "left")
    unit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT.items() for x in kv]), F.col("format")), F.lit("sections"))
    return got.select(
        "path", F.regexp_extract("path", "[^/]*$", 0).alias("filename"), "format", F.col("method").alias("extraction_method"), recorded_mode(F.col("format"), F.lit(requested), F.col("method")).alias("extraction_mode"),
        "sha256", F.round(F.col("length") / (1024 * 1024), 2).alias("file_size_mb"), unit.alias("unit"), "units", "chars", "words", "estimated_tokens", "estimated_tokens_human",
        F.col("chapters").alias("chapters_detected"), F.col("sample").alias("chapter_headings_sample"), "has_toc",
    )


def figures(documents: DataFrame) -> DataFrame:
    """(doc_id, page, caption, kind) of pictures with a caption: page of the first place (0 without), kind of the first class, else the first annotation's.

    ``pictures`` is ARRAY<STRUCT<caption, prov: ARRAY<STRUCT<page_no>>, classes: ARRAY<STRING>, annotations: ARRAY<STRING>>>.
    """
    p = documents.select("doc_id", F.posexplode("pictures").alias("pos", "p")).filter(F.coalesce(strip(F.col("p.caption")), F.lit("")) != "")
    page = F.coalesce(F.try_element_at("p.prov", F.lit(1))["page_no"], F.lit(0))
    kind = F.coalesce(F.try_element_at("p.classes", F.lit(1)), F.try_element_at("p.annotations", F.lit(1)))
    return p.select("doc_id", "pos", page.alias("page"), strip(F.col("p.caption")).alias("caption"), kind.alias("kind"))


def upsert(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` whose key is not in ``fresh``, and all of ``fresh``."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def backfill(slugs: DataFrame, manifests: DataFrame, files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Matches of files to slugs that have no manifest yet (a dry run: nothing is written)."""
    return match_files(slugs.join(manifests.select("slug").distinct(), "slug", "left_anti"), files, threshold)


def remap_files(files: DataFrame, offsets: DataFrame, key: str = "bundle") -> DataFrame:
    """Files (key, rel, text) with printed pages in their citations by (key, page_offset), and how many citations changed."""
    got = files.join(offsets.select(key, "page_offset"), key, "left")
    new = got.withColumn("new", remap_citations(F.col("text"), F.col("page_offset")))
    pages = F.aggregate(F.transform(F.regexp_extract_all("text", F.lit(r"\[Ch[^\]]*\]"), 0), lambda b: F.when(F.col("page_offset").isNull() & F.contains(b, F.lit("(pdf)")), 0).otherwise(F.regexp_count(b, F.lit(r"p\.\d")))), F.lit(0), lambda a, x: a + x)
    return new.select(key, "rel", F.col("new").alias("text"), pages.alias("changed"))


def contested(notes: DataFrame) -> DataFrame:
    """(vault, key, contested): whether notes of one name key disagree in status."""
    return notes.select("vault", name_key(F.col("slug")).alias("key"), "status").filter("key <> ''").groupBy("vault", "key").agg((F.countDistinct("status") > 1).alias("contested"))


def taken_names(notes: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed notes (vault, slug, title) whose slug or title key is a slug, alias or title of the vault already, with its least ord."""
    names = F.concat(F.array("slug", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = notes.select("vault", "ord", F.explode(names).alias("n")).select("vault", "ord", name_key(F.col("n")).alias("key")).filter("key <> ''").groupBy("vault", "key").agg(F.min("ord").alias("ord"))
    asked = proposed.select("vault", "slug", F.explode(F.array_distinct(F.array(name_key(F.col("slug")), name_key(F.col("title"))))).alias("key")).filter("key <> ''")
    return asked.join(known, ["vault", "key"]).groupBy("vault", "slug").agg(F.min("ord").alias("ord"))


def ungrounded_quotes(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(bundle, rel, quote) of ``[Ch ...] "quote"`` citations whose quote stands in no line of the bundle's sources (bundle, line), letter by letter.

    A line holds a quote only if it holds the quote's first word run of
    letters and digits in full, the first and last of it as parts of words; so
    a quote of three runs or more meets only lines with its longest inner run,
    and shorter ones are looked for in lines grouped by their three-letter
    pieces. No quote meets all lines.
    """
    q = files.select("bundle", "rel", F.explode(F.regexp_extract_all("text", F.lit(r'\[Ch[^\]]*\]\s*"([^"\n]+)"'), 1)).alias("quote")).distinct()
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3))))
    runs = F.regexp_extract_all("quote", F.lit(r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"), 0)
    longest = F.try_element_at(F.array_sort(F.transform(runs, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
    q = q.withColumn("run", longest).withColumn("key", F.coalesce(F.concat(F.lit("w"), "run"), F.concat(F.lit("p"), F.substring("quote", 1, 3))))
    lines = sources.select("bundle", "line").distinct()
    by_run = lines.select("bundle", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}]+"), 0))).alias("w")).select("bundle", "line", F.concat(F.lit("w"), "w").alias("key"))
    by_piece = lines.select("bundle", "line", F.explode(pieces(F.col("line"))).alias("w")).select("bundle", "line", F.concat(F.lit("p"), "w").alias("key"))
    asked = q.select("bundle", "key").distinct()
    hit = q.join(by_run.unionByName(by_piece).join(asked, ["bundle", "key"], "left_semi"), ["bundle", "key"]).filter(F.contains(F.col("line"), F.col("quote")))
    # a quote of one or two letters is shorter than any piece
    short = q.filter(F.col("run").isNull() & (F.length("quote") < 3))
    letters = lines.select("bundle", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("line"))), lambda i: F.substr("line", i, F.lit(2)))).alias("two")).select("bundle", F.explode(F.array("two", F.substring("two", 1, 1))).alias("quote")).distinct()
    found = hit.select("bundle", "rel", "quote").unionByName(short.join(letters, ["bundle", "quote"]).select("bundle", "rel", "quote")).distinct()
    return q.select("bundle", "rel", "quote").join(found, ["bundle", "rel", "quote"], "left_anti")


def page_anchored(method: Column, has_feeds: Column) -> Column:
    """Whether citations of a source can name pages: it was read by pages and the breaks are there."""
    return method.isin(*PAGED_METHODS) & has_feeds


def gates(books_: DataFrame) -> DataFrame:
    """Adds ``reviewable`` (at least one rule), ``scaffold`` (code and a language) and ``with_figures`` (at least one captioned figure)."""
    return books_.withColumns({"reviewable": F.col("rules") >= 1, "scaffold": (F.col("code_blocks") >= 1) & blank_to_null(F.col("language")).isNotNull(), "with_figures": F.col("figures") >= 1})
