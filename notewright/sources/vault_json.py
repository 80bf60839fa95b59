"""JSON files of a vault: chunk notes, plan, journal, sources, gold and manifest, read as tables.

Files come as (path, text), so that one scan serves any storage; ``whole_files``
makes such a table. A text that is no JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "struct<type string, slug string, title string, description string, tags array<string>, aliases array<string>, confidence string, status string, body string, related array<string>, citations array<struct<chapter int, quote string, source string>>>"
CHUNK = "struct<id int, source string, label string, chapter int, start_line int, end_line int, words int>"
SOURCE = "struct<slug string, title string, authors array<string>, extraction_method string, source_sha256 string, source_filename string, raw_rel string, page_offset int>"
CONCEPT = "struct<slug string, aliases array<string>, fact_anchor string>"
MANIFEST = "struct<generator_version string, updated string, source_sha256 string, page_offset int, sources array<struct<slug string, source_sha256 string, page_offset int>>, note_counts map<string, bigint>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .json files under a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listed(text: Column, key: str, item: str) -> Column:
    """ARRAY of items of a JSON text: a bare list, or an object that has it under ``key``."""
    inner = F.get_json_object(text, f"$.{key}")
    return F.coalesce(F.from_json(F.when(F.ltrim(text).startswith("["), text), f"array<{item}>"), F.from_json(inner, f"array<{item}>"))


def _items(files: DataFrame, key: str, item: str) -> DataFrame:
    rows = files.select("path", F.posexplode(listed(F.col("text"), key, item)).alias("pos", "x")).filter("x is not null")
    return rows.select("path", "pos", "x.*")


def notes(files: DataFrame) -> DataFrame:
    """(path, pos, fields) of the notes of chunk files; by path as text, then pos, is the order notes count in."""
    return _items(files, "notes", NOTE)


def plan(files: DataFrame, default_source: str | None = None) -> DataFrame:
    """(path, pos, fields) of planned chunks; one without a source belongs to the default one."""
    got = _items(files, "chunks", CHUNK)
    return got.withColumn("source", F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit(default_source)))


def journal(files: DataFrame) -> DataFrame:
    """Distinct ids of chunks that are done: a bare list of numbers, or one under ``done``."""
    return files.select(F.explode(listed(F.col("text"), "done", "int")).alias("id")).filter("id is not null").distinct()


def sources(files: DataFrame) -> DataFrame:
    return _items(files, "sources", SOURCE)


def gold(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts (path, pos, slug, aliases, fact_anchor), links (path, a, b))."""
    pairs = F.from_json(F.get_json_object("text", "$.links"), "array<array<string>>")
    links = files.select("path", F.explode(pairs).alias("l")).filter("size(l) = 2").select("path", F.col("l")[0].alias("a"), F.col("l")[1].alias("b"))
    return _items(files, "concepts", CONCEPT), links


def manifests(files: DataFrame) -> DataFrame:
    """(path, fields) of manifest files."""
    return files.select("path", F.from_json("text", MANIFEST).alias("m")).filter("m is not null").select("path", "m.*")
