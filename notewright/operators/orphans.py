"""References to records that do not exist, per table and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import month_index, name_key
from ..session import cut
from .skew import hot_keys

FOREVER = 2_000_000_000
#: References from which on a key is heavy (and holds a thousandth of all): few enough that the heavy half works at any size.
HEAVY = 20_000
_KEYS = ["table_name", "scope", "key"]


def _scope(c):
    return F.coalesce(F.concat(F.lit("="), c), F.lit("null"))


def note_references(notes: DataFrame) -> DataFrame:
    """One row per note and entry of ``related``; a copied note counts once, from its first arrival."""
    return (
        notes.select("ord", "vault", "loaded_at", F.explode("related").alias("ref"))
        .groupBy("ord", "vault", "ref").agg(F.min("loaded_at").alias("loaded_at"))
        .select(F.lit("notes").alias("table_name"), _scope(F.col("vault")).alias("scope"), name_key(F.col("ref")).alias("key"),
                month_index(F.col("loaded_at")).alias("month"), F.col("ord").cast("long").alias("rec_id"), "ref")
    )


def finding_references(findings: DataFrame) -> DataFrame:
    """One row per finding with a category."""
    return (
        findings.groupBy("finding_id", F.col("category").alias("ref")).agg(F.min("loaded_at").alias("loaded_at"))
        .select(F.lit("findings").alias("table_name"), F.lit("all").alias("scope"), name_key(F.col("ref")).alias("key"),
                month_index(F.col("loaded_at")).alias("month"), F.col("finding_id").cast("long").alias("rec_id"), "ref")
    )


def _valid(df: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct month ranges (last one inclusive) in which a key is answered at the month's end."""
    return (
        df.select(*_KEYS, month_index(F.col(start)).alias("from_m"), F.coalesce(month_index(F.col(end)) - 1, F.lit(FOREVER)).alias("to_m"))
        .filter("key <> '' and from_m <= to_m").groupBy(*_KEYS, "from_m").agg(F.max("to_m").alias("to_m"))
    )


def note_providers(notes: DataFrame) -> DataFrame:
    """Month ranges of every slug and alias of a vault."""
    names = F.array_union(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = (
        notes.select("ord", "vault", "loaded_at", "deleted_at", F.explode(names).alias("name"))
        .select("ord", _scope(F.col("vault")).alias("scope"), name_key(F.col("name")).alias("key"), "loaded_at", "deleted_at")
        .groupBy("ord", "scope", "key").agg(F.min("loaded_at").alias("loaded_at"), F.min("deleted_at").alias("deleted_at"))
    )
    return _valid(each.withColumn("table_name", F.lit("notes")), "loaded_at", "deleted_at")


def category_providers(categories: DataFrame) -> DataFrame:
    """Month ranges of every lint category; several rows of one category add up."""
    each = categories.select(F.lit("findings").alias("table_name"), F.lit("all").alias("scope"), name_key(F.col("category")).alias("key"), "added_at", "retired_at")
    return _valid(each, "added_at", "retired_at")


def orphan_references(references: DataFrame, providers: DataFrame, hot_rows: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(orphan rows, counts per table and month).

    References: table_name, scope, key, month, rec_id, ref; providers: the same
    keys with from_m, to_m. First references are counted per key and month, so
    no key has more rows than there are months. Keys that hold many references
    (at most 1/share of them, see ``skew.hot_keys``) are checked against a
    broadcast of their own providers; all others by a shuffled anti-join; both
    results are united. Orphan keys are then brought back to their references
    the same way.

    An empty or null key refers to nothing and never is an orphan; a null
    month has no period and is left out; equal (record, reference) pairs count
    once; empty inputs give empty results; other columns are ignored.
    """
    refs = cut(references.filter("key <> '' and month is not null").select(*_KEYS, "month", "rec_id", "ref"))
    counted = refs.groupBy(*_KEYS, "month").agg(F.count(F.lit(1)).alias("n"))
    per_key = counted.groupBy(*_KEYS).agg(F.sum("n").alias("n"))
    hot = hot_keys(per_key, _KEYS, rows=hot_rows)

    def unanswered(side: DataFrame, answers: DataFrame) -> DataFrame:
        on = [side[k] == answers[k] for k in _KEYS] + [side["month"] >= answers["from_m"], side["month"] <= answers["to_m"]]
        return side.join(answers, on, "left_anti")

    def found(rows: DataFrame, missing: DataFrame) -> DataFrame:
        return rows.join(missing.select(*_KEYS, "month"), [*_KEYS, "month"], "left_semi")

    if hot is None:
        missing = cut(unanswered(counted, providers))
        orphans = found(refs, missing)
    else:
        hot = cut(hot)
        heavy = unanswered(counted.join(F.broadcast(hot), _KEYS, "left_semi"), F.broadcast(providers.join(F.broadcast(hot), _KEYS, "left_semi")))
        light = unanswered(counted.join(F.broadcast(hot), _KEYS, "left_anti"), providers)
        missing = cut(heavy.withColumn("hot", F.lit(True)).unionByName(light.withColumn("hot", F.lit(False))))
        orphans = found(refs.join(F.broadcast(hot), _KEYS, "left_semi"), F.broadcast(missing.filter("hot"))).unionByName(
            found(refs.join(F.broadcast(hot), _KEYS, "left_anti"), missing.filter("not hot"))
        )
    counts = missing.groupBy("table_name", period(F.col("month")).alias("period")).agg(
        F.sum("n").alias("orphans"), F.countDistinct("scope", "key").alias("keys")
    )
    return orphans.select("table_name", period(F.col("month")).alias("period"), "rec_id", "ref"), counts


def period(month):
    """``yyyy-MM`` of a month index."""
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))


def vault_orphans(notes: DataFrame, findings: DataFrame, categories: DataFrame, hot_rows: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Orphans of ``notes.related`` and ``findings.category``."""
    return orphan_references(
        note_references(notes).unionByName(finding_references(findings)),
        note_providers(notes).unionByName(category_providers(categories)),
        hot_rows,
    )
