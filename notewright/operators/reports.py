"""Reports as rows of text lines (group, k, text), in order of k: a reader sorts and prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model_loops import SHOWN_ITEMS


def percent(share: Column) -> Column:
    """Whole percents, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def lint_report(findings: DataFrame) -> DataFrame:
    """Per bundle: a line of totals (k = 0), then one line a finding, errors first, by path and line."""
    totals = findings.groupBy("bundle").agg(F.format_string("%d errors, %d warnings", F.count_if(F.col("level") == "error"), F.count_if(F.col("level") == "warning")).alias("text"))
    rank = F.when(F.col("level") == "error", 0).otherwise(1)
    ordered = findings.withColumn("o", rank).selectExpr("*", "cast(row_number() over (partition by bundle order by o, path, coalesce(line, 0), category, message) as int) as k")
    place = F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    line = F.concat_ws(" ", F.upper("level"), "category", place, "message")
    return totals.select("bundle", F.lit(0).alias("k"), "text").unionByName(ordered.select("bundle", "k", line.alias("text")))


def score_report(scores: DataFrame, found: str, total: str, name: str, missing: DataFrame | None = None, item: str = "item") -> DataFrame:
    """Per bundle: ``name: share (found/total)``, then up to SHOWN_ITEMS missing items (bundle, item) in one line."""
    share = F.when(F.col(total) > 0, F.col(found) / F.col(total)).otherwise(1.0)
    head = scores.select("bundle", F.lit(0).alias("k"), F.concat(F.lit(f"{name}: "), percent(share), F.lit(" ("), F.col(found).cast("string"), F.lit("/"), F.col(total).cast("string"), F.lit(")")).alias("text"))
    if missing is None:
        return head
    first = missing.selectExpr("bundle", f"{item} as item", f"row_number() over (partition by bundle order by {item}) as n").filter(F.col("n") <= SHOWN_ITEMS)
    tail = first.groupBy("bundle").agg(F.concat(F.lit("missing: "), F.array_join(F.array_sort(F.collect_list("item")), ", ")).alias("text"))
    return head.unionByName(tail.select("bundle", F.lit(1).alias("k"), "text"))


def plan_report(plan: DataFrame) -> DataFrame:
    """Per skill: one line an upgrade entry, by part of the plan and order of the change log."""
    ordered = plan.selectExpr("*", "cast(row_number() over (partition by skill order by plan, seq) as int) as k")
    version = F.array_join(F.transform("version", lambda x: x.cast("string")), ".")
    issue = F.coalesce(F.concat(F.lit(" (#"), "issue", F.lit(")")), F.lit(""))
    return ordered.select("skill", "k", F.concat("plan", F.lit(" "), version, F.lit(": "), F.coalesce("cls", F.lit("")), issue).alias("text"))
