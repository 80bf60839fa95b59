"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import name_key
from ..session import cut
from . import tokens

#: Documents of a source summed up in one task; deviation of the shares that a larger mix may cost (none).
PER_BUCKET, TOLERANCE = 50_000, 0.0


def plan_mix(rows: list[tuple[str, float, int, int, int]], tolerance: float = TOLERANCE, total: int | None = None) -> list[tuple[str, float, int, int]]:
    """(source, target share, epochs, budget of the fraction) from (source, weight, max repeats, tokens, documents) of one mix.

    Shares are of the weights of all sources. Without ``total`` the size of
    the mix follows from two deviations of the shares: what capped sources
    miss, which grows with the size, and what choosing whole documents
    rounds, which falls with it. The largest size is taken whose expected
    deviation is at most ``tolerance`` above the smallest possible: by
    default, the size with the least deviation.
    """
    weights = sum(max(0.0, r[1] or 0.0) for r in rows)
    share = {r[0]: max(0.0, r[1] or 0.0) / weights if weights else 0.0 for r in rows}
    cap = {s: max(0, r if r is not None else 1) * t for s, _, r, t, _ in rows}
    half = {s: t / n * min(1 / 4, 1 / n) if n else 0.0 for s, _, _, t, n in rows}  # expected rounding to whole documents, the last of which is the best fit of n
    here = [s for s in share if share[s] > 0 and cap[s] > 0]
    if not here:
        return [(r[0], share[r[0]], 0, 0) for r in rows]
    want = {s: share[s] / sum(share[s] for s in here) for s in here}

    def deviation(size: float) -> float:
        got = {s: min(want[s] * size, cap[s]) for s in here}
        all_ = sum(got.values())
        return sum(max(0.0, want[s] - got[s] / all_) + min(want[s], half[s] / all_) * (got[s] < cap[s]) for s in here)

    if total is None:
        ends = [cap[s] / want[s] for s in here]
        lo, hi = min(ends), max(ends)
        sizes = [lo * (hi / lo) ** (i / 400) for i in range(401)]
        devs = [deviation(x) for x in sizes]
        total = max(x for x, v in zip(sizes, devs, strict=True) if v <= min(devs) + tolerance + 1e-9)
    out = []
    for s, _, _, t, _ in rows:
        budget = int(min(want[s] * total, cap[s]) + 1e-6) if s in want else 0
        out.append((s, share[s], budget // t if t else 0, budget % t if t else 0))
    return out


def mixed(documents: DataFrame, targets: DataFrame, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY, seed: int = 11,
          tolerance: float = TOLERANCE, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with repeats, report of shares), for every mix of ``targets``.

    Chosen: mix, source, doc_id, n_tokens, repeats. Report: mix, source,
    target_share, max_repeats, source_tokens, chosen_tokens, actual_share,
    documents, most_repeats; sources without documents come out with 0.

    Each document draws -ln(u) / quality, u by a hash of its id; within a
    source the smallest go first (weighted sampling without replacement). Whole
    epochs of a source come before the fraction, which takes documents in that
    order as long as they are within the budget, and last the one document
    whose size comes nearest to what is left of it, if that comes nearer to the
    budget than leaving it out. Prefix
    sums run in buckets of about PER_BUCKET documents of one source, cut along
    the draw, with the buckets' totals before them: a hot source spreads over
    many tasks. Sources are compared by name key. Documents of a null or
    unnamed source and those without tokens are never chosen; repeated rows of
    a doc_id count once; a null weight or one below 0 counts as 0, null
    max_repeats as 1; targets repeated for one source add their weights.
    """
    spark = documents.sparkSession
    docs = tokens.measured(documents, ("source",), folder, vocabulary)
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens", "quality")).alias("d")).select("doc_id", "d.*")
    docs = docs.select("doc_id", name_key(F.col("source")).alias("key"), "n_tokens", "quality").filter("key <> '' and n_tokens > 0")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    drawn = cut(docs.withColumn("draw", -F.log(u) / F.col("quality")))

    wanted = targets.filter("mix is not null and source is not null").withColumn("key", name_key(F.col("source"))).groupBy("mix", "key").agg(
        F.min("source").alias("source"), F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    per = drawn.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    known = cut(wanted.join(per, "key", "left").na.fill(0, ["tokens", "n"]))
    rows = known.orderBy("mix", "source").limit(100_001).collect()  # as many as the targets table has, which is given by hand
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 mix targets")
    plan = []
    for mix in dict.fromkeys(r["mix"] for r in rows):
        own = [r for r in rows if r["mix"] == mix]
        for r, (_, share, epochs, rest) in zip(own, plan_mix([(r["key"], r["weight"], r["max_repeats"], r["tokens"], r["n"]) for r in own], tolerance, total), strict=True):
            plan.append((mix, r["source"], r["key"], share, r["max_repeats"], r["tokens"], epochs, rest))
    kinds = T.StructType.fromDDL("mix string, source string, key string, target_share double, max_repeats int, source_tokens long, epochs long, rest long")
    steps = F.broadcast(spark.createDataFrame(plan, kinds))

    counts = F.broadcast(known.select("key", "n").distinct())  # as small as the plan
    bucket = F.least(F.floor((1 - F.exp(-F.col("draw"))) * F.ceil(F.col("n") / PER_BUCKET)), F.ceil(F.col("n") / PER_BUCKET) - 1)
    parts = drawn.join(counts, "key").withColumn("bucket", bucket)
    totals = parts.groupBy("key", "bucket").agg(F.sum("n_tokens").alias("t"))
    # one row per PER_BUCKET documents; a source's rows are few enough for one window
    before = totals.selectExpr("key", "bucket", "sum(t) over (partition by key order by bucket) - t as ahead")
    inside = parts.selectExpr("*", "sum(n_tokens) over (partition by key, bucket order by draw, doc_id rows unbounded preceding) as inside")
    summed = cut(inside.join(before, ["key", "bucket"]).select("key", "doc_id", "n_tokens", "draw", (F.col("ahead") + F.col("inside")).alias("upto")))
    # one row per mix and source: the room that whole documents leave, and the document that fills it best
    all_steps = summed.join(steps, "key")
    gaps = all_steps.groupBy("mix", "key", "rest").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("full")).select("mix", "key", (F.col("rest") - F.coalesce("full", F.lit(0))).alias("gap"))
    gaps = F.broadcast(cut(gaps.filter("gap > 0")))
    off = F.abs(F.col("gap") - F.col("n_tokens"))
    fills = all_steps.filter("upto > rest").join(gaps, ["mix", "key"]).filter(off < F.col("gap")).groupBy("mix", "key").agg(F.min_by("doc_id", F.struct(off, "draw", "doc_id")).alias("fill"))
    fills = F.broadcast(cut(fills))
    taken = (F.col("upto") <= F.col("rest")) | F.coalesce(F.col("doc_id") == F.col("fill"), F.lit(False))
    chosen = all_steps.join(fills, ["mix", "key"], "left").withColumn("repeats", F.col("epochs") + taken.cast("long"))
    chosen = cut(chosen.filter("repeats > 0").select("mix", "source", "doc_id", "n_tokens", "repeats"))

    sums = chosen.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("chosen_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    report = steps.join(sums, ["mix", "source"], "left").na.fill(0, ["chosen_tokens", "documents", "most_repeats"])
    report = report.selectExpr("mix", "source", "target_share", "max_repeats", "source_tokens", "chosen_tokens",
                               "coalesce(try_divide(chosen_tokens, sum(chosen_tokens) over (partition by mix)), 0D) as actual_share", "documents", "most_repeats")
    return chosen, report
