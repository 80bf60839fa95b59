"""The resumable chunk run as a stream: new plan rows are worked on once, whatever stops in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import exists


def run_plan(spark: SparkSession, plan_dir: str, out_dir: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Read plan rows (parquet files of ``plan_dir``) as they arrive and append ``work`` of those not yet in ``out_dir``.

    ``work`` keeps the id and adds an ``error`` column; rows with an error are
    written under ``failed`` and are taken up again by the next plan that
    names them. A batch that is run again after a failure finds its ids
    already there and writes nothing twice. Paths may be of any file system
    that Hadoop knows; a batch takes at most ``files_per_batch`` plan files.
    """
    schema = spark.read.parquet(plan_dir).schema
    done, failed = (f"{out_dir.rstrip('/')}/{x}" for x in ("done", "failed"))

    def batch(df: DataFrame, _: int) -> None:
        todo = df.dropDuplicates(["id"])
        if exists(spark, done):
            todo = todo.join(spark.read.parquet(done).select("id"), "id", "left_anti")
        got = work(todo).persist()
        got.filter("error is null").drop("error").write.mode("append").parquet(done)
        got.filter("error is not null").select("id", "error").write.mode("append").parquet(failed)
        got.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(plan_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events per type and window, late rows up to the watermark; the same plan over a table or a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    per = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
