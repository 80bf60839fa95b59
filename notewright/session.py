"""Session helpers: table reading and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session on one machine (a local master, as in tests) names
    none a local folder is made, once per session; on a cluster, whose
    machines share no such folder, the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="notewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/notewright-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so its lineage ends there.

    A written table, not a local checkpoint: an executor's loss costs nothing.
    """
    path = f"{_own_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._cut_path = path  # type: ignore[attr-defined]
    return again


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Remove a table made by :func:`cut` that nothing will read again."""
    path = getattr(df, "_cut_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear_cuts(spark: SparkSession) -> None:
    """Remove all tables this application cut, once their results are written or no longer needed."""
    _delete(spark, _own_dir(spark))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system Hadoop knows is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
