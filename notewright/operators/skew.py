"""Joins that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many rows, and from so large a share; the share bounds the number of hot keys.
HOT_ROWS, HOT_SHARE = 200_000, 0.001


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n", rows: int = HOT_ROWS, share: float = HOT_SHARE) -> DataFrame | None:
    """Keys holding at least ``rows`` rows and ``share`` of all, of a table with one row per key.

    At most ``1/share`` keys can qualify, whatever the input's size, so the
    result may be broadcast. None if there are none.
    """
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    least = max(rows, share * (total or 0))
    if not total or most < least:
        return None
    return counted.filter(F.col(n) >= least).select(*keys)


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, whose rows per hot key are few.

    Rows of hot keys meet a broadcast of the right side's rows of those keys;
    all others meet by shuffle; the results are united, no row is lost. Key
    nulls never match (as in SQL); a left or anti join keeps such left rows.
    """
    if hot is None:
        return left.join(right, keys, how)
    flag = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = left.join(flag, keys, "left")
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    a = marked.filter("_hot").drop("_hot").join(few, keys, how)
    b = marked.filter("_hot is null").drop("_hot").join(right, keys, how)
    return a.unionByName(b)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counted: DataFrame, salt: list[str], how: str = "left", n: str = "n", rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key of any size.

    The rows of a key hot in ``counted`` (one row per key with ``n``, its rows
    in ``left``) spread by a hash of ``salt`` over one part for every ``rows``
    of them, and each part gets a copy of the key's right row, so that nothing
    large is broadcast and no task holds more of a key than about ``rows``.
    """
    hot = hot_keys(counted, keys, n, rows)
    if hot is None:
        return left.join(right, keys, how)
    parts = F.broadcast(counted.join(F.broadcast(hot), keys, "left_semi").select(*keys, F.ceil(F.col(n) / rows).cast("int").alias("_parts")))
    many = F.coalesce("_parts", F.lit(1))
    a = left.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*salt), many).cast("int")).drop("_parts")
    b = right.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"], how).drop("_part")
