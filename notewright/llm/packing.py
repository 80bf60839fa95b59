"""Filling fixed-capacity containers with documents along a space-filling curve."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import tokens

#: Documents packed in one task, cells the curve is counted in, items ordered by size together, containers open at once.
SEGMENT, CELL_BITS, WINDOW, OPEN = 50_000, 16, 1024, 256


def pack(sizes: np.ndarray, capacity: int, window: int = WINDOW, most_open: int = OPEN) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, container, start, end) of items in order, each piece at most ``capacity`` long.

    An item larger than the capacity fills containers of its own; its rest is
    an item like any other. Within a window of neighbours the largest goes
    first, into the fullest open container it fits in; when too many are
    open, the fullest is closed.
    """
    out: list[tuple[int, int, int, int, int]] = []
    room: list[tuple[int, int]] = []  # (free, container), ascending
    made = 0
    for w in range(0, len(sizes), window):
        rests = []
        for i in range(w, min(w + window, len(sizes))):
            n = int(sizes[i])
            full = max(0, (n - 1) // capacity) if n > capacity else 0
            for k in range(full):
                out.append((i, k, made, k * capacity, (k + 1) * capacity))
                made += 1
            rests.append((n - full * capacity, i, full))
        rests.sort(key=lambda r: (-r[0], r[1]))
        for n, i, k in rests:
            at = bisect_left(room, (n, -1))
            if at < len(room):
                free, c = room.pop(at)
            else:
                free, c = capacity, made
                made += 1
            out.append((i, k, c, k * capacity, k * capacity + n))
            if free - n > 0:
                insort(room, (free - n, c))
                if len(room) > most_open:
                    room.pop(0)
    return out


def packed(documents: DataFrame, specs: DataFrame, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """spec, capacity_tokens, container_id, doc_id, piece, start_token, end_token, tokens for every document and spec.

    Documents are ordered by the Hilbert index of their hashed vectors, so a
    container holds neighbours. The curve is counted in 2^CELL_BITS cells, and
    adjacent cells are put together to segments of about SEGMENT documents; a
    cell with more (copies of one text) is cut into several by a hash of the
    id. Segments are packed independently, for every spec, from sizes and keys
    alone: no text is shuffled. A document is split only where it is larger
    than the capacity, into full containers and a rest. A document without
    tokens (null or empty text) takes no room and comes out with 0 tokens;
    repeated rows of a doc_id count once; specs with a null capacity or one
    below 1 are left out; other columns are ignored.
    """
    spark = documents.sparkSession
    wanted = [(r[0], r[1]) for r in specs.filter("capacity_tokens >= 1").select("spec", "capacity_tokens").distinct().orderBy("spec", "capacity_tokens").limit(10_001).collect()]
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 container specs")
    one = tokens.measured(documents, (), folder, vocabulary).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), F.min("curve_key").alias("curve_key"))
    sized = cut(one.withColumn("cell", F.shiftright("curve_key", tokens.DIMS * tokens.BITS - CELL_BITS).cast("int")))
    # at most 2^CELL_BITS rows, whatever the input
    cells = {r[0]: r[1] for r in sized.groupBy("cell").count().collect()}
    plan, segment, held = [], 0, 0
    for cell in sorted(cells):
        n = cells[cell]
        if held and held + n > SEGMENT:
            segment, held = segment + 1, 0
        parts = -(-n // SEGMENT)
        plan.append((cell, segment, parts))
        segment, held = (segment + parts, 0) if parts > 1 else (segment, held + n)
    n_segments = segment + 1
    layout = F.broadcast(spark.createDataFrame(plan, "cell int, first int, parts int"))
    placed = sized.join(layout, "cell").select("doc_id", "n_tokens", "curve_key", (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("segment"))
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"spec string, capacity_tokens int, container_id long, doc_id {kind}, piece int, start_token long, end_token long, tokens long"

    def pack_segment(segment: int, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["curve_key", "n_tokens", "doc_id"], kind="stable")
        sizes, ids = group["n_tokens"].to_numpy(), group["doc_id"].to_numpy()
        out = []
        for spec, capacity in wanted:
            rows = np.array(pack(sizes, capacity), dtype=np.int64).reshape(-1, 5)
            out.append(pd.DataFrame({"spec": spec, "capacity_tokens": capacity, "container_id": (segment << 32) + rows[:, 2], "doc_id": ids[rows[:, 0]], "piece": rows[:, 1],
                                     "start_token": rows[:, 3], "end_token": rows[:, 4], "tokens": rows[:, 4] - rows[:, 3]}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        for segment, group in pd.concat(parts).groupby("segment") if parts else ():
            yield pack_segment(int(segment), group)

    # one task a segment, whatever its bytes
    return placed.repartitionById(n_segments, F.col("segment").cast("int")).mapInPandas(run, schema)


def fill_report(packed_items: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, share of room used, documents that were split."""
    per = packed_items.groupBy("spec", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("t"), F.sum((F.col("piece") == 1).cast("long")).alias("s"))
    total = F.sum("t")
    return per.groupBy("spec", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), total.alias("tokens"),
        (total / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("fill"), F.sum("s").alias("split_documents"),
    )
