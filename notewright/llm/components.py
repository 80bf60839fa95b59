"""Consolidating pairwise links into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators.skew import HOT_ROWS, hot_keys, join_by_key
from ..session import cut, drop_cut

#: Identifiers of names that no note carries start here, so the least identifier of a group with a note is a note's.
GHOST = 1 << 62
MAX_ROUNDS = 100


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", hot_rows: int = HOT_ROWS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, root) for every identifier of ``edges``: root is the least identifier of its component.

    Every vertex v keeps a cluster of identifiers, at first its neighbours and
    itself. In a round it sends the whole cluster to the cluster's least member
    m, and m alone to all other members; what a vertex receives is its next
    cluster. Stable after O(log diameter) rounds: m's cluster is the component
    and every other vertex holds only m. Clusters are rows (v, member), never
    arrays, so a component of any size stays distributed; a vertex with a very
    large cluster meets its minimum by broadcast (``skew.join_by_key``). Each
    round is written to the shared folder. Edges with a null end and loops
    link nothing; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v <> u")
    both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    now = cut(both.unionByName(both.select("v", F.col("v").alias("u")).distinct()))
    before = None
    for _ in range(max_rounds):
        least = now.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("h"))
        # rows are distinct, so that equal counts and hashes of all rows mean equal clusters
        seen = least.agg(F.count(F.lit(1)), F.sum("n"), F.bit_xor("h"), F.max("n")).first()
        sized = cut(least) if (seen[3] or 0) >= hot_rows else least
        hot = hot_keys(sized, ["v"], rows=hot_rows) if sized is not least else None
        sent = join_by_key(now, sized.select("v", "m"), ["v"], "inner", hot)
        pairs = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        after = cut(sent.select(F.explode(pairs).alias("p")).select("p.v", "p.u").distinct())
        drop_cut(now)
        if sized is not least:
            drop_cut(sized)
        if seen[:3] == before:
            break
        before, now = seen[:3], after
    else:
        raise RuntimeError(f"not stable after {max_rounds} rounds")
    return after.filter("u >= v").select(F.col("u").alias("id"), F.col("v").alias("root"))


def _scope(c):
    return F.coalesce(F.concat(F.lit("="), c), F.lit("null"))


def note_names(notes: DataFrame) -> DataFrame:
    """Distinct (scope, key, ord): slug and aliases of every note by name key, scoped by vault."""
    names = F.array_union(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        notes.filter("ord is not null").select(F.col("ord").cast("long").alias("ord"), _scope(F.col("vault")).alias("scope"), F.explode(names).alias("name"))
        .select("scope", name_key(F.col("name")).alias("key"), "ord").filter("key <> ''").distinct()
    )


def note_groups(notes: DataFrame, matches: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(ord, group_ord) of every note: the least ord among all notes linked to it directly or through others.

    Notes of one vault that share a name are linked, and so are the names of a
    match row with ``same`` true, also through names that no note carries. A
    name stands for its least ord (for names without a note a number from
    GHOST), so a name shared by a third of all notes costs one row a note.
    Notes without a usable name are their own group; match rows with a null
    verdict, a null or empty slug, or one name on both sides link nothing;
    repeated rows count once; null vaults form one vault; other columns are
    ignored.
    """
    names = cut(note_names(notes))
    per_name = names.groupBy("scope", "key").agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(per_name, ["scope", "key"], rows=hot_rows)
    shared = per_name.filter("n > 1").select("scope", "key", "rep")
    links = join_by_key(names, shared, ["scope", "key"], "inner", hot).filter("ord <> rep").select(F.col("ord").alias("a"), F.col("rep").alias("b"))

    pairs = cut(
        matches.filter("same").select(_scope(F.col("vault")).alias("scope"), name_key(F.col("slug_a")).alias("x"), name_key(F.col("slug_b")).alias("y"))
        .filter("x <> '' and y <> '' and x <> y").distinct()
    )
    judged = pairs.select("scope", F.explode(F.array("x", "y")).alias("key")).distinct()
    known = per_name.select("scope", "key", "rep")
    ident = judged.join(known, ["scope", "key"], "left")
    ident = cut(ident.withColumn("id", F.coalesce("rep", F.lit(GHOST) + F.monotonically_increasing_id())).drop("rep"))
    most = pairs.select("scope", F.explode(F.array("x", "y")).alias("key")).groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n"))
    hot_x = hot_keys(most, ["scope", "key"], rows=hot_rows)
    ends = pairs
    for side, to in (("x", "a"), ("y", "b")):
        hot_side = None if hot_x is None else hot_x.withColumnRenamed("key", side)
        ends = join_by_key(ends, ident.select("scope", F.col("key").alias(side), F.col("id").alias(to)), ["scope", side], "inner", hot_side)
    roots = hash_to_min(links.unionByName(ends.select("a", "b")), hot_rows=hot_rows).filter(f"id < {GHOST}").withColumnRenamed("id", "ord")
    every = notes.filter("ord is not null").select(F.col("ord").cast("long").alias("ord")).distinct()
    return every.join(roots, "ord", "left").select("ord", F.coalesce("root", "ord").alias("group_ord"))
