"""Near-duplicate records: all pairs of texts whose word sets are similar, and their groups."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut
from .components import hash_to_min

#: Shared tokens asked of the prefixes of the first order, and tokens that the prefixes of the further orders have beyond the words no similar text need share.
SHARED, LATER = 4, 8
#: A word is frequent from this share of the records, or from BLOCK records; of more than MOST_FREQUENT such words the most frequent are told to the tasks.
FREQUENT, MOST_FREQUENT = 1 / 2000, 1_000_000
#: Records of one posting list that meet in one place at most; longer lists are cut into blocks.
BLOCK = 20_000
#: Texts whose postings make up one task's share.
TEXTS_PER_TASK = 5_000
#: A broadcast of candidate ids is allowed up to so many (8 bytes each).
ID_BOUND = 2_000_000
#: Members of one class that meet in one task at most when classes are expanded to pairs.
MEMBERS = 2_000

_WORD = re.compile("[a-z0-9]+")


def _word_set(*parts: str | None) -> set[str]:
    return set(_WORD.findall(" ".join(p or "" for p in parts).lower()))


def _hash64(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def _at_least(x: float) -> int:
    """Smallest integer not below x, safe from the last bits of a product."""
    return math.ceil(x - 1e-9)


def frequent_words(texts: DataFrame, n_texts: int, share: float = FREQUENT) -> dict[str, int]:
    """word -> number of texts, of words in more than ``share`` of all texts or in more than BLOCK texts.

    Counted over all texts: per batch, then per word. At most MOST_FREQUENT
    words come out, the most frequent ones; a word left out counts as rare,
    which costs candidates but no result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for row in zip(*(batch[c] for c in batch.columns), strict=True):
                counts.update(_word_set(*row))
            if len(counts) > 200_000:
                yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
                counts = Counter()
        if counts:
            yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})

    least = max(1, min(int(n_texts * share), BLOCK))
    got = texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > least).orderBy(F.desc("n"), "word").limit(MOST_FREQUENT)
    return {r["word"]: r["n"] for r in got.toLocalIterator()}


class _Keys(dict):
    """word -> 64-bit hash; word frequencies in classes of a quarter of a power of two."""

    def __init__(self, frequent: dict[str, int]) -> None:
        self.classes = {_hash64(w): min(127, 1 + int(4 * math.log2(n))) for w, n in frequent.items()}

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = _hash64(word)
        return h


def _most(cls: np.ndarray) -> np.ndarray:
    """The most records a word of a frequency class can have."""
    return np.where(cls > 0, 2.0 ** (cls / 4), 0)


def prefixes(texts: DataFrame, id_col: str, frequent, threshold: float, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per text: its class (sum and xor of its words' hashes), size, the prefix of order 0 and the prefixes of orders 1 and 2.

    Order 0 ranks words by frequency class, then hash; order 1 those of odd
    hash before those of even hash, order 2 the other way round, each by
    frequency class, then hash. ``later`` holds the size, the number of odd
    words, the length of either later prefix (three of 4 bytes) and 16 bits of
    each of their tokens, the last bit of which tells odd from even.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = _Keys(frequent.value)
        known = np.array(sorted(keys.classes), np.int64)
        cls_of = np.array([keys.classes[h] for h in known.tolist()], np.int64)
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.iloc[at : at + 4096]
                flat, n = [], np.zeros(len(batch), np.int64)
                for i, row in enumerate(zip(*(batch[c] for c in batch.columns if c != id_col), strict=True)):
                    words = _word_set(*row)
                    n[i] = len(words)
                    flat.extend(words)
                h = np.fromiter(map(keys.__getitem__, flat), np.int64, len(flat))
                row = np.repeat(np.arange(len(batch)), n)
                first = np.cumsum(n) - n
                c1, c2 = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
                some = n > 0
                if len(h):
                    c1[some], c2[some] = np.add.reduceat(h, first[some]), np.bitwise_xor.reduceat(h, first[some])
                cls = np.zeros(len(h), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    cls = np.where(known[k] == h, cls_of[k], 0)
                low = h & ((1 << 40) - 1)
                base = row << 48 | cls << 40 | low
                miss = n - np.array([_at_least(threshold * x) for x in n.tolist()], np.int64)  # words no similar text need share
                place = np.arange(len(h)) - np.repeat(first, n)
                rank = np.sort(base)
                inside = place < np.repeat(miss + shared, n)
                kept = rank[inside]
                size = np.minimum(n, miss + shared)
                ends = np.cumsum(size)
                tokens, freq = (kept & 0xFFFFFFFF).astype("<u4").tobytes(), _most(kept >> 40 & 127).astype("<i4")
                long = np.minimum(n, miss + LATER)
                last = np.cumsum(long)
                odd = np.bincount(row, low & 1, len(batch)).astype("<i4")
                later = []
                for odd_first in (1, 0):
                    order = np.sort(base | ((low & 1) ^ odd_first) << 47)
                    later.append((order[place < np.repeat(miss + LATER, n)] & 0xFFFF).astype("<u2").tobytes())
                head = np.stack([n.astype("<i4"), odd, long.astype("<i4")], axis=1).tobytes() if len(batch) else b""
                heavy = np.array([bool(s) and freq[e - 1] > block for s, e in zip(size.tolist(), ends.tolist(), strict=True)])
                yield pd.DataFrame({
                    "id": batch[id_col].to_numpy(), "c1": c1, "c2": c2, "n": n.astype(np.int32),
                    "prefix": [tokens[4 * (e - s) : 4 * e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)],
                    "freq": [freq[e - s : e].tobytes() if x else b"" for s, e, x in zip(size.tolist(), ends.tolist(), heavy.tolist(), strict=True)],
                    "later": [head[12 * i : 12 * i + 12] + later[0][2 * (e - s) : 2 * e] + later[1][2 * (e - s) : 2 * e] for i, (s, e) in enumerate(zip(long.tolist(), last.tolist(), strict=True))],
                })

    return texts.mapInPandas(run, "id long, c1 long, c2 long, n int, prefix binary, freq binary, later binary")


def _postings(threshold: float, block: int):
    """Rows (tok, blk, rec, n, pos, rest): a record under each of its plain prefix's tokens, with 16 bits of each prefix token after it.

    A token of more than ``block`` records has several lists, one for each
    pair of blocks; a record is in the lists of its own block with every other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tok, blk, rec, size, pos, rest = [], [], [], [], [], []
            for i, n, p, f in zip(batch["id"], batch["n"], batch["prefix"], batch["freq"], strict=True):
                array = np.frombuffer(p, "<u4")
                t, short, freq = array.astype(np.int32).tolist(), (array >> 8).astype("<u2").tobytes(), np.frombuffer(f, "<i4").tolist()
                plain = min(len(t), n - _at_least(threshold * n) + 1)
                if not freq:
                    tok += t[:plain]
                    blk += [0] * plain
                    rec += [i] * plain
                    size += [n] * plain
                    pos += range(plain)
                    rest += [short[2 * k + 2 :] for k in range(plain)]
                    continue
                for k in range(plain):
                    cuts = -(-freq[k] // block) if freq[k] > block else 1
                    own = i % cuts
                    for other in range(cuts):
                        tok.append(t[k])
                        blk.append(min(own, other) * cuts + max(own, other))
                        rec.append(i)
                        size.append(n)
                        pos.append(k)
                        rest.append(short[2 * k + 2 :])
            if not tok:
                continue
            yield pd.DataFrame({"tok": np.array(tok, np.int32), "blk": np.array(blk, np.int32), "rec": np.array(rec, np.int64), "n": np.array(size, np.int32),
                                "pos": np.array(pos, np.int32), "rest": pd.Series(rest, dtype=object)})

    return run


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return at, np.diff(np.concatenate((at, [len(sorted_keys)])))


def _pair_up(later: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + 1 ... i + later[i]), about ``most`` at a time."""
    ends, n, at = np.cumsum(later), len(later), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        k = later[at:to]
        a = np.repeat(np.arange(at, to), k)
        if len(a):
            yield a, np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + a + 1
        at = to


def _need(threshold: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that sets of these sizes must share."""
    return np.ceil(threshold / (1 + threshold) * (x.astype(np.int64) + y) - 1e-9).astype(np.int64)


def _common(rest: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tokens that the rests of rows x and y have in common."""
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 50_000):
        xs, ys = x[at : at + 50_000], y[at : at + 50_000]
        rows, where = np.unique(np.concatenate((xs, ys)), return_inverse=True)
        lens = np.array([len(rest[i]) // 2 for i in rows.tolist()])
        pair = np.repeat(np.arange(len(xs)), lens[where[: len(xs)]])
        flat = [np.frombuffer(b"".join(rest[i] for i in side.tolist()), "<u2").astype(np.int64) for side in (xs, ys)]
        pair_y = np.repeat(np.arange(len(ys)), lens[where[len(xs) :]])
        hit = np.isin(pair << 16 | flat[0], pair_y << 16 | flat[1])
        out[at : at + 50_000] = np.bincount(pair[hit], minlength=len(xs))
    return out


def _join_lists(group: np.ndarray, rec: np.ndarray, n: np.ndarray, pos: np.ndarray, rest: list[bytes], threshold: float, shared: int, most: int = 2_000_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of whole posting lists (``group`` numbers them): they share the list's token and enough of those after it.

    A pair that must share ``need`` words leaves at most n - need of each
    text's words alone, so its k-th shared word is among the first
    n - need + k of either text. With s words shared by the stored prefixes,
    at most s + max(n - stored prefix) can be shared in all.
    """
    m = len(rec)
    lens = np.fromiter((len(r) // 2 for r in rest), np.int64, m)
    owner = np.repeat(np.arange(m), lens)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens) + pos[owner] + 1  # position of the second word
    both = (group[owner] << 16 | np.frombuffer(b"".join(rest), "<u2").astype(np.int64)) << 12 | np.minimum(place, 4095)
    order = np.argsort(both, kind="stable")
    both, owner, place = both[order], owner[order], place[order]
    # rows of one list with one second word, by position; partners up to where both positions are too late
    room = (n[owner] * ((1 - threshold) / threshold) + 2 * shared).astype(np.int64) - place
    last = np.searchsorted(both, (both >> 12 << 12) | np.clip(room, 0, 4095), side="right")
    later = np.maximum(0, last - np.arange(len(owner)) - 1)
    got, out = [], []
    for a, b in _pair_up(later, most):
        x, y = owner[a], owner[b]
        nx, ny = n[x], n[y]
        need = _need(threshold, nx, ny)
        gx, gy = nx - need, ny - need  # words that may stay alone
        ok = (gx >= pos[x]) & (gy >= pos[y]) & (gx + shared > place[a]) & (gy + shared > place[b]) & (x != y)
        x, y = x[ok], y[ok]
        got.append(np.minimum(x, y) * m + np.maximum(x, y))
    if got:
        code = np.sort(np.concatenate(got))
        s, count = _runs(code)
        x, y = code[s] // m, code[s] % m
        need = _need(threshold, n[x], n[y])
        ok = (count + 1 >= np.minimum(shared, need)) & (rec[x] != rec[y])
        x, y, need = x[ok], y[ok], need[ok]
        tail = n - pos - 1 - lens  # words after the stored prefix
        least = need - np.maximum(tail[x], tail[y])
        ok = _common(rest, x, y) + 1 >= least
        x, y = rec[x[ok]], rec[y[ok]]
        out.append((np.minimum(x, y), np.maximum(x, y)))
    # texts that need to share one word only meet by the list's token itself
    single = np.flatnonzero(n < 1 / threshold + 1)
    if threshold < 0.5 and len(single):
        _, k = _runs(group[single])
        later = np.repeat(k, k) - (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)) - 1
        for a, b in _pair_up(later, most):
            x, y = single[a], single[b]
            ok = (_need(threshold, n[x], n[y]) <= 1) & (rec[x] != rec[y])
            out.append((np.minimum(rec[x], rec[y])[ok], np.maximum(rec[x], rec[y])[ok]))
    return out


def _candidates(threshold: float, shared: int):
    """Over rows of whole posting lists (sorted by token and block): candidate pairs."""

    def flush(parts: list[pd.DataFrame], out: list) -> None:
        f = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        tok = f["tok"].to_numpy().astype(np.int64) << 32 | f["blk"].to_numpy().astype(np.int64)
        _, length = _runs(tok)
        several = np.repeat(length > 1, length)
        f = f[several]
        group = np.repeat(np.arange(int((length > 1).sum())), length[length > 1])
        if len(f):
            out += _join_lists(group, f["rec"].to_numpy(), f["n"].to_numpy(), f["pos"].to_numpy(), f["rest"].to_list(), threshold, shared)

    def frame(out: list) -> pd.DataFrame:
        a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.int64)
        b = np.concatenate([y for _, y in out]) if out else np.empty(0, np.int64)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        out: list = []
        for batch in batches:
            if not len(batch):
                continue
            # a list may go on in the next batch: keep the rows of the last one
            last = (batch["tok"].iloc[-1], batch["blk"].iloc[-1])
            same = ((batch["tok"] == last[0]) & (batch["blk"] == last[1])).to_numpy()
            at = int(np.argmax(same)) if same.any() else len(batch)
            if parts and at:
                parts.append(batch.iloc[:at])
                flush(parts, out)
                parts = [batch.iloc[at:]]
            elif at:
                flush([batch.iloc[:at]], out)
                parts = [batch.iloc[at:]]
            else:
                parts.append(batch)
            if sum(len(x) for x, _ in out) > 500_000:
                yield frame(out)
                out = []
        if parts:
            flush(parts, out)
        yield frame(out)

    return run


def _shared(later_a: list[bytes], later_b: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs can be similar by the prefixes of orders 1 and 2.

    With c tokens shared by two prefixes of one order, a pair shares at most c
    and the longer of the two rests behind the prefixes. The odd words are told
    by order 1, the even ones by order 2, so the pair's odd and even words
    together are bounded by both orders at once. A pair stays if each bound
    reaches the number of words it must share. 16 bits may take different
    words for one, which can only keep a pair.
    """
    m = len(later_a)
    heads = np.frombuffer(b"".join(x[:12] for side in (later_a, later_b) for x in side), "<i4").astype(np.int64).reshape(2, m, 3)
    n, odd, size = heads[:, :, 0], heads[:, :, 1], heads[:, :, 2]
    need = _need(threshold, n[0], n[1])
    keep, together = np.ones(m, bool), np.zeros(m, np.int64)
    for k, of_class in ((0, odd), (1, n - odd)):
        flat, pair = [], []
        for side, texts in enumerate((later_a, later_b)):
            at = [(12 + 2 * z * k, 12 + 2 * z * (k + 1)) for z in size[side].tolist()]
            flat.append(np.frombuffer(b"".join(x[a:b] for x, (a, b) in zip(texts, at, strict=True)), "<u2").astype(np.int64))
            pair.append(np.repeat(np.arange(m), size[side]))
        hit = np.isin(pair[0] << 16 | flat[0], pair[1] << 16 | flat[1])
        keep &= np.bincount(pair[0][hit], minlength=m) + (n - size).max(axis=0) >= need
        own = [(f & 1) == 1 - k for f in flat]
        rest = of_class - np.stack([np.bincount(p[o], minlength=m) for p, o in zip(pair, own, strict=True)])
        together += np.bincount(pair[0][hit & own[0]], minlength=m) + rest.max(axis=0)
    return keep & (together >= need)


def similar_classes(texts: DataFrame, id_col: str, columns: list[str], threshold: float = 0.8, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, similarity) of class representatives, members (id, rep)).

    A class holds all texts with one word set; its representative is the
    least id. The word set is the distinct runs of a-z and 0-9 of the
    lower-cased columns joined by blanks (null counts as empty). All pairs of
    different word sets with Jaccard similarity of at least ``threshold`` come
    out, by filters over several global token orders, with prefixes longer
    than the plain one by ``shared`` - 1 and LATER - 1 tokens:

    * posting lists of the rare-first order give the pairs that share at least
      ``shared`` tokens of its prefixes (fewer where the pair need not share
      that many at all);
    * of these keys those remain that also share enough tokens of the prefixes
      under two further orders, odd hashes first and even hashes first; the
      prefixes are looked up by key, so that the many pairs that only these
      two orders would bring are never listed.

    Only pairs left by all orders fetch the whole word sets and are verified. Words are
    ranked by counts over all texts; only the frequent ones (a number bounded
    by the mean text length, not by the number of texts) are told to the
    tasks, the others are equally rare and ordered by hash. A posting list of
    a frequent token is cut into blocks and every pair of blocks meets
    separately, so no list gathers in one task. Empty word sets (null or blank
    texts) form one class and are similar to nothing else; rows that repeat an
    id count once; a null id is left out; other columns are ignored.
    """
    sc = texts.sparkSession.sparkContext
    only = texts.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), *columns)
    n_texts = only.count()
    frequent = sc.broadcast(frequent_words(only.select(*columns), n_texts))
    every = cut(prefixes(only, id_col, frequent, threshold, shared))
    ranked = every.groupBy("c1", "c2", "n").agg(F.min(F.struct("id", "prefix", "freq", "later")).alias("r")).select("c1", "c2", "n", "r.*")
    reps = ranked.filter("n > 0")
    lists = reps.select("id", "n", "prefix", "freq").mapInPandas(_postings(threshold, BLOCK), "tok int, blk int, rec long, n int, pos int, rest binary")
    # tasks of one size at any number of texts
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_texts // TEXTS_PER_TASK)
    found = lists.repartition(tasks, "tok", "blk").sortWithinPartitions("tok", "blk").mapInPandas(_candidates(threshold, shared), "a long, b long")
    pairs = cut(found.distinct())

    small = pairs.count() * 2 <= ID_BOUND

    def with_ends(of: DataFrame, table: DataFrame, column: Column, name: str) -> DataFrame:
        """Pairs with a column of both ends; only rows that are some pair's end are shuffled."""
        ids = of.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ends = table.join(F.broadcast(ids) if small else ids, "id", "left_semi").select("id", column.alias(name)).dropDuplicates(["id"])
        for c in ("a", "b"):
            of = of.join(ends.toDF(c, f"{name}_{c}"), c)
        return of

    @F.pandas_udf("boolean")
    def all_orders(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_shared(x.to_list(), y.to_list(), threshold) if len(x) else np.empty(0, bool))

    left = cut(with_ends(pairs, reps, F.col("later"), "later").filter(all_orders("later_a", "later_b")).select("a", "b"))
    drop_cut(pairs)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])), F.lit("[a-z0-9]+"), 0))
    inter = F.size(F.array_intersect("t_a", "t_b"))
    sim = inter / (F.size("t_a") + F.size("t_b") - inter)
    checked = with_ends(left, only.withColumnRenamed(id_col, "id"), tokens, "t").select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= threshold)
    member = every.select("id", "c1", "c2", "n").distinct()
    members = member.join(member.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep")), ["c1", "c2", "n"]).select("id", "rep")
    return checked, members


def similar_pairs(texts: DataFrame, id_col: str, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """(a, b) of all similar texts, a < b, classes expanded to their members."""
    pairs, members = similar_classes(texts, id_col, columns, threshold)
    pairs, members = cut(pairs.select("a", "b")), cut(members)
    # only classes of several texts need expanding
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    more = cut(members.join(several, "rep").withColumn("parts", F.ceil(F.col("k") / MEMBERS).cast("int")))
    side = pairs
    for c in ("a", "b"):
        side = side.join(more.select(F.col("rep").alias(c), F.col("id").alias(f"{c}2")), c, "left")
        side = side.select(*[x for x in side.columns if x not in (c, f"{c}2")], F.coalesce(f"{c}2", c).alias(c))
    across = side.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a large class meets itself in parts: one side is in its own part, the other in all
    one = more.select("rep", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    all_ = more.select("rep", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    inside = one.join(all_, ["rep", "part"]).filter("a < b").select("a", "b")
    return across.unionByName(inside)


def similar_groups(texts: DataFrame, id_col: str, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """(id, class_id, group_id, links): every text with its class, the least id linked to it directly or through others, and its class's number of similar classes."""
    pairs, members = similar_classes(texts, id_col, columns, threshold)
    pairs = cut(pairs.select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    roots = hash_to_min(pairs).toDF("rep", "root")
    got = members.join(links, "rep", "left").join(roots, "rep", "left")
    return got.select("id", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
