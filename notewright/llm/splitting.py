"""Splitting oversized chunks at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys

#: Chunks that one row holds at most beside its text, and lines of a text that a row of a source with more chunks covers.
PER_ROW, LINES = 400, 2000

_WORD = re.compile(r"[^ \t\n\r\f]+")
_HEADING = re.compile(r"\f?\s*(#{1,6} .{1,90}|(?i:chapter|chapitre|kapitel|cap[íi]tulo|capitolo)\s+[0-9]+(?:[.:]?|\b.{0,89}[^.,;:\s])|[0-9]{1,2}(?:\.[0-9]{1,2})*\.?\s+[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^.;:]{1,70})\s*")
MAX_HEADING = 110

#: Weights of boundaries: a piece ends at the strongest kind found in the last part of its room.
BLANK, LINE, SENTENCE = 3, 2, 1
#: What a sentence ends with, and what may stand behind its full stop.
_STOPS, _CLOSING = np.array([ord(c) for c in ".!?…。"], np.uint32), np.array([ord(c) for c in "”\")"], np.uint32)


def headings(lines: list[str]) -> list[tuple[int, str]]:
    """(place, label) of the lines that read as headings."""
    return [(k, x.strip().lstrip("#").strip()) for k, x in enumerate(lines) if len(x) <= MAX_HEADING and _HEADING.fullmatch(x)]


class SourceText:
    """Word offsets of the lines of a source from ``first_line`` on, computed once for all chunks in them.

    ``before`` is the last heading above these lines.
    """

    def __init__(self, raw: str, first_line: int = 1, before: str | None = None) -> None:
        self.raw, self.lines, self.first, self.before = raw, raw.split("\n"), first_line, before
        spans = [m.span() for m in _WORD.finditer(raw)]
        self.start, self.end = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        lens = np.fromiter((len(x) + 1 for x in self.lines), np.int64, len(self.lines))
        self.line_at = np.concatenate(([0], np.cumsum(lens)))  # offset of each line
        self.words_before = np.searchsorted(self.start, self.line_at)  # words before each line
        self.kinds: np.ndarray | None = None
        self.heads: list[tuple[int, str]] | None = None

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Words [a, b) of the source's lines first to last, 1-based and inclusive, as far as they exist."""
        n = len(self.lines)
        lo, hi = max(first - self.first, 0), min(max(last - self.first + 1, 0), n)
        return (0, 0) if lo >= hi else (int(self.words_before[lo]), int(self.words_before[hi]))

    def line_of(self, word: int) -> int:
        return int(np.searchsorted(self.line_at, self.start[word], side="right")) + self.first - 1

    def head_words(self) -> list[tuple[int, str]]:
        """(first word, label) of the headings."""
        if self.heads is None:
            self.heads = [(int(self.words_before[k]), label) for k, label in headings(self.lines)]
        return self.heads

    def boundaries(self) -> np.ndarray:
        """The strongest natural boundary before each word; 0 is none."""
        if self.kinds is None:
            n = len(self.start)
            kinds = np.zeros(n + 1, dtype=np.int8)
            if n > 1:
                code = np.frombuffer(self.raw.encode("utf-32-le", "surrogatepass"), np.uint32)
                feeds = np.concatenate(([0], np.cumsum(code == 10)))
                pages = np.concatenate(([0], np.cumsum(code == 12)))
                gap, to = self.end[:-1], self.start[1:]
                lines = feeds[to] - feeds[gap]
                last = code[gap - 1]
                prev = np.where(gap - 2 >= self.start[:-1], code[np.maximum(gap - 2, 0)], 0)
                ends = np.isin(last, _STOPS) | (np.isin(last, _CLOSING) & (prev == ord(".")))
                kinds[1:n] = np.where((lines > 1) | (pages[to] > pages[gap]), BLANK, np.where(ends, np.where(lines > 0, LINE, SENTENCE), 0))
            # a heading's line begins a piece
            for word, _ in self.head_words():
                if word < n:
                    kinds[word] = BLANK
            self.kinds = kinds
        return self.kinds

    def label(self, word: int, end: int) -> str | None:
        """The last heading up to the piece's first word, else the first inside it."""
        heads = self.head_words()
        i = bisect_right(heads, word, key=lambda h: h[0])
        if i or self.before:
            return heads[i - 1][1] if i else self.before
        return heads[0][1] if heads and heads[0][0] < end else None


def cut_points(kinds: np.ndarray, a: int, b: int, limit: int, overlap: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, natural) of pieces covering words [a, b), each of at most ``limit`` words.

    Offsets of the boundaries of each kind are sorted; the last one under the
    limit is found by binary search, first among the strongest kind in the
    second half of the room, then the weaker ones there, then any in the first
    half that still advances; without one the cut is hard, at the limit. The
    next piece starts exactly ``overlap`` words before the end. An overlap of
    the limit or more would never advance: it becomes the limit less one word.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    by_kind = [a + np.flatnonzero(kinds[a:b] >= k) for k in (BLANK, LINE, SENTENCE)]
    s = a
    while b - s > limit:
        room, end = s + limit, None
        for least in (s + max(limit // 2, overlap), s + overlap):
            for offsets in by_kind:
                i = int(np.searchsorted(offsets, room, side="right")) - 1
                if i >= 0 and offsets[i] > least:
                    end = int(offsets[i])
                    break
            if end is not None:
                break
        yield s, end or room, end is not None
        s = (end or room) - overlap
    yield s, b, True


_SCHEMA = (
    "id int, source string, chunk_words int, max_words int, piece int, start_word int, end_word int, "
    "start_line int, end_line int, words int, overlap int, label string, natural boolean, text string"
)


def _int(v) -> int | None:
    return None if v is None or v != v else int(v)


def _pieces_of(text: SourceText, chunk: dict, source: str | None, limit: int | None, overlap: int, with_text: bool) -> Iterator[tuple]:
    first, last = _int(chunk["start_line"]), _int(chunk["end_line"])
    a, b = (0, 0) if first is None or last is None else text.span(first, last)
    n = b - a
    cuts = [(a, b, True)] if limit is None or n <= limit else cut_points(text.boundaries(), a, b, limit, overlap)
    done = a
    for k, (s, e, natural) in enumerate(cuts):
        lines = (text.line_of(s), text.line_of(e - 1)) if e > s else (first, last)
        label = (text.label(s, e) if e > s else None) or (chunk["label"] or "").strip() or f"lines {lines[0]}-{lines[1]}"
        body = (text.raw[text.start[s] : text.end[e - 1]] if e > s else "") if with_text else None
        yield chunk["id"], source, n, limit, k, s - a, e - a, *lines, e - s, done - s, label, natural, body
        done = e


def _segments(texts: DataFrame, wanted: DataFrame, n_lines: int) -> DataFrame:
    """(source, seg, part, raw, first_line, before, format): the lines that the chunks of each segment cover, and the last heading above them.

    A segment is ``n_lines`` lines of a source; its text goes on to the last line of
    the chunks that begin in it. Every part of a segment gets a copy.
    """
    schema = "source string, format string, seg int, part int, raw string, first_line int, before string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, raw, fmt, segs in zip(batch["source"], batch["raw"], batch["format"], batch["segs"], strict=True):
                lines = (raw or "").split("\n")
                heads = headings(lines)
                for g in segs:
                    first = g["seg"] * n_lines
                    i = bisect_right(heads, first - 1, key=lambda h: h[0])
                    text, before = "\n".join(lines[first : g["last"]]), heads[i - 1][1] if i else None
                    yield pd.DataFrame([(source, fmt, g["seg"], part, text, first + 1, before) for part in range(g["parts"])], columns=[x.split()[0] for x in schema.split(", ")])

    return texts.join(wanted, "source").select("source", "raw", "format", "segs").mapInPandas(run, schema)


def split_chunks(chunks: DataFrame, raw_sources: DataFrame, limits: DataFrame, with_text: bool = True, per_row: int = PER_ROW, n_lines: int = LINES) -> DataFrame:
    """Pieces of all chunks, none with more words than ``max_words`` of its source's format.

    start_word and end_word count from the chunk's first word (end exclusive),
    lines from the source's. Chunks within the limit come out as one piece, as
    do chunks of a format without a limit. ``overlap`` counts the words a piece
    shares with the one before: what the format asks, unless that is the limit
    or more. ``label`` is the nearest heading, else the chunk's label, else
    ``lines a-b``; ``words`` is counted, not taken from the input. Copies of a
    chunk or source count once. A chunk of a null or unknown source, or without
    lines inside the text, has no words and comes out as one empty piece.

    A source with up to ``per_row`` chunks is read once, with all of them. One
    with more is cut into segments of ``n_lines`` lines; chunks go to the segment
    they begin in, in parts of about ``per_row``, so that work grows with the
    text and the chunks, not with their product, and no source gathers in one
    task.
    """
    one = chunks.filter("id is not null").select("id", "source", "label", "start_line", "end_line").groupBy("id").agg(
        *[F.max(F.struct("source", "label", "start_line", "end_line")).alias("c")]
    ).select("id", "c.*")
    per = one.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("source is not null")
    large = hot_keys(per, ["source"], rows=per_row + 1, share=0.0)
    texts = raw_sources.filter("slug is not null").groupBy(F.col("slug").alias("source")).agg(F.max(F.struct("raw", "format")).alias("t"))
    texts = texts.select("source", F.col("t.raw").alias("raw"), F.col("t.format").alias("format"))
    small = limits.groupBy("format").agg(F.min("max_words").alias("max_words"), F.max("overlap_words").alias("overlap_words"))
    packed = F.collect_list(F.struct("id", "label", "start_line", "end_line")).alias("chunks")
    columns = ["source", "raw", "first_line", "before", "chunks", "format"]

    few = one if large is None else one.join(large, "source", "left_anti")
    # a chunk without a source meets no text: its own row each
    grouped = few.groupBy("source", F.when(F.col("source").isNull(), F.col("id")).alias("bucket")).agg(packed)
    full = grouped.join(texts, "source", "left").withColumns({"first_line": F.lit(1), "before": F.lit(None).cast("string")}).select(*columns)
    if large is not None:
        begin = F.floor((F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)) - 1) / n_lines).cast("int")
        many = one.join(large, "source", "left_semi").withColumn("seg", begin)
        last = F.when(F.col("start_line").isNotNull(), F.col("end_line"))
        sized = many.groupBy("source", "seg").agg(F.max(F.coalesce(last, F.lit(0))).alias("last"), F.ceil(F.count(F.lit(1)) / per_row).cast("int").alias("parts"))
        wanted = sized.groupBy("source").agg(F.collect_list(F.struct("seg", "last", "parts")).alias("segs"))  # one entry for n_lines lines
        # the parts of a segment that holds many chunks, as many as it needs
        placed = many.join(sized.select("source", "seg", "parts"), ["source", "seg"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        by_part = placed.groupBy("source", "seg", "part").agg(packed)
        full = full.unionByName(by_part.join(_segments(texts, wanted, n_lines), ["source", "seg", "part"], "left").withColumn("first_line", F.coalesce("first_line", F.lit(1))).select(*columns))
    full = full.join(small, "format", "left").select("source", "raw", "first_line", "before", "chunks", "max_words", "overlap_words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for source, raw, first, before, group, limit, overlap in batch.itertuples(index=False, name=None):
                text = SourceText(raw or "", first, before)
                for c in group:
                    out += _pieces_of(text, c, source, _int(limit), _int(overlap) or 0, with_text)
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return full.mapInPandas(run, _SCHEMA)


def oversized(chunks: DataFrame, raw_sources: DataFrame, limits: DataFrame) -> DataFrame:
    """ids of chunks that had to be split."""
    return split_chunks(chunks, raw_sources, limits, with_text=False).filter("chunk_words > max_words").select("id").distinct()
