"""Splitting of sources with many chunks, headings and overlaps."""

import itertools
import random

import numpy as np
import pytest

from notewright.llm import splitting


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(8)
    raw = "\n".join(rnd.choice(("", "Chapter 3 Winds", "2.1 Tides", "a few words. of one line", "more words here, and more.", "x " * 30)) for _ in range(120))
    rows = [(i, rnd.choice(("big", "big", "big", "small")), None, rnd.randint(-2, 125), rnd.randint(0, 130)) for i in range(200)]
    rows += [(900, "big", "own", 1, 120), (901, "big", "own", None, 5), (902, None, "own", 1, 2), (903, "big", "own", 10**6, 10**6 + 5)]
    chunks = spark.createDataFrame(rows, "id int, source string, label string, start_line int, end_line int")
    sources = spark.createDataFrame([("big", "pdf", raw), ("small", "txt", raw[:400])], "slug string, format string, raw string")
    limits = spark.createDataFrame([("pdf", 40, 7), ("txt", 25, 20)], "format string, max_words int, overlap_words int")
    return chunks, sources, limits


@pytest.mark.parametrize("per_row,n_lines", [(1, 1), (3, 7), (10, 50), (50, 1000)])
def test_segments_give_the_same_pieces(tables, per_row, n_lines):
    want = splitting.split_chunks(*tables).orderBy("id", "piece").collect()
    got = splitting.split_chunks(*tables, per_row=per_row, n_lines=n_lines).orderBy("id", "piece").collect()
    assert len(want) > 400 and got == want


def test_overlap_is_what_the_format_asks(tables):
    for _, pieces in itertools.groupby(splitting.split_chunks(*tables).orderBy("id", "piece").collect(), lambda r: r.id):
        pieces = list(pieces)
        assert pieces[0].overlap == 0 and all(p.overlap == (7 if p.source == "big" else 20) for p in pieces[1:])
        assert all(b.start_word == a.end_word - b.overlap for a, b in itertools.pairwise(pieces))


def test_overlap_of_the_limit_or_more():
    pieces = list(splitting.cut_points(np.zeros(20, np.int8), 0, 12, 4, 9))
    assert pieces[0] == (0, 4, False) and all(b[0] == a[1] - 3 for a, b in itertools.pairwise(pieces)) and pieces[-1][1] == 12


def test_headings():
    heads = ["Chapter 12 The Fall", "CHAPTER 2", "kapitel 4 Wind", "1.2 Ärzte und Kranke", "# Title", "3. Обзор темы", "\f2.1 Tides", "Chapter 5."]
    prose = ["12 monkeys ate the fruit", "3 of them were late", "chapters 3 and 4", "1.5 litres of milk", "7 × 8 is 56", "Chapter one", "2. Wait; then go", "chapter 3 of it says so."]
    assert [label for _, label in splitting.headings(heads)] == ["Chapter 12 The Fall", "CHAPTER 2", "kapitel 4 Wind", "1.2 Ärzte und Kranke", "Title", "3. Обзор темы", "2.1 Tides", "Chapter 5."]
    assert splitting.headings(prose) == []


def test_boundaries_brute():
    rnd = random.Random(2)
    for _ in range(200):
        raw = "".join(rnd.choice(["a", "b.", " ", "\n", "\n\n", "\f", ".”", ')', "!", "\t", "x…", '."', "é", "😀?"]) for _ in range(rnd.randint(0, 60)))
        t = splitting.SourceText(raw)
        want = np.zeros(len(t.start) + 1, np.int8)
        for i in range(len(t.start) - 1):
            gap, word = raw[t.end[i] : t.start[i + 1]], raw[t.start[i] : t.end[i]]
            if gap.count("\n") > 1 or "\f" in gap:
                want[i + 1] = splitting.BLANK
            elif word.endswith((".", "!", "?", "…", ".”", '."', ".)", "。")):
                want[i + 1] = splitting.LINE if "\n" in gap else splitting.SENTENCE
        for word, _ in t.head_words():
            if word < len(t.start):
                want[word] = splitting.BLANK
        assert (t.boundaries() == want).all()
