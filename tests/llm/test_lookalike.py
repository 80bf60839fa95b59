"""Characters of all of Unicode, and sources that hold most citations."""

import pytest

from notewright.llm import lookalike


@pytest.mark.parametrize("c", ["\U0001f130", "﹙", "︵", "㉐", "\U0001f14b", "ꟲ", "\U00010781", "²", "①", "½"])
def test_what_looks_different_stays_at_any_code(c):
    assert lookalike.canonical(f"a{c}b") == f"a{c}b"


@pytest.mark.parametrize("c,to", [("\U0001d400", "A"), ("Ａ", "A"), ("ﬁ", "fi"), ("\U0001d7d8", "0"), ("﹣", "-"), ("‐", "-"), (" ", " "), ("\U000e0041", "")])
def test_what_looks_the_same_goes_at_any_code(c, to):
    assert lookalike.canonical(f"a{c}b") == f"a{to}b"


@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_a_source_of_many_citations(spark, hot_rows):
    notes = spark.createDataFrame([(i, [(1, f"word {i % 50}", "big" if i % 3 else "small"), (1, "ｗord 7", "big")]) for i in range(60)], "ord long, citations array<struct<chapter int, quote string, source string>>")
    sources = spark.createDataFrame([("big", " ".join(f"word {i}" for i in range(40))), ("small", "no words")], "slug string, raw string")
    rows = lookalike.grounded(notes, sources, hot_rows=hot_rows).collect()
    assert len(rows) == 120 and {r.how for r in rows if r.pos == 1} == {"rewritten"}
    assert all(r.how == ("absent" if r.ord % 3 == 0 or r.ord % 50 >= 40 else "as_written") for r in rows if r.pos == 0)
