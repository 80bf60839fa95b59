"""References that nothing valid answers."""

from datetime import datetime as dt

import pytest

from notewright.operators.orphans import vault_orphans
from notewright.operators.skew import hot_keys, join_by_key

NOTES = "ord long, vault string, slug string, aliases array<string>, related array<string>, loaded_at timestamp, deleted_at timestamp, period string, ref string"
FINDINGS = "finding_id long, vault string, category string, loaded_at timestamp, n int"
CATEGORIES = "category string, added_at timestamp, retired_at timestamp"


def note(ord_, vault, slug, aliases, related, loaded, deleted=None):
    return (ord_, vault, slug, aliases, related, loaded, deleted, "x", "y")


def run(spark, notes, findings, categories, hot_rows):
    got = vault_orphans(spark.createDataFrame(notes, NOTES), spark.createDataFrame(findings, FINDINGS), spark.createDataFrame(categories, CATEGORIES), hot_rows)
    return sorted(tuple(r) for r in got[0].collect()), {(r.table_name, r.period): r.orphans for r in got[1].collect()}


@pytest.mark.parametrize("hot_rows", [10**9, 1])
def test_orphans(spark, hot_rows):
    jan, feb = dt(2024, 1, 10), dt(2024, 2, 1)
    notes = [
        note(1, "v", "Alpha Note", ["The A"], ["beta", "the-a!", "", None, "--"], jan),
        note(2, "v", "beta", None, None, feb),  # arrives when the month is over
        note(3, "v", "gamma", [], ["ALPHA  note", "delta"], jan, feb),  # deleted exactly at the month's end: still valid in it
        note(3, "v", "gamma", [], ["ALPHA  note", "delta"], feb, dt(2024, 3, 1)),  # a copy
        note(4, "v", "x", [], ["gamma", "beta"], feb),
        note(5, "w", "y", [], ["beta"], jan),  # another vault
        note(6, None, "z", [], ["z", "beta"], jan),
        note(7, "v", "u", [], ["u"], None),
    ]
    findings = [(1, "v", "Missing_Type", jan, 0), (2, "v", "old", feb, 0), (3, "v", None, jan, 0), (4, "v", "old", jan, 0), (4, "v", "old", feb, 0), (5, None, "nope", feb, 0)]
    categories = [("missing-type", dt(2023, 1, 1), None), ("old", dt(2023, 1, 1), feb), ("old", dt(2024, 6, 1), None), (None, jan, None)]
    rows, counts = run(spark, notes, findings, categories, hot_rows)
    assert rows == [
        ("findings", "2024-02", 2, "old"), ("findings", "2024-02", 5, "nope"),
        ("notes", "2024-01", 1, "beta"), ("notes", "2024-01", 3, "delta"), ("notes", "2024-01", 5, "beta"), ("notes", "2024-01", 6, "beta"), ("notes", "2024-02", 4, "gamma"),
    ]
    assert counts == {("findings", "2024-02"): 2, ("notes", "2024-01"): 4, ("notes", "2024-02"): 1}


def test_empty(spark):
    assert run(spark, [], [], [], 10**9) == ([], {})


def test_hot_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 0), (None, 0)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, y string")
    hot = hot_keys(left.groupBy("k").count(), ["k"], "count", rows=50)
    assert [r.k for r in hot.collect()] == [1]
    assert join_by_key(left, right, ["k"], "inner", hot).count() == 91
    assert join_by_key(left, right, ["k"], "left", hot).count() == 92
