"""Results that are whole: nothing is left out that the operators promise."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from notewright.operators import model_loops as ml, notes as nt
from notewright.plans import bundle_queries as bq, work_queries as wq
from test_core import NOTE, SOURCE, _note


def _norm(text):
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def test_ground_compatibility_characters(spark):
    """Against brute force: full-width letters, ligatures, sharp s, decomposed accents, over page ends."""
    r = random.Random(5)
    pieces = ["ﬁnd", "find", "ＡＢＣ", "abc", "Straße", "STRASSE", "caf\u00e9", "cafe\u0301", "ſ", "s", "İ", "Ⅷ", "viii", "´", "　", "\f", "\n\f ", "😀", "Σς"]
    raw = " ".join(r.choice(pieces) for _ in range(200))
    quotes = [" ".join(r.choice(pieces) for _ in range(r.randint(1, 3))) for _ in range(150)] + ["", " 　", "nowhere", "ABC"]
    notes = spark.createDataFrame([_note(i, f"n{i}", (q,)) for i, q in enumerate(quotes)], NOTE)
    got = {g.ord: (g.at, g.page) for g in nt.ground(notes, spark.createDataFrame([("s", "Book", None, raw)], SOURCE)).collect()}
    text, starts, at = _norm(raw), [], 1
    for k, p in enumerate(raw.split("\f"), 1):
        if n := _norm(p):
            starts.append((at, k))
            at += len(n) + 1
    assert len(got) == len(quotes)
    for i, q in enumerate(quotes):
        at = text.find(_norm(q)) + 1 if _norm(q) else 0
        assert got[i] == ((at, max(k for s, k in starts if s <= at)) if at else (None, None)), q


RAW = "slug string, title string, format string, page_offset int, source_filename string, raw string, loaded_at timestamp, deleted_at timestamp"


def _write(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def _raw(slug, raw, format_="txt"):
    return (slug, "T", format_, None, f"{slug}.{format_}", raw, None, None)


def test_cover_has_every_heading(spark, tmp_path):
    """Large chapter numbers and gaps between them; a plain anti-join has the same."""
    raw = "\n".join(f"Chapter {n} Topic {w}" for n, w in ((1, "One"), (2, "Known"), (9, "Gap"), (61, "Far"), (401, "Farthest")))
    d = _write(spark, tmp_path, raw_sources=([_raw("s", raw)], RAW), notes=([_note(1, "topic-known")], NOTE))
    assert sorted(r.slug for r in wq.cover_notes(spark, d).collect()) == ["topic-far", "topic-farthest", "topic-gap", "topic-one"]


def test_every_note_is_judged(spark, tmp_path):
    quote = "alpha beta gamma"
    d = _write(spark, tmp_path, notes=([_note(i, f"n{i}", (quote,), body=quote) for i in range(15)], NOTE))
    assert [(r.total, r.supported, r.faithfulness) for r in wq.verdict_tally(spark, d).collect()] == [(15, 15, 1.0)]


def test_missing_verdict_is_unsupported(spark):
    expected = spark.createDataFrame([("v", i) for i in range(4)], "vault string, ord long")
    verdicts = spark.createDataFrame([("v", 0, "supported"), ("v", 1, "overreach")], "vault string, ord long, verdict string")
    r = ml.tally(expected, verdicts, ["vault", "ord"]).first()
    assert (r.total, r.supported, r.overreach, r.unsupported, r.faithfulness) == (4, 1, 1, 2, 0.25)


def test_readers_run_on_every_source(spark, tmp_path):
    d = _write(spark, tmp_path, raw_sources=([_raw("a", "R&amp;D &lt;x", "html"), _raw("b", "<p>hi</p>", "html"), _raw("c", "{plain}", "rtf"), _raw("d", "{\\rtf1 x}", "rtf")], RAW))
    assert {r.slug: r.text for r in wq.html_to_text(spark, d).collect()} == {"a": "R&D <x", "b": "\nhi", "c": "{plain}", "d": "{\\rtf1 x}"}
    assert {r.slug: r.text for r in wq.rtf_to_text(spark, d).collect()} == {"a": "R&amp;D &lt;x", "b": "<p>hi</p>", "c": "plain", "d": "x"}


def test_indexes_list_every_file(spark, tmp_path):
    """Oddly written, unknown and null types: each note's file stands in the index of its folder."""
    types = ["Concept", "concept", "METHOD", "antiPattern", "gadget", None]
    notes = [_note(i, f"n{i}x", type_=t) for i, t in enumerate(types)] + [_note(8, "two", type_="Entity"), _note(9, "two", type_="method")]
    d = _write(spark, tmp_path, raw_sources=([_raw("s", "alpha beta gamma")], RAW), notes=(notes, NOTE))
    files = {r.rel for r in bq.rendered_notes(spark, d).collect()}
    listed = {x for r in bq.section_indexes(spark, d).collect() for x in re.findall(r"\]\(/([^)]*)\)", r.text)}
    assert listed == files and {"concepts/n1x.md", "methods/n2x.md", "anti-patterns/n3x.md", "concepts/n4x.md", "concepts/n5x.md", "methods/two.md"} < files


def test_gold_has_all_partners(spark, tmp_path):
    """A hub of many partners, partners that stand on one side only, repeated, reversed and self pairs; against brute force."""
    pairs = [("hub", f"p{i}") for i in range(5)] + [("p9", "hub"), ("p1", "hub"), ("hub", "p1"), ("solo", "solo"), ("x", "y")]
    matches = [(i, "v", a, b, True) for i, (a, b) in enumerate(pairs)] + [(90, "v", "no", "x", False), (91, "v", None, "x", True)]
    notes = [_note(1, "p4", related=["p9"]), _note(2, "p9"), _note(3, "x", related=["p4", "y"]), _note(4, "y"), _note(5, "solo")]
    d = _write(spark, tmp_path, note_matches=(matches, "match_id long, vault string, slug_a string, slug_b string, same boolean"), notes=(notes, NOTE))
    slugs, edges = {n[3] for n in notes}, {frozenset(e) for e in (("p4", "p9"), ("x", "p4"), ("x", "y"))}
    partners = {}
    for a, b in pairs:
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    note = {c: next((k for k in [c, *sorted(ks - {c})] if k in slugs), None) for c, ks in partners.items()}
    links = {frozenset(p) for p in pairs}
    g, r = bq.gold_recall(spark, d).first(), bq.link_recall(spark, d).first()
    assert (g.found, g.concepts) == (sum(v is not None for v in note.values()), len(note)) == (6, 10)
    assert (r.linked, r.links) == (sum({note[k] for k in e} in edges for e in links), len(links)) == (2, 8)
