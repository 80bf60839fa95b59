"""Extraction metadata, figures, archives and gates."""

from pyspark.sql import functions as F

from notewright.operators import provenance as pv
from notewright.session import clear_cuts, cut
from notewright.sources import files as fs


def test_metadata(spark):
    rows = spark.createDataFrame([("d/a.txt", b"Chapter 1 One\nsome words here", 2_500_000), ("b.html", b"<p>x</p>", 1), ("c.bin", b"?", 1)], "path string, content binary, length long")
    got = {r.filename: r for r in pv.metadata(fs.extracted(rows), rows).collect()}
    assert set(got) == {"a.txt", "b.html"}
    a = got["a.txt"]
    assert (a.format, a.extraction_method, a.extraction_mode, a.file_size_mb, a.unit, a.words, a.estimated_tokens, a.chapters_detected, a.has_toc) == ("text", "plain", "text", 2.38, "sections", 6, 8, 1, False)
    assert len(a.sha256) == 64


def test_modes_and_figures(spark):
    df = spark.createDataFrame([("pdf", "technical", "pypdf"), ("pdf", "technical", "docling"), ("epub", "technical", "zipfile")], "f string, r string, m string")
    assert [r.x for r in df.select(pv.recorded_mode(F.col("f"), F.col("r"), F.col("m")).alias("x")).collect()] == ["text", "technical", "technical"]
    docs = spark.createDataFrame([(1, [(" cap ", [(3,)], ["chart"], None), ("", [(4,)], None, None), ("two", None, [], ["photo"]), None]), (2, None)],
                                 "doc_id int, pictures array<struct<caption string, prov array<struct<page_no int>>, classes array<string>, annotations array<string>>>")
    assert [tuple(r) for r in pv.figures(docs).orderBy("pos").collect()] == [(1, 0, 3, "cap", "chart"), (1, 2, 0, "two", "photo")]


def test_upsert_and_backfill(spark):
    base, fresh = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, x int"), spark.createDataFrame([("b", 3), ("c", 4)], "slug string, x int")
    assert sorted(map(tuple, pv.upsert(base, fresh, "slug").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    slugs = spark.createDataFrame([("clean-code",), ("done-book",)], "slug string")
    got = pv.backfill(slugs, slugs.filter("slug = 'done-book'"), spark.createDataFrame([("Clean Code.pdf",), ("Done Book.pdf",)], "name string")).collect()
    assert [(r.slug, r.source) for r in got] == [("clean-code", "Clean Code.pdf")]


def test_remap_files(spark):
    files = spark.createDataFrame([("v", "a.md", "[Ch 1, p.9] [Ch 2, p.3]"), ("w", "b.md", "[Ch 1, p.9] [Ch 1, p.2 (pdf)]")], "bundle string, rel string, text string")
    got = {r.rel: (r.text, r.changed) for r in pv.remap_files(files, spark.createDataFrame([("v", 4)], "bundle string, page_offset int")).collect()}
    assert got == {"a.md": ("[Ch 1, p.5] [Ch 2, p.1]", 2), "b.md": ("[Ch 1, p.9 (pdf)] [Ch 1, p.2 (pdf)]", 1)}


def test_names_and_quotes(spark):
    notes = spark.createDataFrame([(1, "v", "A b", "T", ["x y"], "established"), (2, "v", "a-b", "U", None, "contested"), (3, "v", None, None, None, None)], "ord int, vault string, slug string, title string, aliases array<string>, status string")
    assert [tuple(r) for r in pv.contested(notes).collect()] == [("v", "a-b", True)]
    asked = spark.createDataFrame([("v", "new", "X  Y!"), ("v", "other", "none"), ("w", "a-b", "T")], "vault string, slug string, title string")
    assert [tuple(r) for r in pv.taken_names(notes, asked).collect()] == [("v", "new", 1)]
    files = spark.createDataFrame([("v", "a.md", '[Ch 1] "in it" and [Ch 2, p.3] "not there"')], "bundle string, rel string, text string")
    assert [r.quote for r in pv.ungrounded_quotes(files, spark.createDataFrame([("v", "it is in it.")], "bundle string, line string")).collect()] == ["not there"]


def test_gates_and_cuts(spark):
    df = spark.createDataFrame([(1, 0, "", 0), (0, 2, "py", 3)], "rules int, code_blocks int, language string, figures int")
    assert [(r.reviewable, r.scaffold, r.with_figures) for r in pv.gates(df).collect()] == [(True, False, False), (False, True, True)]
    assert df.select(pv.page_anchored(F.lit("pypdf"), F.lit(True)).alias("x")).first().x
    assert cut(df).count() == 2
    clear_cuts(spark)
