"""Readers, sinks, salted joins, vault files, JSON scans and runs around a model."""

import importlib
import io
import random
import re
import sys
import unicodedata
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from notewright import session
from notewright.functions.unicode_sql import nfkc_folded
from notewright.operators import bundle as bd, model_loops as ml, notes as nt, provenance as pv, reports as rp, skew, vault as vt
from notewright.sources import files as fs, vault_json as vj
from notewright.streaming.build import run_plan


@pytest.mark.parametrize("page,text", [
    ("a<p>b &amp;amp; c</p><br>d", "a\nb &amp; c\nd"), ("<style>p > a {x}</style>x<script>if (a < b) '</p>'</script>y", "xy"), ("<SCRIPT>never closed <p>", ""), ("<!-- <p>no --> 1 < 2 &lt;p>", " 1 < 2 <p>"),
    ('<div title="a > b">t</div>', "\nt"), ("<head><title>h</title></head><h2>T</h2>&eacute;", "\nTé"), ("", ""), ("<", "<"),
])
def test_html(page, text):
    assert fs.html_text(page) == text


@pytest.mark.parametrize("raw,text", [
    (r"{\rtf1\ansi Hello\par World\tab end}", "Hello\nWorld\tend"), (r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x;}Text}", "Text"), (r"a\u8217?b {\uc0\u233}c", "a’b éc"), (r"\{x\} 5\~m\_n \\ \'e9", "{x} 5 m-n \\  "),
    (r"\paragraph \partial x", "x"), ("plain\ntext", "plain\ntext"), (r"}}{{\b bold\b0 }", "bold"), ("", ""), (r"\u55357?\u56832?", ""), (r"{\uc2\u8217''x}y", "’xy"),
])
def test_rtf(raw, text):
    assert fs.rtf_text(raw) == text


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def test_epub_goes_by_the_spine():
    package = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml"/><item id="n" href="nav.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/></spine></package>'
    text = fs.epub_text(_zip({"O/x.opf": package, "O/a.xhtml": "<p>ONE", "O/b.xhtml": "<p>TWO", "O/nav.xhtml": "<p>NAV"}))
    assert text.split() == ["ONE", "TWO"]
    assert fs.epub_text(_zip({"z.html": "<p>Z", "a.html": "<p>A"})).split() == ["A", "Z"] and fs.epub_text(b"no zip") is None


def test_docx_tables():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    doc = f"<w:document {w}><w:body>{p('before')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('')}</w:tr></w:tbl>{p('')}{p('after')}</w:body></w:document>"
    assert fs.docx_text(_zip({"word/document.xml": doc})) == "before\na | b\nc | \nafter"


def test_write_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "x"), ("c.md", "é"), ("d.md", None)], "rel string, text string")
    for _ in range(2):
        fs.write_files(df, f"file://{tmp_path}/out")
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a/b.md": "x", "c.md": "é", "d.md": ""}
    for bad in ("../x.md", "/x.md", "a/../../x.md"):
        with pytest.raises(ValueError):
            fs.write_files(spark.createDataFrame([(bad, "x")], "rel string, text string"), str(tmp_path))


def test_plan_stream_by_uri(spark, tmp_path):
    plan, out = f"file:{tmp_path}/plan", f"file:{tmp_path}/out/"
    spark.range(6).withColumnRenamed("id", "id").write.parquet(plan)
    work = lambda df: df.withColumn("error", F.when(F.col("id") == 3, "bad"))
    for k in range(2):
        run_plan(spark, plan, out, f"file:{tmp_path}/ck{k}", work).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{out}done").collect()) == [0, 1, 2, 4, 5]
    assert session.exists(spark, f"{out}failed") and not session.exists(spark, f"{out}none")


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError):
        session.shared_dir(Fake())


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    every = set(entry.queries())
    monkeypatch.setitem(sys.modules, entry._LLM, None)
    core = set(importlib.reload(entry).queries())
    assert core <= every and {q.split("_")[0] for q in every - core} <= {f"p{n}" for n in range(2, 10)} and "p1_found" in core


@pytest.mark.parametrize("rows", [2, 10**9])
def test_salted_join(spark, rows):
    left = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), (None, 2), ("c", 3)], "k string, i int")
    right = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    per = left.groupBy("k").count().filter("k is not null").withColumnRenamed("count", "n")
    got = skew.salted_join(left, right, ["k"], per, ["i"], rows=rows)
    assert sorted(map(str, got.select("k", "i", "v").collect())) == sorted(map(str, left.join(right, "k", "left").select("k", "i", "v").collect()))


def test_sql_forms():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aBßéÉﬁ①Ａ ｋ́İıΣς²½ǅŒ​한Ⓐ㍿") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    con = duckdb.connect()
    con.execute("create table t (x varchar)")
    con.executemany("insert into t values (?)", [(x,) for x in texts])
    assert dict(con.sql(f"select x, {nfkc_folded('x')} from t").fetchall()) == {x: unicodedata.normalize("NFKC", x).casefold() for x in texts}


def test_match_files_below_the_threshold(spark):
    slugs = spark.createDataFrame([("red-fox-jumps-high-here",), ("blue-whale",), ("no-such",), ("",), (None,)], "slug string")
    files = spark.createDataFrame([("red fox.pdf",), ("blue whale.pdf",), ("whale blue.epub",), (None,)], "name string")
    got = {r.slug: (r.source, r.score, r.ambiguous) for r in nt.match_files(slugs.filter("slug is not null"), files.filter("name is not null")).collect()}
    assert got == {"red-fox-jumps-high-here": (None, 0.4, False), "blue-whale": (None, 1.0, True), "no-such": (None, 0.0, False), "": (None, 0.0, False)}


def test_ungrounded_quotes_brute(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))
    lines = [(rnd.choice("xy"), " ".join(word() for _ in range(rnd.randint(0, 8)))) for _ in range(40)]
    quotes = [(rnd.choice("xy"), (lambda t, a: t[a : a + rnd.randint(1, 9)])(rnd.choice(lines)[1] or "ab", rnd.randint(0, 5)) or "q") for _ in range(120)]
    files = [(b, f"{i}.md", f'- [Ch 1, p.2] "{q}" x\n[Ch 2] none') for i, (b, q) in enumerate(quotes)]
    got = {tuple(r) for r in pv.ungrounded_quotes(spark.createDataFrame(files, "bundle string, rel string, text string"), spark.createDataFrame(lines, "bundle string, line string")).collect()}
    assert got == {(b, f"{i}.md", q) for i, (b, q) in enumerate(quotes) if not any(x == b and q in line for x, line in lines)}


def _merged(spark, n=5):
    rows = [("v", f"n{i:02d}", ("Concept", "antipattern", None)[i % 3], f"T{i}", "d", "medium", "established", "body", [], [], [], [("s", 1, "q", "3")] if i % 2 else [("t", 1, "q", None)], 1 + i % 2, bool(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "vault string, slug string, type string, title string, description string, confidence string, status string, body string, tags array<string>, aliases array<string>, related array<string>, citations array<struct<source string, chapter int, quote string, folio string>>, occurrences long, merged boolean")


def test_vault_files(spark):
    sources = spark.createDataFrame([("v", "s", 'A "book"', ["X", "Y"], "pypdf", "h", "f.pdf", "raw/s.txt", 3), ("v", "t", None, None, None, None, None, None, None), ("w", "u", "U", ["Z"], "plain", "k", "g", "r", None)],
                                    "vault string, slug string, title string, authors array<string>, extraction_method string, source_sha256 string, source_filename string, raw_rel string, page_offset int")
    dropped = spark.createDataFrame([("v", 2, 1)], "vault string, citations long, notes long")
    m = _merged(spark)
    notes = bd.rendered(m, spark.createDataFrame([("v", "n00", "n01"), ("v", "n01", "n00")], "vault string, src string, dst string"), sources.select(F.col("slug").alias("source"), F.col("title").alias("source_title")), "2026-01-01T00:00:00Z")
    build = lambda page: {(r.bundle, r.rel): r.text for r in vt.assembled(notes, m, sources, dropped, "2026-01-01T00:00:00Z", page).collect()}
    files = build(100)
    assert files == build(100)  # the same again
    assert "# Anti Patterns\n\n- [T1](/anti-patterns/n01.md) — d\n- [T4]" in files["v", "anti-patterns/index.md"] and "[t](/references/t.md) — \n" in files["v", "references/index.md"]
    assert "## Concepts\n- [T3]" in files["v", "moc/s.md"] and "/n00.md" not in files["v", "moc/s.md"] and files["w", "moc/u.md"].endswith("# U — map of content\n")
    assert "2 sources; left out 2 citations" in files["v", "log.md"] and "Built 0 notes" in files["w", "log.md"] and 'title: "A \\"book\\""' in files["v", "references/s.md"]
    table = spark.createDataFrame([(b, r, t) for (b, r), t in files.items()], "bundle string, rel string, text string")
    assert {(r.category, r.message[:20]) for r in bd.lint(table, strict_links=True).collect()} <= {("missing-type", "the front matter nam")}
    paged = build(1)
    assert "- [T4]" in paged["v", "anti-patterns/index-2.md"] and "- [T3]" in paged["v", "moc/s-1.md" if ("v", "moc/s-1.md") in paged else "moc/s.md"] + paged.get(("v", "moc/s-2.md"), "")
    counts = {r.vault: r for r in vt.manifests(m, sources, dropped, "2026-01-01", "1").collect()}
    assert counts["v"].note_counts["concepts"] == 3 and counts["w"].note_counts["methods"] == 0 and counts["v"].dropped.citations == 2


def test_note_parts_and_facts(spark):
    text = "---\ntype: Concept\n---\n# T one\nline a\n\nline b\n## Related\n- [x](/y.md)\n# Citations\n[1] [Ch 2] \"first 'q'\" \"second\"\nno quote\n## More\n\"not cited\""
    b = spark.createDataFrame([("b", "n.md", text), ("b", "e.md", ""), ("b", "o.md", "## Citations\n\"early\"")], "bundle string, rel string, text string")
    got = {r.rel: (r.title, r.body, r.quotes) for r in bd.note_parts(b).collect()}
    assert got["n.md"] == ("T one", "line a\n\nline b", ["first 'q'"]) and got["o.md"] == ("", "", ["early"])
    facts = spark.createDataFrame([("b", "c", "ＬＩＮＥ  a"), ("b", "c", "absent"), ("b", "x", "line"), ("b", "c", " ")], "bundle string, concept string, anchor string")
    matched = spark.createDataFrame([("b", "c", "n"), ("b", "x", None)], "bundle string, concept string, slug string")
    r = bd.fact_coverage(matched, facts, spark.createDataFrame([("b", "n", text)], "bundle string, slug string, text string")).first()
    assert (r.found, r.facts) == (1, 3)
    lines = {x.k: x.text for x in rp.score_report(spark.createDataFrame([("b", 1, 8)], "bundle string, f int, t int"), "f", "t", "Recall", spark.createDataFrame([("b", f"m{i:02d}") for i in range(20)], "bundle string, item string")).collect()}
    assert lines[0] == "Recall: 12% (1/8)" and lines[1].count(",") == ml.SHOWN_ITEMS - 1


def test_json_scans(spark, tmp_path):
    for name, text in {"10.json": '[{"slug": "b"}]', "2.json": '{"notes": [{"slug": "c", "citations": [{"chapter": 1, "quote": "q", "source": "s"}]}, null]}', "bad.json": "{", "gold.json": '{"concepts": [{"slug": "a", "fact_anchor": "f"}], "links": [["a", "b"], ["x"]]}', "j.json": "[3, 1, 3]", "m.json": '{"generator_version": "1.2.3", "note_counts": {"concepts": 2}}'}.items():
        (tmp_path / name).write_text(text)
    files = vj.whole_files(spark, str(tmp_path))
    only = lambda n: files.filter(F.col("path").endswith(n))
    rows = vj.notes(files.filter(F.col("path").rlike("/(10|2|bad).json$"))).orderBy("path", "pos").collect()
    assert [(r.slug, r.citations and r.citations[0].quote) for r in rows] == [("b", None), ("c", "q")]
    concepts, links = vj.gold(only("gold.json"))
    assert concepts.first().fact_anchor == "f" and [(r.a, r.b) for r in links.collect()] == [("a", "b")]
    assert sorted(r.id for r in vj.journal(only("j.json")).collect()) == [1, 3] and vj.manifests(only("m.json")).first().note_counts == {"concepts": 2}
    plan = vj.plan(spark.createDataFrame([("p", '{"chunks": [{"id": 1, "source": ""}, {"id": 2, "source": "s"}]}')], "path string, text string"), "first")
    assert {r.id: r.source for r in plan.collect()} == {1: "first", 2: "s"}


def test_runs_around_a_model(spark):
    chunks = spark.createDataFrame([(1, "s", 1, "alpha beta"), (2, None, 2, "gamma"), (3, "", None, None)], "id int, source string, chapter int, text string")

    def model(prompt):
        failed = F.contains(prompt, F.lit("gamma"))
        return F.struct(F.lit('```json\n[{"slug": "x"}]\n```').alias("text"), F.lit(0.5).alias("cost_usd"), F.when(failed, F.repeat(F.lit("e"), 300)).alias("error"))

    built = {r.id: r for r in ml.build(chunks, model, "first").collect()}
    assert built[1].notes[0].slug == "x" and built[2].notes == [] and len(built[2].error) == ml.SHOWN_ERROR and built[3].notes[0].slug == "x"
    total = ml.run_summary(ml.build(chunks, model)).first()
    assert (total.done, total.failed, total.notes, total.cost_usd) == (2, 1, 2, 1.5) and total.failures[0].startswith("2: eee")
    # a critic that names one more word of the passage a round
    critic = ml.echo_model(lambda p: F.concat(F.lit('{"notes": [{"slug": "'), F.coalesce(F.try_element_at(F.array_except(F.split(F.regexp_extract(p, r"<passage>\n([^<]*)\n", 1), " "), F.split(F.regexp_extract(p, "<known>([^<]*)<", 1), " ")), F.lit(1)), F.lit("")), F.lit('"}]}')), 1.0)
    found, cost = ml.cover(chunks, spark.createDataFrame([(1, "alpha")], "id int, slug string"), critic, 5)
    assert {(r.id, r.slug) for r in found.collect()} == {(1, "beta"), (2, "gamma")} and cost == 5.0
    notes = spark.createDataFrame([(i, "v", f"s{i}", "t", "b", []) for i in range(5)], "ord long, vault string, slug string, title string, body string, citations array<struct<chapter int, quote string, source string>>")
    judge = ml.echo_model(lambda p: F.when(F.contains(p, F.lit('slug="s4"')), F.lit("sorry")).otherwise(F.lit('{"verdicts": [{"slug": "s0", "verdict": "supported"}, {"slug": "s1", "verdict": "Overreach"}, {"slug": "s0", "verdict": "unsupported"}]}')), 0.25)
    r = ml.verify(notes, judge, size=2).first()
    assert (r.total, r.supported, r.overreach, r.unsupported, r.cost_usd, r.ok) == (5, 0, 1, 4, 0.75, False)
    prompt = ml.judge_batches(notes, 2).filter("array_contains(ords, 0L)").first().prompt
    assert re.findall('slug="(s[0-9])"', prompt) == ["s0", "s1"]
