"""Operators on long texts, notes, bundles, files, upgrades and streams, on small fixtures."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from notewright.functions import text as tx
from notewright.operators import books, bundle as bd, model_loops as ml, notes as nt, upgrades as up
from notewright.session import cut, drop_cut
from notewright.sources import files as fs
from notewright.streaming.build import event_windows, run_plan


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, " A  b\n", tx.squeeze) == "A b"
    assert one(spark, "a\r\nb c\n", tx.text_lines) == ["a", "b", "c"]
    assert one(spark, "a\n", tx.lines) == ["a", ""]
    assert one(spark, "--Éa b!", tx.name_key) == "a-b"
    assert one(spark, "!!", tx.slugify) == "source"
    assert one(spark, "binary-symmetric--channel", tx.initials) == "bsc"
    assert one(spark, "The cat, the Cats of it", lambda c: tx.token_set(c, ("the",))) == ["cat", "cats"]
    assert one(spark, None, tx.words) is None


def test_month_is_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        ts = "timestamp_micros(1706745599999999L)"  # the last microsecond of January 2024 in UTC
        assert spark.sql(f"select {ts} x").select(tx.month_index(F.col("x")).alias("m")).first().m == 2024 * 12
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("line,chapter", [
    ("Chapter 3 Convolutional Codes", 3), ("2.2.3 Parity-Check Matrix", 2), ("3.2 Trellis Diagram and the Viterbi Algorithm", 3), ("Chapter 2", 2), ("CAPÍTULO 4 Los Ríos", 4),
    ("010101010101010101010101", None), ("322 ACRONYMS", None), ("Chapter 2 presents the code.", None), ("1. All code words of the list are counted once here too", None), ("1 G1,k+1 (D)", None), ("2 Es", None), ("", None), ("plain", None),
])
def test_heading(spark, line, chapter):
    h = one(spark, line, books.heading)
    assert (h and h.chapter) == chapter


def _pages(anchors, total):
    return "\f".join(anchors.get(i, "lorem ipsum") for i in range(1, total + 1))


def _chapter(n, folio):
    return f"Chapter {n}\nlorem ipsum body text\n{folio}"


@pytest.mark.parametrize("anchors,total,offset", [
    ({14: (1, 10), 24: (2, 20), 34: (3, 30)}, 40, 4), ({14: (1, 10), 24: (2, 20)}, 30, None), ({4: (7, 0), 5: (8, 10), 6: (9, 11), 7: (10, 12)}, 9, None),
    ({14: (1, 10), 24: (2, 20), 34: (3, 25), 44: (4, 35)}, 50, None), ({34: (3, 30), 44: (4, 40), 54: (5, 50)}, 60, 4), ({}, 1, None),
])
def test_page_offset(spark, anchors, total, offset):
    df = spark.createDataFrame([("s", _pages({p: _chapter(*a) for p, a in anchors.items()}, total)), ("n", None)], "slug string, raw string")
    assert {r.id: r.page_offset for r in books.page_offsets(df).collect()} == {"s": offset, "n": None}


def test_remap(spark):
    t = "[Ch 1, p.21] and p.21 and [Ch 2, p.3] [x] [Ch 9"
    fn = lambda off: lambda c: books.remap_citations(c, F.lit(off).cast("int"))
    assert one(spark, t, fn(12)) == "[Ch 1, p.9] and p.21 and [Ch 2, p.1] [x] [Ch 9"
    marked = one(spark, t, fn(None))
    assert marked == "[Ch 1, p.21 (pdf)] and p.21 and [Ch 2, p.3 (pdf)] [x] [Ch 9"
    assert one(spark, marked, fn(None)) == marked


def test_clean(spark):
    raw = "\n".join(["14", "HEADER ONE 3", "text here"] * 5 + ["INTRODUCTION", " 322 ", "12345"])
    df = spark.createDataFrame([("s", raw), ("e", ""), ("n", None)], "slug string, raw string")
    got = {r.id: (r.text, r.removed) for r in books.cleaned(df).collect()}
    assert got["s"] == ("\n".join(["text here"] * 5 + ["INTRODUCTION", "12345"]), 11) and got["e"] == ("", 0)


def _greedy(lines, target):
    start = i = words = 0
    out = []
    while i < len(lines):
        words += len(lines[i].split())
        i += 1
        if words >= target:
            end = next((j for j in range(i, min(i + 40, len(lines))) if not lines[j].strip()), i)
            out.append((start + 1, end))
            start = i = end
            words = 0
    return [*out, (start + 1, len(lines))] if start < len(lines) else out


def test_chunks(spark):
    raw = "Chapter 1 Start\n" + "\n".join("a b c d" if i % 17 else "" for i in range(100)) + "\n2.1 Second Part\nx y z"
    df = spark.createDataFrame([("s", raw), ("e", ""), ("n", None)], "slug string, raw string")
    got = books.label_chunks(df, 50).orderBy("source", "seq").collect()
    mine = [(r.start_line, r.end_line) for r in got if r.source == "s"]
    assert mine == _greedy(raw.split("\n"), 50) and [(r.start_line, r.end_line) for r in got if r.source == "e"] == [(1, 1)]
    labels = [r.label for r in got if r.source == "s"]
    assert labels[0] == labels[1] == "Chapter 1 Start" and "2.1 Second Part" in labels[-1]
    assert [r for r in got if r.source == "e"][0].label == "lines 1-1"


def test_structure(spark):
    df = spark.createDataFrame([("s", "Contents\nChapter 2 B\nChapter 1 A\nChapter 2 again\n3. Weak"), ("w", "1. First Part\n2. Second part, and more."), ("n", None)], "slug string, raw string")
    got = {r.id: r for r in books.structure(df).collect()}
    assert (got["s"].chapters, got["s"].sample, got["s"].has_toc) == (2, ["Chapter 1 A", "Chapter 2 B"], True)
    assert (got["w"].chapters, got["n"].chapters, got["n"].has_toc) == (1, 0, False)


NOTE = "ord long, vault string, type string, slug string, title string, description string, tags array<string>, aliases array<string>, confidence string, status string, body string, related array<string>, citations array<struct<chapter int, quote string, source string>>, loaded_at timestamp, deleted_at timestamp"
SOURCE = "slug string, title string, page_offset int, raw string"


def _note(ord_, slug, quotes=("beta gamma",), body="b", related=(), type_="Concept", title="T", aliases=(), tags=("t",)):
    return (ord_, "v", type_, slug, title, "d", list(tags), list(aliases), None, "", body, list(related), [(1, q, "s") for q in quotes], None, None)


def test_ground_and_merge(spark):
    notes = spark.createDataFrame([
        _note(1, "bsc", ("beta\ngamma  DELTA",), title="short"), _note(2, "binary-symmetric-channel", ("finding here", "nowhere"), body="longer", title="long"),
        _note(3, "encoders", title="plural"), _note(4, "encoder", body="bb", title="single", aliases=["enc"]), _note(5, "lost", ("nowhere",)), _note(6, "none", ()),
    ], NOTE)
    sources = spark.createDataFrame([("s", "Book", None, "intro line\n\falpha beta gamma\ndelta epsilon\n\fthe finding here\n"), ("n", "N", 1, None)], SOURCE)
    g = nt.ground(notes, sources)
    assert {(r.ord, r.pos): r.folio for r in g.collect()} == {(1, 0): "2 (pdf)", (2, 0): "3 (pdf)", (2, 1): None, (3, 0): "2 (pdf)", (4, 0): "2 (pdf)", (5, 0): None}
    assert tuple(nt.drop_stats(g, notes).first()) == (2, 2)
    roots = nt.fold_roots(nt.fold_edges(notes.select("slug")))
    assert {(r.slug, r.root) for r in roots.collect()} == {("bsc", "binary-symmetric-channel"), ("encoders", "encoder")}
    m = {r.slug: r for r in nt.merged(notes, g, roots).collect()}
    assert set(m) == {"binary-symmetric-channel", "encoder"}
    b = m["binary-symmetric-channel"]
    assert (b.title, b.body, b.aliases, len(b.citations), b.merged) == ("long", "longer", ["bsc"], 2, True)
    assert (m["encoder"].title, m["encoder"].aliases, len(m["encoder"].citations)) == ("single", ["encoders", "enc"], 1)


@pytest.mark.parametrize("slugs,want", [({"basis", "bases"}, {}), ({"code", "coding"}, {}), ({"bsc", "block-code"}, {}), ({"bc", "binary-code", "block-cipher"}, {"bc": "binary-code"})])
def test_folds(spark, slugs, want):
    edges = nt.fold_edges(spark.createDataFrame([(s,) for s in slugs] + [(None,)], "slug string"))
    assert {r.slug: r.root for r in nt.fold_roots(edges).collect()} == want


def test_fold_chain_and_cycle(spark):
    chain = spark.createDataFrame([(f"s{i:02}", f"s{i + 1:02}") for i in range(20)] + [("x", "y"), ("y", "x")], "slug string, target string")
    got = {r.slug: r.root for r in nt.fold_roots(chain).collect()}
    assert {got[f"s{i:02}"] for i in range(20)} == {"s20"} and got.get("x", "x") == got.get("y", "y")


def test_links_and_titles(spark):
    notes = spark.createDataFrame([_note(1, "alpha", related=["BETA ", "x y", "alpha", "gone"], title="error correcting code"), _note(2, "beta", aliases=["Alpha"], title="error correcting code here"), _note(3, "gamma", aliases=["X Y"], title="error correcting code")], NOTE)
    idx = nt.alias_index(notes)
    assert {(r.key, r.slug) for r in idx.collect()} == {("alpha", "alpha"), ("beta", "beta"), ("gamma", "gamma"), ("x y", "gamma")}
    assert {(r.src, r.dst) for r in nt.related_links(notes, idx).collect()} == {("alpha", "beta"), ("beta", "alpha"), ("alpha", "gamma"), ("gamma", "alpha")}
    pairs = nt.similar_titles(notes, 0.5)
    assert {(r.ord_a, r.ord_b) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}
    won = nt.winners(pairs, notes)
    assert {r.loser: r.winner for r in nt.merges(won).collect()} == {"beta": "alpha", "gamma": "beta"}
    files = spark.createDataFrame([("Hexagonal Architecture.pdf",), ("other architecture.pdf",), ("java.epub",)], "name string")
    m = {r.slug: r for r in nt.match_files(spark.createDataFrame([("hexagonal-architecture",), ("architecture",), ("nothing",)], "slug string"), files).collect()}
    assert m["hexagonal-architecture"].source == "Hexagonal Architecture.pdf" and m["architecture"].ambiguous and m["architecture"].source is None and m["nothing"].score == 0


def test_validation(spark):
    rows = [_note(1, "ok", type_="concept"), _note(2, "Bad Slug", type_="x", title=" "), _note(3, "no-cites", ())]
    got = {r.ord: r for r in nt.validated(spark.createDataFrame(rows, NOTE)).collect()}
    assert (got[1].canonical_type, got[1].errors, got[1].confidence) == ("Concept", [], "medium")
    assert got[2].errors == ["type", "slug", "title"] and got[3].errors == ["citations"]


def _file(type_, related="", cited=True, extra=""):
    return f"---\ntype: {type_}\ntitle: \"x: y\"\n{extra}---\n\n# X\n\nbody\n\n## Related\n{related}\n\n# Citations\n" + ('[1] [Ch 1, p.2] "q" — [B](/references/b.md)\n' if cited else "")


def test_lint(spark):
    clean = [("v", "index.md", "---\nokf_version: 1\n---\n"), ("v", "log.md", "## 2026-02-02\n## 2026-01-01\n"), ("v", "references/b.md", "---\ntype: Source\n---\n"),
             ("v", "concepts/a.md", _file("Concept", "- [b](/concepts/b.md)")), ("v", "concepts/b.md", _file("Method", "- [a](a.md) and [web](https://x.org/y.md)"))]
    schema = "bundle string, rel string, text string"
    df = spark.createDataFrame(clean, schema)
    assert bd.lint(df, strict_links=True).collect() == []
    s = bd.lint_summary(df).first()
    assert (s.md_files, s.concept_notes, s.atomic, s.cited, s.errors) == (5, 3, 2, 2, 0)
    bad = [("v", "concepts/index.md", "---\nx: 1\n---\n"), ("v", "x/log.md", "## 2026-13-45\n## 2026-01-01\n## 2026-02-01\n"), ("v", "concepts/c.md", _file("Concept", "- [a](../concepts/a.md) [out](../../z.md)", cited=False)), ("v", "notype.md", "text\n"), ("v", "open.md", "---\ntype: Concept\n")]
    got = sorted(((r.category, r.path, r.line) for r in bd.lint(spark.createDataFrame(clean + bad, schema)).collect()), key=str)
    assert got == sorted([
        ("coverage", ".", None), ("coverage", "concepts/c.md", None), ("dangling-link", "concepts/c.md", 11), ("log-format", "x/log.md", 1), ("log-format", "x/log.md", 3),
        ("missing-type", "notype.md", 1), ("missing-type", "open.md", 1), ("reciprocity", "concepts/c.md", 11), ("reserved-file", "concepts/index.md", 1),
    ], key=str)


def test_render_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([_note(1, "alpha", related=["beta"], title='Say "x"'), _note(2, "beta", aliases=["b e"])], NOTE)
    sources = spark.createDataFrame([("s", "Book", None, "alpha beta gamma")], SOURCE)
    m = nt.merged(notes, nt.ground(notes, sources), nt.fold_roots(nt.fold_edges(notes.select("slug"))))
    files = bd.rendered(m, nt.related_links(notes, nt.alias_index(notes)), sources.select(F.col("slug").alias("source"), F.col("title").alias("source_title")), "2026-01-01T00:00:00Z")
    fs.write_files(files.unionByName(bd.section_indexes(m)), str(tmp_path))
    text = (tmp_path / "concepts/alpha.md").read_text()
    assert 'title: "Say \\"x\\""' in text and "- [T](/concepts/beta.md) — d" in text and '[1] [Ch 1, p.1 (pdf)] "beta gamma" — [Book](/references/s.md)' in text
    again = fs.read_bundle(spark, f"file://{tmp_path}", "v")
    assert {r.rel for r in again.collect()} == {"concepts/alpha.md", "concepts/beta.md", "concepts/index.md"}
    b = bd.bundle_notes(again)
    assert {r.slug: r["keys"] for r in b.collect()} == {"alpha": ["alpha"], "beta": ["beta", "b e"]}
    gold = spark.createDataFrame([("v", "c1", ["no", "B  E"]), ("v", "c2", ["zzz"])], "bundle string, concept string, keys array<string>")
    r = bd.concept_recall(bd.match_gold(b, gold)).first()
    assert (r.found, r.concepts, r.recall) == (1, 2, 0.5)


def _zip(entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return b.getvalue()


def test_zip_entry():
    names = ["O/c 2.xhtml", "O/x/c1.xhtml", "c3.xhtml"]
    assert [fs.zip_entry(h, "O", names) for h in ("c%202.xhtml#a", "c1.xhtml", "c3.xhtml", "../c3.xhtml", "#a", "no.xhtml")] == [names[0], names[1], names[2], names[2], None, None]


def test_files(spark):
    epub = _zip({"mimetype": "application/epub+zip", "O/content.opf": '<manifest><item href="c%202.xhtml"/><item href="c1.xhtml"/></manifest><spine><itemref/><itemref/></spine>', "O/c 2.xhtml": "<head><title>no</title></head><p>BETA &amp; more</p>", "O/c1.xhtml": "<p>ALPHA<script>x</script></p>"})
    docx = _zip({"[Content_Types].xml": "", "word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>GOLD</w:t></w:r></w:p><w:p/></w:document>'})
    rows = [("a.epub", epub), ("b.dat", epub), ("c.DOCX", docx), ("d.bin", docx), ("e.txt", "é\r\nx".encode("cp1252")), ("f.html", b"<p>hi &lt;b&gt;</p>"), ("g.rtf", rb"{\rtf1 a\par b\'e9}"), ("h.xyz", b"?"), ("i.pdf", b"%PDF-1.4"), ("j.txt", b""), ("k.epub", b"PKbroken")]
    got = {r.path: r for r in fs.extracted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.epub"].text == got["b.dat"].text and "ALPHA" in got["a.epub"].text and "BETA & more" in got["a.epub"].text and "no" not in got["a.epub"].text and got["a.epub"].units == 2
    assert got["a.epub"].text.index("BETA") < got["a.epub"].text.index("ALPHA")
    assert got["c.DOCX"].text == got["d.bin"].text == "GOLD" and got["e.txt"].text == "é\nx" and got["f.html"].text == "\nhi <b>" and got["g.rtf"].text.split() == ["a", "b"]
    assert got["h.xyz"].format is None and got["j.txt"].text is None and got["j.txt"].attempts[0].outcome == "empty" and got["k.epub"].text is None


LOG = """# Log
<!-- ## [9.9.9]
- example [additive] -->
## [1.2.0] - 2026
### Added
- First thing
  wrapped (#9) [transform; steps 4, 5.1]
- Untagged
- Other [regenerate]

text
## [1.1.0]
- Early (#7) [Additive]
- Infra [infra]
"""


def test_changelog(spark):
    e = up.change_entries(spark.createDataFrame([(LOG,)], "text string")).orderBy("seq").collect()
    assert [(r.version, r.cls, r.steps, r.description, r.issue) for r in e] == [
        ([1, 2, 0], "transform", ["4", "5.1"], "First thing wrapped", "9"), ([1, 2, 0], "regenerate", [], "Other", None), ([1, 1, 0], "additive", [], "Early", "7"), ([1, 1, 0], "infra", [], "Infra", None),
    ]
    plan = up.plan_upgrades(spark.createDataFrame([("s", "1.1.0"), ("t", "1.0.9"), ("u", "x")], "skill string, generator_version string"), up.change_entries(spark.createDataFrame([(LOG,)], "text string")), "1.2.0")
    assert sorted((r.skill, r.plan) for r in plan.collect()) == [("s", "regenerate"), ("s", "transform"), ("t", "additive"), ("t", "regenerate"), ("t", "skipped"), ("t", "transform")]
    files = spark.createDataFrame([("SKILL.md", "argument-hint: [topic]\n\n## Scope & Limits\nx")], "path string, text string")
    reg = {"9": lambda df: df.withColumn("text", up.widen_hint(up.inject_section(F.col("text"), "## P\n", "## P", "## Scope & Limits")))}
    done, remains = up.apply_transforms(files, plan, reg)
    text = done.first().text
    assert text == 'argument-hint: [topic, or "<topic> in <stack>"]\n\n## P\n\n---\n\n## Scope & Limits\nx'
    assert reg["9"](done).first().text == text
    assert {r.plan for r in remains.collect()} == {"regenerate", "additive"}


def test_model_loops(spark):
    replies = spark.createDataFrame([(1, '```json\n{"verdicts": [{"slug": "a", "verdict": "Supported", "reason": "r"}, {"slug": "b", "verdict": "maybe"}]}\n```'), (2, 'Sure: {"verdicts": [{"slug": "a", "verdict": "overreach"}]} ok'), (3, "no json"), (4, None)], "reply_id int, reply string")
    v = ml.parse_verdicts(replies)
    assert {(r.slug, r.verdict, r.reason) for r in v.collect()} == {("a", "overreach", ""), ("b", "unsupported", "")}
    t = ml.tally(spark.createDataFrame([("x", "a"), ("x", "c")], "g string, slug string"), v, ["slug"]).collect()
    assert sum(r.total for r in t) == 2
    plan = spark.createDataFrame([(i, "p") for i in range(5)], "id int, x string")
    assert [r.id for r in ml.pending(plan, spark.createDataFrame([(1,), (1,)], "id int"), 2).collect()] == [0, 2]
    fresh = ml.next_ids(plan, spark.createDataFrame([("b",), ("a",), ("c",)], "x string"), ["x"])
    assert {(r.x, r.id) for r in fresh.collect()} == {("a", 5), ("b", 6), ("c", 7)}
    all_ = spark.createDataFrame([(i,) for i in range(6)], "k int")
    found, rounds = ml.until_dry(all_.limit(0), lambda have, r: all_.filter(F.col("k") < 2 * r), ["k"], 9)
    assert found.count() == 6 and rounds == 4


def test_rules_and_figures(spark):
    files = spark.createDataFrame([("a/x.py", "eval(1)\nok\neval(2)"), ("tests/x.py", "eval(1)")], "path string, text string")
    rules = [{"id": "r", "scope": r"\.py$", "exclude": "^tests/", "pattern": r"\beval\(", "severity": "violation", "confidence": "high"}]
    assert [(r.path, r.line_no, r.verdict) for r in up.review(files, rules).orderBy("line_no").collect()] == [("a/x.py", 1, "violation"), ("a/x.py", 3, "violation")]
    figs = spark.createDataFrame([("Figure 3.2: x", 1), ("photo", 12), ("photo", 0)], "c string, p int")
    ranges = F.array(F.struct(F.lit(1).alias("chapter"), F.lit(1).alias("first_page")), F.struct(F.lit(2).alias("chapter"), F.lit(10).alias("first_page")))
    assert [r.x for r in figs.select(up.figure_chapter(F.col("c"), F.col("p"), ranges).alias("x")).collect()] == [3, 2, None]


def test_stream(spark, tmp_path):
    plan, out, ck = (str(tmp_path / x) for x in ("plan", "out", "ck"))
    work = lambda df: df.withColumn("error", F.when(F.col("id") == 2, "boom"))
    spark.range(3).selectExpr("cast(id as int) id").write.parquet(plan)
    run_plan(spark, plan, out, ck, work).awaitTermination()
    spark.range(1, 6).selectExpr("cast(id as int) id").write.mode("append").parquet(plan)
    run_plan(spark, plan, out, ck, lambda df: df.withColumn("error", F.lit(None).cast("string"))).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/done").collect()) == [0, 1, 2, 3, 4, 5]
    assert [r.id for r in spark.read.parquet(f"{out}/failed").collect()] == [2]


def test_windows_and_cut(spark):
    ev = spark.sql("select timestamp'2024-01-01 10:00:00' ts, 'a' event_type, 2.0D value union all select timestamp'2024-01-02 00:00:00', 'a', 1.0D")
    assert [(r.n, r.total) for r in event_windows(ev).orderBy("window_start").collect()] == [(1, 2.0), (1, 1.0)]
    c = cut(ev)
    assert c.count() == 2
    drop_cut(c)
