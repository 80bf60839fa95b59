"""Training-data operators against brute force on small tables, with nulls, ties, repeats and odd rows."""

import itertools
import random
import re

import numpy as np
import pytest

from notewright.llm import components, dom, lookalike, markup, mixing, neardup, packing, repetition, splitting, tokens


def components_brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hot_rows", [10**9, 3])
def test_hash_to_min(spark, hot_rows):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    pairs += [(7, 7), (100, 101)]
    df = spark.createDataFrame([*pairs, (None, 5), (5, None)], "a long, b long")
    got = {r.id: r.root for r in components.hash_to_min(df, hot_rows=hot_rows).collect()}
    assert got == components_brute([p for p in pairs if p[0] != p[1]])


def test_hash_to_min_empty(spark):
    assert components.hash_to_min(spark.createDataFrame([], "a long, b long")).count() == 0


def test_note_groups(spark):
    notes = spark.createDataFrame(
        [(1, "v", "A b", ["x"], 0), (2, "v", "c", ["a-B", None, ""], 0), (2, "v", "c", ["a-B", None, ""], 1), (3, "v", "d", None, 0), (4, "w", "a b", [], 0), (5, "v", None, [], 0), (6, "v", "e", [], 0), (7, "v", "!!", ["??"], 0)],
        "ord long, vault string, slug string, aliases array<string>, root int",
    )
    matches = spark.createDataFrame(
        [("v", "c", "ghost", True), ("v", "GHOST", "d", True), ("v", "e", "d", None), ("v", "e", "d", False), ("w", "e", "a b", True), ("v", "e", "e", True), ("v", None, "e", True), (None, "e", "d", True)],
        "vault string, slug_a string, slug_b string, same boolean",
    )
    got = {r.ord: r.group_ord for r in components.note_groups(notes, matches).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_cut_points():
    kinds = np.zeros(101, np.int8)
    kinds[[18, 47, 60]] = splitting.SENTENCE
    kinds[40] = splitting.BLANK
    pieces = list(splitting.cut_points(kinds, 0, 100, 30, 5))
    assert all(e - s <= 30 for s, e, _ in pieces) and pieces[-1][1] == 100
    assert all(b[0] == a[1] - 5 for a, b in itertools.pairwise(pieces))
    assert pieces[0][:2] == (0, 18) and pieces[1][:2] == (13, 40)
    assert list(splitting.cut_points(kinds, 0, 100, 1, 9))[0] == (0, 1, False)


def test_split_chunks(spark):
    raw = "Chapter 1 Start\n\n" + "\n".join(f"w{i} x{i} y{i}." for i in range(40)) + "\n\nlast line"
    chunks = spark.createDataFrame(
        [(1, "s", None, 1, 99, None, 3), (1, "s", None, 1, 99, None, 4), (2, "s", " ", 3, 4, 5, 0), (3, None, "l", 1, 2, 0, 0), (4, "unknown", "l", 1, 2, 0, 0), (5, "s", "l", None, 4, 0, 0), (6, "t", "own", 1, 1, 0, 0), (7, "s", "", 90, 99, 1, 0)],
        "id int, source string, label string, start_line int, end_line int, words int, piece int",
    )
    sources = spark.createDataFrame([("s", "pdf", raw), ("s", "pdf", raw), ("t", "odd", "many words " * 50), (None, "pdf", "x"), ("u", None, None)], "slug string, format string, raw string")
    limits = spark.createDataFrame([("pdf", 30, 4), (None, 1, 1)], "format string, max_words int, overlap_words int")
    rows = splitting.split_chunks(chunks, sources, limits).orderBy("id", "piece").collect()
    one = [r for r in rows if r.id == 1]
    assert len(one) > 4 and all(r.words <= 30 and r.words == len(r.text.split()) for r in one) and one[0].chunk_words == 125
    words = raw.split()
    assert all(words[r.start_word : r.end_word] == r.text.split() for r in one)
    assert {r.label for r in one} == {"Chapter 1 Start"}
    assert all(b.start_word == a.end_word - 4 for a, b in itertools.pairwise(one))
    rest = {r.id: r for r in rows if r.id > 1}
    assert rest[2].words == 6 and rest[3].words == rest[4].words == rest[5].words == rest[7].words == 0 and rest[6].words == 100 and rest[6].max_words is None
    assert [r.id for r in splitting.oversized(chunks, sources, limits).collect()] == [1]


def test_canonical():
    same = [("ｆｕｌｌ", "full"), ("cafe\u0301", "café"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u3000c", "a b c"), ("ﬁnd", "find"), ("раураl", "paypal"), ("οΜ", "oM"), ("non\u2011x", "non-x"), ("а\u0301", "á")]
    for a, b in same:
        assert lookalike.canonical(a) == lookalike.canonical(b) == b
    for a, b in [("x²", "x2"), ("½", "1/2"), ("É", "é"), ("e", "é"), ("ß", "ss"), ("①", "1"), ("œ", "oe"), ("A", "a")]:
        assert lookalike.canonical(a) != lookalike.canonical(b)
    assert lookalike.canonical("STRASSE", True) == lookalike.canonical("straße", True)
    for t in ("", "plain", "e\u0301\u00adа²ﬁ ｘ\u2028y"):
        assert lookalike.canonical(lookalike.canonical(t)) == lookalike.canonical(t)


def test_grounded(spark):
    notes = spark.createDataFrame(
        [(1, [(1, "plain  text", "s"), (1, "ｐlain\u00a0text", "s"), (None, "Plain text", "s"), (1, None, "s"), (1, "x", None), (1, "x", "none")], 1), (1, [(1, "plain  text", "s")], 2), (2, None, 1), (3, [(1, " ", "s"), (1, "é", "n"), None], 1)],
        "ord long, citations array<struct<chapter int, quote string, source string>>, how int",
    )
    sources = spark.createDataFrame([("s", "some plain\ntext here"), ("s", "some plain\ntext here"), ("n", None), (None, "q")], "slug string, raw string")
    got = {(r.ord, r.pos): r.how for r in lookalike.grounded(notes, sources).collect()}
    assert got == {(1, 0): "as_written", (1, 1): "rewritten", (1, 2): "absent", (1, 3): "no_source", (1, 4): "no_source", (1, 5): "no_source", (3, 0): "as_written", (3, 1): "no_source", (3, 2): "no_source"}


def _word_set(*parts):
    return set(re.findall("[a-z0-9]+", " ".join(p or "" for p in parts).lower()))


@pytest.mark.parametrize("threshold,block", [(0.7, 20_000), (0.7, 7), (0.8, 20_000), (0.35, 20_000)])
def test_similar_pairs(spark, threshold, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(0, None, None), (1, "", None), (2, "a", "b"), (3, "b a", None), (4, "A-b", None), (5, "c", None)]
    for i in range(10, 130):
        if i % 3 and len(rows) > 8:
            base = list(_word_set(*rnd.choice(rows[6:])[1:]))
            for _ in range(rnd.randint(0, 4)):
                base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            rnd.shuffle(base)
        else:
            base = rnd.sample(vocabulary, rnd.randint(1, 25))
        rows.append((i, " ".join(base), rnd.choice((None, "the"))))
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[9], (None, "x", "y")]], "id long, t string, u string, rec int")
    sets = {r[0]: _word_set(*r[1:]) for r in rows}
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (not x and not y) or (x | y and len(x & y) >= threshold * len(x | y) - 1e-9):
            want.add((a, b))
    assert {tuple(r) for r in neardup.similar_pairs(df, "id", ["t", "u"], threshold).collect()} == want
    if threshold == 0.7 and block > 7:
        groups = {r.id: r.group_id for r in neardup.similar_groups(df, "id", ["t", "u"], threshold).collect()}
        brute = components_brute(want)
        assert groups == {i: brute.get(i, i) for i in sets}


def test_similar_pairs_empty(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], "id long, t string"), "id", ["t"], 0.8).count() == 0


def test_repetition(spark):
    texts = [(1, None), (2, ""), (3, "a b c d"), (4, "a b c d e"), (5, "x " * 500), (6, "A b C d e f\ta B c D e f a b c d e f"), (7, " ".join(map(str, range(3000))))]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, n_words int")

    def share(t):
        w = (t or "").lower().split()
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return 1 - len(set(g)) / len(g) if g else 0.0

    got = {r.doc_id: r for r in repetition.profile(docs).collect()}
    assert {i: r.rep5_share for i, r in got.items()} == pytest.approx({i: share(t) for i, t in texts})
    assert got[5].top_word_share == 1.0 and "rep5_share" in got[5].flags and got[1].flags == []
    assert sorted(r.doc_id for r in repetition.repetitive(docs).collect()) == sorted(i for i, t in texts if share(t) > 0.25)


def test_pack():
    rnd = random.Random(3)
    sizes = [rnd.randint(0, 300) for _ in range(2000)] + [0, 100, 1000]
    rows = packing.pack(np.array(sizes), 128)
    room = {}
    for _, _, c, s, e in rows:
        room[c] = room.get(c, 0) + e - s
    assert max(room.values()) <= 128 and sum(room.values()) == sum(sizes)
    for i, n in enumerate(sizes):
        own = sorted((s, e) for j, _, _, s, e in rows if j == i)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in itertools.pairwise(own))
        assert len(own) == max(1, -(-n // 128))
    assert sum(room.values()) / (128 * len(room)) > 0.97


def test_hilbert():
    points = np.array(list(itertools.product(range(8), repeat=2)))
    key = tokens.hilbert(points, 3)
    assert sorted(key) == list(range(64))
    along = points[np.argsort(key)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 20)
    docs = spark.createDataFrame([(i, f"word{i % 5} " * (i % 90), 1) for i in range(150)] + [(150, None, 1), (151, "", 1), (3, "again", 1), (None, "no id", 1)], "doc_id long, text string, tokens int")
    specs = spark.createDataFrame([("tiny", 32), ("big", 500), ("none", None), ("tiny", 32)], "spec string, capacity_tokens int")
    rows = packing.packed(docs, specs).collect()
    assert {r.spec for r in rows} == {"tiny", "big"}
    enc = tokens.encoder()
    for spec, cap in (("tiny", 32), ("big", 500)):
        own = [r for r in rows if r.spec == spec]
        assert {r.doc_id for r in own} == set(range(152))
        fill = {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
        assert max(fill.values()) <= cap
        assert sum(r.tokens for r in own if r.doc_id == 10) == len(enc.encode_ordinary("word0 " * 10))
    assert packing.packed(docs.limit(0), specs).count() == 0


def test_plan_mix():
    plan = {p[0]: p for p in mixing.plan_mix([("a", 1.0, 3, 1000, 10), ("b", 1.0, 2, 100_000, 1000), ("gone", 2.0, 1, 0, 0), ("zero", 0.0, 1, 50, 1)])}
    assert plan["a"][1] == plan["b"][1] == 0.25 and plan["gone"][2:] == (0, 0) and plan["zero"][2:] == (0, 0)
    assert plan["a"][2] * 1000 + plan["a"][3] <= 3000
    assert mixing.plan_mix([("a", None, None, 0, 0)]) == [("a", 0.0, 0, 0)]
    fixed = mixing.plan_mix([("a", 3.0, 9, 1000, 10), ("b", 1.0, 9, 1000, 10)], total=2000)
    assert [p[2:] for p in fixed] == [(1, 500), (0, 500)]


def test_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 50)
    docs = spark.createDataFrame(
        [(i, "one two three four five " * (1 + i % 7), "Big Source") for i in range(400)] + [(1000 + i, f"rare text number {i}", "rare") for i in range(5)] + [(2000, None, "rare"), (2001, "lost", None), (2002, "x", "unwanted"), (5, "one two", "big-source")],
        "doc_id long, text string, source string",
    )
    targets = spark.createDataFrame([("m", "big-source", 0.9, 1), ("m", "rare", 0.1, 4), ("m", "absent", None, 2), ("n", "rare", 1.0, None)], "mix string, source string, target_weight double, max_repeats int")
    chosen, report = mixing.mixed(docs, targets)
    rows, shares = chosen.collect(), {(r.mix, r.source): r for r in report.collect()}
    assert len({(r.mix, r.doc_id) for r in rows}) == len(rows)
    assert all(r.repeats <= shares[r.mix, r.source].max_repeats for r in rows)
    assert shares["m", "rare"].actual_share == pytest.approx(0.1, abs=0.03) and shares["m", "absent"].chosen_tokens == 0
    assert shares["n", "rare"].actual_share == 1.0
    assert sum(r.n_tokens * r.repeats for r in rows if r.mix == "m" and r.source == "rare") == shares["m", "rare"].chosen_tokens
    # the same documents again
    assert sorted(map(tuple, mixing.mixed(docs, targets)[0].collect())) == sorted(map(tuple, rows))


def test_markup_model():
    x, y = markup.training_rows(300, seed=5)
    assert ((markup.model().margin(x) > 0) == (y > 0)).mean() > 0.99


def _clean(text):
    _, nodes, take = next(markup.decided([text], markup.model()))
    return {n.kind for n, t in zip(nodes, take, strict=True) if t}, markup.clean(text, nodes, take)


PROSE = """The grove costs $ 81 in spring, though $ 90 was asked. Here n < 8 and m > 11, so it holds.
Multiply 30 * 31 * 3 for each weight. It was kept under C:\\Temp\\pond by mistake. Set some_buffer_max once.
Read grid[76][77] before [Ch 15, p.84]; treap == plan compares, R&D paid. A shuttle at $52.50 and one at $56.25.
As item #69 says, when a<plan the filter wins, and when b>76 it loses. Chapter 1 stays."""


def test_prose_is_kept():
    assert _clean(PROSE) == (set(), PROSE)


@pytest.mark.parametrize("text,kind,clean", [
    ("Intro words here.\n\n<h2 id=\"tub\">Tub field</h2>\n<p>Some <b>bold</b> text &amp; more.</p>", "html", "## Tub field"),
    ("Any words of it.\n\n```python\n# not a heading\nif a < b: pass\n```\nand so on.", "markdown", "# not a heading\nif a < b: pass"),
    ("This is **strong stuff** in a row of words.", "markdown", "This is strong stuff in a row of words."),
    ("See [[old page|the page]] of it.", "wiki", "See the page of it."),
    ("So that \\footnote{a word of it.} it was $x_{2} + y^2 = z$ again.", "latex", "$x_{2} + y^2 = z$"),
    ("== Old part ==\nText follows it here.", "wiki", "## Old part"),
    ("\\section{First part}\n\\label{sec:first}\nText follows it here.", "latex", "# First part"),
    ("{| class=\"x\"\n|-\n| left || 6\n|}\nText follows.", "wiki", "| left | 6 |"),
    ("<!-- hidden note -->\nText follows it here.", "html", "Text follows it here."),
])
def test_markup(text, kind, clean):
    kinds, out = _clean(text)
    assert kinds == {kind} and clean in out


def test_tree_is_nested():
    nodes = dom.tree("<div>a **b `c*d*e` f** <i>x</div> [l](u) </i> \\emph{z {y}}" * 50)
    for n in nodes:
        assert n.start <= n.a <= n.b <= n.end
        if n.parent >= 0:
            p = nodes[n.parent]
            assert p.a <= n.start and n.end <= p.b and n.depth == p.depth + 1


def test_long_odd_lines():
    """Texts made to be slow: one line, many openers, nothing closed."""
    import time

    for text in ("a | b " * 40_000, "`x " * 20_000, "<!-- x " * 20_000, "<b>x " * 20_000, "$x " * 20_000, "[[x " * 20_000, "''x " * 20_000, "**x " * 20_000, "\\begin{a} " * 10_000, "# " + "x " * 100_000):
        start = time.time()
        _, nodes, take = next(markup.decided([text], markup.model()))
        markup.clean(text, nodes, take)
        assert time.time() - start < 30


def test_clean_sources(spark):
    df = spark.createDataFrame([("a", "x **b** y", 1), ("a", "x **b** y", 1), ("n", None, 1), ("e", "", 1), (None, "<b>q</b>", 1), ("long", "word " * 50_000, 1)], "slug string, raw string, clean int")
    got = {r.source: r for r in markup.clean_sources(df).collect()}
    assert got["a"].clean == "x b y" and got["a"].kinds == ["markdown"] and got["n"].clean is None and got["e"].clean == "" and got["long"].clean == "word " * 50_000
    assert set(got) == {"a", "n", "e", "long"}
