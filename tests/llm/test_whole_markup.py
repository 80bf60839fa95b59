"""Markup at any length, and features of whole contents."""

import time

import pytest

from notewright.llm import dom, markup

LONG = "word " * 2_000 + "end"


@pytest.mark.parametrize("type_,text", [
    ("display", f"\\[{LONG}\\]"), ("display", f"$${LONG}$$"), ("template", f"{{{{{LONG}}}}}"), ("wlink", f"[[{LONG}]]"), ("image", f"![{LONG}](u.png)"), ("link", f"[{LONG}](u)"),
    ("math", f"\\({LONG}\\)"), ("math", f"${LONG}$"), ("math", "$" + "a b\n" * 2_500 + "c$"), ("strike", f"~~{LONG}~~"), ("strong", f"**{LONG}**"), ("strong", f"__{LONG}__"), ("emph", f"*{LONG}*"), ("emph", f"_{LONG}_"),
    ("fence", f"~~~\n{LONG}\n~~~"), ("tag", f"<ul>{'<li>x' * 2_500}</ul>"), ("tag", f"<pre>{'<b>x' * 2_500}</pre>"),
])
def test_long_constructs(type_, text):
    assert len(text) >= 10_000
    spans = {(n.type, n.start, n.end) for n in dom.tree(f"before\n\n{text}\n\nafter")}
    assert (type_, 8, 8 + len(text)) in spans


def test_paragraphs_end_inline_constructs():
    text = "\\(a\n\nb\\) ~~a\n \nb~~ __a\n\nb__ **a\n\nb** $a\n\nb$ \\(c\\) ~~d~~"
    assert sorted(n.type for n in dom.tree(text)) == ["math", "strike"]


def test_unclosed_openers_stay_linear():
    for x in ("\\[x ", "\\(x ", "~~x ", "__x ", "**x ", "*x ", "_x ", "{{x ", "![x ", "[x ", "$$x ", "$x\n", "<b>x</i>", "\\(x\n\n"):
        start = time.time()
        dom.tree(x * 40_000 + "\\] \\) x~~ x__ }} ]] $$")
        assert time.time() - start < 20, x


def test_features_count_whole_contents():
    """What stands beyond the 400th character of an element, its 200th sibling and the 200th character of a line."""
    text = "y" * 500 + " <p>" + "x" * 600 + " 12 ab cd {|/.=</p>\n<div>" + "<b>x</b>" * 300 + "</div>"
    nodes = dom.tree(text)
    rows = markup.features(text, nodes)
    p, b = (next(i for i, n in enumerate(nodes) if n.name == name) for name in ("p", "b"))
    inner = text[nodes[p].a : nodes[p].b]
    assert rows[p][7:11] == [len(inner), sum(c.isalpha() for c in inner) / len(inner), sum(c.isdigit() for c in inner) / len(inner), inner.count(" ")]
    assert not rows[p][15] and all(rows[p][25:32]) and rows[p][32] and rows[p][20] == 501  # the last character, marks, two words, the line before
    assert rows[b][4] == rows[b][5] == 300
