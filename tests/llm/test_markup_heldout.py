"""Markup and prose in forms that neither the training texts nor the test tables hold, and how well prose survives."""

import pytest

from notewright.llm import markup

#: (languages, text): passages written for this test alone.
CONSTRUCTS = [
    ({"html"}, "The meeting is at noon.<br clear=all>Bring a coat, it may rain before evening."),
    ({"html"}, "<article><header><h3>Tides of the week</h3></header><p>High water comes twice a day.</p></article>"),
    ({"html"}, "Press <kbd>Ctrl</kbd> and wait until the lamp turns green."),
    ({"html"}, "<dl><dt>Sill</dt><dd>the lower part of a window</dd></dl>\nas the list above says."),
    ({"html"}, "Fish &amp; chips for two, please &hellip; and a pot of tea."),
    ({"html"}, "<blockquote cite=\"letters\">Never was so much owed.</blockquote>\nSo he wrote."),
    ({"html"}, "Water is H<sub>2</sub>O, as everybody learns at school."),
    ({"html"}, "A line before.\n<!-- TODO: check the year -->\nA line behind."),
    ({"markdown"}, "## Getting started with bees\n\nBuy a veil first and read a lot."),
    ({"markdown"}, "It is **very** important to close the gate, and _never_ to leave it open."),
    ({"markdown"}, "Run `make install` before anything else, then restart."),
    ({"markdown"}, "![A heron at dawn](img/heron.jpg)\n\nThe heron stood still."),
    ({"markdown"}, "The rules are in [the handbook](https://rules.example/book?id=4) of the club."),
    ({"markdown"}, "```sh\ncurl -s localhost | sort\n```\nprints all of them."),
    ({"markdown"}, "- [x] boil the eggs\n- [ ] set the table\n"),
    ({"markdown"}, "| Town | People |\n|:-----|-------:|\n| Ulm | 126000 |\n\nsource: own count"),
    ({"markdown"}, "The price was ~~twelve~~ ten coins on that day."),
    ({"wiki"}, "=== Early life ===\nHe grew up near the harbour."),
    ({"wiki"}, "The [[Battle of Hastings|battle]] lasted one day only."),
    ({"wiki"}, "{{Infobox river\n| name = Saale\n| length = 413\n}}\nThe river flows north."),
    ({"wiki"}, "The ''Beagle'' set sail in December, and '''Darwin''' was on board."),
    ({"wiki"}, "It was founded in 1850.{{citation needed|date=May 2020}} Later it moved."),
    ({"wiki"}, "[[Category:Rivers of Thuringia]]\nThe river has many bends."),
    ({"wiki"}, "{| border=1\n! Year !! Yield\n|-\n| 1990 || 14\n|}\nNo more years are known."),
    ({"latex"}, "As \\citet{knuth1984} shows, typesetting is hard to do well."),
    ({"latex"}, "\\subsection{Materials and methods}\nAll samples were kept cold."),
    ({"latex"}, "The area is $\\pi r^2$ where $r$ denotes the radius of the disc."),
    ({"latex"}, "\\begin{quote}\nTo be or not to be.\n\\end{quote}\nThat was the question."),
    ({"latex"}, "We find\n\\[ \\int_0^1 x \\, dx = \\frac{1}{2} \\]\nfor the first case."),
    ({"latex"}, "See Section~\\ref{sec:proof} for the proof, \\emph{mutatis mutandis}."),
    ({"latex"}, "\\begin{align*}\na &= b + c \\\\\n  &= d\n\\end{align*}\nends the proof."),
]
#: Prose, code talk and data that use the same characters.
DECOYS = [
    "The result holds if p < 0.05 and n > 30; otherwise repeat the trial.", "She paid $5 for the bread and $12 for the cheese.", "Rates went from ~3% to ~4% in May.", "The file my_old_notes_v2.txt was lost.",
    "In C one writes int *a, *b; and then a = b.", "Call print(*args, **kwargs) at the end.", "A Map<String> holds strings, a List<Integer> numbers.", "Set $PATH and $HOME first, then log in again.",
    "The regular expression ^a.*z$ fits any such word.", "He lives at D:\\photos\\2019\\summer and nowhere else.", "{\"id\": {\"n\": 3}, \"ok\": true}", "The matrix [[1, 0], [0, 1]] changes nothing.",
    "Take 2 * 3 * 4 boxes, i.e. 24 of them.", "x = y, y = z and so x = z.", "if (a == b) { return a; }", "Our score was 3:2 (#7 scored twice).",
    "Mail me at <jo@example.org> before Monday.", "A door of 6'2'' by 3'1'' is enough.", "Tom & Jerry; Bonnie & Clyde; R&B.", "See [4] and [12, p. 7] for more.", "The variables x_1, x_2 and x_3 are free.",
    "The shares fell | the bonds rose | gold held.", "Use cp -r ~/docs /backup and wait.", "He said \\\"no\\\" and left.", "Note*: prices* may change without notice.", "Row[i][j] is the cell, row[j][i] its mirror.",
    "one => two -> three <- four", "The C# and F# languages run there.", "Fold the paper 10-15 times [sic] and {press} it.", "1. Wash the rice.\n2. Boil it.\n- or leave it raw", "50% off * only today *",
    "It costs $20/month or $200/year.", "\"\\n\" ends a line and \"\\t\" is a tab.", "The ratio a:b = c:d is kept == true.", "I <3 this song!", "Chapter 4: The Storm (pp. 12-19)",
]


def _decide(text):
    _, nodes, take = next(markup.decided([text], markup.model()))
    return {n.kind for n, t in zip(nodes, take, strict=True) if t}, markup.clean(text, nodes, take)


def test_unseen_constructs():
    right = [_decide(text)[0] == kinds for kinds, text in CONSTRUCTS]
    assert sum(right) / len(right) >= 0.9, [CONSTRUCTS[i][1] for i, r in enumerate(right) if not r]


def test_unseen_prose_is_kept():
    right = [_decide(text) == (set(), text) for text in DECOYS]
    assert sum(right) / len(right) >= 0.9, [(d, _decide(d)) for d, r in zip(DECOYS, right, strict=True) if not r]


def test_prose_between_constructs_is_unharmed():
    """Every stretch between the constructs of made texts must stand in the clean text, in order."""
    maker, all_, kept = markup._Maker(9001), 0, 0
    made = [maker.text() for _ in range(400)]
    for (text, spans), (_, nodes, take) in zip(made, markup.decided([t for t, _ in made], markup.model()), strict=True):
        out, at, to = markup.clean(text, nodes, take), 0, 0
        for a, b, kind in [*sorted(spans), (len(text), len(text), "end")]:
            if kind:
                for word in text[at:a].split():
                    all_ += len(word)
                    where = out.find(word, to)
                    if where >= 0:
                        kept, to = kept + len(word), where
                at = b
    assert all_ > 50_000 and kept / all_ >= 0.995


def test_nested_and_long_markup_leaves_nothing():
    cases = [
        ("{{infobox|" + "name=value|" * 240 + "}} Words after it.", {"wiki"}, " Words after it."),
        ("**" + "word " * 129 + "end** after it.", {"markdown"}, "word " * 129 + "end after it."),
        ("[[File:pond.png|thumb|" + "a long caption of it " * 32 + "]] after it.", {"wiki"}, ("a long caption of it " * 32).strip() + " after it."),
        ("{{cite|title={{lang|fr|mot}}|page=3}} Words follow it.", {"wiki"}, " Words follow it."),
        ("It is **bold *and slanted* text** here.", {"markdown"}, "It is bold and slanted text here."),
        ("A \\footnote{with \\textbf{a {deep {nest}}} inside} word.", {"latex"}, "A  (with a {deep {nest}} inside) word."),
    ]
    for text, kinds, want in cases:
        assert _decide(text) == (kinds, want)
    for formula in ("\\[" + " a_{1} + b_{2} +" * 200 + " c \\]", "$" + " a_{1} + b_{2} +" * 20 + " c $"):
        kinds, out = _decide(f"We find {formula} at last.")
        assert kinds == {"latex"} and out.count("a_{1}") == formula.count("a_{1}")


def test_structure_is_kept():
    cases = [
        ("<ol>\n<li>one</li>\n<li>two\n<ul><li>in</li></ul></li>\n</ol>\nnext", "1. one\n2. two\n  - in\nnext"),
        ("\\begin{enumerate}\n\\item first\n\\item second\n\\begin{itemize}\n\\item in\n\\end{itemize}\n\\end{enumerate}\nText.", "1. first\n2. second\n  - in\nText."),
        ("<table>\n<tr><th>A</th><th>B</th></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>\nText", "| A | B |\n|---|---|\n| 1 | 2 |\nText"),
        ("{| class=\"x\"\n|+ Caption\n! h1 !! h2\n|-\n| style=\"a\" | left\n| '''bold'''\n|-\n| c || d\n|}\nText", "Caption\n| h1 | h2 |\n|---|---|\n| left | bold |\n| c | d |\nText"),
        ("See <a href=\"https://c.org/x?a=1&amp;b=2\">here</a> and [there](https://a.org/b \"title\").", "See here (https://c.org/x?a=1&b=2) and there (https://a.org/b)."),
    ]
    for text, want in cases:
        assert _decide(text)[1] == want


def test_edits_stay_inside_constructs():
    text = "It was ~ 5 of them, as w~\\cite{abc} says.\n\n\n\n\nFour blank lines and ```\n\n\n\n\n``` too."
    assert _decide(text)[1] == text.replace("~\\cite{abc}", "")


@pytest.mark.parametrize("text", ["{" * 60_000, "[" * 60_000 + "]", "{{a|" * 20_000 + "}}" * 20_000, "*a " * 60_000 + "b*", "''a " * 40_000, "\\begin{a}" * 20_000 + "\\end{a}" * 20_000, "[a](" * 30_000, "\\a{" * 20_000 + "}" * 20_000])
def test_odd_nesting_stays_linear(text):
    import time

    start = time.time()
    _decide(text)
    assert time.time() - start < 40
