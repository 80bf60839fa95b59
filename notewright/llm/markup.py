"""Markup residue: boosted trees decide which nodes of a text's tree are markup, then the text is written clean."""

from __future__ import annotations

import html
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import LITERAL_NAMES, TYPES, VOID, Node, tree
from .gbt import BoostedTrees

#: Names of HTML elements, and of frequent LaTeX commands and environments.
HTML_NAMES = set(
    "a abbr article aside b blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img "
    "input ins kbd label li link main mark math meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video".split()
)
LATEX_NAMES = set(
    "section subsection subsubsection chapter paragraph part title author label ref eqref cite citep citet footnote emph textbf textit texttt textsc underline item caption begin end includegraphics url href usepackage "
    "documentclass input frac sqrt sum int alpha beta gamma delta epsilon lambda mu pi sigma theta omega cdot times leq geq le ge infty left right mathbf mathrm text ldots dots quad hline maketitle bibliography noindent newline".split()
)
#: Labelled training texts made, and the seed: the whole training set is bounded by them.
TRAIN_TEXTS, SEED = 4000, 17
#: Features that attribute tokens are hashed to.
TOKEN_BUCKETS = 12


def _class(ch: str) -> int:
    if not ch:
        return 0
    if ch == "\n":
        return 2
    if ch.isspace():
        return 1
    if ch.isalnum():
        return 3
    return 4 if ch in "([{\"'“‘" else 5 if ch in ")]}.,;:!?\"'”’" else 6 if ch in "\\/:" else 7


class _Counts:
    """Prefix sums over one text, so that a node's whole content costs the same at any length."""

    SETS = {"letter": str.isalpha, "digit": str.isdigit, "space": " \n".__contains__, "blank": str.isspace, "break": "\n".__contains__, "script": "^_\\{}".__contains__, "sign": "=+<>".__contains__, "{": "{".__contains__, "|": "|".__contains__, "/": "/".__contains__, ".": ".".__contains__}

    def __init__(self, text: str) -> None:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        values, at = np.unique(code, return_inverse=True)
        chars = [chr(v) for v in values]
        is_ = {k: np.array([f(c) for c in chars], bool)[at] if chars else np.zeros(0, bool) for k, f in self.SETS.items()}
        latin = np.array(["a" <= c.lower() <= "z" and c.isascii() for c in chars], bool)[at] if chars else np.zeros(0, bool)
        n = len(code)
        gap, drive = np.zeros(n, bool), np.zeros(n, bool)  # a blank between two letters and two letters; the letter of "C:\\"
        if n > 4:
            gap[2:-2] = latin[:-4] & latin[1:-3] & (code[2:-2] == 32) & latin[3:-1] & latin[4:]
        if n > 2:
            drive[:-2] = latin[:-2] & (code[1:-1] == ord(":")) & (code[2:] == ord("\\"))
        # compact arrays whose single numbers are read fast
        flat = lambda first, v: array("i", np.concatenate(([first], v)).astype(np.int32).tobytes())
        self.sums = {k: flat(0, np.cumsum(v, dtype=np.int32)) for k, v in (is_ | {"gap": gap, "drive": drive}).items()}
        place = np.arange(n, dtype=np.int32)
        self.last = {k: flat(-1, np.maximum.accumulate(np.where(v, place, -1))) for k, v in (("break", is_["break"]), ("blank", is_["blank"]), ("other", ~latin))}

    def of(self, kind: str, a: int, b: int) -> int:
        """How many characters of a kind are in [a, b)."""
        return self.sums[kind][b] - self.sums[kind][a] if b > a else 0


@lru_cache(65_536)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKEN_BUCKETS


def _attribute_tokens(n: Node) -> list[int]:
    """How many tokens of a node's name and attribute names fall in each bucket."""
    out = [0] * TOKEN_BUCKETS
    for token in [n.name, *(re.findall(r"([A-Za-z_:][\w:-]*)\s*=", n.attrs.lower()) if n.attrs else ())]:
        if token:
            out[_bucket(token)] += 1
    return out


def features(text: str, nodes: list[Node]) -> list[list[float]]:
    """One row per node: type, name and attribute tokens, neighbours, content, subtree density, depth, siblings."""
    if not nodes:
        return []
    by_type: dict[str, int] = {}
    among: dict[tuple[int, str], int] = {}
    for n in nodes:
        by_type[n.type] = by_type.get(n.type, 0) + 1
        among[n.parent, n.type] = among.get((n.parent, n.type), 0) + 1
    counts, out = _Counts(text), []
    for n in nodes:
        a, b, size = n.a, n.b, n.b - n.a
        has = lambda kind: counts.of(kind, a, b)  # noqa: B023, E731
        first, last = text[a : min(a + 1, b)], text[b - 1 : b] if b > a else ""
        before, after = text[n.start - 1 : n.start] if n.start else "", text[n.end : n.end + 1]
        line = counts.last["break"][n.start] + 1
        siblings = len(nodes[n.parent].children) if n.parent >= 0 else 0
        same = among[n.parent, n.type] if n.parent >= 0 else 0
        covered = sum(nodes[i].end - nodes[i].start for i in n.children)
        known = n.name in HTML_NAMES if n.type == "tag" else n.name.rstrip("*") in LATEX_NAMES if n.type == "command" else False
        head = text[n.start : n.start + 3]
        # what stands right before: a path with a drive since the last blank, a backslash and letters, or a slash
        path = counts.of("drive", max(line, counts.last["blank"][n.start] + 1), n.start - 2)
        other = counts.last["other"][n.start]
        named = line <= other < n.start - 1 and text[other] == "\\"
        out.append([
            TYPES.index(n.type), n.depth, len(nodes), by_type[n.type], same, siblings, len(n.children),
            size, has("letter") / max(1, size), has("digit") / max(1, size), has("space"), covered / max(1, size),
            first.isspace(), last.isspace(), first.isdigit(), last.isalnum(), has("break") > 0,
            _class(before), _class(after), counts.of("blank", line, n.start) == n.start - line, n.start - line,
            known, "=" in n.attrs, bool(n.attrs) and "=" not in n.attrs and n.attrs != "/", n.name in VOID, len(n.name),
            has("script") > 0, has("sign") > 0, has("{") > 0, has("|") > 0, has("/") > 0, has(".") > 0,
            counts.of("gap", a + 2, b - 2) > 0, text[n.end - 1 : n.end] in ")}>;", head.count(head[:1]),
            before.isalnum() and after.isalnum(), path > 0 or named or (before == "/" and line < n.start), b > a and a < n.end,
            *_attribute_tokens(n),
        ])
    return out


# --- labelled training texts -------------------------------------------------


class _Maker:
    """Texts with constructs at known places; everything is invented from syllables."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def w(self) -> str:
        r = self.r
        return "".join(r.choice(("br", "c", "d", "f", "gl", "h", "k", "l", "m", "n", "p", "qu", "r", "s", "st", "t", "v", "w", "z")) + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(("", "n", "r", "st", "m", "é"))

    def ws(self, a: int = 1, b: int = 4, sep: str = " ") -> str:
        return sep.join(self.w() for _ in range(self.r.randint(a, b)))

    def num(self) -> int:
        return self.r.randint(1, 400)

    def sentence(self) -> str:
        s = self.ws(4, 14)
        return s[0].upper() + s[1:] + self.r.choice((".", ".", ";", ", and " + self.ws(2, 5) + "."))

    def inline(self) -> tuple[str, str]:
        """(kind, construct) inside a line; kind '' is prose."""
        r, w, ws, n = self.r, self.w, self.ws, self.num
        var = r.choice("abcnmxyzk")
        html_ = [
            lambda: f"<{(t := r.choice(('b', 'i', 'em', 'strong', 'span', 'sub', 'sup', 'a', 'code', 'u', 'SPAN', 'B', 'font', 'small')))}{r.choice(('', '', f' class={chr(34)}{w()}{chr(34)}', f' id={w()}', f' href={chr(34)}/{w()}/{w()}{chr(34)}', chr(10) + f'  class={chr(39)}{w()}{chr(39)}'))}>{r.choice((ws(), str(n())))}</{t}>",
            lambda: r.choice(("<br>", "<br/>", "<BR/>", "<br />", f'<img src="{w()}.png">', "<hr>")),
            lambda: r.choice(("&amp;", "&lt;", "&nbsp;", "&#8217;", "&#x2019;", "&quot;", "&eacute;", "&mdash;", f"&lt;{w()}&gt;")),
            lambda: f"<!-- {ws()} -->",
            lambda: f"<a href={chr(34)}https://{w()}.org/{w()}?{w()}={n()}{chr(34)} title='{w()}'>{ws()}</a>", lambda: f"<span style={chr(34)}{w()}: {w()}; {w()}: {n()}px{chr(34)}><{(t := r.choice(('b', 'i', 'q', 's')))}>{ws(2, 6)}</{t}></span>",
            lambda: r.choice((f"<input type={w()} disabled>", f"<img alt={chr(34)}{ws()}{chr(34)} src={w()}.jpg width={n()}>", f"</{r.choice(('p', 'div', 'span', 'b'))}>")),
        ]
        md = [
            lambda: f"**{ws()}**", lambda: f"__{ws()}__", lambda: f"*{ws(1, 2)}*", lambda: f"_{ws(1, 2)}_", lambda: f"~~{ws()}~~", lambda: f"***{w()}***",
            lambda: f"`{r.choice((ws(1, 3, '_'), w() + '()', ws(1, 2), w() + '.' + w()))}`", lambda: f"[{ws()}](/{w()}/{w()}.md)", lambda: f"[{ws()}](https://{w()}.org/{w()})", lambda: f"![{ws()}]({w()}/{w()}.png)",
            lambda: f"**{ws()} *{w()}* {ws()}**", lambda: f"***{ws()}***", lambda: f"[![{w()}]({w()}.svg)](https://{w()}.org)", lambda: f"[{ws()}](https://{w()}.org/{w()} {chr(34)}{ws()}{chr(34)})", lambda: f"**{self.sentence()}**", lambda: f"*{self.sentence()}*", lambda: f"[{w()} [{n()}]](/{w()})",
        ]
        wiki = [
            lambda: f"[[{ws()}]]", lambda: f"[[{ws()}|{ws()}]]", lambda: f"[[File:{w()}.png|thumb|{ws()}]]", lambda: f"[[Category:{w()}]]", lambda: f"{{{{{w()}|{ws()}}}}}", lambda: f"{{{{{w()}|{w()}={n()}}}}}",
            lambda: f"{{{{{w()} {w()}|title={ws()}|page={n()}}}}}", lambda: f"''{ws(1, 3)}''", lambda: f"'''{ws(1, 3)}'''", lambda: f"{{{{{w()}}}}}",
            lambda: f"{{{{{w()}|{w()}={{{{{w()}|{ws()}}}}}|{w()}={n()}}}}}", lambda: f"[[File:{w()}.jpg|thumb|{n()}px|{ws()} [[{w()}]] {ws()}]]", lambda: f"'''''{ws()}'''''", lambda: f"'''{w()} ''{w()}'' {w()}'''", lambda: f"[[{w()}#{ws()}|{w()}]]", lambda: f"[[{w()}:{ws()}]]",
        ]
        math = lambda: r.choice((f"{var}_{{{r.randint(1, 9)}}} + y^2 = z", f"{var}_{r.randint(1, 9)} \\le b", f"{var}^2", f"{var}", f"{var}={r.randint(1, 99)}", f"\\alpha + {var}", f"f({var})", f"{var} < {r.randint(1, 9)}", f"\\frac{{1}}{{{r.randint(2, 9)}}}"))
        latex = [
            lambda: f"\\footnote{{{ws(1, 4)}.}}", lambda: f"~\\cite{{{w()}{n()}}}", lambda: f"\\{r.choice(('emph', 'textbf', 'textit', 'ref', 'label', 'url', 'texttt'))}{{{r.choice((ws(1, 2), 'sec:' + w()))}}}",
            lambda: f"${math()}$", lambda: f"\\({math()}\\)", lambda: f"\\{r.choice(('ldots', 'noindent', 'newline', 'alpha', 'quad'))}", lambda: f"\\{r.choice(('emph', 'footnote', w()))}{{{ws(2, 5)}}}",
            lambda: f"\\textbf{{\\emph{{{ws()}}} {ws()}}}", lambda: f"\\cite[p.~{n()}]{{{w()}}}", lambda: f"$\\mathbb{{R}}^{{{var}}}$", lambda: f"${var}_1, \\ldots, {var}_n$", lambda: f"\\footnote{{{ws()} \\textit{{{ws()}}} {ws()}}}", lambda: f"\\href{{https://{w()}.org}}{{{ws()}}}", lambda: f"$O({var} \\log {var})$", lambda: (e := r.choice(("$", "$ "))) + r.choice((" + ", ", ", " = ", " - ")).join(math() for _ in range(r.randint(2, 40))) + e[::-1], lambda: f"${var} \\in {var.upper()}$",
        ]
        money = lambda: f"${n()}{r.choice(('', '.50', ',000', ' million'))}"
        prose = [
            lambda: f"{var} < {n()} and m > {n()}", lambda: f"a<{var} while {var}>{n()}", lambda: f"if {w()} <b and c> {w()}", lambda: f"{money()} {ws(1, 4)} {money()}", lambda: f"$ {n()} {ws(1, 4)} $ {n()}", lambda: f"{money()}-{money()} and {money()}",
            lambda: f"{n()} * {n()} * {n()}", lambda: f"{n()}*{n()}*{n()}", lambda: f"{var}*{w()}*{n()}", lambda: f"{w()}_{w()}_{w()}", lambda: f"__{w()}__", lambda: f"_{w()}_{w()}" if r.random() < 0.5 else f"{w().upper()}_{w().upper()}_{w().upper()}",
            lambda: f"{r.choice('CDE')}:\\{w().title()}\\{w()}", lambda: f"C:\\{w()}\\{w()}\\{w()}.txt", lambda: f"\\\\{w()}\\{w()}", lambda: f"{w()}[{n()}][{n()}]", lambda: f"{w()}[[{n()}]]", lambda: f"[Ch {n()}, p.{n()}]", lambda: f"{w()}[{n()}](x)" if r.random() < 0.3 else f"[{n()}] ({ws()})",
            lambda: f"#{n()}", lambda: f"# {n()}" if r.random() < 0.2 else f"C# and F#", lambda: f"{w()} == {w()}, {w()} = {w()}", lambda: f"R&D; {w()} & {w()}", lambda: f"AT&T", lambda: f"~{n()} to ~{n()}", lambda: f"~~{n()} and {n()}~~" if r.random() < 0.1 else f"~/{w()}/{w()}",
            lambda: f"{n()}'{n()}''", lambda: f"5'' by {n()}''", lambda: f"{w()} | {w()}", lambda: f"/{w()}/{w()}", lambda: f"{w()}@{w()}.org", lambda: f"{{{w()}}}", lambda: f"{w()} -> {w()} <- {w()}", lambda: f"<{n()}>", lambda: f"<{w()}@{w()}.org>", lambda: f"2^{n()} or x_{r.randint(1, 9)}",
            lambda: f"{w().title()}<{w().title()}>", lambda: f"{w().title()}<{w()}, {w()}>", lambda: f"${w().upper()}/{w()} and ${w().upper()}", lambda: f"${{{w()}}}", lambda: f"{w()}(*{w()}, **{w()})", lambda: f"{w()} *{w()}, *{w()};", lambda: f"{n()}**{n()} and {n()}**{r.randint(1, 9)}",
            lambda: f"{{{chr(34)}{w()}{chr(34)}: {{{chr(34)}{w()}{chr(34)}: {n()}}}}}", lambda: f"[[{n()}, {n()}], [{n()}, {n()}]]", lambda: f"%{w().upper()}%\\{w()}", lambda: f"{chr(34)}{w()}\\n{w()}{chr(34)}", lambda: f"^{w()}.*{w()}$", lambda: f"\\d+\\s*{w()}", lambda: f"{w()} = ''", lambda: f"'' and ''",
            lambda: f"{w()}*, {w()}*", lambda: f"#{w()} #{w()}", lambda: f"{w()} || {w()} | {w()}", lambda: f"--{w()}={w()}", lambda: f"{w()} <= {n()} => {w()}", lambda: f"<{n()} or >{n()}", lambda: f"______", lambda: f"{w()}[{w()}({n()})]", lambda: f"({w()})[{n()}]", lambda: f"{w()}[{var}][{var}+1]",
            lambda: f"{n()}~{n()}", lambda: f"${n()}k-${n()}k", lambda: f"{w()} & {w()}; {w()}", lambda: f"{w()}_{r.randint(1, 9)}_{r.randint(1, 9)}", lambda: f"{w()}.__{w()}__.{w()}", lambda: f"\'{w()}\' ''{w()}",
        ]
        kind, pool = r.choice((("html", html_), ("markdown", md), ("wiki", wiki), ("latex", latex), ("", prose), ("", prose), ("", prose)))
        got = r.choice(pool)()
        if pool is prose and re.fullmatch(r"__\w+__", got):
            got = w() + got + w()  # a name with double underscores inside
        return kind, got

    def block(self) -> tuple[str, str]:
        """(kind, lines) of a whole block."""
        r, w, ws = self.r, self.w, self.ws
        rows = range(r.randint(1, 4))
        return r.choice([
            lambda: ("html", f"<{(t := r.choice(('p', 'P', 'div', 'h2', 'li', 'blockquote')))}{r.choice(('', f' id={chr(34)}{w()}{chr(34)}'))}>{self.sentence()}</{t}>"),
            lambda: ("html", "<ul>\n" + "\n".join(f"  <li>{ws()}</li>" for _ in rows) + "\n</ul>"),
            lambda: ("html", "<table>\n" + "\n".join(f"<tr><td>{w()}</td><td>{w()}</td></tr>" for _ in rows) + "\n</table>"),
            lambda: ("html", f"<pre><code>\n{w()} = {w()}[0] * {w()}\n</code></pre>"),
            lambda: ("markdown", "#" * r.randint(1, 6) + " " + ws(1, 5).capitalize()),
            lambda: ("markdown", f"```{r.choice(('python', '', 'sql'))}\n# {ws()}\ndef {w()}({w()}):\n    return {w()} < 5\n```"),
            lambda: ("markdown", f"| {w()} | {w()} |\n|---|---|\n" + "\n".join(f"| {w()} | {w()} |" for _ in rows)),
            lambda: ("markdown", "\n".join(f"- [{r.choice(' xX')}] {ws()}" for _ in rows)),
            lambda: ("wiki", (e := "=" * r.randint(2, 5)) + f" {ws(1, 4)} " + e),
            lambda: ("wiki", '{| class="' + w() + '"\n|-\n' + "\n|-\n".join(f"| {w()} || {r.randint(1, 9)}" for _ in rows) + "\n|}"),
            lambda: ("latex", "\\begin{itemize}\n" + "\n".join(f"\\item {ws()}" for _ in rows) + "\n\\end{itemize}"),
            lambda: ("latex", "\\begin{equation}\n" + f"\\alpha_{{{r.randint(1, 9)}}} = \\frac{{1}}{{{r.randint(2, 20)}}}" + "\n\\end{equation}"),
            lambda: ("latex", f"\\{r.choice(('section', 'subsection', 'chapter'))}{{{ws()}}}\n\\label{{sec:{w()}}}"),
            lambda: ("latex", f"$$\n\\sum_{{i=1}}^{{{r.randint(2, 9)}}} i^2\n$$"),
            lambda: ("latex", f"\\[\nE = {self.num()} \\cdot m\n\\]"),
            lambda: ("html", f"<div class={chr(34)}{w()} {w()}{chr(34)}>\n  <p>{self.sentence()}</p>\n  <ol>\n" + "\n".join(f"    <li>{ws()}</li>" for _ in rows) + "\n  </ol>\n</div>"),
            lambda: ("html", "<table>\n" + f"<tr><th>{w()}</th><th>{w()}</th></tr>\n" + "\n".join(f"<tr><td>{w()}</td><td>{self.num()}</td></tr>" for _ in rows) + "\n</table>"),
            lambda: ("html", f"<{(t := r.choice(('script', 'style')))}>\n{w()} {{ {w()}: {w()}; }}\n</{t}>"),
            lambda: ("html", f"<!--\n{ws()}\n{self.sentence()}\n-->"),
            lambda: ("markdown", f"~~~{r.choice(('', 'js'))}\n{w()} = {w()} * {self.num()} * {w()};\n~~~"),
            lambda: ("markdown", f"| {w()} | {w()} | {w()} |\n| :--- | ---: | :-: |\n" + "\n".join(f"| {w()} | **{w()}** | {self.num()} |" for _ in rows)),
            lambda: ("wiki", "{{" + w() + "\n" + "\n".join(f"| {w()} = {ws()}" for _ in rows) + "\n}}"),
            lambda: ("wiki", "{|\n|+ " + ws() + f"\n! {w()} !! {w()}\n|-\n" + "\n|-\n".join(f"| {w()}\n| '''{w()}'''" for _ in rows) + "\n|}"),
            lambda: ("latex", "\\begin{enumerate}\n" + "\n".join(f"\\item {ws()} \\emph{{{w()}}}" for _ in rows) + "\n\\end{enumerate}"),
            lambda: ("latex", "\\begin{figure}[h]\n\\centering\n\\includegraphics[width=3cm]{" + w() + "}\n\\caption{" + ws() + "}\n\\label{fig:" + w() + "}\n\\end{figure}"),
            lambda: ("latex", "\\begin{tabular}{ll}\n" + "\n".join(f"{w()} & {self.num()} \\\\" for _ in rows) + "\n\\end{tabular}"),
            lambda: ("latex", "\\begin{align}\n" + f"{w()[0]} &= \\sum_{{k}} k^2 \\\\\n &\\leq {self.num()}" + "\n\\end{align}"),
            lambda: ("latex", "\\begin{verbatim}\n" + f"{w()}[{self.num()}] = *{w()}" + "\n\\end{verbatim}"),
            lambda: ("", f"{w()} == {w()}, whereas {w()} = {self.num()} sets it."),
            lambda: ("", f"= {ws(1, 2)} ends at {w()} ="),
            lambda: ("", f"{r.choice(('* * *', '***', '-----', '=====', '_____'))}"),
            lambda: ("", f"* {ws()}\n* {ws()}"),
            lambda: ("", f"*{ws()}, but see {w()}."),
            lambda: ("", f"Chapter {r.randint(1, 20)} {ws(1, 3).title()}"),
            lambda: ("", f"{w()} | {w()} | {w()}\n---- {ws()}"),
            lambda: ("", f"- {ws()}\n- {ws()}"),
            lambda: ("", f"    {w()} = {w()}[{r.randint(0, 9)}]"),
        ])()

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = [], [], 0

        def put(s: str) -> None:
            nonlocal at
            out.append(s)
            at += len(s)

        for _ in range(self.r.randint(1, 4)):
            if self.r.random() < 0.35:
                kind, s = self.block()
                spans.append((at, at + len(s), kind))
                put(s + "\n\n")
                continue
            for _ in range(self.r.randint(1, 4)):
                kind, s = self.inline()
                joined = s[0] in "<&\\[{~" and kind in ("html", "wiki", "latex") and self.r.random() < 0.25
                put(self.ws(1, 6) + ("" if joined else self.r.choice((" ", " ", "\n", ": ", " ("))))
                spans.append((at, at + len(s), kind))
                put(s + self.r.choice((" ", ", ", ". ", "\n", "; ", ")", "" if kind == "html" else " ")))
            put(self.sentence() + "\n\n")
        return "".join(out), spans


def training_rows(texts: int = TRAIN_TEXTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of made texts: 1 where a node lies in a construct of its own kind.

    Nodes inside another kind's literal content are left to the decoder and
    are not training rows.
    """
    maker, xs, ys = _Maker(seed), [], []
    for _ in range(texts):
        text, spans = maker.text()
        nodes = tree(text)
        for n, f in zip(nodes, features(text, nodes), strict=True):
            inside = [k for a, b, k in spans if a <= n.start and n.end <= b]
            if inside and inside[0] and inside[0] != n.kind:
                continue
            xs.append(f)
            ys.append(1.0 if inside and inside[0] == n.kind else 0.0)
    return np.array(xs, dtype=float), np.array(ys)


@lru_cache(2)
def model(texts: int = TRAIN_TEXTS, seed: int = SEED) -> BoostedTrees:
    """The fitted trees; made once a process."""
    return BoostedTrees().fit(*training_rows(texts, seed))


# --- decoding -----------------------------------------------------------------


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """Markup or prose for every node: the most likely choice without contradictions.

    Nothing inside literal content (code, formulas, comments) is markup: a
    node under a literal node of markup is prose with certainty, one that is
    free counts with its own probability. Sums of log-probabilities go up the
    tree once and choices down once.
    """
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    free = [0.0] * len(nodes)  # best sum of the descendants
    take = [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        as_markup = float(yes[i]) + (0.0 if n.literal else free[i])
        as_prose = float(no[i]) + free[i]
        take[i] = as_markup > as_prose
        if n.parent >= 0:
            free[n.parent] += max(as_markup, as_prose)
    shut = [False] * len(nodes)
    for i, n in enumerate(nodes):
        if n.parent >= 0 and (shut[n.parent] or (take[n.parent] and nodes[n.parent].literal)):
            shut[i], take[i] = True, False
    return take


def decided(texts: list[str], trees: BoostedTrees) -> Iterator[tuple[str, list[Node], list[bool]]]:
    """Every text with its nodes and their decisions; all nodes are scored together."""
    parsed = [tree(t) for t in texts]
    rows = [f for t, nodes in zip(texts, parsed, strict=True) for f in features(t, nodes)]
    margin = trees.margin(np.array(rows, dtype=float)) if rows else np.empty(0)
    at = 0
    for t, nodes in zip(texts, parsed, strict=True):
        yield t, nodes, decode(nodes, margin[at : at + len(nodes)])
        at += len(nodes)


# --- clean text ----------------------------------------------------------------

_BLOCK = {"p", "div", "section", "article", "ul", "ol", "dl", "table", "blockquote", "header", "footer", "figure", "main", "tr", "br", "hr", "dt", "dd", "caption", "body", "html"}
_DROP = {"script", "style", "head"}
_LEVEL = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_LISTS = {"ul", "ol", "itemize", "enumerate", "description"}
_GONE = {"label", "cite", "citep", "citet", "ref", "eqref", "maketitle", "noindent", "usepackage", "documentclass", "bibliography", "input", "includegraphics", "centering", "hline"}
_WEB = re.compile(r"(?:https?://|mailto:)[^\s\"'<>]+")


def _row(cells: list[str], head: bool = False) -> str:
    line = "| " + " | ".join(" ".join(x.split()) for x in cells) + " |"
    return line + "\n|" + "---|" * len(cells) if head else line


def _braces(s: str) -> str:
    return re.sub(r"^\{|\}$", "", s.replace("}{", " "))


def _with_target(label: str, target: str) -> str:
    """A link's text, with its address behind it where that leads out and the text does not say it."""
    m = _WEB.match(target.strip())
    return f"{label} ({m[0]})" if m and m[0] not in label else label


def _wiki_table(inner: str) -> str:
    """Rows of a wiki table: ``|-`` parts them, ``!`` opens header cells, ``|+`` the caption; a cell's attributes go."""
    out, row, head = [], [], False
    for line in [*inner.split("\n"), "|-"]:
        line = line.strip()
        if line.startswith("|-"):
            if row:
                out.append(_row(row, head))
            row, head = [], False
        elif line.startswith("|+"):
            out.append(line[2:].strip())
        elif line[:1] in ("|", "!"):
            head = head or line[0] == "!"
            cells = re.split(r"\|\||!!" if line[0] == "!" else r"\|\|", line[1:])
            row += [re.sub(r"^[^|\[\]]*=[^|\[\]]*\|(?!\|)", "", c) for c in cells]
        elif line and row:
            row[-1] += " " + line
    return "\n".join(out)


class _Writer:
    """Writes the clean text of one decided tree."""

    def __init__(self, text: str, nodes: list[Node], take: list[bool]) -> None:
        self.text, self.nodes, self.take = text, nodes, take
        self.number: dict[int, tuple[int, int, bool]] = {}  # item: (depth of lists, place in its list, ordered)
        seen: dict[int, int] = {}
        depth = [0] * len(nodes)
        list_of = [-1] * len(nodes)
        for i, n in enumerate(nodes):
            up = n.parent
            depth[i], list_of[i] = (depth[up], list_of[up]) if up >= 0 else (0, -1)
            if take[i] and n.name in _LISTS and n.b > n.a:
                depth[i], list_of[i] = depth[i] + 1, i
            elif take[i] and n.name in ("li", "item"):
                k = list_of[i]
                seen[k] = seen.get(k, 0) + 1
                self.number[i] = (max(0, depth[i] - 1), seen[k], k >= 0 and nodes[k].name in ("ol", "enumerate"))

    def mark(self, i: int) -> str:
        depth, place, ordered = self.number[i]
        return "  " * depth + (f"{place}." if ordered else "-")

    def write(self, i: int, inner: str) -> str:
        """What a node of markup becomes; ``inner`` is its content, already clean."""
        n, text = self.nodes[i], self.text
        raw = text[n.a : n.b]
        if n.type == "tag":
            return self.tag(i, n, raw, inner)
        if n.type == "comment":
            return ""
        if n.type == "charref":
            return html.unescape(text[n.start : n.end]).replace("\xa0", " ")
        if n.type in ("fence", "code"):
            return text[n.start : n.end]
        if n.type == "mdtable":
            return inner
        if n.type in ("display", "math"):
            return f"${' '.join(raw.split())}$" if n.type == "math" else f"$${raw}$$"
        if n.type in ("heading", "task"):
            return text[n.start : n.a] + inner if n.type == "heading" else re.sub(r"\[[ xX]\]", "", text[n.start : n.end]).rstrip()
        if n.type == "wheading":
            return f"{'#' * len(text[n.start : n.a].rstrip())} {inner}"
        if n.type == "link":
            return _with_target(inner, text[n.b + 2 : n.end - 1])
        if n.type in ("wlink", "template"):
            first, *rest = inner.split("|")
            if n.type == "template" or first.strip().lower().startswith("category:"):
                return ""
            if re.match(r"(?i)\s*(file|image):", first):
                words = [x for x in rest if not re.fullmatch(r"\s*(?:thumb|thumbnail|frame|frameless|border|left|right|center|none|upright|\d*x?\d+px|\w+=.*)\s*", x)]
                return words[-1].strip() if words else ""
            return rest[-1] if rest else first
        if n.type == "wtable":
            return _wiki_table(inner)
        if n.type == "env":
            if n.name.rstrip("*") in ("equation", "align", "displaymath", "math", "gather"):
                return f"$${raw}$$"
            if n.name.rstrip("*") in ("tabular", "array", "longtable"):
                rows = [re.split(r"(?<!\\)&", x) for x in re.sub(r"\\hline\b", "", inner).split("\\\\") if x.strip()]
                return "\n".join(_row(x) for x in rows)
            return f"```{raw}```" if n.name in LITERAL_NAMES else inner.strip("\n")
        if n.type == "command":
            return self.command(i, n, raw, inner)
        return inner  # emphasis and images: their text

    def tag(self, i: int, n: Node, raw: str, inner: str) -> str:
        name, filled = n.name, n.b > n.a
        if name in _DROP:
            return ""
        if re.fullmatch("h[1-6]", name):
            return f"\n{'#' * int(name[1])} {inner.strip()}\n" if filled else ""
        if name == "li":
            return "" if n.attrs == "/" else f"\n{self.mark(i)} {inner.strip()}"
        if name == "pre" and filled:
            return "\n```\n" + html.unescape(re.sub(r"</?code[^<>]*>", "", raw)).strip("\n") + "\n```\n"
        if name == "code" and filled:
            return f"`{html.unescape(raw)}`"
        if name in ("td", "th"):
            return f" {' '.join(inner.split())} |"
        if name == "tr":
            cells = [self.nodes[c].name for c in n.children if self.take[c] and self.nodes[c].type == "tag" and self.nodes[c].name in ("td", "th")]
            rule = "\n|" + "---|" * len(cells) if cells and set(cells) == {"th"} else ""
            return f"\n| {' '.join(inner.split())}{rule}" if inner.strip() else "\n"
        if name == "a":
            m = re.search(r"(?i)\bhref\s*=\s*[\"']?([^\s\"'<>]+)", n.attrs)
            return _with_target(inner, html.unescape(m[1])) if m and inner.strip() else inner
        if name == "img":
            m = re.search(r"(?i)\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", n.attrs)
            return html.unescape(next((x for x in m.groups() if x), "")) if m else ""
        if name in _BLOCK:
            return "\n" + inner[inner[:1] == "\n" :] + "\n" * (inner[-1:] != "\n") if filled else "\n"
        return inner

    def command(self, i: int, n: Node, raw: str, inner: str) -> str:
        name, tie = n.name.rstrip("*"), " " if self.text[n.start] == "~" else ""
        if name in _LEVEL:
            return f"{tie}{'#' * _LEVEL[name]} {_braces(inner)}"
        if name == "item":
            return self.mark(i)
        if name in _GONE:
            return ""
        if name == "footnote":
            return f" ({_braces(inner).strip()})"
        if name == "href" and (m := re.match(r"\{([^{}]*)\}", raw)):
            return tie + _with_target(_braces(inner[m.end() :]), m[1])
        return tie + _braces(inner) if raw else self.text[n.start : n.end]


def clean(text: str, nodes: list[Node], take: list[bool]) -> str:
    """The text with its markup written as plain structure; prose is kept to the letter.

    Line breaks that a construct brings along fall together with those that
    stand beside it already; no others are touched.
    """
    if not any(take):
        return text
    writer = _Writer(text, nodes, take)
    roots = [i for i, n in enumerate(nodes) if n.parent < 0]
    done: dict[int, str] = {}

    def body(a: int, b: int, children: list[int]) -> str:
        parts, at, fresh = [], a, True  # fresh: nothing but a line break stands before

        def put(s: str) -> None:
            nonlocal fresh
            if s:
                parts.append(s)
                fresh = s[-1] == "\n"

        for c in children:
            n, s = nodes[c], done.pop(c)
            put(text[at : n.start])
            if take[c] and n.type == "tag":
                s = s[1:] if fresh and s[:1] == "\n" else s
                s = s[:-1] if s[-1:] == "\n" and text[n.end : n.end + 1] == "\n" else s
            put(s)
            at = n.end
        put(text[at:b])
        return "".join(parts)

    for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
        n = nodes[i]
        inner = body(n.a, n.b, n.children)
        done[i] = writer.write(i, inner) if take[i] else text[n.start : n.a] + inner + text[n.b : n.end]
    return body(0, len(text), roots)


def clean_sources(df: DataFrame, id_col: str = "slug", text_col: str = "raw", texts: int = TRAIN_TEXTS, seed: int = SEED) -> DataFrame:
    """(source, kinds, n_nodes, n_markup, clean) of every distinct source.

    Headings come out as ``#`` lines, lists as ``-``, tables as ``|`` rows,
    code in backticks, formulas in dollars; other markup leaves its text.
    kinds are the languages of the nodes decided as markup, sorted. The model
    is fitted on ``texts`` made texts (a fixed bound) and sent to the tasks.
    Copies of a source count once, of differing texts the greatest; a null
    text has no kinds and stays null, an empty one stays empty; a null id is
    left out; other columns are ignored. Nodes are found in whole texts, and
    their features count whole contents.
    """
    fitted = df.sparkSession.sparkContext.broadcast(model(texts, seed))
    one = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("source")).agg(F.max(text_col).alias("raw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = fitted.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                out = []
                for source, raw, (text, nodes, take) in zip(part["source"], part["raw"], decided([x or "" for x in part["raw"]], trees), strict=True):
                    kinds = sorted({n.kind for n, t in zip(nodes, take, strict=True) if t})
                    out.append((source, kinds, len(nodes), sum(take), None if raw is None else clean(text, nodes, take)))
                yield pd.DataFrame(out, columns=["source", "kinds", "n_nodes", "n_markup", "clean"])

    return one.mapInPandas(run, "source string, kinds array<string>, n_nodes int, n_markup int, clean string")


def kinds_found(df: DataFrame) -> DataFrame:
    """(source, kind) of every kind of markup a source holds."""
    return clean_sources(df).select("source", F.explode("kinds").alias("kind"))
