"""A tree of everything in a text that may be markup, of four languages at once. Constructs have no greatest length."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_P = r"(?:(?!\n[ \t]*\n)[\s\S])"  # any character of one paragraph
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)(/?)>")


#: Types whose content is literal: nothing inside them is markup.
LITERAL = {"comment", "fence", "code", "display", "math", "charref"}
#: Names of tags and environments whose content is literal.
LITERAL_NAMES = {"script", "style", "pre", "code", "verbatim", "lstlisting", "equation", "equation*", "align", "align*", "displaymath", "math"}
#: Elements without an end tag.
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


@dataclass(slots=True)
class Node:
    """Characters [start, end) with content [a, b)."""

    type: str
    kind: str
    start: int
    a: int
    b: int
    end: int
    name: str = ""
    attrs: str = ""
    parent: int = -1
    depth: int = 0
    children: list[int] = field(default_factory=list)

    @property
    def literal(self) -> bool:
        return self.type in LITERAL or (self.type in ("tag", "env") and self.name in LITERAL_NAMES)


class _Between:
    """From an opener to the next closer behind at least one character, at any distance (of one paragraph if so asked).

    Openers and closers are listed once and met by binary search, so that unclosed openers cost nothing.
    """

    def __init__(self, opener: str, closer: str, paragraph: bool = True) -> None:
        self.opener, self.closer, self.paragraph = re.compile(opener), re.compile(closer), paragraph

    def spans(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(start, a, b, end) of all matches, none overlapping."""
        closers = [m.span() for m in self.closer.finditer(text)]
        starts = [a for a, _ in closers]
        breaks = [m.start() for m in _BREAK.finditer(text)] if self.paragraph else []
        at = 0
        while (m := self.opener.search(text, at)) and (k := bisect_left(starts, m.end() + 1)) < len(closers):
            p = bisect_left(breaks, m.end())
            if p < len(breaks) and breaks[p] < closers[k][0]:
                at = m.start() + 1
                continue
            yield m.start(), m.end(), *closers[k]
            at = closers[k][1]


_BREAK = re.compile(r"\n(?=[ \t]*\n)")
_RUN = {"{": re.compile(r"(?<!\\)\{+|(?<!\\)\}+"), "[": re.compile(r"\[+|\]+"), "*": re.compile(r"\*+"), "'": re.compile(r"'{2,}")}
_TARGET = re.compile(r"\((?:[^()\n]|\([^()\n]*\))*(?:\n(?:[^()\n]|\([^()\n]*\))+)?\)")
_ENV = re.compile(r"\\begin\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*|\\end\{([A-Za-z]+\*?)\}")
_COMMAND = re.compile(r"~?\\([A-Za-z]+\*?)(?:\[[^\]\n]*\])?")


def brackets(text: str, opener: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """({place of an opening bracket: place of its closing one}, doubled pairs (start, end)), nested to any depth, in one pass.

    A run of closing brackets meets the last open ones: two at once where the
    two last open ones stand side by side, else one. Brackets behind a
    backslash count only where they are square.
    """
    one: dict[int, int] = {}
    double: list[tuple[int, int]] = []
    open_: list[int] = []
    for m in _RUN[opener].finditer(text):
        at, end = m.span()
        if text[at] == opener:
            open_ += range(at, end)
            continue
        while at < end and open_:
            if end - at >= 2 and len(open_) >= 2 and open_[-2] == open_[-1] - 1:
                b, a = open_.pop(), open_.pop()
                one[b], one[a] = at, at + 1
                double.append((a, at + 2))
                at += 2
            else:
                one[open_.pop()] = at
                at += 1
    return one, double


def runs(text: str, mark: str, lengths: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """(start, a, b, end) of text between two equally long runs of a mark in one paragraph, nested as brackets are.

    A run opens before and closes behind what is no white space; a closing run
    takes the last open one of its length and shuts those opened since.
    """
    out: list[tuple[int, int, int, int]] = []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    open_: list[tuple[int, int]] = []
    by_length: dict[int, list[int]] = {}
    block = 0
    for m in _RUN[mark].finditer(text):
        at, end = m.span()
        n = end - at
        if n not in lengths:
            continue
        if (now := bisect_left(breaks, at)) != block:
            block, open_, by_length = now, [], {}
        if at and not text[at - 1].isspace() and by_length.get(n):
            k = by_length[n][-1]
            out.append((open_[k][0], open_[k][1], at, end))
            while len(open_) > k:
                a, b = open_.pop()
                by_length[b - a].pop()
        elif end < len(text) and not text[end].isspace():
            by_length.setdefault(n, []).append(len(open_))
            open_.append((at, end))
    return out


def _templates(text: str) -> Iterator[Node]:
    for a, b in brackets(text, "{")[1]:
        if b - a > 4:
            yield Node("template", "wiki", a, a + 2, b - 2, b)


def _wiki_links(text: str) -> Iterator[Node]:
    for a, b in brackets(text, "[")[1]:
        if b - a > 4:
            yield Node("wlink", "wiki", a, a + 2, b - 2, b)


def _links(image: bool) -> Callable[[str], Iterator[Node]]:
    def run(text: str) -> Iterator[Node]:
        for a, b in brackets(text, "[")[0].items():
            pictured = a > 0 and text[a - 1] == "!"
            if pictured == image and (image or b > a + 1) and text[b + 1 : b + 2] == "(" and (m := _TARGET.match(text, b + 1)):
                yield Node("image" if image else "link", "markdown", a - image, a + 1, b, m.end())

    return run


def _environments(text: str) -> Iterator[Node]:
    """LaTeX environments: an end takes the last open beginning of its name and shuts those opened since."""
    open_: list[Node] = []
    by_name: dict[str, list[int]] = {}
    for m in _ENV.finditer(text):
        if m[1]:
            by_name.setdefault(m[1], []).append(len(open_))
            open_.append(Node("env", "latex", m.start(), m.end(), m.end(), m.end(), m[1]))
        elif by_name.get(m[2]):
            k = by_name[m[2]][-1]
            n = open_[k]
            while len(open_) > k:
                by_name[open_.pop().name].pop()
            n.b, n.end = m.start(), m.end()
            yield n


def _commands(text: str) -> Iterator[Node]:
    """LaTeX commands with all their braced arguments; a tie before one belongs to it."""
    pairs, at = brackets(text, "{")[0], 0
    while m := _COMMAND.search(text, at):
        end = m.end()
        while text[end : end + 1] == "{" and end in pairs:
            end = pairs[end] + 1
        yield Node("command", "latex", m.start(), m.end(), end, end, m[1])
        at = m.end()  # commands inside the arguments are nodes of their own


def _stars(length: int) -> Callable[[str], Iterator[Node]]:
    def run(text: str) -> Iterator[Node]:
        for at in runs(text, "*", (1, 2, 3)):
            if (at[1] - at[0] > 1) == (length > 1):
                yield Node("strong" if length > 1 else "emph", "markdown", *at)

    return run


def _quotes(text: str) -> Iterator[Node]:
    for at in runs(text, "'", (2, 3, 5)):
        yield Node("wemph", "wiki", *at)

#: (type, kind, trigger, finder or pattern with groups open, inner, close or none); earlier ones win where two cross.
_PATTERNS = [
    ("comment", "html", "<!--", re.compile(r"<!--[\s\S]*?-->")),
    ("charref", "html", "&", re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")),
    ("fence", "markdown", ("```", "~~~"), re.compile(r"^(?P<o>[ \t]*(?P<f>```+|~~~+)[ \t]*[\w+#-]*[ \t]*\n)(?P<i>[\s\S]*?)(?P<c>^[ \t]*(?P=f)[ \t]*)$", re.M)),
    ("env", "latex", "\\begin", _environments),
    ("display", "latex", "\\[", _Between(r"\\\[", r"\\\]", paragraph=False)),
    ("display", "latex", "$$", re.compile(r"(?P<o>\$\$)(?P<i>[^$]++)(?P<c>\$\$)")),
    ("wtable", "wiki", "{|", re.compile(r"^(?P<o>[ \t]*\{\|[^\n]*)(?P<i>[\s\S]*?)(?P<c>^[ \t]*\|\})", re.M)),
    ("code", "markdown", "`", re.compile(rf"(?<!`)(?P<o>(?P<f>`{{1,2}})(?!`))(?P<i>{_P}+?)(?P<c>(?<!`)(?P=f)(?!`))")),
    ("template", "wiki", "{{", _templates),
    ("wlink", "wiki", "[[", _wiki_links),
    ("image", "markdown", "![", _links(True)),
    ("link", "markdown", "](", _links(False)),
    ("mdtable", "markdown", "|", re.compile(r"(?:^[^|\n]*\|[^\n]*\n)?^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$(?:\n[^|\n]*\|[^\n]*$)*", re.M)),
    ("task", "markdown", "[", re.compile(r"^[ \t]*[-*+] \[[ xX]\](?=[ \t])", re.M)),
    ("heading", "markdown", "#", re.compile(r"^(?P<o>[ \t]{0,3}#{1,6}[ \t]+)(?P<i>[^\s#][^\n]*?)(?P<c>[ \t]*#*[ \t]*)$", re.M)),
    ("wheading", "wiki", "=", re.compile(r"^(?P<o>(?P<f>={1,6})[ \t]*)(?P<i>[^=\s][^\n]*?)(?P<c>[ \t]*(?P=f))[ \t]*$", re.M)),
    ("command", "latex", "\\", _commands),
    ("math", "latex", "\\(", _Between(r"\\\(", r"\\\)")),
    ("math", "latex", "$", re.compile(r"(?P<o>(?<![\\$])\$(?!\$))(?P<i>(?:(?!\n[ \t]*\n)[^$])++)(?P<c>(?<!\\)\$(?!\$))")),
    ("wemph", "wiki", "''", _quotes),
    ("strike", "markdown", "~~", _Between(r"~~(?=[^\s~])", r"(?<=[^\s~])~~")),
    ("strong", "markdown", "**", _stars(2)),
    ("strong", "markdown", "__", _Between(r"(?<!_)__(?=[^\s_])", r"(?<=[^\s_])__(?!_)")),
    ("emph", "markdown", "*", _stars(1)),
    ("emph", "markdown", "_", re.compile(r"(?P<o>(?<!_)_(?=[^\s_]))(?P<i>(?:(?!\n[ \t]*\n)[^_])++)(?P<c>(?<=[^\s_])_(?!_))")),
]
TYPES = list(dict.fromkeys(["tag", *(p[0] for p in _PATTERNS)]))
KINDS = ("html", "markdown", "wiki", "latex")
def _tags(text: str) -> list[Node]:
    """Elements: start tags paired with the nearest fitting end tag; the others stand alone."""
    out: list[Node] = []
    open_: list[Node] = []
    by_name: dict[str, list[int]] = {}  # places in open_, so that an end tag finds its start at any distance
    for m in _TAG.finditer(text):
        name, close = m[2].lower(), m[1] == "/"
        if close:
            if by_name.get(name):
                k = by_name[name][-1]
                n = open_[k]
                n.b, n.end = m.start(), m.end()
                while len(open_) > k:
                    by_name[open_.pop().name].pop()
            else:
                out.append(Node("tag", "html", m.start(), m.end(), m.end(), m.end(), name, "/"))
        else:
            out.append(n := Node("tag", "html", m.start(), m.end(), m.end(), m.end(), name, m[3].strip()))
            if name not in VOID and not m[4]:
                by_name.setdefault(name, []).append(len(open_))
                open_.append(n)
    return out


#: What must be there for a node of a type to close, so that openers alone cost nothing.
_CLOSERS = {"comment": "-->", "env": "\\end{", "wtable": "|}", "template": "}}", "wlink": "]]", "charref": ";"}


def tree(text: str) -> list[Node]:
    """Nodes in document order, parents first. Where two cross, the one found later is left out."""
    found: list[Node] = _tags(text) if "<" in text else []
    for type_, kind, trigger, pattern in _PATTERNS:
        if not any(t in text for t in ((trigger,) if isinstance(trigger, str) else trigger)) or _CLOSERS.get(type_, "") not in text:
            continue
        if isinstance(pattern, _Between):
            found += [Node(type_, kind, *at) for at in pattern.spans(text)]
            continue
        if not isinstance(pattern, re.Pattern):
            found += pattern(text)
            continue
        for m in pattern.finditer(text):
            g = m.groupdict()
            if "o" in g:
                found.append(Node(type_, kind, m.start(), m.start("i"), m.end("i"), m.end(), g.get("n") or ""))
            else:  # a table's cells hold nodes, other constructs of this sort nothing
                found.append(Node(type_, kind, m.start(), m.start() if type_ == "mdtable" else m.end(), m.end(), m.end()))
    order = sorted(range(len(found)), key=lambda i: (found[i].start, -found[i].end, i))
    # crossing: in order of finding, drop what crosses an earlier one
    gone: set[int] = set()
    stack: list[int] = []
    for i in order:
        n = found[i]
        while stack and found[stack[-1]].end <= n.start:
            stack.pop()
        while stack and found[stack[-1]].end < n.end:
            k = stack[-1]
            if k < i:
                gone.add(i)
                break
            gone.add(k)
            stack.pop()
        if i not in gone:
            stack.append(i)
    out: list[Node] = []
    stack = []
    for i in order:
        if i in gone:
            continue
        n = found[i]
        while stack and out[stack[-1]].end <= n.start:
            stack.pop()
        # equal spans, or a part of the delimiters themselves, are no content
        if stack and (top := out[stack[-1]]) and (n.start < top.a or n.end > top.b):
            continue
        n.parent, n.depth = (stack[-1], out[stack[-1]].depth + 1) if stack else (-1, 0)
        if stack:
            out[stack[-1]].children.append(len(out))
        stack.append(len(out))
        out.append(n)
    return out
