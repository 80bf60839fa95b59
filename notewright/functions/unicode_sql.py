"""SQL expressions for character forms that DuckDB has no function for; their tables are made by rule from Unicode's own data."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapped(expr: str, table: dict[str, str]) -> str:
    """``expr`` with every character that is a key of ``table`` replaced; only texts with characters beyond ASCII, or keys within it, are taken apart."""
    low = "".join(k for k in table if k < "\x80")
    keys, values = (", ".join(_literal(x) for x in side) for side in (table.keys(), table.values()))
    test = "[^\\x00-\\x7f]" if not low else "[^\\x00-\\x7f]|[" + "".join(f"\\x{ord(c):02x}" for c in low) + "]"
    each = f"case when regexp_matches(ch, '{test}') then coalesce(map([{keys}], [{values}])[ch], ch) else ch end"
    return f"(case when regexp_matches({expr}, '{test}') then array_to_string(list_transform(regexp_extract_all({expr}, '(?s).'), lambda ch: {each}), '') else {expr} end)"


def by_rule(rule: Callable[[str], str | None], first: int = 0x80) -> dict[str, str]:
    """character -> what the rule makes of it, where that is something else."""
    out = {}
    for code in range(first, sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            if (to := rule(c)) is not None and to != c:
                out[c] = to
    return out


def compatibility(c: str) -> str | None:
    """The compatibility decomposition of a character that has one beside its canonical one."""
    full = unicodedata.normalize("NFKD", c)
    return full if full != unicodedata.normalize("NFD", c) else None


def nfkc_folded(expr: str) -> str:
    """NFKC and full case folding of a text."""
    composed = f"nfc_normalize({mapped(expr, by_rule(compatibility))})"
    return f"lower({mapped(composed, by_rule(lambda c: c.casefold() if c.casefold() != c.lower() or len(c.lower()) > 1 else None))})"
