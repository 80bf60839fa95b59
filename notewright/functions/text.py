"""Column builders for text. All but :func:`folded` stay inside Catalyst."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space as a Java character class (what Python's str.split() separates at).
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: Everything str.splitlines() breaks at.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def name_key(c: Column) -> Column:
    """Lower case, every run outside a-z and 0-9 one ``-``, none at the ends; ``''`` names nothing."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Every run of Unicode white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def ascii_squeeze(c: Column) -> Column:
    """Every run of ASCII white space one blank."""
    return F.regexp_replace(c, r"[ \t\n\r\x0b\f]+", " ")


def words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NOT_WS}+"))


def norm(c: Column) -> Column:
    """Comparison form: lower case, sharp s as ss, white space squeezed."""
    return squeeze(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def folded(c: Column) -> Column:
    """Compatibility form (NFKC) of the whole text, fully case folded; white space stays.

    An Arrow function that runs once per distinct value of a batch; pure ASCII values never leave the JVM.
    """

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        done = [unicodedata.normalize("NFKC", v).casefold() for v in values]
        return pd.Series([None if k < 0 else done[k] for k in codes], dtype=object)

    plain = c.isNull() | ~c.rlike(r"[^\x00-\x7f]")
    return F.coalesce(F.when(plain, F.lower(c)), run(F.when(~plain, c)))


def lines(c: Column) -> Column:
    """Split at line feeds only; a trailing empty line stays."""
    return F.split(c, "\n")


def text_lines(c: Column) -> Column:
    """Split at every Unicode line break, without a trailing empty line."""
    parts = F.split(c, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def pages(c: Column) -> Column:
    """Split at form feeds."""
    return F.split(c, "\f")


def slugify(c: Column, default: str = "source") -> Column:
    key = name_key(c)
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(default)).otherwise(key)


def initials(slug: Column) -> Column:
    """First letters of a dashed slug's parts."""
    return F.array_join(F.transform(F.filter(F.split(slug, "-"), lambda p: p != ""), lambda p: F.substring(p, 1, 1)), "")


def token_set(c: Column, stop: tuple[str, ...] = (), least: int = 3) -> Column:
    """Distinct lower-case a-z0-9 runs of at least ``least`` characters, without stop words."""
    toks = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    keep = F.filter(toks, lambda t: F.length(t) >= least)
    return F.array_distinct(F.array_except(keep, F.array(*[F.lit(s) for s in stop])) if stop else keep)


def folio(page: Column, offset: Column) -> Column:
    """Printed page of a physical page: ``N (pdf)`` without an offset, else at least 1."""
    return F.when(offset.isNull(), F.concat(page.cast("string"), F.lit(" (pdf)"))).otherwise(
        F.greatest(F.lit(1), page - offset).cast("string")
    )


def month_index(ts: Column) -> Column:
    """Months since year 0, in UTC whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds(ts.cast("timestamp")) / 86_400).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (an optimizer would copy it into every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
