"""One consistent form for text that looks the same but differs in its characters."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_squeeze
from ..operators.skew import HOT_ROWS, salted_join

#: Letters of other scripts that look like a Latin letter, and hyphens that look like "-".
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "ӏ": "l", "Ӏ": "I", "ү": "y", "Ү": "Y",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ѐ": "è", "ё": "ë", "ї": "ï", "Ѐ": "È", "Ё": "Ë", "Ї": "Ï", "ό": "ó", "ά": "á", "ί": "í", "ύ": "ú", "ϊ": "ï", "ϋ": "ü", "Ό": "Ó", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ύ": "Ý",
    "ա": "w", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ո": "n", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    "ⅼ": "l", "ɑ": "a", "ɡ": "g", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "﹣": "-", "⁃": "-",
}

#: Ranges of characters that are drawn as nothing.
_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_SPACES = re.compile("[\x1c-\x1f\u0085   -     　]")
#: Kinds of compatibility decompositions that look different from what they decompose to.
_VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<small>")


@lru_cache(2)
def _kept(last: int = sys.maxunicode) -> re.Pattern:
    """Characters up to ``last`` whose compatibility form looks different (superscripts, fractions, circled ...), found by rule."""
    own = [c for c in map(chr, range(0x80, last + 1)) if unicodedata.decomposition(c).startswith(_VISIBLE) and c not in LOOKALIKES]
    return re.compile("([" + "".join(map(re.escape, own)) + "]+)")


_TABLE = str.maketrans(LOOKALIKES)


def canonical(text: str, fold_case: bool = False) -> str:
    """The consistent form of ``text``.

    Default-ignorable characters go, every other space becomes a blank (line
    breaks stay), what remains is brought to the composed compatibility form
    (but superscripts, fractions and the like, which look different, stay),
    look-alike letters become Latin, and with ``fold_case`` full case folding
    is applied. Idempotent.
    """
    if text.isascii():
        out = _SPACES.sub(" ", text)
        return out.casefold() if fold_case else out
    text = _SPACES.sub(" ", _IGNORABLE.sub("", text))
    if not text.isascii():
        # a class within 16 bits is looked up at once, a wider one is gone through
        parts = _kept(0xFFFF if max(text) <= "\uffff" else sys.maxunicode).split(text)
        for i in range(0, len(parts), 2):
            parts[i] = unicodedata.normalize("NFKC", parts[i])
        # composed again over the joints, and after letters changed (a Cyrillic a with an accent)
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", "".join(parts)).translate(_TABLE))
        text = _SPACES.sub(" ", text)
    return unicodedata.normalize("NFC", text.casefold()) if fold_case else text


def canonical_column(c: Column, fold_case: bool = False) -> Column:
    """:func:`canonical` as an Arrow function; it runs once per distinct value of a batch."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        done = [canonical(v, fold_case) for v in values]
        return pd.Series([None if k < 0 else done[k] for k in codes], dtype=object)

    return run(c)


def with_canonical(df: DataFrame, column: str, to: str, fold_case: bool = False) -> DataFrame:
    """``df`` with the consistent form of ``column``; null stays null, '' stays ''.

    Pure ASCII values without control separators never leave the JVM.
    """
    plain = F.col(column).isNull() | ~F.col(column).rlike(r"[^\x00-\x1b\x20-\x7f]")
    asis = F.lower(column) if fold_case else F.col(column)
    return df.withColumn(to, F.coalesce(F.when(plain, asis), canonical_column(F.when(~plain, F.col(column)), fold_case)))


def quotes(notes: DataFrame) -> DataFrame:
    """Distinct (ord, pos, source, quote) of all citations; copies of a note count once."""
    return notes.select("ord", F.posexplode("citations").alias("pos", "c")).select("ord", "pos", "c.source", "c.quote").distinct()


def sources(raw_sources: DataFrame) -> DataFrame:
    """(source, as_is, same) per source: its text with white space squeezed, and its consistent form (null where equal)."""
    one = raw_sources.filter("slug is not null and raw is not null").groupBy(F.col("slug").alias("source")).agg(F.max("raw").alias("raw"))
    both = with_canonical(one, "raw", "_same")
    as_is, same = ascii_squeeze(F.col("raw")), ascii_squeeze(F.col("_same"))
    return both.select("source", as_is.alias("as_is"), F.when(as_is != same, same).alias("same"))


def grounded(notes: DataFrame, raw_sources: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(ord, pos, source, quote, same_quote, how): whether each citation's quote occurs in its source.

    ``how`` is ``as_written``, ``rewritten`` (only once quote and source are in
    the consistent form), ``absent`` or ``no_source`` (unknown or null source,
    or null quote). An empty quote occurs as written. Sources are rewritten
    once each, not once a citation; the citations of a source cited by very
    many spread over several copies of it, and both tests run as built-in
    expressions. Copies of a note or source count once; a source with
    several differing texts under one slug is read in its greatest text.
    """
    q = with_canonical(quotes(notes), "quote", "_q")
    q = q.withColumn("same_quote", F.trim(ascii_squeeze(F.col("_q")))).drop("_q")
    per = q.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("source is not null")
    got = salted_join(q, sources(raw_sources), ["source"], per, ["ord", "pos"], rows=hot_rows)
    plain = F.contains(F.col("as_is"), F.trim(ascii_squeeze(F.col("quote"))))
    rewritten = F.contains(F.coalesce("same", "as_is"), F.col("same_quote"))
    how = F.when(F.col("as_is").isNull() | F.col("quote").isNull(), "no_source").when(plain, "as_written").when(rewritten, "rewritten").otherwise("absent")
    return got.select("ord", "pos", "source", "quote", "same_quote", how.alias("how"))
