"""Repetition inside one document: a threshold table compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the a an and or of to in is that it its with as for on by this one no any each so at from be are not but "
    "der die das und ein eine ist nicht von zu mit den dem im auf für "
    "le la les un une des et est de du que qui dans pour pas au "
    "el los las y es por con para una se del no en"
).split()

#: measure, comparison, threshold: what counts as repetitive or broken text.
THRESHOLDS = [
    ("rep5_share", ">", 0.25),
    ("line_dup_share", ">", 0.30),
    ("para_dup_share", ">", 0.30),
    ("line_dup_chars", ">", 0.20),
    ("symbol_ratio", ">", 0.10),
    ("top_word_share", ">", 0.40),
    ("mean_word_len", ">", 15.0),
    ("stop_word_share", "<", 0.01),
]


def _dup_share(items: Column) -> Column:
    """1 - distinct / all; null for no items."""
    return F.when(F.size(items) > 0, 1 - F.size(F.array_distinct(items)) / F.size(items))


def shingles(w: Column, n: int = 5) -> Column:
    """64-bit hashes of all sequences of ``n`` consecutive words; none for shorter texts."""
    none = F.array().cast("array<bigint>")
    codes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) >= n, let(codes, lambda h: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n))))).otherwise(none)


def measures(text: Column, w: Column, lines: Column, paras: Column) -> dict[str, Column]:
    """Measures of a text from its words, trimmed non-empty lines and paragraphs."""
    size, chars = F.size(w), F.length(F.array_join(lines, ""))
    same = F.struct(F.lit("").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(acc["x"] == x, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("x"), n.alias("n"), F.greatest(acc["m"], n).alias("m"))

    run = F.aggregate(F.array_sort(w), same, step, lambda acc: acc["m"])  # longest run of equal sorted words
    stop = list(dict.fromkeys(STOP_WORDS))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "n_words": size,
        "n_lines": F.size(lines),
        "rep5_share": zero(let(shingles(w), _dup_share)),
        "line_dup_share": zero(_dup_share(lines)),
        "para_dup_share": zero(_dup_share(paras)),
        "line_dup_chars": zero(F.when(chars > 0, 1 - F.length(F.array_join(F.array_distinct(lines), "")) / chars)),
        "symbol_ratio": zero(F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")) / F.length(text))),
        "top_word_share": zero(F.when(size > 0, run / size)),
        "mean_word_len": zero(F.when(size > 0, F.length(F.array_join(w, "")) / size)),
        "stop_word_share": zero(F.when(size > 0, F.size(F.filter(w, lambda x: x.isin(*stop))) / size)),
    }


def profile(documents: DataFrame, only: list[str] | None = None, thresholds: list[tuple[str, str, float]] = THRESHOLDS) -> DataFrame:
    """doc_id, the measures (or ``only`` some of them) and ``flags``, the measures beyond their threshold.

    One projection over the scan: no shuffle, no user function, nothing kept
    between documents. Null and blank texts have no words and all shares 0;
    texts under five words have no sequences and a share of 0; texts without
    words are not flagged; repeated rows give repeated rows; columns of the
    input with the measures' names are not carried along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = lambda parts: F.filter(F.transform(parts, F.trim), lambda x: x != "")

    def body(w: Column) -> Column:
        def inner(lines: Column) -> Column:
            def last(paras: Column) -> Column:
                ms = {k: v for k, v in measures(text, w, lines, paras).items() if only is None or k in only}
                return let(F.struct(*[v.alias(k) for k, v in ms.items()]), lambda m: F.struct(m.alias("m"), F.when(F.size(w) > 0, flags(m, ms)).otherwise(none).alias("flags")))

            return let(trimmed(F.split(text, r"\n\s*\n")), last)

        return let(trimmed(F.split(text, "\n")), inner)

    none = F.array().cast("array<string>")

    def flags(m: Column, known) -> Column:
        hits = [F.when((m[k] > x) if op == ">" else (m[k] < x), F.lit(k)) for k, op, x in thresholds if k in known]
        return F.array_compact(F.array(*hits)) if hits else none

    return documents.select("doc_id", let(words(F.lower(text)), body).alias("_p")).select("doc_id", "_p.m.*", "_p.flags")


def repetitive(documents: DataFrame, measure: str = "rep5_share") -> DataFrame:
    """doc_id of documents beyond the threshold of ``measure``."""
    return profile(documents, [measure]).filter(F.array_contains("flags", measure)).select("doc_id")
