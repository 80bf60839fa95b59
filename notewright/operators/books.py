"""Structure of long texts: metrics, chapters, running headers, pages and folios, chunks and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, blank_to_null, let, lines, pages, strip, text_lines, word_count

#: Heading words, and the limits of what counts as a heading, header, folio or vote.
HEADING_WORDS = "chapter|chapitre|capitolo|kapitel|cap[íiÍI]tulo"
STRONG = rf"(?i)^\s*(?:(?:{HEADING_WORDS})\s+(\d+)\b|ch\.\s*(\d+)\b)"
WEAK = r"^\s*(\d+)\.\s+[A-Z]"
SECTION = r"^\s*(\d+)(?:\.\d+)*\s+[A-Z]"
LEADING = rf"(?i)^\s*(?:(?:{HEADING_WORDS}|ch)\.?\s*)?\d+(?:\.\d+)*[.)]?\s*"
TOC = r"(?im)^\s*(table of contents|contents|[íÍ]ndice|sum[áÁ]rio)\s*$"
MAX_HEADING, TOC_CHARS, SAMPLE, MAX_HEADER, MIN_REPEAT = 70, 30_000, 10, 60, 5
MAX_TITLE_WORDS, MIN_TITLE_WORD, MAX_CHAPTER, MAX_FOLIO, MIN_AGREE, LOOKAHEAD = 8, 3, 99, 4000, 3, 40


def one_text(sources: DataFrame) -> DataFrame:
    """One row per source slug; copies agree in everything but arrival."""
    keep = [c for c in sources.columns if c not in ("slug", "loaded_at")]
    return sources.filter("slug is not null").groupBy("slug").agg(F.max_by(F.struct(*keep), "loaded_at").alias("s")).select("slug", "s.*")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds chars, words, estimated_tokens (words / 0.75, cut) and a human form of it; null texts have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = word_count(t)
    est = F.floor(n / 0.75).cast("long")
    human = F.when(est >= 1000, F.concat(F.lit("~"), F.floor(est / 1000).cast("string"), F.lit("K"))).otherwise(F.concat(F.lit("~"), est.cast("string")))
    return df.withColumns({"chars": F.length(t).cast("long"), "words": n.cast("long"), "estimated_tokens": est, "estimated_tokens_human": human})


def _number(c: Column, pattern: str, *groups: int) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(c, pattern, g)) for g in groups]).try_cast("long")


def chapter_number(line: Column) -> tuple[Column, Column]:
    """(strong, weak) chapter number of a line: by a chapter word, or a short ``N. Title`` that is no sentence."""
    weak = F.when((F.length(line) <= MAX_HEADING) & ~line.rlike("[.,;:]$"), _number(line, WEAK, 1))
    return _number(line, STRONG, 1, 2), weak


def chapters(df: DataFrame, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """(id, kind, number, heading): first line of each chapter number; weak ones only where there is no strong one."""
    each = df.select(F.col(id_col).alias("id"), F.posexplode(text_lines(F.col(text))).alias("line_no", "line"))
    strong, weak = chapter_number(F.col("line"))
    found = each.select("id", "line_no", "line", strong.alias("s"), weak.alias("w"))
    found = found.select("id", "line_no", "line", F.when(F.col("s").isNotNull(), "strong").otherwise("weak").alias("kind"), F.coalesce("s", "w").alias("number")).filter("number is not null")
    first = found.groupBy("id", "kind", "number").agg(F.min_by("line", "line_no").alias("heading"))
    kinds = first.groupBy("id").agg(F.max(F.col("kind") == "strong").alias("any_strong"))
    return first.join(kinds, "id").filter("any_strong = (kind = 'strong')").drop("any_strong")


def structure(df: DataFrame, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """(id, chapters, sample, has_toc): number of chapters, the first ten headings by number, table of contents or not."""
    per = chapters(df, id_col, text).groupBy("id").agg(F.count(F.lit(1)).alias("chapters"), F.array_sort(F.collect_list(F.struct("number", "heading"))).alias("h"))
    toc = df.select(F.col(id_col).alias("id"), F.coalesce(F.substring(F.col(text), 1, TOC_CHARS).rlike(TOC), F.lit(False)).alias("has_toc"))
    got = toc.join(per, "id", "left")
    sample = F.transform(F.slice(F.coalesce("h", F.array().cast("array<struct<number:long,heading:string>>")), 1, SAMPLE), lambda x: F.trim(x["heading"]))
    return got.select("id", F.coalesce("chapters", F.lit(0)).alias("chapters"), sample.alias("sample"), "has_toc")


def header_core(line: Column) -> Column:
    return strip(F.regexp_replace(strip(line), r"^[\d\s]+|[\d\s]+$", ""))


def is_caps(c: Column) -> Column:
    return (c != "") & (c == F.upper(c)) & c.rlike(r"\p{L}")


def marked_lines(df: DataFrame, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """(id, line_no, line, core, page_number, header): every line, and whether it is a page number or a running header.

    A running header is an all-caps core of at most MAX_HEADER characters that
    a text repeats MIN_REPEAT times. Headers are counted per text and core
    before they meet the lines again, so no text gathers in one task.
    """
    each = df.select(F.col(id_col).alias("id"), F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    each = each.withColumn("core", header_core(F.col("line")))
    can = each.filter(is_caps(F.col("core")) & (F.length("core") <= MAX_HEADER))
    running = can.groupBy("id", "core").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_REPEAT).select("id", "core", F.lit(True).alias("header"))
    got = each.join(running, ["id", "core"], "left")
    return got.select("id", "line_no", "line", "core", strip(F.col("line")).rlike(r"^\d{1,4}$").alias("page_number"), F.coalesce("header", F.lit(False)).alias("header"))


def cleaned(df: DataFrame, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """(id, text, removed): texts without page-number lines and running headers."""
    m = marked_lines(df, id_col, text)
    gone = F.col("page_number") | F.col("header")
    kept = F.array_sort(F.collect_list(F.when(~gone, F.struct("line_no", "line"))))
    return m.groupBy("id").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), F.sum(gone.cast("long")).alias("removed"))


def page_offsets(df: DataFrame, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """(id, page_offset): physical minus printed page, by vote of the pages that open a chapter.

    A page votes once for each distinct offset of the numbers at the ends of
    its first and last line; the offset wins with at least MIN_AGREE votes and
    a strict majority, and is null otherwise or without form feeds.
    """
    page = df.select(F.col(id_col).alias("id"), F.size(pages(F.col(text))).alias("n"), F.posexplode(pages(F.col(text))).alias("p", "page"))
    page = page.filter("n > 1").withColumn("l", F.filter(F.transform(text_lines(F.col("page")), strip), lambda x: x != "")).filter("size(l) > 0")
    first, last = F.element_at("l", 1), F.element_at("l", -1)
    head = page.select("id", (F.col("p") + 1).alias("p"), first.alias("first"), F.when(F.size("l") > 1, last).alias("last"), _number(first, rf"(?i)^\s*(?:{HEADING_WORDS})\s+(\d+)\b", 1).alias("chapter"))
    ends = F.array(*[_number(F.col(c), p, 1) for c in ("first", "last") for p in (r"^\s*(\d{1,4})\b", r"\b(\d{1,4})\s*$")])
    votes = head.filter("chapter is not null").select("id", F.explode(F.array_distinct(F.transform(F.filter(ends, lambda v: (v > 0) & (v <= MAX_FOLIO) & (v != F.col("chapter"))), lambda v: F.col("p") - v))).alias("offset"))
    per = votes.groupBy("id", "offset").agg(F.count(F.lit(1)).alias("n"))
    won = per.groupBy("id").agg(F.max_by("offset", "n").alias("o"), F.max("n").alias("n"), F.sum("n").alias("total"))
    won = won.filter((F.col("o") >= 0) & (F.col("n") >= MIN_AGREE) & (F.col("n") * 2 > F.col("total"))).select("id", F.col("o").cast("int").alias("page_offset"))
    return df.select(F.col(id_col).alias("id")).join(won, "id", "left")


def remap_citations(text: Column, offset: Column) -> Column:
    """``p.N`` inside ``[Ch ...]`` as printed folio (at least 1), or marked ``(pdf)`` without an offset; marked ones stay."""

    def bracket(b: Column) -> Column:
        parts = F.split(b, r"(?=p\.\d)")  # each part after the first begins with p.N

        def page(x: Column) -> Column:
            num = F.regexp_extract(x, r"^p\.(\d+)", 1)
            rest = F.regexp_replace(x, r"^p\.\d+", "")
            new = F.when(offset.isNull(), F.concat(num.cast("string"), F.lit(" (pdf)"))).otherwise(F.greatest(F.lit(1), num.try_cast("long") - offset).cast("string"))
            return F.when(num == "", x).otherwise(F.concat(F.lit("p."), new, rest))

        done = F.array_join(F.transform(parts, page), "")
        return F.when(offset.isNull() & F.contains(b, F.lit("(pdf)")), b).otherwise(done)

    segments = F.regexp_extract_all(text, F.lit(r"\[Ch[^\]]*\]|(?:(?!\[Ch[^\]]*\])[\s\S])+"), 0)
    return F.array_join(F.transform(segments, lambda s: F.when(s.startswith("[Ch") & s.endswith("]"), bracket(s)).otherwise(s)), "")


def heading(line: Column) -> Column:
    """STRUCT<chapter, label> of a line that reads as a heading, else null."""

    def of(t: Column) -> Column:
        strong, weak = chapter_number(t)
        digits = F.regexp_extract(t, SECTION, 1)
        number = F.coalesce(strong, weak, F.when((digits != "") & (F.length(digits) <= 3), digits.try_cast("long")))

        def title(after: Column) -> Column:
            first = F.regexp_extract(after, rf"^[^{WS[1:]}+", 0)
            count = word_count(after)
            upper = F.substring(after, 1, 1).rlike(r"^\p{Lu}") & ~is_caps(after)
            good = upper & (count <= MAX_TITLE_WORDS) & (F.length(first) >= MIN_TITLE_WORD) & first.rlike(r"\p{L}") & ~first.rlike(r"\d")
            short = (F.length(t) <= MAX_HEADING) & ~t.rlike("[.,;:]$")
            ok = (t != "") & (number <= MAX_CHAPTER) & short & ((after == "") | good)
            return F.when(ok, F.struct(number.cast("int").alias("chapter"), t.alias("label")))

        return let(strip(F.regexp_replace(t, LEADING, "")), title)

    return let(strip(line), of)


def chunk_bounds(text: Column, target: int) -> Column:
    """ARRAY<STRUCT<start_line, end_line, words>>: greedy pieces of about ``target`` words, cut at the next blank line if one is near.

    One fold over the lines of a text: a piece ends after the line that
    reaches the target, moved on to the first blank line of the next
    LOOKAHEAD; that blank line opens the next piece.
    """

    def body(ls: Column) -> Column:
        def counted(wc: Column) -> Column:
            n = F.size(wc)
            none = F.array().cast("array<struct<s:int,e:int>>")
            zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("w"), none.alias("out"))

            def step(acc: Column, i: Column) -> Column:
                w = acc["w"] + F.element_at(wc, i)
                ahead = F.slice(ls, i + 1, LOOKAHEAD)
                blank = F.array_position(F.transform(ahead, lambda x: strip(x) == ""), True).cast("int")
                end = F.when((i < n) & (blank > 0), i + blank - 1).otherwise(i)
                done = F.struct(end.alias("s"), F.lit(0).alias("w"), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), end.alias("e")))).alias("out"))
                more = F.struct(acc["s"].alias("s"), w.alias("w"), acc["out"].alias("out"))
                return F.when(i <= acc["s"], acc).when(w >= target, done).otherwise(more)

            def finish(acc: Column) -> Column:
                return F.when(acc["s"] < n, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), n.alias("e"))))).otherwise(acc["out"])

            out = F.aggregate(F.sequence(F.lit(1), n), zero, step, finish)
            total = lambda x: F.aggregate(F.slice(wc, x["s"] + 1, x["e"] - x["s"]), F.lit(0), lambda a, b: a + b)
            return F.transform(out, lambda x: F.struct((x["s"] + 1).alias("start_line"), x["e"].alias("end_line"), total(x).alias("words")))

        return let(F.transform(ls, lambda x: word_count(x)), counted)

    return let(lines(text), body)


def plan_chunks(df: DataFrame, target: int = 150, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """(source, seq, start_line, end_line, words) of every text."""
    found = df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("source"), F.posexplode(chunk_bounds(F.col(text), target)).alias("seq", "c"))
    return found.select("source", "seq", "c.*")


def label_chunks(df: DataFrame, target: int = 150, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """Planned chunks with chapter and label: the first heading inside, else the nearest one before, else the lines."""

    def body(hs: Column, cs: Column) -> Column:
        def one(c: Column) -> Column:
            inside = F.filter(hs, lambda h: (h["line"] >= c["start_line"]) & (h["line"] <= c["end_line"]))
            before = F.filter(hs, lambda h: h["line"] < c["start_line"])
            none = F.struct(F.lit(None).cast("int").alias("line"), F.struct(F.lit(None).cast("int").alias("chapter"), F.format_string("lines %d-%d", c["start_line"], c["end_line"]).alias("label")).alias("h"))
            h = F.coalesce(F.try_element_at(inside, F.lit(1)), F.try_element_at(before, F.lit(-1)), none)
            return F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), c["words"].alias("words"), h["h"]["chapter"].alias("chapter"), h["h"]["label"].alias("label"))

        return F.transform(cs, one)

    t = F.col(text)
    found = F.filter(F.transform(lines(t), lambda x, i: F.struct((i + 1).alias("line"), heading(x).alias("h"))), lambda x: x["h"].isNotNull())
    out = let(found, lambda hs: let(chunk_bounds(t, target), lambda cs: body(hs, cs)))
    got = df.filter(t.isNotNull()).select(F.col(id_col).alias("source"), F.posexplode(out).alias("seq", "c"))
    return got.select("source", "seq", "c.*")


def chunk_texts(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, text): lines start_line to end_line of each chunk's source, as far as they exist."""
    one = chunks.groupBy("id").agg(F.max(F.struct("source", "start_line", "end_line")).alias("c")).select("id", "c.*")
    ls, start = lines(F.col("raw")), F.greatest(F.col("start_line"), F.lit(1))
    text = F.array_join(F.slice(ls, start, F.greatest(F.lit(0), F.col("end_line") - start + 1)), "\n")
    return one.join(one_text(sources).select(F.col("slug").alias("source"), "raw"), "source").select("id", text.alias("text"))


def line_pages(df: DataFrame, id_col: str = "slug", text: str = "raw") -> DataFrame:
    """(id, line_no, page, folio) of lines: form feeds before the line plus 1, and the printed page by the source's offset."""
    before = lambda ls: F.transform(ls, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    rows = df.select(F.col(id_col).alias("id"), "page_offset", F.explode(before(lines(F.col(text)))).alias("l")).select("id", "page_offset", "l.*")
    feeds = F.regexp_count("line", F.lit("\f"))
    page = rows.withColumn("f", feeds).selectExpr("id", "page_offset", "line_no", "f", "cast(coalesce(sum(f) over (partition by id order by line_no rows between unbounded preceding and 1 preceding), 0) + 1 as int) as page")
    return page.select("id", "line_no", "page", F.when(F.col("page_offset").isNull(), F.concat(F.col("page").cast("string"), F.lit(" (pdf)"))).otherwise(F.greatest(F.lit(1), F.col("page") - F.col("page_offset")).cast("string")).alias("folio"))
