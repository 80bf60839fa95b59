"""Queries on long texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import books
from ..session import table


def _src(spark, d):
    return books.one_text(table(spark, d, "raw_sources"))


def doc_metrics(spark, d):
    return books.metrics(table(spark, d, "documents")).select("doc_id", "chars", "words", "estimated_tokens", "estimated_tokens_human")


def metrics_by_source(spark, d):
    m = books.metrics(table(spark, d, "documents"))
    return m.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.max("chars").alias("longest"))


def line_stats(spark, d):
    each = _src(spark, d).select("slug", F.explode(tx.lines(F.col("raw"))).alias("line"))
    return each.groupBy("slug").agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("line") == "").cast("long")).alias("empty"), F.max(F.length("line")).cast("long").alias("longest"))


def text_line_stats(spark, d):
    each = _src(spark, d).select("slug", F.explode(tx.text_lines(F.col("raw"))).alias("line"))
    return each.groupBy("slug").agg(F.count(F.lit(1)).alias("lines"))


def page_stats(spark, d):
    each = _src(spark, d).select("slug", F.posexplode(tx.pages(F.col("raw"))).alias("p", "page"))
    return each.select("slug", (F.col("p") + 1).cast("long").alias("page_no"), F.length("page").cast("long").alias("chars"))


def chapters_detected(spark, d):
    return books.chapters(_src(spark, d))


def structure(spark, d):
    return books.structure(_src(spark, d))


def page_number_lines(spark, d):
    return books.marked_lines(_src(spark, d)).filter("page_number").select("id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def repeated_lines(spark, d):
    """Line cores that come back in many places of the corpus."""
    m = books.marked_lines(table(spark, d, "documents"), "doc_id", "text").filter("core <> ''")
    return m.groupBy("core").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("id").alias("documents")).filter("lines >= 5")


def clean_text(spark, d):
    return books.cleaned(_src(spark, d))


def page_offset(spark, d):
    return books.page_offsets(_src(spark, d))


def remap_citations(spark, d):
    return _src(spark, d).select("slug", books.remap_citations(F.col("raw"), F.col("page_offset")).alias("text"))


def chunk_plan(spark, d):
    return books.plan_chunks(_src(spark, d))


def chunk_labels(spark, d):
    return books.label_chunks(_src(spark, d))


def chunk_text(spark, d):
    return books.chunk_texts(table(spark, d, "chunks"), table(spark, d, "raw_sources"))


def line_pages(spark, d):
    p = books.line_pages(_src(spark, d))
    return p.groupBy("id", "page", "folio").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


QUERIES = {f.__name__: f for f in (doc_metrics, metrics_by_source, line_stats, text_line_stats, page_stats, chapters_detected, structure, page_number_lines, repeated_lines,
                                   clean_text, page_offset, remap_citations, chunk_plan, chunk_labels, chunk_text, line_pages)}

_S = "s as (select slug, any_value(raw) raw, any_value(page_offset) page_offset from raw_sources where slug is not null group by slug)"
_WSC = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NWSC = _WSC.replace("[", "[^", 1)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WSC}+|{_WSC}+$', '', 'g')"


def _text_lines(x: str) -> str:
    return rf"regexp_split_to_array({x}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_NWSC}+'))"


_STRONG1 = rf"(?i)^\s*(?:{books.HEADING_WORDS})\s+(\d+)\b"
_STRONG2 = r"(?i)^\s*ch\.\s*(\d+)\b"
_CHAPTERS = f"""
l as (select slug, generate_subscripts(x, 1) n, unnest(x) line from (select slug, {_text_lines("raw")} x from s)),
m as (select slug, n, line, coalesce(nullif(regexp_extract(line, '{_STRONG1}', 1), ''), nullif(regexp_extract(line, '{_STRONG2}', 1), '')) sn,
      case when len(line) <= 70 and not regexp_matches(line, '[.,;:]$') then nullif(regexp_extract(line, '{books.WEAK}', 1), '') end wn from l),
f as (select slug, case when sn is not null then 'strong' else 'weak' end kind, try_cast(coalesce(sn, wn) as bigint) number, arg_min(line, n) heading from m where coalesce(sn, wn) is not null group by all),
c as (select f.* from f join (select slug, bool_or(kind = 'strong') st from f group by slug) k using (slug) where number is not null and st = (kind = 'strong'))
"""
_CORE = _strip("regexp_replace(" + _strip("line") + r", '^[\d\s]+|[\d\s]+$', '', 'g')")
_LINES = "l as (select slug, generate_subscripts(x, 1) n, unnest(x) line from (select slug, string_split(raw, chr(10)) x from s))"
_MARK = f"""{_LINES}, k as (select *, {_CORE} core, regexp_matches({_strip("line")}, '^\\d{{1,4}}$') pn from l),
h as (select slug, core from k where core <> '' and core = upper(core) and regexp_matches(core, '\\p{{L}}') and len(core) <= 60 group by all having count(*) >= 5),
m as (select k.*, h.core is not null hd from k left join h on h.slug = k.slug and h.core = k.core)"""
_PLAN = f"""{_LINES}, w as (select slug, n, {_wc("line")} wc, {_strip("line")} = '' bl from l),
p as (select slug, n, bl, sum(wc) over (partition by slug order by n) pw, count(*) over (partition by slug) total,
      min(case when bl then n end) over (partition by slug order by n rows between 1 following and 40 following) nb from w),
a as (select slug, n s, pw from p union all select distinct slug, 0, 0 from p),
u as (select slug, pw, min(n) i from p group by slug, pw),
j as (select a.slug, a.s, u.i from a asof join u on a.slug = u.slug and a.pw + 150 <= u.pw),
jump as (select j.slug, j.s, coalesce(p.nb - 1, j.i) e from j join p on p.slug = j.slug and p.n = j.i),
nx as (select a.slug, a.s, coalesce(jump.e, t.total) e from a left join jump using (slug, s) join (select distinct slug, total from p) t using (slug) where a.s < t.total),
walk as (select slug, 0 seq, s, e from nx where s = 0 union all select nx.slug, walk.seq + 1, nx.s, nx.e from walk join nx on nx.slug = walk.slug and nx.s = walk.e),
plan as (select walk.slug, seq, walk.s + 1 start_line, walk.e end_line, (select cast(sum(wc) as int) from w where w.slug = walk.slug and w.n > walk.s and w.n <= walk.e) words from walk)"""

ORACLE = {
    "doc_metrics": f"""select doc_id, len(t) chars, w words, cast(floor(w / 0.75) as bigint) estimated_tokens,
        case when floor(w / 0.75) >= 1000 then '~' || cast(cast(floor(floor(w / 0.75) / 1000) as bigint) as varchar) || 'K' else '~' || cast(cast(floor(w / 0.75) as bigint) as varchar) end estimated_tokens_human
        from (select doc_id, coalesce(text, '') t, {_wc("coalesce(text, '')")} w from documents)""",
    "metrics_by_source": f"select source, lang, count(*) documents, cast(sum({_wc('coalesce(text, chr(32))')}) as bigint) words, max(len(coalesce(text, ''))) longest from documents group by all",
    "line_stats": f"with {_S}, {_LINES} select slug, count(*) lines, count(*) filter (line = '') empty, max(len(line)) longest from l group by slug",
    "text_line_stats": f"with {_S}, x as (select slug, {_text_lines('raw')} x from s) select slug, cast(len(x) - (x[-1] = '')::int as bigint) lines from x where len(x) > (x[-1] = '')::int",
    "page_stats": f"with {_S} select slug, generate_subscripts(x, 1) page_no, len(unnest(x)) chars from (select slug, string_split(raw, chr(12)) x from s)",
    "remap_citations": r"""with s as (select slug, any_value(page_offset) o, regexp_extract_all(any_value(raw), '\[Ch[^\]]*\]|\[|[^\[]+') x from raw_sources where slug is not null group by slug)
        select slug, array_to_string(list_transform(x, lambda t: case when t not like '[Ch%]' or (o is null and contains(t, '(pdf)')) then t else array_to_string(list_transform(regexp_extract_all(t, 'p\.[0-9]+|p|[^p]+'), lambda u: case when regexp_full_match(u, 'p\.[0-9]+')
            then 'p.' || case when o is null then u[3:] || ' (pdf)' else greatest(1, cast(u[3:] as bigint) - o)::varchar end else u end), '') end), '') as text from s""",
    "chapters_detected": f"with {_S}, {_CHAPTERS} select slug id, kind, number, heading from c",
    "structure": rf"""with {_S}, {_CHAPTERS} select s.slug id, coalesce(k, 0) chapters, coalesce(h, []) sample, regexp_matches(substr(raw, 1, 30000), '{books.TOC}') has_toc
        from s left join (select slug, count(*) k, list_transform(list(heading order by number)[1:10], lambda x: trim(x)) h from c group by slug) using (slug)""",
    "page_number_lines": f"with {_S}, {_MARK} select slug id, n line_no, line from m where pn",
    "repeated_lines": f"""with s as (select doc_id slug, text raw from documents), {_LINES}, k as (select *, {_CORE} core from l)
        select core, count(*) lines, count(distinct slug) documents from k where core <> '' group by core having count(*) >= 5""",
    "clean_text": f"with {_S}, {_MARK} select slug id, coalesce(string_agg(line, chr(10) order by n) filter (not pn and not hd), '') as text, count(*) filter (pn or hd) removed from m group by slug",
    "page_offset": rf"""with {_S}, p as (select slug, generate_subscripts(x, 1) p, unnest(x) page from (select slug, string_split(raw, chr(12)) x from s) where len(x) > 1),
        l as (select slug, p, list_filter(list_transform({_text_lines("page")}, lambda x: {_strip("x")}), lambda x: x <> '') l from p),
        h as (select slug, p, l[1] a, case when len(l) > 1 then l[-1] end b, try_cast(nullif(regexp_extract(l[1], '{_STRONG1}', 1), '') as bigint) ch from l where len(l) > 0),
        v as (select distinct slug, p, p - f as o from (select slug, p, ch, try_cast(unnest([regexp_extract(a, '^\s*(\d{{1,4}})\b', 1), regexp_extract(a, '\b(\d{{1,4}})\s*$', 1), regexp_extract(b, '^\s*(\d{{1,4}})\b', 1), regexp_extract(b, '\b(\d{{1,4}})\s*$', 1)]) as bigint) f from h where ch is not null) where f > 0 and f <= 4000 and f <> ch),
        n as (select slug, o, count(*) n from v group by all), t as (select slug, arg_max(o, n) o, max(n) n, sum(n) total from n group by slug)
        select s.slug id, cast(case when o >= 0 and n >= 3 and 2 * n > total then o end as int) page_offset from s left join t using (slug)""",
    "chunk_plan": f"with recursive {_S}, {_PLAN} select slug source, seq, cast(start_line as int) start_line, cast(end_line as int) end_line, words from plan",
    "chunk_labels": rf"""with recursive {_S}, {_PLAN}, t as (select slug, n, {_strip("line")} t from l),
        q as (select *, coalesce(nullif(regexp_extract(t, '{_STRONG1}', 1), ''), nullif(regexp_extract(t, '{_STRONG2}', 1), ''), case when len(t) <= 70 and not regexp_matches(t, '[.,;:]$') then nullif(regexp_extract(t, '{books.WEAK}', 1), '') end,
            case when len(regexp_extract(t, '{books.SECTION}', 1)) <= 3 then nullif(regexp_extract(t, '{books.SECTION}', 1), '') end) num, {_strip(f"regexp_replace(t, '{books.LEADING}', '')")} a from t where t <> ''),
        h as (select slug, n, cast(try_cast(num as bigint) as int) chapter, t as label from q where try_cast(num as bigint) <= 99 and len(t) <= 70 and not regexp_matches(t, '[.,;:]$')
            and (a = '' or (regexp_matches(a, '^\p{{Lu}}') and not (a = upper(a) and regexp_matches(a, '\p{{L}}')) and {_wc("a")} <= 8 and len(regexp_extract(a, '^{_NWSC}+')) >= 3 and regexp_matches(regexp_extract(a, '^{_NWSC}+'), '\p{{L}}') and not regexp_matches(regexp_extract(a, '^{_NWSC}+'), '\d'))))
        select p.slug source, p.seq, cast(start_line as int) start_line, cast(end_line as int) end_line, words, coalesce(i.chapter, b.chapter) chapter, coalesce(i.label, b.label, 'lines ' || start_line || '-' || end_line) as label from plan p
        left join (select p.slug, p.seq, arg_min(chapter, n) chapter, arg_min(h.label, n) as label from plan p join h on h.slug = p.slug and h.n between start_line and end_line group by all) i on i.slug = p.slug and i.seq = p.seq
        left join (select p.slug, p.seq, arg_max(chapter, n) chapter, arg_max(h.label, n) as label from plan p join h on h.slug = p.slug and h.n < start_line group by all) b on b.slug = p.slug and b.seq = p.seq""",
    "chunk_text": """with c as (select id, any_value(source) source, any_value(start_line) a, any_value(end_line) b from chunks group by id), s as (select slug, any_value(raw) raw from raw_sources group by slug)
        select id, array_to_string(string_split(raw, chr(10))[greatest(a, 1):b], chr(10)) as text from c join s on s.slug = c.source""",
    "line_pages": f"""with {_S}, {_LINES}, p as (select l.slug, l.n, s.page_offset o, coalesce(sum(len(line) - len(replace(line, chr(12), ''))) over (partition by l.slug order by n rows between unbounded preceding and 1 preceding), 0) + 1 as page from l join s using (slug))
        select slug id, cast(page as int) page, case when o is null then cast(cast(page as int) as varchar) || ' (pdf)' else cast(cast(greatest(1, page - o) as int) as varchar) end folio, cast(min(n) as int) first_line, cast(max(n) as int) last_line from p group by slug, page, o""",
}
