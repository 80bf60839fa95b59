"""Queries around files, model runs, upgrades, rules and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key, token_set
from ..operators import books
from ..operators import model_loops as ml
from ..operators import notes as nt
from ..operators import upgrades as up
from ..session import cut, table
from ..sources import files as fs
from ..streaming.build import event_windows as _windows
from .book_queries import _CHAPTERS
from .book_queries import _S as _SOURCES
from .note_queries import _notes, _src


def html_to_text(spark, d):
    return _src(spark, d).select("slug", fs.html_reader(F.col("raw")).alias("text"))


def rtf_to_text(spark, d):
    return _src(spark, d).select("slug", fs.rtf_reader(F.col("raw")).alias("text"))


def sha256_text(spark, d):
    return _src(spark, d).select("slug", F.sha2(F.col("raw").cast("binary"), 256).alias("sha256"))


def extraction(spark, d):
    """Sources as files of their format's kind, read by the chains that need no library."""
    ext = F.when(F.col("format").isin("html", "rtf"), F.col("format")).otherwise("txt")
    files = _src(spark, d).select(F.concat("slug", F.lit("."), ext).alias("path"), F.encode("raw", "UTF-8").alias("content"))
    got = fs.extracted(files)
    return got.select("path", "format", "method", "sha256", F.transform("attempts", lambda a: F.concat(a["name"], F.lit(":"), a["outcome"])).alias("attempts"), (F.length("text") > 0).alias("has_text"))


def match_replies(spark, d):
    """Verdicts of match rows as replies in several forms, and what is read from them."""
    v = F.when(F.col("same"), "true").otherwise("false")
    obj = F.concat(F.lit('{"same": '), v, F.lit("}"))
    m = F.col("match_id") % 4
    reply = F.when(m == 0, obj).when(m == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(m == 2, F.concat(F.lit("So: "), obj, F.lit(" I think."))).otherwise("no idea")
    return table(spark, d, "note_matches").groupBy("match_id").agg(F.max("same").alias("same")).select("match_id", ml.parse_same(reply).alias("same"))


def verdict_tally(spark, d):
    n = _notes(spark, d)
    quotes = F.transform(F.coalesce("citations", F.array().cast("array<struct<chapter:int,quote:string,source:string>>")), lambda c: F.coalesce(c["quote"], F.lit("")))
    judged = n.select("vault", "ord", ml.offline_verdict(F.col("body"), quotes).alias("verdict"))
    return ml.tally(n.select("vault", "ord"), judged, ["vault", "ord"])


def judge_batches(spark, d):
    b = ml.judge_batches(_notes(spark, d))
    return b.select("vault", "part", "batch", F.size("ords").alias("notes"), F.element_at("ords", 1).alias("first_ord"))


def pending_chunks(spark, d):
    c = table(spark, d, "chunks")
    plan = c.select("id", "source").dropDuplicates(["id"])
    return ml.pending(plan, c.filter("words is not null and label is not null").select("id"))


def built_chunks(spark, d):
    c = table(spark, d, "chunks")
    return c.select("id", "source").dropDuplicates(["id"]).join(c.filter("words is not null and label is not null").select("id").distinct(), "id", "left_semi")


def cover_notes(spark, d):
    """Headings of sources that no note is named after; every round proposes from all headings, until none is new."""
    heads = cut(books.chapters(_src(spark, d)).select(name_key(F.regexp_replace("heading", books.LEADING, "")).alias("slug")).filter("slug <> ''").distinct())
    known = table(spark, d, "notes").select(name_key(F.col("slug")).alias("slug"))
    found, _ = ml.until_dry(known, lambda have, k: heads.join(have, "slug", "left_anti"), ["slug"], 20)
    return found


def semver_delta(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.format_string("%d.%d.%d", F.col("p_partkey") % 3, F.col("p_size") % 12, F.col("p_partkey") % 20).alias("v"), F.lower(F.element_at(F.split("p_type", " "), 1)).alias("t"))
    e = v.select("p_partkey", up.version(F.col("v")).alias("version"), F.when(F.col("p_partkey") % 4 == 0, "additive").when(F.col("p_partkey") % 4 == 1, "transform").otherwise(F.col("t")).alias("cls"))
    return up.delta(e, F.array(F.lit(0), F.lit(9), F.lit(12)), F.array(F.lit(2), F.lit(1), F.lit(3))).groupBy("plan").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


#: Rules on lines of documents: (id, scope, pattern, severity, confidence).
RULES = [
    {"id": "error-line", "scope": "^lint/", "pattern": "^ERROR ", "severity": "violation", "confidence": "high"},
    {"id": "warn-line", "scope": "^lint/", "pattern": "^WARN ", "severity": "violation", "confidence": "low"},
    {"id": "dated-heading", "scope": "^log/", "pattern": r"^## [0-9]{4}-[0-9]{2}-[0-9]{2}", "severity": "smell", "confidence": "high"},
    {"id": "page-mention", "scope": "", "exclude": "^lint/", "pattern": "(?i)by page [0-9]+", "severity": "smell", "confidence": "low"},
]


def rule_review(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select(F.concat_ws("/", "doc_type", F.col("doc_id").cast("string")).alias("path"), "text")
    return up.review(docs, RULES).groupBy("path", "rule", "verdict").agg(F.count(F.lit(1)).alias("hits"), F.min("line_no").alias("first_line"))


def topic_index(spark, d):
    t = _notes(spark, d).select("vault", F.explode(token_set(F.coalesce("title", F.lit("")), nt.TITLE_STOP)).alias("term"))
    return up.index_terms(t, "term", "vault")


def cost_estimate(spark, d):
    docs = books.metrics(table(spark, d, "documents")).withColumn("chapters", F.coalesce(F.col("chapter"), F.lit(0)))
    return ml.cost_estimate(docs, "source")


def event_windows(spark, d):
    return _windows(table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (html_to_text, rtf_to_text, sha256_text, extraction, match_replies, verdict_tally, judge_batches, pending_chunks, built_chunks, cover_notes, semver_delta, rule_review, topic_index, cost_estimate, event_windows)}

_S = "s as (select slug, any_value(raw) raw, any_value(format) format from raw_sources where slug is not null group by slug)"


def _chain(x: str, steps) -> str:
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_HTML = _chain("raw", [*((rf"(?is)<{t}\b.*?</{t}\s*>", "") for t in ("script", "style", "head")), ("(?s)<!--.*?-->", ""), (r"(?i)<(?:p|br|h[1-6]|li|div)\b[^>]*>", "\n"), ("</?[A-Za-z][^>]*>", "")])
_NAMED = {"lt": "'<'", "gt": "'>'", "quot": "chr(34)", "nbsp": "chr(160)", "amp": "'&'", "eacute": "'é'", "mdash": "'—'", "hellip": "'…'"}
_CHAR = " ".join(f"when t = '&{n};' then {c}" for n, c in _NAMED.items())
_HTML = f"""array_to_string(list_transform(regexp_extract_all({_HTML}, '&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[a-z]+;|&|[^&]+'), lambda t: case {_CHAR}
    when t like '&#x%;' then chr(cast('0x' || t[4:len(t) - 1] as int)) when t like '&#%;' then chr(cast(t[3:len(t) - 1] as int)) else t end), '')"""
#: One piece of an RTF text after the other: escapes in hex, control words, signs, braces, text.
_RTF = r"""array_to_string(list_transform(regexp_extract_all(raw, '\\''[0-9a-fA-F]{2}|\\[a-zA-Z]+(?:-?[0-9]+)? ?|\\[^a-zA-Z]|[{}]|[^\\{}]+|\\'), lambda t: case when t in ('{', '}') then '' when t not like '\%' or t = '\' then t when t like '\''%' and len(t) = 4 then ' '
    when regexp_full_match(t, '\\(?:pard?|line|sect|page|row)(?:-?[0-9]+)? ?') then chr(10) when regexp_full_match(t, '\\(?:tab|cell)(?:-?[0-9]+)? ?') then chr(9) when regexp_full_match(t, '\\[a-zA-Z]+(?:-?[0-9]+)? ?') then ''
    when t = '\~' then chr(160) when t = '\_' then '-' when t in ('\*', '\-') then '' else t[2:] end), '')"""
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: len(x) >= 3))"
_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STOP = ", ".join(f"'{x}'" for x in nt.TITLE_STOP)
ORACLE = {
    "html_to_text": f"with {_S} select slug, {_HTML} as text from s",
    "rtf_to_text": f"with {_S} select slug, {_RTF} as text from s",
    "sha256_text": f"with {_S} select slug, sha256(raw) sha256 from s",
    "extraction": f"""with {_S}, f as (select slug || '.' || case when format in ('html', 'rtf') then format else 'txt' end path, case when format in ('html', 'rtf') then format else 'text' end format, raw from s)
        select path, format, case format when 'html' then 'html' when 'rtf' then 'rtf-regex' else 'plain' end as method, sha256(raw) sha256, case format when 'html' then ['html:ok'] when 'rtf' then ['striprtf:unavailable', 'rtf-regex:ok'] else ['plain:ok'] end attempts, true has_text from f""",
    "match_replies": "select match_id, match_id % 4 <> 3 and coalesce(bool_or(same), false) same from note_matches group by match_id",
    "verdict_tally": f"""with n as (select ord, any_value(vault) vault, any_value(body) body, any_value(citations) citations from notes where ord is not null group by ord),
        t as (select ord, vault, {_TOK.format("coalesce(body, '')")} b, {_TOK.format("array_to_string(list_transform(coalesce(citations, []), lambda c: coalesce(c.quote, '')), ' ')")} q from n),
        v as (select vault, case when len(list_intersect(b, q)) / greatest(len(b), 1) >= 0.8 then 'supported' when len(list_intersect(b, q)) / greatest(len(b), 1) >= 0.5 then 'overreach' else 'unsupported' end v from t)
        select vault, count(*) total, count(*) filter (v = 'supported') supported, count(*) filter (v = 'overreach') overreach, count(*) filter (v = 'unsupported') unsupported, count(*) filter (v = 'supported') / count(*) faithfulness from v group by vault""",
    "judge_batches": """with n0 as (select distinct ord, vault from notes where ord is not null), n as (select *, ord % cast(ceil(count(*) over (partition by vault) / 10000) as bigint) part from n0), r as (select *, (row_number() over (partition by vault, part order by ord) - 1) // 10 batch from n)
        select vault, part, cast(batch as int) batch, cast(count(*) as int) notes, min(ord) first_ord from r group by all""",
    "pending_chunks": "select id, any_value(source) source from chunks group by id having not bool_or(words is not null and label is not null)",
    "built_chunks": "select id, any_value(source) source from chunks group by id having bool_or(words is not null and label is not null)",
    "cover_notes": f"""with {_SOURCES}, {_CHAPTERS}, h as (select distinct {_KEY.format(f"regexp_replace(heading, '{books.LEADING}', '')")} slug from c)
        select slug from h where slug <> '' and slug not in (select {_KEY.format("slug")} from notes where slug is not null)""",
    "semver_delta": """with e as (select p_partkey, [cast(p_partkey % 3 as int), cast(p_size % 12 as int), cast(p_partkey % 20 as int)] v, case p_partkey % 4 when 0 then 'additive' when 1 then 'transform' else lower(split_part(p_type, ' ', 1)) end c from part)
        select case when c in ('additive', 'transform', 'regenerate') then c else 'skipped' end as plan, count(*) n, min(p_partkey) as first from e where v[1] * 10000 + v[2] * 100 + v[3] > 912 and v[1] * 10000 + v[2] * 100 + v[3] <= 20103 group by 1""",
    "rule_review": r"""with l as (select concat_ws('/', doc_type, doc_id) path, generate_subscripts(x, 1) n, unnest(x) line from (select doc_type, doc_id, string_split(text, chr(10)) x from documents where text is not null)),
        h as (select path, n, 'error-line' as rule, 'violation' verdict from l where path like 'lint/%' and line like 'ERROR %' union all select path, n, 'warn-line', 'suggestion' from l where path like 'lint/%' and line like 'WARN %'
        union all select path, n, 'dated-heading', 'suggestion' from l where path like 'log/%' and regexp_matches(line, '^## [0-9]{4}-[0-9]{2}-[0-9]{2}') union all select path, n, 'page-mention', 'suggestion' from l where path not like 'lint/%' and regexp_matches(line, '(?i)by page [0-9]+'))
        select path, rule, verdict, count(*) hits, cast(min(n) as int) first_line from h group by all""",
    "topic_index": f"""with n as (select ord, any_value(vault) vault, any_value(title) title from notes where ord is not null group by ord), t as (select distinct vault, unnest(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda x: len(x) >= 3 and x not in ({_STOP}))) term from n)
        select term, string_agg(vault, ', ' order by vault) places from t where vault is not null group by term""",
    "cost_estimate": f"select source, sum(len(regexp_extract_all(coalesce(text, ''), '{_W.replace('[', '[^', 1)}+'))) * cast(1.3 as double) input_tokens, sum(coalesce(chapter, 0)) * 1000 + 8500 output_tokens from documents group by source",
    "event_windows": "select cast(date_trunc('day', ts) as timestamp) window_start, event_type, count(*) n, sum(value) total from events group by all",
}
