"""Queries on upgrades, provenance, JSON files and runs around a model, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import books
from ..operators import model_loops as ml
from ..operators import notes as nt
from ..operators import provenance as pv
from ..operators import upgrades as up
from ..session import table
from ..sources import vault_json as vj
from .note_queries import _notes, _src

_str = lambda c: F.col(c).cast("string")


def _logs(spark, d):
    """One change log a part: a tagged bullet over two lines, an untagged one, and one inside a comment."""
    n = F.col("p_partkey")
    cls = F.element_at(F.array(*[F.lit(x) for x in ("Additive", "transform", "regenerate", "docs")]), (n % 4 + 1).cast("int"))
    text = F.concat(F.lit("# Changes\n\n## ["), F.format_string("%d.%d.%d", n % 3, F.col("p_size") % 12, n % 20), F.lit("] - 2026\n<!--\n- old [transform]\n-->\n- "), "p_name", F.lit(",\n  more of it (#"), _str("p_partkey"),
                    F.lit(") ["), cls, F.when(n % 2 == 0, F.lit("; steps 2, 3.1")).otherwise(F.lit("")), F.lit("]\n- a bullet without a tag\n"))
    return table(spark, d, "part").select(text.alias("text"))


def change_entries(spark, d):
    e = up.change_entries(_logs(spark, d))
    return e.select("seq", "version", "cls", "steps", "description", "issue")


def upgrade_plan(spark, d):
    """Suppliers as skills of several versions, parts as changes: entries each still needs."""
    entries = up.change_entries(_logs(spark, d)).filter("version[0] = 1 and version[1] < 2")
    skills = table(spark, d, "supplier").select(_str("s_suppkey").alias("skill"), F.format_string("%d.%d.%d", F.col("s_suppkey") % 2, F.col("s_suppkey") % 3, F.lit(0)).alias("generator_version"))
    return up.plan_upgrades(skills, entries, "1.1.9").groupBy("skill", "plan").agg(F.count(F.lit(1)).alias("entries"))


def upgrade_bumps(spark, d):
    """Which skills reach the current version when only issues of odd number have a transform."""
    entries = up.change_entries(_logs(spark, d)).filter("version[0] = 1 and version[1] < 1 and cls <> 'docs'")
    skills = table(spark, d, "supplier").select(_str("s_suppkey").alias("skill"), F.when(F.col("s_suppkey") % 2 == 0, "1.0.18").otherwise("1.0.19").alias("generator_version"))
    plan = up.plan_upgrades(skills, entries, "1.1.9")
    return up.bumped(skills, plan, plan.filter("plan = 'regenerate' or cast(issue as int) % 2 = 0"), "1.1.9")


def source_hashes(spark, d):
    """Whether each source's archived text has the hash its row names."""
    s = _src(spark, d)
    return up.source_ok(s.select(F.col("slug").alias("skill"), "source_sha256"), s.select(F.col("slug").alias("skill"), F.sha2(F.col("raw").cast("binary"), 256).alias("sha256")))


def recorded_offsets(spark, d):
    s = _src(spark, d)
    found = books.page_offsets(s).select(F.col("id").alias("skill"), F.col("page_offset").alias("offset"))
    return up.with_offset(s.select(F.col("slug").alias("skill"), "page_offset"), found)


def personalized_hints(spark, d):
    n = _notes(spark, d).filter("title is not null")
    files = n.select(_str("ord").alias("skill"), F.lit("s.md").alias("rel"), F.concat(F.lit("---\nargument-hint: [<"), "title", F.lit(">]\n---\n")).alias("text"))
    return up.personalized(files, n.select(_str("ord").alias("skill"), (F.col("ord") % 3).alias("rules"))).select("skill", "text")


def injected_sections(spark, d):
    b = _notes(spark, d).filter("body is not null").select("ord", F.when(F.col("ord") % 3 == 0, F.concat("body", F.lit("\n## Sources\nx"))).when(F.col("ord") % 3 == 1, F.concat("body", F.lit("\n## Cues\n"))).otherwise(F.col("body")).alias("text"))
    return b.select("ord", up.inject_section(F.col("text"), "## Cues\nask early\n", "## Cues", "## Sources").alias("text"))


def unknown_rules(spark, d):
    c = table(spark, d, "findings").select(F.col("finding_id").cast("string").alias("path"), F.col("category").alias("rule")).filter("rule is not null").distinct()
    return up.unknown_rules(c, table(spark, d, "lint_categories").select(F.col("category").alias("name")))


def term_lines(spark, d):
    return up.term_counts(_src(spark, d), ["chapter", "source", "page"], "slug", "raw")


def figure_chapters(spark, d):
    """Chapters of captions by label, else by page."""
    ranges = F.array(*[F.struct(F.lit(c).alias("chapter"), F.lit(p).alias("first_page")) for c, p in ((1, 1), (2, 20), (3, 55))])
    c = table(spark, d, "chunks").groupBy("id").agg(F.max("start_line").alias("page"))
    caption = F.when(F.col("id") % 3 == 0, F.format_string("Figure %d.2: a plot", F.col("id") % 9)).otherwise(F.lit("a plot"))
    return c.select("id", up.figure_chapter(caption, F.col("page"), ranges).alias("chapter"))


def contested_names(spark, d):
    return pv.contested(_notes(spark, d))


def taken_names(spark, d):
    n = _notes(spark, d)
    proposed = n.filter("slug is not null").select("vault", F.concat("slug", F.lit("-x")).alias("slug"), "title")
    return pv.taken_names(n, proposed)


def page_anchors(spark, d):
    return _src(spark, d).select("slug", F.coalesce(pv.page_anchored(F.col("extraction_method"), F.contains("raw", F.lit("\f"))), F.lit(False)).alias("anchored"))


def upserted_sources(spark, d):
    """Sources with those of one format written anew under another title."""
    base = _src(spark, d).select("slug", "title")
    fresh = _src(spark, d).filter("format = 'pdf'").select("slug", F.lit("new").alias("title")).unionByName(spark.createDataFrame([("brand-new", "new")], "slug string, title string"))
    return pv.upsert(base, fresh, "slug")


def without_manifest(spark, d):
    """Backfill proposals of sources outside one vault."""
    s = _src(spark, d)
    files = s.filter("source_filename is not null").select(F.col("source_filename").alias("name"))
    return pv.backfill(s.select("slug"), s.filter("vault = 'field-handbook'").select("slug"), files).select("slug", "source")


def next_chunk_ids(spark, d):
    plan = table(spark, d, "chunks").select("id")
    fresh = table(spark, d, "documents").select("doc_id").distinct()
    return ml.next_ids(plan, fresh, ["doc_id"])


def parsed_verdicts(spark, d):
    """Replies of ten notes each: fenced or not, verdicts in several spellings."""
    v = F.element_at(F.array(*[F.lit(x) for x in ("supported", " Overreach ", "UNSUPPORTED", "perhaps")]), (F.col("ord") % 4 + 1).cast("int"))
    item = F.to_json(F.struct(F.concat(F.lit("n"), _str("ord")).alias("slug"), v.alias("verdict"), F.lit("so").alias("reason")))
    r = _notes(spark, d).select(F.floor(F.col("ord") / 10).alias("reply_id"), "ord", item.alias("i")).groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("ord", "i"))).alias("x"))
    obj = F.concat(F.lit('{"verdicts": ['), F.array_join(F.transform("x", lambda x: x["i"]), ", "), F.lit("]}"))
    return ml.parse_verdicts(r.select("reply_id", F.when(F.col("reply_id") % 2 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(obj).alias("reply")))


def name_slugs(spark, d):
    return _notes(spark, d).select("ord", tx.slugify(F.col("title")).alias("slug"))


def _first_word():
    def reply(prompt):
        w = F.regexp_extract(prompt, r"<passage>\s*(\w+)", 1)
        return F.when(w != "", F.concat(F.lit('{"notes": [{"slug": "'), F.lower(w), F.lit('", "title": "t"}]}'))).otherwise(F.lit("nothing"))

    return ml.echo_model(reply, 0.5)


def built_notes(spark, d):
    """A build over all chunks by an offline model that names a note after the passage's first ASCII word."""
    one = table(spark, d, "chunks").groupBy("id").agg(F.max(F.struct("source", "chapter")).alias("c")).select("id", "c.*")
    chunks = one.join(books.chunk_texts(table(spark, d, "chunks"), table(spark, d, "raw_sources")), "id")
    return ml.build(chunks, _first_word()).select("id", F.try_element_at("notes", F.lit(1))["slug"].alias("slug"), "cost_usd", "error")


def build_summary(spark, d):
    """Per source: chunks built and failed; every chunk without words fails."""
    c = table(spark, d, "chunks").groupBy("id", "source").agg(F.max("words").alias("words")).filter("source is not null")
    none = F.array().cast("array<string>")
    r = c.select("id", "source", F.when(F.coalesce("words", F.lit(0)) > 0, F.array(F.lit("n"))).otherwise(none).alias("notes"), F.lit(0.25).alias("cost_usd"), F.when(F.coalesce("words", F.lit(0)) == 0, "no words").alias("error"))
    return ml.run_summary(r, "source")


def verified_vaults(spark, d):
    """Verification in batches by an offline model that judges a slug by its length."""

    def reply(prompt):
        slugs = F.regexp_extract_all(prompt, F.lit('<note slug="([^"]*)">'), 1)
        one = lambda s: F.concat(F.lit('{"slug": "'), s, F.lit('", "verdict": "'), F.element_at(F.array(*[F.lit(v) for v in ml.VERDICTS]), (F.length(s) % 3 + 1).cast("int")), F.lit('"}'))
        return F.concat(F.lit('{"verdicts": ['), F.array_join(F.transform(slugs, one), ", "), F.lit("]}"))

    n = _notes(spark, d).filter("vault is not null and slug is not null")
    return ml.verify(n, ml.echo_model(reply, 0.1), floor=0.2).withColumn("cost_usd", F.round("cost_usd", 6))


def arbitrated_pairs(spark, d):
    """Similar titles that an offline model calls the same when they begin with one letter."""

    def reply(prompt):
        a, b = (F.regexp_extract(prompt, rf"<{t}>(.)", 1) for t in ("one", "other"))
        return F.when(a == b, '{"same": true}').otherwise('{"same": false}')

    n = _notes(spark, d)
    return ml.arbitrate(nt.similar_titles(n, 0.6), n, ml.echo_model(reply)).select("vault", "ord_a", "ord_b")


def json_notes(spark, d):
    """Notes written as chunk files in both forms and read again."""
    n = _notes(spark, d).select("ord", F.to_json(F.struct("slug", "title", "tags", "citations"), {"ignoreNullFields": "false"}).alias("j"))
    text = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("["), "j", F.lit("]"))).otherwise(F.concat(F.lit('{"notes": ['), "j", F.lit("]}")))
    return vj.notes(n.select(_str("ord").alias("path"), text.alias("text"))).select("path", "slug", "title", "tags", "citations")


def json_plan(spark, d):
    c = table(spark, d, "chunks").groupBy("id").agg(F.max(F.struct("source", "start_line", "end_line")).alias("c")).select("id", "c.*")
    files = c.select(_str("id").alias("path"), F.concat(F.lit("["), F.to_json(F.struct("id", "source", "start_line", "end_line")), F.lit("]")).alias("text"))
    return vj.plan(files, "first-book").select("id", "source", "start_line", "end_line")


_FS = (change_entries, upgrade_plan, upgrade_bumps, source_hashes, recorded_offsets, personalized_hints, injected_sections, unknown_rules, term_lines, figure_chapters, contested_names, taken_names, page_anchors, upserted_sources,
       without_manifest, next_chunk_ids, parsed_verdicts, name_slugs, built_notes, build_summary, verified_vaults, arbitrated_pairs, json_notes, json_plan)
QUERIES = {f.__name__: f for f in _FS}

from . import book_queries as bq  # noqa: E402
from . import note_queries as nq  # noqa: E402

_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_S = "s as (select slug, any_value(raw) raw, any_value(format) format, any_value(title) title, any_value(vault) vault, any_value(source_sha256) source_sha256, any_value(page_offset) page_offset, any_value(extraction_method) extraction_method, any_value(source_filename) source_filename from raw_sources where slug is not null group by slug)"
_E = "e as (select [cast(p_partkey % 3 as int), cast(p_size % 12 as int), cast(p_partkey % 20 as int)] version, ['additive', 'transform', 'regenerate', 'docs'][p_partkey % 4 + 1] cls, p_partkey k, p_name from part)"
_GROUP = "case when cls in ('additive', 'transform', 'regenerate') then cls else 'skipped' end"
_VN = "(x[1] * 10000 + x[2] * 100 + x[3])"
_CTX = "tx as (select c.id, array_to_string(string_split(raw, chr(10))[greatest(a, 1):z], chr(10)) t from (select id, max(source) source, max(start_line) a, max(end_line) z from chunks where id is not null group by id) c join s on s.slug = c.source)"
ORACLE = {
    "change_entries": f"with {_E} select cast(0 as int) seq, version, cls, case when k % 2 = 0 then ['2', '3.1'] else [] end steps, p_name || ', more of it' description, k::varchar issue from e",
    "upgrade_plan": f"""with {_E}, k as (select s_suppkey::varchar skill, (s_suppkey % 2) * 10000 + (s_suppkey % 3) * 100 v from supplier)
        select skill, {_GROUP} as plan, count(*) entries from k join e on e.version[1] = 1 and e.version[2] < 2 and {_VN.replace("x[", "e.version[")} > v and {_VN.replace("x[", "e.version[")} <= 10109 group by all""",
    "upgrade_bumps": f"""with {_E}, k as (select s_suppkey::varchar skill, case when s_suppkey % 2 = 0 then '1.0.18' else '1.0.19' end g, case when s_suppkey % 2 = 0 then 10018 else 10019 end v from supplier),
        p as (select skill, bool_or(cls = 'regenerate' or k % 2 = 0) stays from k join (select cls, k, {_VN.replace("x[", "version[")} n from e where version[1] = 1 and version[2] < 1 and cls <> 'docs') e on n > v and n <= 10109 group by skill)
        select k.skill, case when stays is not null and not stays then '1.1.9' else g end generator_version, coalesce(not stays, false) bumped from k left join p using (skill)""",
    "source_hashes": f"with {_S} select slug skill, coalesce(source_sha256 <> '' and source_sha256 = sha256(raw), false) ok from s",
    "recorded_offsets": f"with {_S}, f as ({bq.ORACLE['page_offset']}) select s.slug skill, coalesce(s.page_offset, f.page_offset) page_offset from s left join f on f.id = s.slug",
    "personalized_hints": """with n as (select ord, any_value(title) title from notes where ord is not null group by ord) select ord::varchar skill, concat('---', chr(10), 'argument-hint: [<', title, '>', case when ord % 3 >= 1 and not contains(lower(title), 'stack') then ', or "<topic> in <stack>"' else '' end, ']', chr(10), '---', chr(10)) as text from n where title is not null""",
    "injected_sections": """with n as (select ord, any_value(body) b from notes where ord is not null group by ord) select ord, case ord % 3 when 0 then concat(b, chr(10), '## Cues', chr(10), 'ask early', chr(10), chr(10), '---', chr(10), chr(10), '## Sources', chr(10), 'x') when 1 then concat(b, chr(10), '## Cues', chr(10))
        else concat(regexp_replace(b, '\\s+$', ''), chr(10), chr(10), '---', chr(10), chr(10), '## Cues', chr(10), 'ask early', chr(10)) end as text from n where b is not null""",
    "unknown_rules": f"select distinct finding_id::varchar path, category as rule from findings where category is not null and not exists (select 1 from lint_categories l where lower({nq._strip('l.category')}) = lower({nq._strip('findings.category')}))",
    "term_lines": f"with {_S}, l as (select slug, unnest(string_split(lower(raw), chr(10))) l from s) select slug id, term, count(*) n from l join (select unnest(['chapter', 'source', 'page']) term) t on contains(l, term) group by all",
    "figure_chapters": "select id, cast(case when id % 3 = 0 then id % 9 else case when max(start_line) >= 55 then 3 when max(start_line) >= 20 then 2 when max(start_line) >= 1 then 1 end end as int) chapter from chunks group by id",
    "contested_names": f"with n as (select ord, any_value(vault) vault, any_value(slug) slug, any_value(status) status from notes where ord is not null group by ord) select vault, {_KEY.format('slug')} as key, count(distinct status) > 1 contested from n where {_KEY.format('slug')} <> '' group by all",
    "taken_names": f"""with n as (select ord, any_value(vault) vault, any_value(slug) slug, any_value(title) title, any_value(aliases) aliases from notes where ord is not null group by ord), k as (select vault, ord, {_KEY.format("x")} k from (select vault, ord, unnest(list_concat([slug, title], coalesce(aliases, []))) x from n)),
        p as (select distinct vault, slug || '-x' slug, unnest([{_KEY.format("slug || '-x'")}, {_KEY.format("title")}]) k from n where slug is not null) select p.vault, p.slug, min(ord) ord from p join k on k.vault = p.vault and k.k = p.k and k.k <> '' group by all""",
    "page_anchors": f"with {_S} select slug, coalesce(extraction_method in ('pdftotext', 'pypdf', 'pdfminer') and contains(raw, chr(12)), false) anchored from s",
    "upserted_sources": f"with {_S} select slug, case when format = 'pdf' then 'new' else title end title from s union all select 'brand-new', 'new'",
    "without_manifest": f"select f.slug, f.source from ({nq.ORACLE['file_matches']}) f where f.slug not in (select slug from raw_sources where slug is not null and vault = 'field-handbook')",
    "next_chunk_ids": "select doc_id, cast((select max(id) from chunks) + row_number() over (order by doc_id nulls first) as int) id from (select distinct doc_id from documents)",
    "parsed_verdicts": "select 'n' || ord slug, ['supported', 'overreach', 'unsupported', 'unsupported'][ord % 4 + 1] verdict, 'so' reason from (select distinct ord from notes where ord is not null)",
    "name_slugs": f"select ord, coalesce(nullif({_KEY.format('any_value(title)')}, ''), 'source') slug from notes where ord is not null group by ord",
    "built_notes": f"with {_S}, {_CTX} select id, nullif(lower(regexp_extract(t, '^\\s*(\\w+)', 1)), '') slug, cast(0.5 as double) cost_usd, cast(null as varchar) error from tx",
    "build_summary": """with c as (select id, source, coalesce(max(words), 0) w from chunks where source is not null group by all), k as (select *, row_number() over (partition by source, w = 0 order by id) k from c)
        select source, count(*) filter (w > 0) done, count(*) filter (w = 0) failed, count(*) filter (w > 0) notes, count(*) * cast(0.25 as double) cost_usd, coalesce(list(id || ': no words' order by id) filter (w = 0 and k <= 12), []) failures from k group by source""",
    "verified_vaults": """with n as (select ord, any_value(vault) vault, any_value(slug) slug from notes where ord is not null group by ord), v as (select vault, ord, row_number() over (partition by vault order by ord) - 1 k, len(slug) % 3 m from n where vault is not null and slug is not null)
        select vault, count(*) total, count(*) filter (m = 0) supported, count(*) filter (m = 1) overreach, count(*) filter (m = 2) unsupported, count(*) filter (m = 0) / count(*) faithfulness, round(count(distinct k // 10) * cast(0.1 as double), 6) cost_usd, count(*) filter (m = 2) = 0 and count(*) filter (m = 0) / count(*) >= 0.2 ok from v group by vault""",
    "arbitrated_pairs": f"select p.vault, ord_a, ord_b from ({nq.ORACLE['title_pairs']}) p join (select ord, any_value(title) t from notes group by ord) a on a.ord = ord_a join (select ord, any_value(title) t from notes group by ord) b on b.ord = ord_b where coalesce(a.t, ':')[1] = coalesce(b.t, ':')[1]",
    "json_notes": "select ord::varchar path, any_value(slug) slug, any_value(title) title, any_value(tags) tags, any_value(citations) citations from notes where ord is not null group by ord",
    "json_plan": "select id, coalesce(nullif(max(source), ''), 'first-book') source, max(start_line) start_line, max(end_line) end_line from chunks where id is not null group by id",
}
