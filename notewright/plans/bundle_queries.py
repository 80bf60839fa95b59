"""Queries on bundles of Markdown files, each with its SQL. The documents of a source are its bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..functions.unicode_sql import nfkc_folded
from ..operators import bundle as bd
from ..operators import notes as nt
from ..operators import reports as rp
from ..session import cut, table
from .note_queries import _merged, _notes, _src


def _bundle(spark, d):
    """Notes under their section and title, logs as log.md of a folder, the rest as pages."""
    docs = table(spark, d, "documents").filter("source is not null and text is not null")
    title = name_key(F.regexp_extract("text", r"\ntitle: ([^\n]*)", 1))
    rel = (
        F.when((F.col("doc_type") == "note") & (title != ""), F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("methods/")).otherwise(F.lit("concepts/")), title, F.lit(".md")))
        .when(F.col("doc_type") == "log", F.concat(F.lit("logs/"), F.col("doc_id").cast("string"), F.lit("/log.md"))).otherwise(F.concat(F.lit("pages/"), F.col("doc_id").cast("string"), F.lit(".md")))
    )
    # one file per path: the one with the greatest id
    return docs.select(F.col("source").alias("bundle"), rel.alias("rel"), "text", "doc_id").groupBy("bundle", "rel").agg(F.max_by("text", "doc_id").alias("text"))


def front_matter_fields(spark, d):
    return bd.parsed(_bundle(spark, d)).filter("fields is not null").select("bundle", "rel", F.posexplode("fields").alias("pos", "e")).select("bundle", "rel", "pos", "e.k", "e.v")


def note_links(spark, d):
    return bd.links(_bundle(spark, d))


def dangling_links(spark, d):
    return bd.dangling(_bundle(spark, d)).select("bundle", "rel", "line_no", "target")


def related_section_links(spark, d):
    b = _bundle(spark, d)
    return bd.related_lines(b)


def lint_findings(spark, d):
    return bd.lint(_bundle(spark, d))


def lint_summary(spark, d):
    return bd.lint_summary(_bundle(spark, d))


def coverage_gate(spark, d):
    return bd.coverage(_bundle(spark, d))


def note_parts(spark, d):
    return bd.note_parts(_bundle(spark, d))


def fact_coverage(spark, d):
    """Facts: the first quote of every note must stand in the note's own body."""
    n = _notes(spark, d).filter("slug is not null and vault is not null")
    one = n.groupBy(F.col("vault").alias("bundle"), "slug").agg(F.min_by(F.struct("body", "citations"), "ord").alias("n"))
    facts = one.select("bundle", F.col("slug").alias("concept"), F.try_element_at("n.citations", F.lit(1))["quote"].alias("anchor"))
    return bd.fact_coverage(one.select("bundle", F.col("slug").alias("concept"), "slug"), facts, one.select("bundle", "slug", F.col("n.body").alias("text")))


def lint_report(spark, d):
    return rp.lint_report(bd.lint(_bundle(spark, d)))


def _files(spark, d):
    n = _notes(spark, d)
    m = _merged(spark, d).withColumn("type", F.coalesce(nt.canonical_type(F.col("type")), "type"))
    titles = _src(spark, d).select(F.col("slug").alias("source"), F.col("title").alias("source_title"))
    return bd.rendered(m, nt.related_links(n, nt.alias_index(n)), titles, "2026-01-01T00:00:00Z")


def rendered_notes(spark, d):
    return _files(spark, d)


def rendered_lint(spark, d):
    """The lint of the rendered notes: what they still miss."""
    return bd.lint(cut(_files(spark, d)), strict_links=True).groupBy("bundle", "category", "level").agg(F.count(F.lit(1)).alias("findings"))


def section_indexes(spark, d):
    return bd.section_indexes(_merged(spark, d))


def _gold_pairs(spark, d):
    """Distinct (bundle, a, b), a <= b, of slugs that a match row judged equal; as in the SQL, a slug judged equal to itself is a pair (no link can meet it)."""
    m = table(spark, d, "note_matches").filter("same and slug_a is not null and slug_b is not null")
    return m.select(F.col("vault").alias("bundle"), F.least("slug_a", "slug_b").alias("a"), F.greatest("slug_a", "slug_b").alias("b")).distinct()


def _gold(spark, d):
    """Gold concepts (bundle, concept, p, k): every slug that a match row judged equal names, on either side, with itself as its first key and every partner as a further one, in order."""
    m = table(spark, d, "note_matches").filter("same and slug_a is not null and slug_b is not null")
    own = m.select(F.col("vault").alias("bundle"), F.explode(F.array("slug_a", "slug_b")).alias("concept")).distinct()
    pairs = _gold_pairs(spark, d).filter("a <> b")
    rank = lambda n, k: F.struct(F.lit(n).alias("n"), F.col(k).alias("k")).alias("p")
    both = [pairs.select("bundle", F.col(x).alias("concept"), rank(1, y), F.col(y).alias("k")) for x, y in (("a", "b"), ("b", "a"))]
    return own.select("bundle", "concept", rank(0, "concept"), F.col("concept").alias("k")).unionByName(both[0]).unionByName(both[1])


def _note_keys(spark, d):
    n = _notes(spark, d)
    from ..functions.text import norm

    keys = F.array_distinct(F.transform(F.concat(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>"))), norm))
    return n.select(F.col("vault").alias("bundle"), F.format_string("%012d", "ord").alias("rel"), "slug", keys.alias("keys"))


def gold_recall(spark, d):
    return bd.concept_recall(bd.match_gold(_note_keys(spark, d), _gold(spark, d)))


def link_recall(spark, d):
    n = _notes(spark, d)
    edges = nt.related_links(n, nt.alias_index(n)).withColumnRenamed("vault", "bundle")
    return bd.link_recall(bd.match_gold(_note_keys(spark, d), _gold(spark, d)), _gold_pairs(spark, d), edges)


QUERIES = {f.__name__: f for f in (front_matter_fields, note_links, dangling_links, related_section_links, lint_findings, lint_summary, coverage_gate, note_parts, fact_coverage, lint_report, rendered_notes, rendered_lint, section_indexes, gold_recall, link_recall)}

_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


_B = r"""b0 as (select source bundle, doc_id, text, case when doc_type = 'note' and trim(regexp_replace(lower(regexp_extract(text, '\ntitle: ([^\n]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-') <> ''
  then case when doc_id % 2 = 0 then 'methods/' else 'concepts/' end || trim(regexp_replace(lower(regexp_extract(text, '\ntitle: ([^\n]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-') || '.md'
  when doc_type = 'log' then 'logs/' || doc_id || '/log.md' else 'pages/' || doc_id || '.md' end rel from documents where source is not null and text is not null),
b as (select bundle, rel, arg_max(text, doc_id) as text from b0 group by all),
lx as (select bundle, rel, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') x from b),
l as (select bundle, rel, generate_subscripts(x, 1) n, unnest(x) line from (select bundle, rel, case when x[-1] = '' then x[:len(x) - 1] else x end x from lx)),
fd as (select bundle, rel, min(n) e from l where n > 1 and """ + _strip("line") + """ = '---' group by all),
fm as (select l.bundle, l.rel, l.n, l.line from l join fd using (bundle, rel) join l f on f.bundle = l.bundle and f.rel = l.rel and f.n = 1 and """ + _strip("f.line") + r""" = '---' where l.n > 1 and l.n < fd.e and l.line <> '' and not regexp_matches(l.line, '^\s') and contains(l.line, ':')),
kv as (select bundle, rel, n, """ + _strip("split_part(line, ':', 1)") + " k, regexp_replace(" + _strip("regexp_replace(line, '^[^:]*:', '')") + r""", '^["'']+|["'']+$', '', 'g') v from fm),
ty as (select bundle, rel, arg_max(v, n) t from kv where k = 'type' group by all),
p as (select b.*, regexp_extract(b.rel, '[^/]*$') as name, coalesce(t, '') nt from b left join ty using (bundle, rel)),
pa as (select *, name in ('index.md', 'log.md') rs, name not in ('index.md', 'log.md') and nt <> '' and lower(nt) not in ('source', 'moc', 'schema') at_ from p),
lk0 as (select bundle, rel, n, unnest(regexp_extract_all(line, '\[[^\]]*\]\(([^)]+)\)', 1)) raw from l),
lk1 as (select bundle, rel, n, regexp_extract(""" + _strip("raw") + r""", '^\S+') f from lk0),
lk as (select bundle, rel, n, regexp_replace(f, '#.*$', '') target, ltrim(regexp_replace(f, '#.*$', ''), '/') path from lk1 where not regexp_matches(f, '^(https?://|mailto:|#)') and regexp_replace(f, '#.*$', '') like '%.md'),
dg as (select lk.* from lk where not exists (select 1 from b where b.bundle = lk.bundle and b.rel = lk.path)),
hd as (select bundle, rel, n, case when regexp_matches(line, '^#{1,2}\s') then regexp_matches(line, '(?i)^##\s+Related\b') end o from l),
rs as (select bundle, rel, n from (select *, last_value(o ignore nulls) over (partition by bundle, rel order by n) i from hd) where i and o is null),
ch as (select bundle, rel, min(n) c from l where regexp_matches(line, '(?i)^#{1,6}\s+citations\b') group by all),
ci as (select distinct l.bundle, l.rel from l join ch using (bundle, rel) where l.n > c and regexp_matches(line, '\[Ch\b') and not regexp_matches(line, '(?i)^#{1,6}\s+citations\b')),
cv as (select pa.bundle, count(*) filter (at_) atomic, count(*) filter (at_ and ci.rel is not null) cited from pa left join ci using (bundle, rel) group by pa.bundle),
rt as (select lk.bundle, lk.rel, lk.n, lk.path from lk join rs using (bundle, rel, n) join pa using (bundle, rel) where at_ and exists (select 1 from b where b.bundle = lk.bundle and b.rel = lk.path)),
lg as (select l.bundle, l.rel, n, regexp_extract(line, '^#{2,3}\s+(\d{4}-\S*)\s*$', 1) d from l join pa using (bundle, rel) where name = 'log.md'),
ld as (select *, case when regexp_full_match(d, '\d{4}-\d{2}-\d{2}') then try_cast(d as date) end dy from lg where d <> ''),
lo as (select *, lag(dy) over (partition by bundle, rel order by n) bf from ld where dy is not null),
fi as (select bundle, 'error' as level, rel path, 1 as line, 'missing-type' category, 'the front matter names no type' message from pa where not rs and nt = ''
 union all select bundle, 'error', rel, n, 'log-format', 'no such day: ' || d from ld where dy is null
 union all select bundle, 'error', rel, n, 'log-format', cast(dy as varchar) || ' stands below the older ' || cast(bf as varchar) from lo where dy > bf
 union all select bundle, 'error', rel, n, 'dangling-link', 'leads nowhere: ' || target from dg
 union all select pa.bundle, 'error', pa.rel, null, 'coverage', 'cites no chapter' from pa left join ci using (bundle, rel) where at_ and ci.rel is null
 union all select bundle, 'error', '.', null, 'coverage', cited || ' of ' || atomic || ' notes cite a chapter, too few' from cv where atomic > 0 and cited / atomic < 0.8 - 1e-9
 union all select rt.bundle, 'warning', rt.rel, rt.n, 'reciprocity', 'no link back from ' || rt.path from rt join pa q on q.bundle = rt.bundle and q.rel = rt.path and q.at_ where not exists (select 1 from rt r2 where r2.bundle = rt.bundle and r2.rel = rt.path and r2.path = rt.rel))
"""
ORACLE = {
    "front_matter_fields": f"with {_B} select bundle, rel, cast(row_number() over (partition by bundle, rel order by n) - 1 as int) pos, k, v from kv",
    "note_links": f"with {_B} select bundle, rel, cast(n as int) line_no, target, path from lk",
    "dangling_links": f"with {_B} select bundle, rel, cast(n as int) line_no, target from dg",
    "related_section_links": f"with {_B} select bundle, rel, cast(n as int) line_no from rs",
    "lint_findings": f"with {_B} select bundle, level, path, cast(line as int) line, category, message from fi",
    "lint_summary": rf"""with {_B}, cn as (select distinct bundle, rel from l where regexp_matches(line, '(?i)^#{{1,6}}\s+citations\b'))
        select x.*, coalesce(e, 0) errors, coalesce(w, 0) warnings, coalesce(dl, 0) dangling, coalesce(ow, 0) one_way from (select pa.bundle, count(*) md_files, count(*) filter (not rs) concept_notes, count(*) filter (not rs and cn.rel is not null) with_citations, any_value(atomic) atomic, any_value(cited) cited
        from pa left join cn using (bundle, rel) join cv on cv.bundle = pa.bundle group by pa.bundle) x left join (select bundle, count(*) filter (level = 'error') e, count(*) filter (level = 'warning') w, count(*) filter (category = 'dangling-link') dl, count(*) filter (category = 'reciprocity') ow from fi group by bundle) y using (bundle)""",
    "coverage_gate": f"with {_B} select bundle, atomic, cited, case when atomic > 0 then cited / atomic else 1.0 end coverage from cv",
}
ORACLE["note_parts"] = rf"""with {_B}, h as (select *, case when regexp_matches(line, '^#\s+.') and regexp_extract(line, '^#\s+(.+)$', 1) <> '' then n end h1 from l), f as (select *, min(h1) over (partition by bundle, rel) fst from h),
    m as (select *, case when n = fst then 'body' when regexp_matches(line, '^#{{1,6}}\s') then case when regexp_matches(line, '(?i)^#{{1,6}}\s+citations\b') then 'citations' else '' end end mk from f),
    s as (select *, last_value(mk ignore nulls) over (partition by bundle, rel order by n) part, regexp_extract(line, '"([^"]+)"', 1) qt from m)
    select bundle, rel, coalesce(max(case when n = fst then {_strip(r"regexp_extract(line, '^#\s+(.+)$', 1)")} end), '') title, {_strip("coalesce(string_agg(line, chr(10) order by n) filter (mk is null and part = 'body'), '')")} body,
    coalesce(list(qt order by n) filter (mk is null and part = 'citations' and qt <> ''), []) quotes from s group by bundle, rel"""
ORACLE["fact_coverage"] = f"""with o as (select vault bundle, slug, arg_min(row(body, citations), ord) x from (select ord, any_value(vault) vault, any_value(slug) slug, any_value(body) body, any_value(citations) citations from notes where ord is not null group by ord) where slug is not null and vault is not null group by all),
    f as (select bundle, x[1] body, x[2][1].quote q from o), a as (select bundle, trim(regexp_replace({nfkc_folded("body")}, '{_W}+', ' ', 'g')) t, trim(regexp_replace({nfkc_folded("q")}, '{_W}+', ' ', 'g')) q from f where coalesce({_strip("q")}, '') <> '')
    select bundle, count(*) filter (coalesce(contains(t, q), false)) found, count(*) facts, count(*) filter (coalesce(contains(t, q), false)) / count(*) coverage from a group by bundle"""
ORACLE["lint_report"] = f"""with {_B}, o as (select *, row_number() over (partition by bundle order by case level when 'error' then 0 else 1 end, path, coalesce(line, 0), category, message) k from fi)
    select bundle, 0 as k, count(*) filter (level = 'error') || ' errors, ' || count(*) filter (level = 'warning') || ' warnings' as text from fi group by bundle
    union all select bundle, cast(k as int), upper(level) || ' ' || category || ' ' || path || coalesce(':' || line, '') || ' ' || message from o"""
_NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '" + _W.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"
_GOLD = f"""n as (select ord, any_value(vault) vault, any_value(slug) slug, any_value(aliases) aliases, any_value(related) related from notes where ord is not null group by ord),
gp as (select distinct vault bundle, least(slug_a, slug_b) a, greatest(slug_a, slug_b) b from note_matches where same and slug_a is not null and slug_b is not null),
gd as (select bundle, a concept from gp union select bundle, b from gp),
nk0 as (select vault bundle, ord, slug, unnest(list_prepend(slug, coalesce(aliases, []))) k from n),
nk as (select bundle, {_NORM.format("k")} key_, arg_min(slug, ord) slug from nk0 group by all),
gk as (select bundle, concept, 0 p, concept k from gd union all select bundle, a, 1, b from gp where a <> b union all select bundle, b, 1, a from gp where a <> b),
ht as (select gk.bundle, concept, arg_min(slug, row(p, k)) slug from gk join nk on nk.bundle = gk.bundle and nk.key_ = {_NORM.format("k")} group by all),
mg as (select gd.bundle, gd.concept, slug from gd left join ht using (bundle, concept))"""
ORACLE["gold_recall"] = f"with {_GOLD} select bundle, count(slug) found, count(*) concepts, count(slug) / count(*) recall from mg group by bundle"
ORACLE["link_recall"] = f"""with {_GOLD}, idx0 as (select vault, slug, ord, 0 prio, slug as name from n where slug is not null union all select vault, slug, ord, 1, unnest(aliases) from n where slug is not null),
    idx as (select vault, replace(lower({_strip("name")}), 'ß', 'ss') k, arg_min(slug, row(prio, ord)) slug from idx0 where {_strip("name")} <> '' group by all),
    r as (select vault, slug src, unnest(related) as ref from n where slug is not null), ed as (select distinct r.vault, r.src, idx.slug dst from r join idx on idx.vault = r.vault and idx.k = replace(lower({_strip("ref")}), 'ß', 'ss') where r.src <> idx.slug),
    e as (select gl.bundle, x.slug xs, y.slug ys from gp gl left join mg x on x.bundle = gl.bundle and x.concept = gl.a left join mg y on y.bundle = gl.bundle and y.concept = gl.b)
    select bundle, count(*) filter (hit) linked, count(*) links, count(*) filter (hit) / count(*) recall from (select bundle, exists (select 1 from ed where ed.vault = e.bundle and ((ed.src = xs and ed.dst = ys) or (ed.src = ys and ed.dst = xs))) hit from e) group by bundle"""
