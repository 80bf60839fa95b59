"""Queries on whole vaults, each with its SQL. A vault's sources are those that carry its name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import bundle as bd
from ..operators import notes as nt
from ..operators import vault as vt
from ..session import cut, table
from . import note_queries as nq
from .bundle_queries import _files

STAMP, GENERATOR = "2026-01-01T00:00:00Z", "1.0.0"


def _sources(spark, d):
    return nq._src(spark, d).filter("vault is not null")


def _merged(spark, d):
    return nq._merged(spark, d).filter("vault is not null")


def _dropped(spark, d):
    n = nq._notes(spark, d)
    return vt.dropped_by_vault(n, nt.ground(n, nq._src(spark, d)))


def vault_section_listings(spark, d):
    return bd.section_indexes(_merged(spark, d))


def vault_source_listings(spark, d):
    return vt.source_listings(_sources(spark, d))


def vault_source_notes(spark, d):
    return vt.source_notes(_sources(spark, d), STAMP)


def notes_by_source(spark, d):
    return vt.notes_by_source(_merged(spark, d))


def vault_source_maps(spark, d):
    return vt.source_maps(_merged(spark, d), _sources(spark, d), STAMP)


def vault_roots(spark, d):
    return vt.roots_and_logs(_merged(spark, d), _sources(spark, d), _dropped(spark, d), STAMP)


def vault_manifests(spark, d):
    m = vt.manifests(_merged(spark, d), _sources(spark, d), _dropped(spark, d), STAMP, GENERATOR)
    return m.select("vault", "generator_version", "updated", F.explode("note_counts").alias("section", "notes"), F.col("dropped.citations").alias("lost_citations"), F.col("dropped.notes").alias("lost_notes"))


def vault_gate(spark, d):
    """Every vault built from its notes and sources, read back as a bundle and linted: files and errors of each category."""
    m, n = _merged(spark, d), nq._notes(spark, d)
    files = cut(vt.assembled(_files(spark, d).filter("bundle is not null"), m, _sources(spark, d), vt.dropped_by_vault(n, nt.ground(n, nq._src(spark, d))), STAMP))
    found = bd.lint(files, strict_links=True).groupBy("bundle").agg(F.count_if(F.col("category") == "reserved-file").alias("reserved"), F.count_if(F.col("category") == "missing-type").alias("untyped"), F.count_if(F.col("category") == "reciprocity").alias("one_way"))
    return files.groupBy("bundle").agg(F.count(F.lit(1)).alias("files")).join(found, "bundle", "left").na.fill(0)


def reserved_files(spark, d):
    """Lint of listing files: documents under the name index.md, at the root or in a folder."""
    docs = table(spark, d, "documents").filter("source is not null and text is not null")
    root = F.col("doc_id") % 2 == 0
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(f'---\n{bd.VERSION_KEY}: "0.1"\n---\n'), "text")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(f"---\n{bd.VERSION_KEY}: 1\nmore: 2\n---\n"), "text")).otherwise(F.col("text"))
    files = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("bundle"), F.when(root, "index.md").otherwise("part/index.md").alias("rel"), text.alias("text"))
    return bd.lint(files).filter("category = 'reserved-file'").select("bundle", "path", "line", "level")


def relative_links(spark, d):
    """Links of rendered notes rewritten as relative ones, resolved again."""
    docs = table(spark, d, "notes").filter("slug is not null and vault is not null").groupBy("ord").agg(F.first("vault").alias("bundle"), F.first("slug").alias("slug"), F.first("related").alias("related"))
    lines = F.array_join(F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda r: F.concat(F.lit("[x](../b/./c/../"), name_key(r), F.lit(".md)"))), "\n")
    files = docs.select("bundle", F.concat(F.lit("a/"), F.col("ord").cast("string"), F.lit(".md")).alias("rel"), lines.alias("text"))
    return bd.links(files).select("bundle", "rel", "line_no", "path")


QUERIES = {f.__name__: f for f in (vault_section_listings, vault_source_listings, vault_source_notes, notes_by_source, vault_source_maps, vault_roots, vault_manifests, vault_gate, reserved_files, relative_links)}

_SECTION = "coalesce(case lower(type) " + " ".join(f"when '{k.lower()}' then '{v}'" for k, v in nt.SECTIONS.items()) + " end, 'concepts')"
_PLACE = "list_position([" + ", ".join(f"'{s}'" for s in vt.ORDER) + "], section)"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, '-'), lambda w: upper(w[1]) || w[2:]), ' ')"


def _yaml(x: str) -> str:
    return f"to_json({x})"


_MG = f"mg as (select *, {_SECTION} section from ({nq.ORACLE['note_merge']}) where vault is not null)"
_NS = f"ns as (select distinct mg.vault, c.source, section, mg.slug, title from mg join ({nq.ORACLE['note_citations']}) c on c.vault = mg.vault and c.slug = mg.slug where c.source is not null)"
_SR = """sr as (select slug, any_value(vault) vault, coalesce(any_value(title), slug) title, array_to_string(coalesce(any_value(authors), []), ', ') who, coalesce(any_value(extraction_method), '') how, coalesce(any_value(source_sha256), '') sha, coalesce(any_value(raw_rel), '') rel_
  from raw_sources where slug is not null group by slug having any_value(vault) is not null)"""
_NL = "chr(10)"
_LOST = f"""with gr as ({nq.ORACLE['ground_citations']}), p as (select n.ord, n.vault, count(gr."at") kept, count(gr.ord) al from (select ord, any_value(vault) vault from notes where ord is not null group by ord) n left join gr on gr.ord = n.ord group by all)
  select vault, cast(sum(al - kept) as bigint) citations, count(*) filter (kept = 0) notes from p group by vault"""
_PV = f"""lost as ({_LOST}), bk as (select vault, count(*) n_sources, min(title) one_title from sr group by vault), ct as (select bk.vault, s.section, count(mg.slug) notes from bk join (select unnest([{", ".join(f"'{s}'" for s in vt.ORDER)}]) section) s on true left join mg on mg.vault = bk.vault and mg.section = s.section group by all),
pv as (select bk.*, (select sum(notes) from ct where ct.vault = bk.vault) n_notes, (select count(*) from mg where mg.vault = bk.vault and mg.merged) n_merged, coalesce(lost.citations, 0) lc, coalesce(lost.notes, 0) ln, case when n_sources = 1 then one_title else n_sources || ' sources' end label from bk left join lost on lost.vault = bk.vault)"""
_LISTING = f"""select vault bundle, section || '/index.md' rel, '# ' || {_title("section")} || {_NL} || {_NL} || string_agg('- [' || coalesce(title, '') || '](/' || section || '/' || slug || '.md) — ' || coalesce(description, ''), {_NL} order by slug) || {_NL} as text from mg group by vault, section"""
ORACLE = {
    "section_indexes": f"with {_MG.replace(' where vault is not null)', ')')} {_LISTING}",
    "vault_section_listings": f"""with {_MG} select vault bundle, section || '/index.md' rel, '# ' || {_title("section")} || {_NL} || {_NL} || string_agg('- [' || coalesce(title, '') || '](/' || section || '/' || slug || '.md) — ' || coalesce(description, ''), {_NL} order by slug) || {_NL} as text from mg group by vault, section""",
    "vault_source_listings": f"""with {_SR} select vault bundle, 'references/index.md' rel, '# References' || {_NL} || {_NL} || string_agg('- [' || title || '](/references/' || slug || '.md) — ' || who, {_NL} order by slug) || {_NL} as text from sr group by vault
        union all select vault, 'moc/index.md', '# Maps of content' || {_NL} || {_NL} || string_agg('- [' || title || '](/moc/' || slug || '.md) — its notes by section', {_NL} order by slug) || {_NL} from sr group by vault""",
    "vault_source_notes": f"""with {_SR} select vault bundle, 'references/' || slug || '.md' rel, concat('---', {_NL}, 'type: Source', {_NL}, 'title: ', {_yaml("title")}, {_NL}, 'description: ', {_yaml("who")}, {_NL}, 'tags: [source]', {_NL}, 'timestamp: {STAMP}', {_NL}, 'extraction_method: ', how, {_NL}, 'source_sha256: ', sha, {_NL}, 'raw: /', rel_, {_NL}, '---', {_NL}, {_NL},
        '# ', title, {_NL}, {_NL}, 'By ', who, '; read with ', how, '.', {_NL}, {_NL}, 'Its notes are listed in its [map](/moc/', slug, '.md).', {_NL}) as text from sr""",
    "notes_by_source": f"with {_MG}, {_NS} select * from ns",
    "vault_source_maps": f"""with {_MG}, {_NS}, {_SR}, l as (select vault, source, section, {_NL} || {_NL} || '## ' || {_title("section")} || {_NL} || string_agg('- [' || coalesce(title, '') || '](/' || section || '/' || slug || '.md)', {_NL} order by slug) b from ns group by vault, source, section),
        p as (select vault, source, string_agg(b, '' order by {_PLACE}) b from l group by all)
        select sr.vault bundle, 'moc/' || slug || '.md' rel, concat('---', {_NL}, 'type: MOC', {_NL}, 'title: ', {_yaml("title || ' — map of content'")}, {_NL}, 'description: ', {_yaml("'Notes that cite ' || title")}, {_NL}, 'tags: [moc]', {_NL}, 'timestamp: {STAMP}', {_NL}, 'source: /references/', slug, '.md', {_NL}, '---', {_NL}, {_NL}, '# ', title, ' — map of content', coalesce(b, ''), {_NL}) as text
        from sr left join p on p.vault = sr.vault and p.source = sr.slug""",
    "vault_roots": f"""with {_MG}, {_SR}, {_PV} select vault bundle, 'index.md' rel, concat('---', {_NL}, '{bd.VERSION_KEY}: "{vt.FORMAT_VERSION}"', {_NL}, '---', {_NL}, {_NL}, '# Notes from ', label, {_NL}, {_NL}, '## Sections', {_NL}, (select string_agg('- [' || {_title("section")} || '](/' || section || '/index.md)' || {_NL}, '' order by {_PLACE}) from ct where ct.vault = pv.vault and notes > 0), '- [References](/references/index.md)', {_NL}, '- [Maps of content](/moc/index.md)', {_NL}) as text from pv
        union all select vault, 'log.md', concat('# Log', {_NL}, {_NL}, '## {STAMP[:10]}', {_NL}, '- Built ', n_notes, ' notes, ', n_merged, ' of them from several places, from ', label, case when lc > 0 or ln > 0 then '; left out ' || lc || ' citations not found in their source and ' || ln || ' notes without any' else '' end, {_NL}) from pv""",
    "vault_manifests": f"with {_MG}, {_SR}, {_PV} select pv.vault, '{GENERATOR}' generator_version, '{STAMP[:10]}' updated, section, ct.notes, lc lost_citations, ln lost_notes from pv join ct on ct.vault = pv.vault",
    "reserved_files": """with f as (select source || '/' || doc_id bundle, doc_id, case when doc_id % 2 = 0 then 'index.md' else 'part/index.md' end path, text from documents where source is not null and text is not null)
        select bundle, path, 1 as line, 'error' as level from f where doc_id % 4 = 2 or (doc_id % 2 = 1 and regexp_matches(text, '^[ \\t]*---[ \\t]*(\\n|\\r|$)'))""",
    "relative_links": """with n as (select ord, any_value(vault) vault, any_value(related) related from notes where slug is not null and vault is not null group by ord), r as (select vault, ord, generate_subscripts(related, 1) i, unnest(related) x from n)
        select vault bundle, 'a/' || ord || '.md' rel, cast(i as int) line_no, 'b/' || trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-') || '.md' path from r where x is not null""",
}
