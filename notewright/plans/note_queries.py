"""Queries on notes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.unicode_sql import nfkc_folded
from ..operators import notes as nt
from ..operators.books import one_text
from ..session import table


def _notes(spark, d):
    return nt.one_note(table(spark, d, "notes"))


def _src(spark, d):
    return one_text(table(spark, d, "raw_sources"))


def note_validation(spark, d):
    return nt.validated(_notes(spark, d)).select("ord", "canonical_type", "confidence", "status", F.array_join("errors", ",").alias("errors"))


def ground_citations(spark, d):
    return nt.ground(_notes(spark, d), _src(spark, d)).select("ord", "pos", "at", "page", "folio")


def ungroundable(spark, d):
    return nt.ground(_notes(spark, d), _src(spark, d)).filter("at is null").groupBy("source").agg(F.count(F.lit(1)).alias("citations"))


def drop_stats(spark, d):
    n = _notes(spark, d)
    return nt.drop_stats(nt.ground(n, _src(spark, d)), n)


def slug_folds(spark, d):
    return nt.fold_edges(_slugs(spark, d))


def slug_fold_roots(spark, d):
    return nt.fold_roots(nt.fold_edges(_slugs(spark, d)))


def _slugs(spark, d):
    n = table(spark, d, "notes").select(tx.name_key(F.col("slug")).alias("slug"))
    # titles' initials and part names give slugs that fold
    p = table(spark, d, "part").select(tx.name_key(F.col("p_name")).alias("slug"))
    return n.unionByName(p).unionByName(p.select(tx.initials(F.col("slug")).alias("slug"))).unionByName(p.select(F.concat("slug", F.lit("s")).alias("slug"))).filter("slug <> ''")


def alias_resolution(spark, d):
    return nt.alias_index(_notes(spark, d))


def related_symmetric(spark, d):
    n = _notes(spark, d)
    return nt.related_links(n, nt.alias_index(n))


def _merged(spark, d):
    n = _notes(spark, d)
    roots = nt.fold_roots(nt.fold_edges(n.select("slug")))
    return nt.merged(n, nt.ground(n, _src(spark, d)), roots)


def note_merge(spark, d):
    m = _merged(spark, d)
    return m.select("vault", "slug", "type", "title", "description", "confidence", "status", "body", "tags", "aliases", "related", F.size("citations").alias("citations"), "occurrences", "merged")


def note_citations(spark, d):
    return _merged(spark, d).select("vault", "slug", F.posexplode("citations").alias("pos", "c")).select("vault", "slug", (F.col("pos") + 1).alias("number"), "c.source", "c.chapter", "c.quote", "c.folio")


def token_sets(spark, d):
    return nt.title_tokens(_notes(spark, d)).select("ord", F.size("t").alias("tokens"))


def title_pairs(spark, d):
    return nt.similar_titles(_notes(spark, d), 0.6)


def merge_winners(spark, d):
    n = _notes(spark, d)
    return nt.winners(nt.similar_titles(n, 0.6), n)


def merges_applied(spark, d):
    n = _notes(spark, d)
    return nt.apply_merges(n, nt.merges(nt.winners(nt.similar_titles(n, 0.6), n)))


def file_matches(spark, d):
    files = table(spark, d, "raw_sources").select(F.col("source_filename").alias("name")).filter("name is not null")
    return nt.match_files(_src(spark, d).select("slug"), files)


def section_counts(spark, d):
    return nt.section_counts(nt.validated(_notes(spark, d)))


QUERIES = {f.__name__: f for f in (note_validation, ground_citations, ungroundable, drop_stats, slug_folds, slug_fold_roots, alias_resolution, related_symmetric, note_merge, note_citations,
                                   token_sets, title_pairs, merge_winners, merges_applied, file_matches, section_counts)}

_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}+', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"replace(lower({_strip(x)}), 'ß', 'ss')"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


_N = """n as (select ord, any_value(vault) vault, any_value(type) type, any_value(slug) slug, any_value(title) title, any_value(description) description, any_value(tags) tags, any_value(aliases) aliases,
  any_value(confidence) confidence, any_value(status) status, any_value(body) body, any_value(related) related, any_value(citations) citations from notes where ord is not null group by ord)"""
_CANON = "case lower(type) " + " ".join(f"when '{k.lower()}' then '{k}'" for k in nt.SECTIONS) + " end"
_G = f"""s0 as (select slug, any_value(raw) x, any_value(page_offset) page_offset from raw_sources where slug is not null group by slug),
s as (select slug, page_offset, {nfkc_folded("x")} raw from s0),
sn as (select slug, page_offset, {_squeeze("raw")} nrm, raw from s),
c as (select ord, generate_subscripts(citations, 1) - 1 pos, unnest(citations) c from n),
cq as (select x, {_squeeze(nfkc_folded("x"))} q from (select distinct c.quote x from c)),
g0 as (select ord, pos, c.source as source, c.chapter as chapter, c.quote as quote, page_offset, raw, nullif(case when q <> '' then instr(nrm, q) end, 0) as at_ from c left join cq on cq.x = c.quote left join sn on sn.slug = c.source where c is not null),
pg as (select slug, generate_subscripts(x, 1) p, {_squeeze("unnest(x)")} t from (select slug, string_split(raw, chr(12)) x from s)),
ps as (select slug, p, t, 1 + coalesce(sum(case when t = '' then 0 else len(t) + 1 end) over (partition by slug order by p rows between unbounded preceding and 1 preceding), 0) st from pg),
g as (select g0.ord, g0.pos, g0.source, g0.chapter, g0.quote, at_, page_offset, (select max(p) from ps where ps.slug = g0.source and t <> '' and st <= at_) as page from g0),
gr as (select ord, cast(pos as int) pos, source, chapter, quote, at_ as "at", cast(page as int) page, case when page is null then null when page_offset is null then page || ' (pdf)' else cast(greatest(1, page - page_offset) as varchar) end folio from g)"""
_EDGES = """singular as (select a.slug, b.slug target from sl a join sl b on a.slug = b.slug || 's'),
exp as (select array_to_string(list_transform(list_filter(string_split(slug, '-'), lambda x: x <> ''), lambda x: x[1]), '') slug, min(slug) target from sl where contains(slug, '-') group by 1),
e as (select sl.slug, coalesce(singular.target, case when not contains(sl.slug, '-') and len(sl.slug) >= 2 then exp.target end) target from sl left join singular on singular.slug = sl.slug left join exp on exp.slug = sl.slug),
ed as (select * from e where target is not null and target <> slug)"""
_SLUGS = f"""sl as (select distinct slug from (select {_key("slug")} slug from notes union all select {_key("p_name")} from part union all select {_key("p_name")} || 's' from part
  union all select array_to_string(list_transform(list_filter(string_split({_key("p_name")}, '-'), lambda x: x <> ''), lambda x: x[1]), '') from part) where slug <> '')"""
_ROOTS = """walk as (select slug, target cur, 1 k from ed union all select walk.slug, ed.target, k + 1 from walk join ed on ed.slug = walk.cur where k < 30),
roots as (select slug, arg_max(cur, k) root from walk group by slug)"""
_IDX = f"""nm as (select vault, slug, ord, 0 prio, slug as name from n where slug is not null union all select vault, slug, ord, 1, unnest(aliases) from n where slug is not null),
idx as (select vault, {_fold("name")} k, arg_min(slug, row(prio, ord)) slug from nm where {_fold("name")} <> '' group by all)"""
_STOP = ", ".join(f"'{x}'" for x in nt.TITLE_STOP)
_TOK = f"""t as (select vault, ord, slug, coalesce(len(body), 0) bl, list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[a-z0-9]+'), lambda x: len(x) >= 3 and x not in ({_STOP}))) t from n)"""
_PAIRS = f"""{_TOK}, x as (select vault, ord, slug, bl, len(t) n, unnest(t) x from t),
pr as (select a.vault, a.ord ord_a, b.ord ord_b, a.slug sa, b.slug sb, a.bl la, b.bl lb, count(*) / (a.n + b.n - count(*)) similarity from x a join x b on a.vault = b.vault and a.x = b.x and a.ord < b.ord and a.slug <> b.slug group by a.vault, a.ord, b.ord, a.slug, b.slug, a.bl, b.bl, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.6 - 1e-12)"""
_WON = f"{_PAIRS}, w as (select vault, ord_a, ord_b, case when la > lb or (la = lb and sa < sb) then sa else sb end winner, case when la > lb or (la = lb and sa < sb) then sb else sa end loser from pr)"
_FSTOP = ", ".join(f"'{x}'" for x in nt.FILE_STOP)


def _ftok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda x: len(x) >= 3 and x not in ({_FSTOP}))"


_SAFE = _strip("{}")
ORACLE = {
    "note_validation": f"""with {_N}, v as (select *, {_CANON} ct, coalesce(nullif(confidence, ''), 'medium') cf, coalesce(nullif(status, ''), 'established') st from n)
        select ord, ct canonical_type, cf confidence, st status, array_to_string(list_filter([case when ct is null then 'type' end, case when not coalesce(regexp_full_match(slug, '[a-z0-9]+(?:-[a-z0-9]+)*'), false) then 'slug' end,
        case when coalesce({_strip("title")}, '') = '' then 'title' end, case when coalesce({_strip("description")}, '') = '' then 'description' end, case when coalesce({_strip("body")}, '') = '' then 'body' end,
        case when cf not in ('low', 'medium', 'high') then 'confidence' end, case when st not in ('established', 'contested', 'insufficient') then 'status' end, case when coalesce(len(citations), 0) < 1 then 'citations' end,
        case when len(list_filter(citations, lambda c: c.chapter is null or coalesce({_strip("c.quote")}, '') = '')) > 0 then 'citation' end], lambda x: x is not null), ',') errors from v""",
    "ground_citations": f'with {_N}, {_G} select ord, pos, "at", page, folio from gr',
    "ungroundable": f'with {_N}, {_G} select source, count(*) citations from gr where "at" is null group by source',
    "drop_stats": f"""with {_N}, {_G}, p as (select n.ord, count("at") kept, count(gr.ord) al from n left join gr on gr.ord = n.ord group by n.ord)
        select cast(sum(al - kept) as bigint) citations_dropped, count(*) filter (kept = 0) notes_dropped from p""",
    "slug_folds": f"with {_SLUGS}, {_EDGES} select slug, target from ed",
    "slug_fold_roots": f"with recursive {_SLUGS}, {_EDGES}, {_ROOTS} select slug, root from roots where slug <> root",
    "alias_resolution": f"with {_N}, {_IDX} select vault, k as key, slug from idx",
    "related_symmetric": f"""with {_N}, {_IDX}, r as (select vault, slug src, unnest(related) as ref from n where slug is not null), l as (select r.vault, r.src, idx.slug dst from r join idx on idx.vault = r.vault and idx.k = {_fold("ref")} where r.src <> idx.slug)
        select vault, src, dst from l union select vault, dst, src from l""",
    "token_sets": f"with {_N}, {_TOK} select ord, cast(len(t) as int) tokens from t",
    "title_pairs": f"with {_N}, {_PAIRS} select vault, ord_a, ord_b, similarity from pr",
    "merge_winners": f"with {_N}, {_WON} select * from w",
    "merges_applied": f"""with {_N}, {_WON}, m as (select vault, loser, arg_max(winner, row(ord_a, ord_b)) winner from w group by all)
        select ord, n.vault, coalesce(winner, slug) slug, case when winner is not null then list_sort(list_distinct(list_append(coalesce(aliases, []), slug))) else aliases end aliases from n left join m on m.vault = n.vault and m.loser = n.slug""",
    "file_matches": f"""with sl as (select distinct slug, {_ftok("slug")} t from raw_sources where slug is not null), f as (select distinct source_filename as name, {_ftok("source_filename")} ft from raw_sources where source_filename is not null),
        x as (select slug, len(t) n, unnest(t) x from sl), y as (select distinct name, unnest(ft) x from f), sc as (select slug, name, count(*) / any_value(n) score from x join y using (x) group by all),
        b as (select slug, max(score) top from sc group by slug), k as (select slug, top, count(*) ties, max(name) as name from sc join b using (slug) where score = top group by all)
        select sl.slug, case when top >= 0.6 and ties = 1 then name end source, round(coalesce(top, 0), 3) score, coalesce(top >= 0.6 and ties > 1, false) ambiguous from sl left join k using (slug)""",
    "section_counts": f"with {_N} select section, count(ord) notes from (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in nt.SECTIONS.items())}) t(ct, section) left join n on {_CANON} = t.ct group by section",
    "note_citations": f"""with recursive {_N}, {_G}, sl as (select distinct slug from n where slug is not null), {_EDGES}, {_ROOTS},
        m as (select gr.*, n.vault, coalesce(roots.root, n.slug) canonical, dense_rank() over (partition by n.vault, coalesce(roots.root, n.slug) order by n.ord) rn from n join gr on gr.ord = n.ord and gr."at" is not null left join roots on roots.slug = n.slug),
        f as (select *, min(row(rn, pos)) over (partition by vault, canonical, source, chapter, quote, folio) first from m)
        select vault, canonical slug, cast(row_number() over (partition by vault, canonical order by rn, pos) as int) number, source, chapter, quote, folio from f where rn = 1 or row(rn, pos) = first""",
    "note_merge": f"""with recursive {_N}, {_G}, sl as (select distinct slug from n where slug is not null), {_EDGES}, {_ROOTS},
        k as (select ord, list(row(source, chapter, quote) order by pos) g from gr where "at" is not null group by ord),
        m as (select n.*, coalesce(roots.root, n.slug) canonical, g, row_number() over (partition by vault, coalesce(roots.root, n.slug) order by n.ord) rn from n join k using (ord) left join roots on roots.slug = n.slug),
        al as (select vault, canonical, rn, unnest(list_concat(coalesce(aliases, []), case when slug <> canonical then [slug] else [] end)) a, generate_subscripts(list_concat(coalesce(aliases, []), case when slug <> canonical then [slug] else [] end), 1) i from m),
        tg as (select vault, canonical, rn, unnest(tags) a, generate_subscripts(tags, 1) i from m),
        ct as (select vault, canonical, rn, unnest(g) a, generate_subscripts(g, 1) i from m),
        ida as (select vault, canonical, coalesce(max(case when slug = canonical and rn > 1 then rn end), 1) pick, count(*) occ, arg_max(body, row(coalesce(len(body), -1), -ord)) body from m group by all)
        select m.vault, m.canonical slug, m.type, m.title, m.description, m.confidence, m.status, ida.body,
        coalesce((select list(a order by rn, i) from (select rn, i, a, min(row(rn, i)) over (partition by a) f from tg where tg.vault = m.vault and tg.canonical = m.canonical) where rn = 1 or row(rn, i) = f), []) tags,
        coalesce((select list(a order by rn, i) from (select rn, i, a, min(row(rn, i)) over (partition by a) f from al where al.vault = m.vault and al.canonical = m.canonical) where rn = 1 or row(rn, i) = f), []) aliases,
        cast((select count(*) from (select rn, i, a, min(row(rn, i)) over (partition by a) f from ct where ct.vault = m.vault and ct.canonical = m.canonical) where rn = 1 or row(rn, i) = f) as int) citations,
        coalesce((select list_sort(list_distinct(flatten(list(related)))) from m r where r.vault = m.vault and r.canonical = m.canonical), []) related,
        occ occurrences, occ > 1 as merged from m join ida on ida.vault = m.vault and ida.canonical = m.canonical and ida.pick = m.rn""",
}
