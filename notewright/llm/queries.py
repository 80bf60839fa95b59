"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from ..functions.unicode_sql import by_rule, compatibility, mapped
from ..session import table
from . import components, lookalike, markup, mixing, neardup, packing, repetition, splitting


def p2_found(spark, d):
    return markup.kinds_found(table(spark, d, "raw_sources")).distinct()


def p2_clean(spark, d):
    """Every source as clean text."""
    return markup.clean_sources(table(spark, d, "raw_sources"))


def p3_found(spark, d):
    g = components.note_groups(table(spark, d, "notes"), table(spark, d, "note_matches"))
    return g.filter("ord <> group_ord").select("group_ord", "ord")


def p3_groups(spark, d):
    """Every note with its group."""
    return components.note_groups(table(spark, d, "notes"), table(spark, d, "note_matches"))


def p4_found(spark, d):
    return splitting.oversized(table(spark, d, "chunks"), table(spark, d, "raw_sources"), table(spark, d, "chunk_limits"))


def p4_pieces(spark, d):
    """All pieces of all chunks, with their texts."""
    return splitting.split_chunks(table(spark, d, "chunks"), table(spark, d, "raw_sources"), table(spark, d, "chunk_limits"))


def _grounded(spark, d):
    return lookalike.grounded(table(spark, d, "notes"), table(spark, d, "raw_sources"))


def p5_found(spark, d):
    return _grounded(spark, d).filter("how = 'rewritten'").select("ord", "pos").distinct()


def p5_forms(spark, d):
    """Every citation with its quote's consistent form and whether it is found."""
    return _grounded(spark, d)


_NOTE_TEXT = ["title", "description", "body"]


def p6_found(spark, d):
    return neardup.similar_pairs(table(spark, d, "notes"), "ord", _NOTE_TEXT, 0.7).toDF("ord_a", "ord_b").distinct()


def p6_groups(spark, d):
    """Every note with its class, group and number of similar classes."""
    return neardup.similar_groups(table(spark, d, "notes"), "ord", _NOTE_TEXT, 0.7)


def _packed(spark, d):
    return packing.packed(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p7_containers(spark, d):
    """Every document's place in the containers of every spec."""
    return _packed(spark, d)


def p7_fill(spark, d):
    """How full the containers are."""
    return packing.fill_report(_packed(spark, d))


def p8_chosen(spark, d):
    """The documents of every mix with their repeats."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    """Target and actual shares of every mix."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return repetition.repetitive(table(spark, d, "documents")).distinct()


def p9_profile(spark, d):
    """All measures of every document."""
    return repetition.profile(table(spark, d, "documents"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')"

QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p6_groups": p6_groups, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_chosen": p8_chosen, "p8_shares": p8_shares, "p9_found": p9_found, "p9_profile": p9_profile}
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
#: Everything a name reaches over notes and equal names; quadratic in the size of a group, so for small tables only.
_GROUPS = f"""with recursive n as (select distinct ord, vault, {_KEY.format("name")} k from (select ord, vault, unnest(list_prepend(slug, coalesce(aliases, []))) as name from notes) where {_KEY.format("name")} <> ''),
    e0 as (select n.vault, f.k a, n.k b from n join (select ord, min(k) k from n group by ord) f using (ord) where f.k <> n.k
        union select vault, {_KEY.format("slug_a")}, {_KEY.format("slug_b")} from note_matches where same and {_KEY.format("slug_a")} <> '' and {_KEY.format("slug_b")} <> ''),
    e as (select vault, a, b from e0 union select vault, b, a from e0),
    reach as (select vault, k a, k b from (select distinct vault, k from n) union select reach.vault, reach.a, e.b from reach join e on e.vault = reach.vault and e.a = reach.b),
    g as (select n.ord, min(m.ord) g from n join reach on reach.vault = n.vault and reach.a = n.k join n m on m.vault = reach.vault and m.k = reach.b group by n.ord)"""
_HEAD = r"\f?\s*(#{1,6} .{1,90}|(?i:chapter|chapitre|kapitel|cap[íi]tulo|capitolo)\s+[0-9]+(?:[.:]?|\b.{0,89}[^.,;:\s])|[0-9]{1,2}(?:\.[0-9]{1,2})*\.?\s+[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^.;:]{1,70})\s*"
_LATER = "list_max(list_filter(b{0}, lambda x: x > s + {1} and x <= s + lim))"
_END = f"case when lim is null or wb - s <= lim then wb else coalesce({', '.join(_LATER.format(k, least) for least in ('greatest(lim // 2, ov)', 'ov') for k in (3, 2, 1))}, s + lim) end"
#: Words with their places, pieces by recursion over the boundaries of each chunk.
_PIECES = rf"""with recursive c as (select id, any_value(source) source, any_value(label) label, any_value(start_line) a, any_value(end_line) z from chunks where id is not null group by id),
    r as (select slug, any_value(raw) raw, any_value(format) format from raw_sources where slug is not null group by slug),
    f as (select format, min(max_words) lim, max(overlap_words) ov from chunk_limits group by format),
    t0 as (select slug, generate_subscripts(x, 1) i, unnest(x) t from (select slug, regexp_extract_all(raw, '[^ \t\n\r\f]+|[ \t\n\r\f]+') x from r)),
    t1 as (select *, sum(len(t)) over (partition by slug order by i) - len(t) off, 1 + sum(len(t) - len(replace(t, chr(10), ''))) over (partition by slug order by i) as line, lag(t) over (partition by slug order by i) gap from t0),
    w0 as (select *, row_number() over (partition by slug order by i) - 1 k, lag(t) over (partition by slug order by i) prev, line - lag(line) over (partition by slug order by i) nl from t1 where not regexp_matches(t, '^[ \t\n\r\f]')),
    ln as (select slug, generate_subscripts(x, 1) n, unnest(x) l from (select slug, string_split(raw, chr(10)) x from r)),
    hd as (select slug, min(k) k, any_value(trim(ltrim(trim(l, e' \t\n\r\f'), '#'), e' \t\n\r\f')) label from ln join w0 using (slug) where line = n and len(l) <= 110 and regexp_full_match(l, '{_HEAD}') group by slug, n),
    w as (select w0.slug, w0.k, t, off, line, case when hd.k is not null then 3 when prev is null then 0 when nl > 1 or contains(gap, chr(12)) then 3 when regexp_matches(prev, '([.!?…。]|[.][”")])$') then case when nl > 0 then 2 else 1 end else 0 end kind from w0 left join hd on hd.slug = w0.slug and hd.k = w0.k),
    g as (select c.id, c.source, c.label, c.a, c.z, lim, coalesce(least(ov, lim - 1), 0) ov, min(k) wa, coalesce(max(k) + 1, 0) wb, count(k) n, list(k order by k) filter (kind >= 3) b3, list(k order by k) filter (kind >= 2) b2, list(k order by k) filter (kind >= 1) b1
      from c left join r on r.slug = c.source left join f on f.format = r.format left join w on w.slug = c.source and w.line between c.a and c.z group by all),
    st as (select id, 0 piece, s, s e0, {_END} e from (select *, coalesce(wa, 0) s from g)
      union all select id, piece + 1, s, e0, {_END} from (select g.*, piece, e - ov s, e e0 from st join g using (id) where e < wb)),
    p as (select st.*, g.*, e = wb or list_contains(b1, e) nat from st join g using (id))
    select p.id, p.source, cast(n as int) chunk_words, lim max_words, piece, cast(s - coalesce(wa, 0) as int) start_word, cast(e - coalesce(wa, 0) as int) end_word, case when n = 0 then a else cast(x.line as int) end start_line, case when n = 0 then z else cast(y.line as int) end end_line,
      cast(e - s as int) words, cast(e0 - s as int) overlap, coalesce(case when n > 0 then coalesce((select max_by(label, k) from hd where hd.slug = p.source and hd.k <= s), (select min_by(label, k) from hd where hd.slug = p.source and hd.k < e)) end, nullif(trim(p.label), ''),
      'lines ' || case when n = 0 then coalesce(a::varchar, 'None') else x.line::varchar end || '-' || case when n = 0 then coalesce(z::varchar, 'None') else y.line::varchar end) label, nat "natural", case when n = 0 then '' else substring(raw, cast(x.off + 1 as bigint), cast(y.off + len(y.t) - x.off as bigint)) end as text
    from p left join w x on x.slug = p.source and x.k = s and n > 0 left join w y on y.slug = p.source and y.k = e - 1 and n > 0 left join r on r.slug = p.source"""


def _same_form(x: str) -> str:
    """:func:`lookalike.canonical` in SQL, its tables made from the operator's own character rules."""
    kept = lookalike._kept()

    def first(c: str) -> str | None:
        return "" if lookalike._IGNORABLE.match(c) else " " if lookalike._SPACES.match(c) else None if kept.match(c) else compatibility(c)

    composed = f"nfc_normalize({mapped(x, by_rule(first, 1))})"
    return f"regexp_replace(nfc_normalize({mapped(composed, lookalike.LOOKALIKES)}), '[\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"


def _squeezed(x: str) -> str:
    return f"regexp_replace({x}, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')"


_GROUNDED = f"""with q as (select distinct ord, generate_subscripts(citations, 1) - 1 pos, unnest(citations) c from notes), d as (select distinct ord, pos, c.source as source, c.quote as quote from q),
    f as (select quote, trim({_squeezed("x")}) same_quote from (select quote, {_same_form("quote")} x from (select distinct quote from d where quote is not null))),
    s as (select slug, {_squeezed("raw")} as_is, {_squeezed("x")} same from (select slug, raw, {_same_form("raw")} x from (select slug, max(raw) raw from raw_sources where slug is not null and raw is not null group by slug))),
    g as (select ord, cast(pos as int) pos, source, d.quote, same_quote, case when as_is is null or d.quote is null then 'no_source' when contains(as_is, trim({_squeezed("d.quote")})) then 'as_written' when contains(same, same_quote) then 'rewritten' else 'absent' end how
      from d left join f on f.quote = d.quote left join s on s.slug = d.source)"""
ORACLE = {
    "p5_found": _GROUNDED + " select distinct ord, pos from g where how = 'rewritten'",
    "p5_forms": _GROUNDED + " select * from g",
    "p4_pieces": _PIECES,
    "p3_found": _GROUPS + " select distinct g group_ord, ord from g where g <> ord",
    "p3_groups": _GROUPS + " select distinct notes.ord, coalesce(g.g, notes.ord) group_ord from notes left join g using (ord) where notes.ord is not null",
    "p6_found": r"""with n as (select ord, list_distinct(regexp_extract_all(lower(coalesce(any_value(title), '') || ' ' || coalesce(any_value(description), '') || ' ' || coalesce(any_value(body), '')), '[a-z0-9]+')) w from notes group by ord),
        t as (select ord, len(w) n, unnest(w) x from n),
        p as (select a.ord ord_a, b.ord ord_b, a.n na, b.n nb, count(*) c from t a join t b on a.x = b.x and a.ord < b.ord and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) group by all)
        select ord_a, ord_b from p where c >= 0.7 * (na + nb - c) - 1e-9""",
    "p6_groups": r"""with recursive n as (select ord, list_sort(list_distinct(regexp_extract_all(lower(coalesce(any_value(title), '') || ' ' || coalesce(any_value(description), '') || ' ' || coalesce(any_value(body), '')), '[a-z0-9]+'))) w from notes where ord is not null group by ord),
        c as (select w, min(ord) k from n group by w), t as (select k, len(w) n, unnest(w) x from c),
        p as (select a.k a, b.k b, a.n na, b.n nb, count(*) c from t a join t b on a.x = b.x and a.k <> b.k and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) group by all),
        e as (select a, b from p where c >= 0.7 * (na + nb - c) - 1e-9), l as (select a, count(*) links from e group by a),
        reach as (select k a, k b from c union select reach.a, e.b from reach join e on e.a = reach.b), g as (select a, min(b) g from reach group by a)
        select n.ord id, c.k class_id, g.g group_id, coalesce(links, 0) links from n join c using (w) join g on g.a = c.k left join l on l.a = c.k""",
    "p4_found": r"""with c as (select id, any_value(source) source, any_value(start_line) a, any_value(end_line) b from chunks group by id),
        r as (select slug, any_value(string_split(raw, chr(10))) l, any_value(format) format from raw_sources group by slug)
        select c.id from c join r on c.source = r.slug join chunk_limits f on f.format = r.format
        where len(list_filter(regexp_split_to_array(array_to_string(l[greatest(a, 1):b], chr(10)), '[ \t\n\r\f]+'), lambda x: x <> '')) > max_words""",
    "p9_found": f"""with w as (select doc_id, {_WORDS} w from documents where text is not null),
        s as (select doc_id, list_transform(range(1, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i:i+4], ' ')) s from w)
        select distinct doc_id from s where len(s) > 0 and 1 - len(list_distinct(s)) / len(s) > 0.25""",
}
