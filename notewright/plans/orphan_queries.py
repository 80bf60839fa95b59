"""Queries of the reference check."""

from __future__ import annotations

from ..operators.orphans import vault_orphans
from ..session import table


def _run(spark, d):
    return vault_orphans(table(spark, d, "notes"), table(spark, d, "findings"), table(spark, d, "lint_categories"))


def p1_found(spark, d):
    return _run(spark, d)[0].distinct()


def p1_counts(spark, d):
    return _run(spark, d)[1]


_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_CASES = f"""
with n as (select ord, any_value(vault) vault, any_value(slug) slug, any_value(aliases) aliases, any_value(related) related,
                  min(loaded_at) loaded_at, min(deleted_at) deleted_at from notes group by ord),
p as (select vault, {_KEY.format("name")} k, loaded_at, deleted_at
      from (select vault, loaded_at, deleted_at, unnest(list_prepend(slug, coalesce(aliases, []))) as name from n)),
r as (select 'notes' table_name, ord rec_id, vault, ref, {_KEY.format("ref")} k, date_trunc('month', loaded_at) + interval 1 month e, strftime(loaded_at, '%Y-%m') period
      from (select ord, vault, loaded_at, unnest(related) as ref from n)),
f as (select 'findings' table_name, finding_id rec_id, category ref, {_KEY.format("category")} k, date_trunc('month', loaded_at) + interval 1 month e, strftime(loaded_at, '%Y-%m') period
      from (select finding_id, any_value(category) category, min(loaded_at) loaded_at from findings group by 1)),
c as (select {_KEY.format("category")} k, added_at, retired_at from lint_categories),
cases as (
select table_name, period, rec_id, ref, k, vault from r where k <> '' and not exists
  (select 1 from p where p.vault = r.vault and p.k = r.k and p.loaded_at < r.e and (p.deleted_at is null or p.deleted_at >= r.e))
union
select table_name, period, rec_id, ref, k, 'all' from f where k <> '' and not exists
  (select 1 from c where c.k = f.k and c.added_at < f.e and (c.retired_at is null or c.retired_at >= f.e)))
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
ORACLE = {
    "p1_found": _CASES + "select distinct table_name, period, cast(rec_id as bigint) rec_id, ref from cases",
    "p1_counts": _CASES + "select table_name, period, count(*) orphans, count(distinct (vault, k)) as keys from cases group by 1, 2",
}
