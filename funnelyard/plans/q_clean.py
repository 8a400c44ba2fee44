"""Registered profiling and cleaning queries (B1-B5, B8, B10) on the dirty view C."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelyard.operators import clean as Cl
from funnelyard.operators import ingest as A
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.sources import bindings as B

C_COLS = ("row_number", "name", "email", "segment", "amount")


def _c(spark, sf_dir):
    return B.dirty_records(spark, sf_dir)


def _h(n, d):
    return f"(case when {d} = 0 then 0 else sign({n}) * ((abs({n}) * 20000 + {d}) // (2 * {d})) end)"


# ---------------------------------------------------------------- B1
_B1 = with_views(f"""
select rows, 5 as columns, missing_values, duplicate_rows, cast(mh as double) / 100 as missing_percentage,
  cast(dh as double) / 100 as duplicate_percentage, cast(greatest(0, 10000 - mh - dh) as double) / 100 as quality_score,
  sample_rows
from (select *, {_h('missing_values', 'rows * 5')} as mh, {_h('duplicate_rows', 'rows')} as dh from (
  select cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as duplicate_rows, cast(sum(m) as bigint) as missing_values
  from (select count(*) as n, sum(m0) as m from (select *, (row_number is null)::int + (name is null)::int +
        (email is null)::int + (segment is null)::int + (amount is null)::int as m0 from C) z
        group by row_number, name, email, segment, amount) g) s) t,
(select list(j order by row_number) as sample_rows from (select row_number, to_json(struct_pack(row_number := row_number,
   name := name, email := email, segment := segment, amount := amount))::varchar as j from C order by row_number limit 5) q) smp
""", "C")


@register("profile_table", _B1)
def q_profile_table(spark, sf_dir):
    return Cl.profile_table(_c(spark, sf_dir), ["row_number"])


# ---------------------------------------------------------------- B2
@register("profile_columns", with_views("\nunion all\n".join(
    f"select {i} as position, '{c}' as name, '{t}' as dtype, count(*) filter (where {c} is null) as missing, "
    f"count(distinct cast({c} as varchar)) as unique_values from C"
    for i, (c, t) in enumerate(zip(C_COLS, ("bigint", "string", "string", "string", "string")))), "C"))
def q_profile_columns(spark, sf_dir):
    return Cl.profile_columns(_c(spark, sf_dir))


# ---------------------------------------------------------------- B3
@register("null_token_count", with_views("\nunion all\n".join(
    f"select {i} as position, '{c}' as name, count(*) filter (where {c} is null or lower(trim(cast({c} as varchar))) "
    "in ('', 'nan', 'null', 'none', 'n/a')) as missing from C" for i, c in enumerate(C_COLS)), "C"))
def q_null_token_count(spark, sf_dir):
    return Cl.count_null_tokens(_c(spark, sf_dir))


# ---------------------------------------------------------------- B4
_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _issues_sql():
    parts = []
    for c in ("name", "email", "segment", "amount"):
        s = _STRIP.format(c=c)
        miss = f"({c} is null or {s} = '')"
        parts.append(f"select row_number, 'missing_value' as type, '{c}' as column, {c} as original_value, "
                     f"null::varchar as cleaned_value, 'warning' as severity from C where {miss}")
        parts.append(f"select row_number, 'whitespace_normalized', '{c}', {c}, {s}, 'info' from C "
                     f"where not {miss} and {s} <> {c}")
        if c == "email":
            parts.append(f"select row_number, 'invalid_email', '{c}', {c}, null, 'error' from C where not {miss} "
                         f"and not regexp_matches({s}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')")
    return "\nunion all\n".join(parts)


@register("clean_issues", with_views(_issues_sql(), "C"))
def q_clean_issues(spark, sf_dir):
    return Cl.explode_issues(Cl.clean_records(_c(spark, sf_dir)))


@register("clean_records", with_views(f"""
select c.row_number, nullif({_STRIP.format(c='name')}, '') as name, nullif({_STRIP.format(c='email')}, '') as email,
  nullif({_STRIP.format(c='segment')}, '') as segment, nullif({_STRIP.format(c='amount')}, '') as amount,
  coalesce(i.n, 0)::int as issue_count, case when coalesce(i.n, 0) > 0 then 'issues_found' else 'clean' end as cleaning_status
from C c left join (select row_number, count(*) as n from iss group by 1) i using (row_number)
""", "C", extra=[("iss", _issues_sql())]))
def q_clean_records(spark, sf_dir):
    return Cl.clean_records(_c(spark, sf_dir)).drop("issues")


# ---------------------------------------------------------------- B5
@register("clean_summary", with_views("""
select (select count(*) from C) as records_processed, (select count(*) from iss)::bigint as issues_found,
  (select count(*) from C where row_number not in (select row_number from iss)) as clean_rows,
  (select count(distinct row_number) from iss) as rows_with_issues,
  (select count(*) from iss where type = 'missing_value')::bigint as missing_value,
  (select count(*) from iss where type = 'whitespace_normalized')::bigint as whitespace_normalized,
  (select count(*) from iss where type = 'invalid_email')::bigint as invalid_email
""", "C", extra=[("iss", _issues_sql())]))
def q_clean_summary(spark, sf_dir):
    return Cl.clean_summary(Cl.clean_records(_c(spark, sf_dir)))


# ---------------------------------------------------------------- B8
@register("drop_placeholders", with_views(
    "select * from C where segment is not null and lower(trim(segment)) not in ('', 'none', 'null', 'n/a', 'na', "
    "'unknown', '-', 'none/unknown', 'total', 'grand total', 'grand_total')", "C"))
def q_drop_placeholders(spark, sf_dir):
    return Cl.drop_placeholders(_c(spark, sf_dir), ["segment"])


# ---------------------------------------------------------------- B10
def _staged_by_segment(spark, sf_dir):
    c = _c(spark, sf_dir)
    ds = F.coalesce(F.nullif(F.trim("segment"), F.lit("")), F.lit("BLANK"))
    return A.stage_records(c.withColumn("_ds", ds), F.col("_ds"), ["row_number"]).select(
        "dataset_id", "row_number", "raw_data", "cleaning_status")


@register("reconcile_load", with_views("""
select s.dataset_id, s.n as staged_rows, m.n as normalised_rows, m.d as duplicate_keys,
  s.n = m.n as counts_match, s.n = m.n and m.d = 0 as may_clear
from (select ds as dataset_id, count(*) as n from st group by 1) s
join (select dataset_id, sum(k)::bigint as n, sum(k - 1)::bigint as d from (
        select dataset_id, rn, count(*) as k from (select ds as dataset_id, rn from st
          union all select ds, rn from st where ds = 'BUILDING') u group by 1, 2) g group by 1) m using (dataset_id)
""", "C", extra=[("st", "select coalesce(nullif(trim(segment), ''), 'BLANK') as ds, row_number() over "
                        "(partition by coalesce(nullif(trim(segment), ''), 'BLANK') order by row_number) as rn from C")]))
def q_reconcile_load(spark, sf_dir):
    staged = _staged_by_segment(spark, sf_dir)
    norm = A.normalise_metrics(staged, {"owner": "name", "source": "segment", "cy_leads": "amount"})
    doubled = norm.unionByName(norm.filter(F.col("dataset_id") == "BUILDING"))
    return Cl.reconcile_load(staged, doubled)
