"""Registered metric / funnel / ranking / filter queries on the metrics view."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelyard.operators import metrics as Mx
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.plans.sqlfrag import from_h, lsum, pct, rate_h
from funnelyard.sources import bindings as B

PLACEHOLDERS = ("'', 'none', 'null', 'n/a', 'na', 'unknown', '-', 'none/unknown', "
                "'total', 'grand total', 'grand_total'")


def _real(c: str) -> str:
    return f"({c} is not null and lower(trim({c})) not in ({PLACEHOLDERS}))"


TOTALS = ", ".join(f"{lsum(f'{p}_{s}')} as {p}_{s}" for p in ("cy", "py")
                   for s in ("leads", "registration", "admission"))


# ---------------------------------------------------------------- F1
@register("metric_total", with_views(
    f"select 'admissions' as metric, 'cy_admission' as measure_column, {lsum('cy_admission')} as total_value "
    "from M where dataset_id = 'ds2026' and campus_name = 'ASIA'", "M"))
def q_metric_total(spark, sf_dir):
    return Mx.metric_total(B.metrics(spark, sf_dir), "ds2026", "admissions",
                           filters={"campus_name": "ASIA"})


@register("metric_total_previous_year", with_views(
    f"select 'leads' as metric, 'py_leads' as measure_column, {lsum('py_leads')} as total_value "
    "from M where dataset_id = 'ds2024'", "M"))
def q_metric_total_py(spark, sf_dir):
    return Mx.metric_total(B.metrics(spark, sf_dir), "ds2024", "leads", year=2023, py_year=2023)


# ---------------------------------------------------------------- F4
@register("breakdown", with_views(
    f"select main_source, source, {lsum('cy_leads')} as metric_value from M "
    f"where dataset_id = 'ds2026' and {_real('main_source')} and {_real('source')} group by all", "M"))
def q_breakdown(spark, sf_dir):
    return Mx.breakdown(B.metrics(spark, sf_dir), "ds2026", ["main_source", "source"], "leads")


@register("breakdown_blank_members", with_views(
    f"select source, state, {lsum('cy_admission')} as metric_value from MB "
    f"where dataset_id = 'ds2024' and {_real('source')} and {_real('state')} "
    "and lead_type = 'F' group by all", "MB"))
def q_breakdown_blank(spark, sf_dir):
    return Mx.breakdown(B.metrics(spark, sf_dir, blanks=True), "ds2024", ["source", "state"],
                        "admission", filters={"lead_type": "F"})


# ---------------------------------------------------------------- F5
@register("ranking_top_programs", with_views("""
select entity_name, metric_value, first(metric_value) over (order by metric_value desc, entity_name
       rows between unbounded preceding and unbounded following) <> 0 as has_value
from (select program_name as entity_name, {s} as metric_value from M
      where dataset_id = 'ds2026' and {r} group by all
      order by metric_value desc, entity_name limit 3) t
""".format(s=lsum("cy_admission"), r=_real("program_name")), "M"))
def q_ranking(spark, sf_dir):
    return Mx.ranking(B.metrics(spark, sf_dir), "ds2026", "program_name", "admissions", n=3)


@register("ranking_bottom_owners", with_views("""
select entity_name, metric_value, first(metric_value) over (order by metric_value asc, entity_name
       rows between unbounded preceding and unbounded following) <> 0 as has_value
from (select owner as entity_name, {s} as metric_value from M
      where dataset_id = 'ds2022' and {r} group by all
      order by metric_value asc, entity_name limit 5) t
""".format(s=lsum("cy_leads"), r=_real("owner")), "M"))
def q_ranking_bottom(spark, sf_dir):
    return Mx.ranking(B.metrics(spark, sf_dir), "ds2022", "owner", "leads", n=5, direction="asc")


# ---------------------------------------------------------------- F7 / D13
def _funnel_yoy_sql(year: int, cy: int) -> str:
    if year == cy:
        cur = {s: f"cy_{s}" for s in ("leads", "registration", "admission")}
        prev = {s: f"py_{s}" for s in cur}
    elif year == cy - 1:
        cur = {s: f"py_{s}" for s in ("leads", "registration", "admission")}
        prev = {s: "cast(0 as bigint)" for s in cur}
    elif year == cy + 1:
        cur = {s: "cast(0 as bigint)" for s in ("leads", "registration", "admission")}
        prev = {s: f"cy_{s}" for s in cur}
    else:
        cur = prev = {s: "cast(0 as bigint)" for s in ("leads", "registration", "admission")}
    sel = ", ".join([f"{cur[s]} as c_{s}" for s in cur] + [f"{prev[s]} as p_{s}" for s in prev])
    return with_views(f"""
select {year} as current_year, {year - 1} as previous_year,
  c_leads as cy_leads, c_registration as cy_registration, c_admission as cy_admission,
  p_leads as py_leads, p_registration as py_registration, p_admission as py_admission,
  coalesce({pct('c_registration', 'c_leads')}, 0) as lead_registration_percent,
  coalesce({pct('c_admission', 'c_leads')}, 0) as lead_admission_percent,
  coalesce({pct('c_admission', 'c_registration')}, 0) as registration_admission_percent,
  {pct('c_leads - p_leads', 'p_leads')} as leads_change_percent,
  {pct('c_registration - p_registration', 'p_registration')} as registration_change_percent,
  {pct('c_admission - p_admission', 'p_admission')} as admission_change_percent
from (select {sel} from t) x
""", "M", extra=[("t", f"select {TOTALS} from M where dataset_id = 'ds{cy}'")])


for _yr in (2026, 2025, 2027):
    def _mk(yr):
        def q(spark, sf_dir):
            return Mx.funnel_yoy_metrics(B.metrics(spark, sf_dir), "ds2026", yr, 2026, 2025)
        return q
    register(f"funnel_yoy_metrics_{_yr}", _funnel_yoy_sql(_yr, 2026))(_mk(_yr))


# ---------------------------------------------------------------- F8
@register("stage_funnel", with_views(f"""
select * from (
  select 1 as stage_order, 'Leads' as stage, cy_leads as count, 100.0::double as pct_of_leads,
         100.0::double as conversion_rate from t
  union all
  select 2, 'Registration', cy_registration, {from_h(rate_h('cy_registration', 'cy_leads'))},
         {from_h(rate_h('cy_registration', 'cy_leads'))} from t
  where cy_registration > 0 or py_registration > 0
  union all
  select 3, 'Admissions', cy_admission, {from_h(rate_h('cy_admission', 'cy_leads'))},
         case when cy_registration > 0 or py_registration > 0
              then {from_h(rate_h('cy_admission', 'cy_registration'))}
              else {from_h(rate_h('cy_admission', 'cy_leads'))} end from t) s
""", "M", extra=[("t", f"select {TOTALS} from M where dataset_id = 'ds2026' and lower(state) = lower('nation_7')")]))
def q_stage_funnel(spark, sf_dir):
    return Mx.stage_funnel(B.metrics(spark, sf_dir), "ds2026", {"state": "nation_7", "campus": "all"})


# ---------------------------------------------------------------- F9
def _kpi_sql(where: str, kpis: tuple[str, ...] | None = None) -> str:
    def count_kpi(name, c, p):
        return (f"select '{name}' as kpi, cast({c} as double) as cy, cast({p} as double) as py, "
                f"cast({c} - {p} as double) as change, {pct(f'{c} - {p}', p)} as growth_pct from t")

    def rate_kpi(name, n1, d1, n0, d0, cond="true"):
        c, p = rate_h(n1, d1), rate_h(n0, d0)
        return (f"select '{name}', {from_h(c)}, {from_h(p)}, {from_h(f'({c}) - ({p})')}, "
                f"{pct(f'({c}) - ({p})', p)} from t where {cond}")
    has_reg = "(cy_registration > 0 or py_registration > 0)"
    parts = [count_kpi("leads", "cy_leads", "py_leads"),
             count_kpi("admissions", "cy_admission", "py_admission"),
             rate_kpi("conversion_rate", "cy_admission", "cy_leads", "py_admission", "py_leads"),
             count_kpi("registration", "cy_registration", "py_registration") + f" where {has_reg}",
             rate_kpi("registration_conversion_rate", "cy_admission", "cy_registration",
                      "py_admission", "py_registration", has_reg)]
    body = "\nunion all\n".join(parts)
    if kpis:
        body = f"select * from ({body}) k where kpi in ({', '.join(repr(x) for x in kpis)})"
    return with_views(body, "M", extra=[("t", f"select {TOTALS} from M where {where}")])


@register("kpi_overview", _kpi_sql("dataset_id = 'ds2026'"))
def q_kpi_overview(spark, sf_dir):
    return Mx.kpi_overview(B.metrics(spark, sf_dir), "ds2026")


@register("kpi_overview_filtered", _kpi_sql(
    "dataset_id = 'ds2024' and lower(campus_name) = 'europe' and lower(source) = 'machinery'"))
def q_kpi_overview_filtered(spark, sf_dir):
    return Mx.kpi_overview(B.metrics(spark, sf_dir), "ds2024",
                           {"campus": "Europe", "source": " machinery ", "program": ""})


# ---------------------------------------------------------------- F17
def _winner(rid, dim, key, direction, cond_having="true", test="cy_admission"):
    order = f"{key} {'desc' if direction == 'desc' else 'asc'}, member asc"
    positive = {"cy_leads": "leads > 0", "cy_admission": "admissions > 0",
                "gain": "admission_change > 0", "loss": "admission_change < 0"}[test]
    return f"""
select * from (select '{rid}' as insight_id, '{dim}' as dimension, member, cy_leads as leads,
       cy_admission as admissions, cy_admission - py_admission as admission_change,
       coalesce({pct('cy_admission', 'cy_leads')}, 0) as conversion_rate
  from facts where dimension = '{dim}' and {cond_having} order by {order} limit 1) w
where {positive}"""


@register("insight_winners", with_views(
    "\nunion all\n".join([
        _winner("highest_lead_source", "source", "cy_leads", "desc", test="cy_leads"),
        _winner("highest_admission_program", "program_name", "cy_admission", "desc"),
        _winner("best_performing_program", "program_name",
                "cast(cy_admission as double) / cy_leads", "desc", "cy_leads >= 10", "cy_leads"),
        _winner("biggest_admission_improvement", "program_name", "cy_admission - py_admission",
                "desc", test="gain"),
        _winner("biggest_admission_decline", "program_name", "cy_admission - py_admission",
                "asc", test="loss"),
        _winner("strongest_state", "state", "cy_admission", "desc"),
        _winner("strongest_campus", "campus_name", "cy_admission", "desc"),
        _winner("best_counsellor", "owner", "cy_admission", "desc"),
    ]), "M", extra=[("facts", "\nunion all\n".join(
        f"select '{d}' as dimension, {d} as member, {lsum('cy_leads')} as cy_leads, "
        f"{lsum('cy_admission')} as cy_admission, {lsum('py_admission')} as py_admission "
        f"from M where dataset_id = 'ds2026' and {d} is not null and {d} <> '' group by {d}"
        for d in ("source", "program_name", "state", "campus_name", "owner")))]))
def q_insight_winners(spark, sf_dir):
    return Mx.insight_winners(B.metrics(spark, sf_dir), "ds2026")


# ---------------------------------------------------------------- F18
def _facts_sql(ds, dims, where="true"):
    return "\nunion all\n".join(
        f"select '{d}' as dimension, {d} as member, {lsum('cy_leads')} as cy_leads, "
        f"{lsum('cy_admission')} as cy_admission from M where dataset_id = '{ds}' and {where} "
        f"and {d} is not null and {d} <> '' group by {d}" for d in dims)


@register("top_performers_leads", with_views("""
select dimension, rank, member as entity, cast(cy_leads as double) as value, cy_admission as admissions,
       cy_leads as leads
from (select *, row_number() over (partition by dimension order by cy_leads desc, member asc) as rank
      from facts) x where rank <= 5
""", "M", extra=[("facts", _facts_sql("ds2026", Mx.DASHBOARD_DIMENSIONS))]))
def q_top_performers_leads(spark, sf_dir):
    return Mx.top_performers(B.metrics(spark, sf_dir), "ds2026", "leads", 5)


@register("top_performers_conversion", with_views(f"""
select dimension, rank, member as entity, coalesce({pct('cy_admission', 'cy_leads')}, 0) as value,
       cy_admission as admissions, cy_leads as leads
from (select *, row_number() over (partition by dimension
        order by cast(cy_admission as double) / cy_leads desc, member asc) as rank
      from facts where cy_leads >= 50) x where rank <= 5
""", "M", extra=[("facts", _facts_sql("ds2024", Mx.DASHBOARD_DIMENSIONS))]))
def q_top_performers_conversion(spark, sf_dir):
    return Mx.top_performers(B.metrics(spark, sf_dir), "ds2024", "conversion_rate", 5)


# ---------------------------------------------------------------- F19
@register("top_members", with_views(
    f"select program_name as member, {lsum('cy_admission')} as admissions from M "
    f"where dataset_id = 'ds2026' and {_real('program_name')} group by 1 "
    "order by admissions desc, member limit 3", "M"))
def q_top_members(spark, sf_dir):
    return Mx.top_members(B.metrics(spark, sf_dir), "ds2026", "program_name", 3)


# ---------------------------------------------------------------- F20
@register("entity_overview", _kpi_sql("dataset_id = 'ds2026' and lower(campus_name) = 'asia'",
                                     ("leads", "admissions", "conversion_rate")))
def q_entity_overview(spark, sf_dir):
    return Mx.entity_overview(B.metrics(spark, sf_dir), "ds2026", "campus_name", "Asia")


@register("entity_breakdowns", with_views(f"""
select dimension, rank, member as entity, cy_leads as leads, cy_admission as admissions,
       coalesce({pct('cy_admission', 'cy_leads')}, 0) as conversion_rate
from (select *, row_number() over (partition by dimension
        order by cy_admission desc, cy_leads desc, member asc) as rank from facts) x
where rank <= 10
""", "M", extra=[("facts", _facts_sql("ds2026", ("source", "state", "owner"),
                                      "lower(campus_name) = 'asia'"))]))
def q_entity_breakdowns(spark, sf_dir):
    return Mx.entity_breakdowns(B.metrics(spark, sf_dir), "ds2026", "campus_name", "Asia")


# ---------------------------------------------------------------- F21
@register("regroup_source", with_views(
    f"select coalesce(main_source, source) as source, {lsum('cy_leads')} as leads, "
    f"{lsum('cy_admission')} as admission from M where dataset_id = 'ds2024' and "
    "(lower(main_source) in ('3-medium', 'building') or lower(source) in ('3-medium', 'building')) "
    "group by 1", "M"))
def q_regroup_source(spark, sf_dir):
    return Mx.regroup_source(B.metrics(spark, sf_dir), "ds2024", ["3-MEDIUM", "Building"])


# ---------------------------------------------------------------- F22
def _season_sql() -> str:
    rows = []
    n = len(Mx.SEASON_MONTHS)
    for i, name in enumerate(Mx.SEASON_MONTHS):
        cols = []
        for p in ("cy", "py"):
            for s, w in (("leads", Mx.SEASON_LEAD_W), ("registration", Mx.SEASON_REG_W),
                         ("admission", Mx.SEASON_ADM_W)):
                if i < n - 1:
                    cols.append(f"({p}_{s} * {w[i]}) // 100")
                else:
                    cols.append(f"{p}_{s} - (" + " + ".join(
                        f"({p}_{s} * {w[j]}) // 100" for j in range(n - 1)) + ")")
        names = [f"{p}_{s}" for p in ("cy", "py") for s in ("leads", "registration", "admission")]
        sel = ", ".join(f"cast({c} as bigint) as {nm}" for c, nm in zip(cols, names))
        rows.append(f"select {i + 1} as month_order, '{name}' as month, {sel} from t")
    body = "\nunion all\n".join(rows)
    return with_views(f"""
select *, coalesce({pct('cy_admission', 'cy_leads')}, 0) as cy_conversion_rate,
       coalesce({pct('py_admission', 'py_leads')}, 0) as py_conversion_rate from ({body}) s
""", "M", extra=[("t", f"select {TOTALS} from M where dataset_id = 'ds2026'")])


@register("seasonal_allocation", _season_sql())
def q_seasonal_allocation(spark, sf_dir):
    return Mx.seasonal_allocation(B.metrics(spark, sf_dir), "ds2026")


# ---------------------------------------------------------------- E7
@register("filter_options", with_views("""
select dimension, value, position from (
  select dimension, value, row_number() over (partition by dimension order by value) as position
  from (select distinct dimension, value from (
    {u}) a where value is not null) d) x where position <= 20
""".format(u="\nunion all\n".join(
    f"select '{d}' as dimension, nullif(trim({d}, ' '), '') as value from M "
    "where dataset_id in ('ds2024', 'ds2026')" for d in B.DIMENSIONS)), "M"))
def q_filter_options(spark, sf_dir):
    return Mx.filter_options(B.metrics(spark, sf_dir), ["ds2024", "ds2026"], B.DIMENSIONS, cap=20)


# ---------------------------------------------------------------- E8
@register("dimension_presence", with_views("\nunion all\n".join(
    f"select '{d}' as dimension, coalesce(max(case when {d} is not null and {d} <> '' then 1 else 0 end), 0) = 1 "
    "as present from MB where dataset_id = 'ds2022'" for d in B.DIMENSIONS), "MB"))
def q_dimension_presence(spark, sf_dir):
    return Mx.dimension_presence(B.metrics(spark, sf_dir, blanks=True), "ds2022")


# ---------------------------------------------------------------- E9 (+F19)
@register("restrict_to_top_programs", with_views(
    f"select program_name, state, {lsum('cy_leads')} as leads from M where dataset_id = 'ds2026' "
    "and program_name in (select member from top3) group by all", "M",
    extra=[("top3", f"select program_name as member, {lsum('cy_admission')} as a from M "
                    f"where dataset_id = 'ds2026' and {_real('program_name')} group by 1 "
                    "order by a desc, member limit 3")]))
def q_restrict_to(spark, sf_dir):
    m = B.metrics(spark, sf_dir)
    top = Mx.top_members(m, "ds2026", "program_name", 3)
    rows = Mx.restrict_to(Mx.for_dataset(m, "ds2026"), "program_name", top)
    return rows.groupBy("program_name", "state").agg(
        F.coalesce(F.sum("cy_leads"), F.lit(0)).cast("long").alias("leads"))



# ---------------------------------------------------------------- B7 / B9 / E1 / E2 / E4-E6 (explicit)
from funnelyard.functions.core import blank_label  # noqa: E402
from funnelyard.operators import compare as Cmp  # noqa: E402
from funnelyard.operators.funnel import norm_level  # noqa: E402
from funnelyard.plans.sqlfrag import blank  # noqa: E402


@register("blank_label_members", with_views(
    f"select {blank('source')} as source_label, {blank('state')} as state_label, count(*) as rows "
    "from MB where dataset_id = 'ds2024' group by all", "MB"))
def q_blank_label(spark, sf_dir):
    m = B.metrics(spark, sf_dir, blanks=True)
    return (Mx.for_dataset(m, "ds2024").groupBy(blank_label("source").alias("source_label"),
                                                 blank_label("state").alias("state_label"))
            .agg(F.count(F.lit(1)).alias("rows")))


def _lvl(c, level):
    from funnelyard.plans.q_funnel import _lvl_sql
    return _lvl_sql(c, level)


@register("hierarchy_labels", with_views(
    f"select {_lvl('lead_type', 1)} as l1, {_lvl('source', 2)} as l2, {_lvl('main_source', 3)} as l3, "
    "count(*) as rows from MB where dataset_id = 'ds2026' group by all", "MB"))
def q_hierarchy_labels(spark, sf_dir):
    m = B.metrics(spark, sf_dir, blanks=True)
    return (Mx.for_dataset(m, "ds2026").groupBy(norm_level("lead_type", 1).alias("l1"),
                                                 norm_level("source", 2).alias("l2"),
                                                 norm_level("main_source", 3).alias("l3"))
            .agg(F.count(F.lit(1)).alias("rows")))


@register("member_filter", with_views(
    f"select program_name, {lsum('cy_leads')} as leads from M where dataset_id = 'ds2026' "
    "and lower(campus_name) = 'asia' group by 1", "M"))
def q_member_filter(spark, sf_dir):
    d = Mx.member_filter(Mx.for_dataset(B.metrics(spark, sf_dir), "ds2026"),
                         {"campus": "asia", "state": "ALL", "source": "  "}, Mx.DASHBOARD_FILTERS)
    return d.groupBy("program_name").agg(F.coalesce(F.sum("cy_leads"), F.lit(0)).cast("long").alias("leads"))


@register("member_filter_blank", with_views(
    f"select source, {lsum('cy_leads')} as leads from MB where dataset_id = 'ds2024' "
    f"and lower({blank('state')}) = 'unspecified' group by 1", "MB"))
def q_member_filter_blank(spark, sf_dir):
    d = Mx.member_filter(Mx.for_dataset(B.metrics(spark, sf_dir, blanks=True), "ds2024"),
                         {"state": "unspecified"}, blank="Unspecified")
    return d.groupBy("source").agg(F.coalesce(F.sum("cy_leads"), F.lit(0)).cast("long").alias("leads"))


@register("change_filter_increased", with_views(
    "select * from ws where absolute_change > 0", extra=[("ws", "select * from (" + __import__(
        "funnelyard.plans.q_compare", fromlist=["_WS"])._WS + ") w")]))
def q_change_filter(spark, sf_dir):
    ws = Cmp.period_workspace(B.metrics(spark, sf_dir), Cmp.PeriodRef("ds2022"), Cmp.PeriodRef("ds2024"))
    return Cmp.change_filter(ws, "increased", "absolute_change")


def _yoy_state_sql(where: str) -> str:
    from funnelyard.plans.q_compare import _member_yoy_cte
    return with_views(where, "M", extra=[("c", _member_yoy_cte("M", "ds2026", "state"))])


@register("direction_filter", _yoy_state_sql("""
select * from c where case when (select count(*) from c where rate_change > 0) > 0 then rate_change > 0
  when (select count(*) from c where admission_change > 0) > 0 then admission_change > 0 else true end"""))
def q_direction_filter(spark, sf_dir):
    return Mx.direction_filter(Cmp.member_yoy(B.metrics(spark, sf_dir), "ds2026", "state"), "increase")


@register("contains_filter_fallback", _yoy_state_sql("""
select * from c where contains(lower(member), 'zzz') or (select count(*) from c where contains(lower(member), 'zzz')) = 0"""))
def q_contains_filter(spark, sf_dir):
    return Mx.contains_filter(Cmp.member_yoy(B.metrics(spark, sf_dir), "ds2026", "state"), "member", "ZZZ")
