"""Registered event-funnel and source-performance queries."""

from __future__ import annotations

import datetime as dt

from funnelyard.operators import funnel as Fn
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.plans.sqlfrag import lsum, pct, pct_h, rate_h
from funnelyard.sources import bindings as B

E_VIEWS = ("E_leads", "E_reg", "E_adm")


def _rng(col: str, y0: int, y1: int) -> str:
    return f"{col} >= date '{y0}-01-01' and {col} < date '{y1 + 1}-01-01'"


def _pct(n, d, zero="null"):
    p = pct(n, d)
    return f"coalesce({p}, 0.0)" if zero == "zero" else p


# ---------------------------------------------------------------- E3
@register("year_filter_previous_year", with_views(
    f"select lead_id, event_date from E_adm where {_rng('event_date', 1997, 1997)}", "E_adm"))
def q_year_filter(spark, sf_dir):
    return Fn.year_filter(B.admission_events(spark, sf_dir), "event_date", when="previous_year",
                          today=dt.date(1998, 3, 15))


# ---------------------------------------------------------------- F2
@register("event_metric_leads", with_views(
    f"select main_source, source, count(lead_id) as metric_value from E_leads "
    f"where {_rng('event_date', 1996, 1996)} and source = 'MACHINERY' group by all", "E_leads"))
def q_event_metric_leads(spark, sf_dir):
    return Fn.event_metric(B.events(spark, sf_dir), "leads", ["main_source", "source"], 1996,
                           {"source": "MACHINERY"})


@register("event_metric_admission_total", with_views(
    f"select count(lead_id) as metric_value from E_adm where {_rng('event_date', 1997, 1997)}", "E_adm"))
def q_event_metric_adm(spark, sf_dir):
    return Fn.event_metric(B.events(spark, sf_dir), "admission", [], 1997)


def _by_dimension(metric, dims, year, filters):
    where = "".join(f" and {c} = '{v}'" for c, v in filters.items())
    sql = with_views(f"select {', '.join(dims)}, count(lead_id) as metric_value from E_{metric}_dims "
                     f"where {_rng('event_date', year, year)}{where} group by all", f"E_{metric}_dims")

    def q(spark, sf_dir):
        return Fn.event_metric(B.events_by_dimension(spark, sf_dir), metric, dims, year, filters)
    return sql, q


for _query, _args in {
    "event_metric_leads_by_program": ("leads", ["program_name", "campus_name", "lead_type"], 1996, {"state": "NATION_3"}),
    "event_metric_leads_by_cluster": ("leads", ["cluster", "state"], 1997, {}),
    "event_metric_registration_by_campus": ("registration", ["campus_name", "program_name"], 1997, {}),
    "event_metric_admission_by_state": ("admission", ["state", "cluster", "admission_status"], 1997, {"campus_name": "ASIA"}),
}.items():
    _sql, _fn = _by_dimension(*_args)
    register(_query, _sql)(_fn)


# ---------------------------------------------------------------- F3
for _name, (_num, _den) in Fn.DERIVED_RATES.items():
    _v = {"leads": "E_leads", "registration": "E_reg", "admission": "E_adm"}

    def _mk(name):
        def q(spark, sf_dir):
            return Fn.derived_rate(B.events(spark, sf_dir), name, 1996)
        return q
    register(f"derived_{_name}", with_views(
        f"select '{_name}' as metric, n.c as numerator, d.c as denominator, {pct('n.c', 'd.c')} as metric_value "
        f"from (select count(lead_id) as c from {_v[_num]} where {_rng('event_date', 1996, 1996)}) n, "
        f"(select count(lead_id) as c from {_v[_den]} where {_rng('event_date', 1996, 1996)}) d",
        _v[_num], _v[_den]))(_mk(_name))


# ---------------------------------------------------------------- F6
def _funnel_yoy_sql(y):
    def cnt(v, yr):
        return f"(select count(lead_id) from {v} where {_rng('event_date', yr, yr)})"
    return with_views(f"""
select {y} as current_year, {y - 1} as previous_year, cy_leads, cy_registration, cy_admission,
  py_leads, py_registration, py_admission,
  {_pct('cy_registration', 'cy_leads', 'zero')} as lead_registration_rate,
  {_pct('cy_admission', 'cy_leads', 'zero')} as lead_admission_rate,
  {_pct('cy_admission', 'cy_registration', 'zero')} as registration_admission_rate,
  {pct('cy_leads - py_leads', 'py_leads')} as leads_growth,
  {pct('cy_registration - py_registration', 'py_registration')} as registration_growth,
  {pct('cy_admission - py_admission', 'py_admission')} as admission_growth
from (select {cnt('E_leads', y)} as cy_leads, {cnt('E_reg', y)} as cy_registration, {cnt('E_adm', y)} as cy_admission,
             {cnt('E_leads', y - 1)} as py_leads, {cnt('E_reg', y - 1)} as py_registration,
             {cnt('E_adm', y - 1)} as py_admission) t
""", *E_VIEWS)


@register("funnel_yoy_events", _funnel_yoy_sql(2000))
def q_funnel_yoy(spark, sf_dir):
    return Fn.funnel_yoy(B.events(spark, sf_dir), 2000)


# ---------------------------------------------------------------- F10
def _year_ctes(y, tag, lead_filter="true"):
    return [
        (f"lb{tag}", f"select lead_id, main_source, source from E_leads where {_rng('event_date', y, y)} and {lead_filter}"),
        (f"rb{tag}", f"select lead_id from E_reg where {_rng('event_date', y, y)} group by lead_id"),
        (f"ab{tag}", f"select lead_id from E_adm where {_rng('event_date', y, y)} group by lead_id"),
        (f"sp{tag}", f"select lb.main_source, lb.source, count(distinct lb.lead_id) as leads, "
                     f"count(distinct case when rb.lead_id is not null then lb.lead_id end) as registration, "
                     f"count(distinct case when ab.lead_id is not null then lb.lead_id end) as admission "
                     f"from lb{tag} lb left join rb{tag} rb on rb.lead_id = lb.lead_id "
                     f"left join ab{tag} ab on ab.lead_id = lb.lead_id group by all"),
    ]


@register("source_performance_year", with_views("select * from sp0", *E_VIEWS, extra=_year_ctes(2000, "0")))
def q_source_performance_year(spark, sf_dir):
    return Fn.source_performance_year(B.events(spark, sf_dir), 2000)


# ---------------------------------------------------------------- F11
def _rates_sql(prefix, l, r, a, zero):
    return (f"{_pct(r, l, zero)} as {prefix}lead_registration_percent, "
            f"{_pct(a, l, zero)} as {prefix}lead_admission_percent, "
            f"{_pct(a, r, zero)} as {prefix}registration_admission_percent")


def _perf_select(y, zero):
    h = rate_h("admission", "leads") if zero == "zero" else pct_h("admission", "leads")
    return f"""
select main_source, source, {y} as current_year, {y - 1} as previous_year, leads, registration, admission,
  {_rates_sql('', 'leads', 'registration', 'admission', zero)},
  previous_leads, previous_registration, previous_admission,
  {_rates_sql('previous_', 'previous_leads', 'previous_registration', 'previous_admission', zero)},
  {pct('leads - previous_leads', 'previous_leads')} as lead_growth_percent,
  {pct('admission - previous_admission', 'previous_admission')} as admission_growth_percent,
  case when leads >= 1 and {h} is not null and {h} < 2000 then 'high_leads_low_conversion'
       when {h} is not null and {h} >= 5000 then 'strong' else 'normal' end as performance_flag,
  case when previous_leads = 0 and leads > 0 then 'new_source' when previous_leads > 0 and leads = 0 then 'dropped'
       when leads > previous_leads then 'increased' when leads < previous_leads then 'decreased'
       else 'unchanged' end as growth_status
from agg"""


_SP_AGG = ("agg", "select coalesce(c.main_source, p.main_source) as main_source, coalesce(c.source, p.source) as source, "
                  "cast(coalesce(c.leads, 0) as bigint) as leads, cast(coalesce(c.registration, 0) as bigint) as registration, "
                  "cast(coalesce(c.admission, 0) as bigint) as admission, "
                  "cast(coalesce(p.leads, 0) as bigint) as previous_leads, "
                  "cast(coalesce(p.registration, 0) as bigint) as previous_registration, "
                  "cast(coalesce(p.admission, 0) as bigint) as previous_admission "
                  "from sp0 c full outer join sp1 p on c.main_source is not distinct from p.main_source "
                  "and c.source is not distinct from p.source")
_SP_SQL = with_views(_perf_select(2000, "null"), *E_VIEWS,
                     extra=_year_ctes(2000, "0") + _year_ctes(1999, "1") + [_SP_AGG])


@register("source_performance_yoy", _SP_SQL)
def q_source_performance(spark, sf_dir):
    return Fn.source_performance(B.events(spark, sf_dir), 2000)


@register("source_performance_metrics", with_views(_perf_select(2026, "zero"), "MB", extra=[
    ("agg", "select coalesce(main_source, 'Unknown') as main_source, coalesce(source, 'Unknown') as source, "
            + ", ".join(f"{lsum(a)} as {b}" for a, b in (
                ("cy_leads", "leads"), ("cy_registration", "registration"), ("cy_admission", "admission"),
                ("py_leads", "previous_leads"), ("py_registration", "previous_registration"),
                ("py_admission", "previous_admission")))
            + " from MB where dataset_id = 'ds2026' group by all")]))
def q_source_performance_metrics(spark, sf_dir):
    return Fn.source_performance_metrics(B.metrics(spark, sf_dir, blanks=True), "ds2026", 2026, 2026, 2025)


# ---------------------------------------------------------------- F12
_INS_NAME = "concat(coalesce(main_source, 'None'), ' / ', coalesce(source, 'None'))"


@register("source_insights", with_views(f"""
select 'high_leads_low_conversion' as type, main_source, source, 'high' as severity,
       concat({_INS_NAME}, ': ', cast(admission as varchar), ' of ', cast(leads as varchar),
              ' leads were admitted') as message, lead_admission_percent
from perf where performance_flag = 'high_leads_low_conversion'
union all
select 'new_source', main_source, source, 'info', concat({_INS_NAME}, ': leads this year, none the year before'),
       null from perf where growth_status = 'new_source'
union all
select 'dropped_source', main_source, source, 'high',
       concat({_INS_NAME}, ': leads the year before, none this year'), null
from perf where growth_status = 'dropped'
""", *E_VIEWS, extra=_year_ctes(2000, "0") + _year_ctes(1999, "1") + [_SP_AGG, ("perf", _perf_select(2000, "null"))]))
def q_source_insights(spark, sf_dir):
    return Fn.source_insights(Fn.source_performance(B.events(spark, sf_dir), 2000))


@register("source_insight_lists", with_views("""
select 'strong' as list, main_source, source from perf where performance_flag = 'strong'
union all select 'weak', main_source, source from perf where performance_flag = 'high_leads_low_conversion'
union all select 'new', main_source, source from perf where growth_status = 'new_source'
union all select 'dropped', main_source, source from perf where growth_status = 'dropped'
""", *E_VIEWS, extra=_year_ctes(2000, "0") + _year_ctes(1999, "1") + [_SP_AGG, ("perf", _perf_select(2000, "null"))]))
def q_source_insight_lists(spark, sf_dir):
    return Fn.insight_lists(Fn.source_performance(B.events(spark, sf_dir), 2000))


@register("source_insight_summary", with_views("""
select count(*) as total_sources, count(*) filter (where performance_flag = 'strong') as strong_sources,
       count(*) filter (where performance_flag = 'high_leads_low_conversion') as weak_sources,
       count(*) filter (where growth_status = 'new_source') as new_sources,
       count(*) filter (where growth_status = 'dropped') as dropped_sources from perf
""", *E_VIEWS, extra=_year_ctes(2000, "0") + _year_ctes(1999, "1") + [_SP_AGG, ("perf", _perf_select(2000, "null"))]))
def q_source_insight_summary(spark, sf_dir):
    return Fn.insight_summary(Fn.source_performance(B.events(spark, sf_dir), 2000))


# ---------------------------------------------------------------- F13
@register("source_tree", with_views(f"""
select main_source, source, 2000 as year, leads, registration, admission,
  {_rates_sql('', 'leads', 'registration', 'admission', 'null')},
  case when leads > 0 and {pct_h('admission', 'leads')} < 2000 then 'high_leads_low_conversion'
       when leads > 0 and {pct_h('admission', 'leads')} >= 5000 then 'strong' else 'normal' end as performance,
  row_number() over (partition by main_source order by leads desc, source) as position
from sp0""", *E_VIEWS, extra=_year_ctes(2000, "0")))
def q_source_tree(spark, sf_dir):
    return Fn.source_tree(B.events(spark, sf_dir), 2000)


# ---------------------------------------------------------------- F14
def _lvl_sql(c, level):
    v = f"trim(coalesce({c}, 'Unknown'))"
    if level == 1:
        return (f"case when {v} = '' or upper({v}) in ('NONE', 'NULL', 'UNKNOWN') then 'OTHERS' "
                f"when upper({v}) = 'IN HOUSE' then 'IN-HOUSE' when upper({v}) = 'OUT SOURCED' then 'OUT-SOURCED' "
                f"else {v} end")
    if level == 2:
        s = f"(case when length({v}) >= 3 and substr({v}, 2, 2) = ': ' then substr({v}, 4) else {v} end)"
        s2 = (f"(case when upper({s}) = 'OUT SOURCED' then 'OUT-SOURCED' when upper({s}) = 'IN HOUSE' "
              f"then 'IN-HOUSE' else {s} end)")
        return f"case when {s2} = '' or upper({s2}) in ('NONE', 'NULL') then 'OTHER' else {s2} end"
    return f"case when {v} = '' or upper({v}) in ('NONE', 'NULL') then 'UNKNOWN' else {v} end"


def _tree3_sql(view, ds, year, cy):
    if year == cy:
        cur = {s: f"cy_{s}" for s in ("leads", "registration", "admission")}
        prev = {s: f"py_{s}" for s in cur}
    else:  # year == cy - 1
        cur = {s: f"py_{s}" for s in ("leads", "registration", "admission")}
        prev = {s: "0" for s in cur}
    sums = ", ".join([f"{lsum(cur['leads'])} as leads", f"{lsum(cur['registration'])} as registration",
                      f"{lsum(cur['admission'])} as admission", f"{lsum(prev['leads'])} as py_leads",
                      f"{lsum(prev['registration'])} as py_registration",
                      f"{lsum(prev['admission'])} as py_admission"])
    h = rate_h("admission", "leads")
    return with_views(f"""
select level, l1, l2, l3, name, leads, registration, admission, py_leads, py_registration, py_admission,
  cast({h} as double) / 100 as lead_admission_percent,
  case when level = 0 then 'normal' when leads >= 1 and {h} < 2000 then 'high_leads_low_conversion'
       when {h} >= 5000 then 'strong' else 'normal' end as performance,
  row_number() over (partition by level, case when level >= 2 then l1 end, case when level = 3 then l2 end
                     order by leads desc, name) as position
from (
  select 3 as level, l1, l2, l3, l3 as name, {sums} from base group by l1, l2, l3
  union all select 2, l1, l2, null, l2, {sums} from base group by l1, l2
  union all select 1, l1, null, null, l1, {sums} from base group by l1
  union all select 0, null, null, null, 'All Sources', {sums} from base) t
""", view, extra=[("base", f"select {_lvl_sql('lead_type', 1)} as l1, {_lvl_sql('source', 2)} as l2, "
                           f"{_lvl_sql('main_source', 3)} as l3, * from {view} where dataset_id = '{ds}'")])


@register("source_tree3", _tree3_sql("M", "ds2026", 2026, 2026))
def q_source_tree3(spark, sf_dir):
    return Fn.source_tree3(B.metrics(spark, sf_dir), "ds2026", 2026, 2026, 2025)


@register("source_tree3_blank_previous_year", _tree3_sql("MB", "ds2024", 2023, 2024))
def q_source_tree3_blank(spark, sf_dir):
    return Fn.source_tree3(B.metrics(spark, sf_dir, blanks=True), "ds2024", 2023, 2024, 2023)


# ---------------------------------------------------------------- F15
@register("tree_search", with_views("""
select t.* from tree t where t.level >= 1 and exists (
  select 1 from tree h where h.level >= 1 and contains(lower(h.name), 'high') and (
    (t.level = 1 and t.l1 = h.l1) or
    (t.level = 2 and h.level >= 2 and t.l1 = h.l1 and t.l2 = h.l2) or
    (t.level = 3 and h.level = 3 and t.l1 = h.l1 and t.l2 = h.l2 and t.l3 = h.l3)))
""", extra=[("tree", "select * from (" + _tree3_sql("M", "ds2026", 2026, 2026) + ") x")]))
def q_tree_search(spark, sf_dir):
    return Fn.tree_search(Fn.source_tree3(B.metrics(spark, sf_dir), "ds2026", 2026, 2026, 2025), "HIGH")


# ---------------------------------------------------------------- F16
def _detail_sql(agg_sql, ms, src, year, zero, views, extra):
    h = rate_h("admission", "leads") if zero == "zero" else pct_h("admission", "leads")
    return with_views(f"""
select '{ms}' as main_source, '{src}' as source, {year} as year, leads, registration, admission,
  {_rates_sql('', 'leads', 'registration', 'admission', zero)},
  case when leads > 0 and admission = 0 then 'high_leads_low_conversion'
       when {h} is not null and {h} >= 5000 then 'strong' else 'normal' end as performance
from ({agg_sql}) a""", *views, extra=extra)


@register("source_detail", _detail_sql(
    "select cast(coalesce(sum(leads), 0) as bigint) as leads, cast(coalesce(sum(registration), 0) as bigint) as registration, "
    "cast(coalesce(sum(admission), 0) as bigint) as admission from sp0", "3-MEDIUM", "BUILDING", 2000, "null",
    E_VIEWS, _year_ctes(2000, "0", "main_source = '3-MEDIUM' and source = 'BUILDING'")))
def q_source_detail(spark, sf_dir):
    return Fn.source_detail(B.events(spark, sf_dir), 2000, "3-MEDIUM", "BUILDING")


@register("source_detail_metrics", _detail_sql(
    f"select {lsum('py_leads')} as leads, {lsum('py_registration')} as registration, "
    f"{lsum('py_admission')} as admission from M where dataset_id = 'ds2026' "
    "and lower(main_source) = '1-urgent' and lower(source) = 'household'", "1-urgent", "household", 2025, "zero",
    ("M",), []))
def q_source_detail_metrics(spark, sf_dir):
    return Fn.source_detail_metrics(B.metrics(spark, sf_dir), "ds2026", 2025, 2026, 2025, "1-urgent",
                                    "household")
