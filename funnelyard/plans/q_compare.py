"""Registered comparison queries (G1-G12) on the metrics view M."""

from __future__ import annotations

from funnelyard.operators import compare as C
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.plans.sqlfrag import blank, from_h, lsum, pct, rate_h
from funnelyard.sources import bindings as B


def _workspace_sql(view: str, a: str, b: str, groups: list[tuple[str, str]], metric: str,
                   performance: str, filters: dict[str, str], entity: str) -> str:
    where = "".join(f" and lower({blank(c)}) = lower('{v}')" for c, v in filters.items())
    gsel = ", ".join(f"{blank(c)} as {alias}" for alias, c in groups)
    using = ", ".join(alias for alias, _ in groups)
    jsel = ", ".join(f"coalesce(pa.{alias}, pb.{alias}) as {alias}" for alias, _ in groups)
    on = " and ".join(f"pa.{alias} = pb.{alias}" for alias, _ in groups)
    a_h = rate_h("period_a_admissions", "period_a_leads")
    b_h = rate_h("period_b_admissions", "period_b_leads")
    value = {"leads": ("cast(period_a_leads as double)", "cast(period_b_leads as double)",
                       "cast(lead_change as double)", "lead_change_percent"),
             "admissions": ("cast(period_a_admissions as double)", "cast(period_b_admissions as double)",
                            "cast(admission_change as double)", "admission_change_percent"),
             "conversion_rate": ("period_a_conversion", "period_b_conversion",
                                 "conversion_change_percentage_points", pct("b_h - a_h", "a_h"))}[metric]
    perf = {"all": "true", "increased": "absolute_change > 0",
            "decreased": "absolute_change < 0"}[performance]
    del using
    return with_views(f"""
select * exclude (a_h, b_h) from (
  select *, {value[0]} as period_a_value, {value[1]} as period_b_value,
         {value[2]} as absolute_change, {value[3]} as growth_percent, {entity} as entity_name
  from calc) x
where {perf}
""", view, extra=[
        ("pa", f"select {gsel}, {lsum('cy_leads')} as period_a_leads, {lsum('cy_admission')} as period_a_admissions "
               f"from {view} where dataset_id = '{a}'{where} group by all"),
        ("pb", f"select {gsel}, {lsum('cy_leads')} as period_b_leads, {lsum('cy_admission')} as period_b_admissions "
               f"from {view} where dataset_id = '{b}'{where} group by all"),
        ("j", f"select {jsel}, cast(coalesce(pa.period_a_leads, 0) as bigint) as period_a_leads, "
              f"cast(coalesce(pb.period_b_leads, 0) as bigint) as period_b_leads, "
              f"cast(coalesce(pa.period_a_admissions, 0) as bigint) as period_a_admissions, "
              f"cast(coalesce(pb.period_b_admissions, 0) as bigint) as period_b_admissions "
              f"from pa full outer join pb on {on}"),
        ("calc", f"select *, period_b_leads - period_a_leads as lead_change, "
                 f"{pct('period_b_leads - period_a_leads', 'period_a_leads')} as lead_change_percent, "
                 f"period_b_admissions - period_a_admissions as admission_change, "
                 f"{pct('period_b_admissions - period_a_admissions', 'period_a_admissions')} as admission_change_percent, "
                 f"{from_h(a_h)} as period_a_conversion, {from_h(b_h)} as period_b_conversion, "
                 f"{from_h(f'({b_h}) - ({a_h})')} as conversion_change_percentage_points, "
                 f"{a_h} as a_h, {b_h} as b_h from j"),
    ])


@register("period_workspace", _workspace_sql(
    "M", "ds2022", "ds2024", [("source", "source"), ("state", "state")], "leads", "all", {}, "source"))
def q_period_workspace(spark, sf_dir):
    m = B.metrics(spark, sf_dir)
    return C.period_workspace(m, C.PeriodRef("ds2022"), C.PeriodRef("ds2024"), "source", "leads")


@register("period_workspace_by_label", _workspace_sql(
    "M", "ds2024", "ds2026", [("program", "program_name"), ("specialization", "cluster")], "admissions", "increased", {}, "program"))
def q_period_workspace_by_label(spark, sf_dir):
    return C.workspace_by_period(B.metrics(spark, sf_dir), B.metrics_registry(spark, sf_dir), "2023-24", 2026,
                                 workspace="program", metric="admissions", performance="increased")


@register("period_workspace_program_blank", _workspace_sql(
    "MB", "ds2024", "ds2026", [("program", "program_name"), ("specialization", "cluster")],
    "conversion_rate", "decreased", {"state": "Unspecified"}, "program"))
def q_period_workspace_program_blank(spark, sf_dir):
    m = B.metrics(spark, sf_dir, blanks=True)
    return C.period_workspace(m, C.PeriodRef("ds2024"), C.PeriodRef("ds2026"), "program",
                              "conversion_rate", "decreased", {"state": "Unspecified"},
                              sort_field="growth_percent")


# ---------------------------------------------------------------- G2
_WS = _workspace_sql("M", "ds2022", "ds2024", [("source", "source"), ("state", "state")], "leads",
                     "all", {}, "source")


@register("workspace_page", "select * exclude (rn, n_after), n_after > 25 as has_more, rn - 1 as row_index from ("
          "select *, row_number() over (order by absolute_change desc nulls last, entity_name, source, state) as rn, "
          "count(*) over () - 25 as n_after from (" + _WS + ") w) x where rn > 25 and rn <= 50")
def q_workspace_page(spark, sf_dir):
    m = B.metrics(spark, sf_dir)
    ws = C.period_workspace(m, C.PeriodRef("ds2022"), C.PeriodRef("ds2024"), "source", "leads")
    from pyspark.sql import functions as F
    return C.page(ws, [F.col("absolute_change").desc_nulls_last(), F.col("entity_name"),
                       F.col("source"), F.col("state")], limit=25, offset=25)


# ---------------------------------------------------------------- G3
_REG_M = ("reg", "select concat('ds', cast(cy as varchar)) as dataset_id, cy - 1 as start_year, cy as end_year, "
                 "row_number() over (order by cy) as seq from (select distinct yr + yr % 2 as cy from F) y")


def _compare_sql(view, a_ds, a_role, b_ds, b_role, dim, stage, conversion, limit):
    def side(ds, role, tag):
        return (f"select {dim} as name, {lsum(f'{role}_{stage}')} as {tag}1, {lsum(f'{role}_leads')} as {tag}2 "
                f"from {view} where dataset_id = '{ds}' and {dim} is not null group by 1")
    if conversion:
        ah, bh = rate_h("a1", "a2"), rate_h("b1", "b2")
        sel = (f"{from_h(ah)} as period_a_value, {from_h(bh)} as period_b_value, "
               f"{from_h(f'({ah}) - ({bh})')} as absolute_change, {pct(f'({ah}) - ({bh})', bh)} as growth_percent, "
               f"{from_h(ah)} as period_a_rate, {from_h(bh)} as period_b_rate, "
               f"{from_h(f'({ah}) - ({bh})')} as rate_change_percentage_points, "
               "case when a2 <> 0 then cast(a1 as double) / a2 else 0.0 end as k")
    else:
        sel = (f"a1 as period_a_value, b1 as period_b_value, a1 - b1 as absolute_change, "
               f"{pct('a1 - b1', 'b1')} as growth_percent, cast(a1 as double) as k")
    return with_views(f"""
select * exclude (k) from (
  select name, {sel} from (
    select coalesce(sa.name, sb.name) as name, coalesce(a1, 0) as a1, coalesce(a2, 0) as a2,
           coalesce(b1, 0) as b1, coalesce(b2, 0) as b2
    from sa full outer join sb on sa.name = sb.name) j) x
order by k desc, name limit {limit}
""", view, extra=[("sa", side(a_ds, a_role, "a")), ("sb", side(b_ds, b_role, "b"))])


@register("compare_periods", _compare_sql("M", "ds2026", "cy", "ds2024", "py", "program_name",
                                          "admission", False, 50))
def q_compare_periods(spark, sf_dir):
    return C.compare_periods(B.metrics(spark, sf_dir), B.metrics_registry(spark, sf_dir), "2025-26", 2023,
                             "program_name", "admissions", limit=50)


@register("compare_periods_conversion", _compare_sql("MB", "ds2024", "cy", "ds2022", "py", "state",
                                                     "admission", True, 10))
def q_compare_periods_conversion(spark, sf_dir):
    return C.compare_periods(B.metrics(spark, sf_dir, blanks=True), B.metrics_registry(spark, sf_dir), 2024,
                             "2021", "state", "conversion_rate", limit=10)


@register("compare_periods_unknown_year", with_views(
    "select program_name as name, cy_leads as period_a_value, cy_leads as period_b_value, "
    "cy_leads as absolute_change, cast(null as double) as growth_percent from M where false", "M"))
def q_compare_periods_unknown(spark, sf_dir):
    return C.compare_periods(B.metrics(spark, sf_dir), B.metrics_registry(spark, sf_dir), 2031, 2026,
                             "program_name", "leads")


# ---------------------------------------------------------------- G4
def _trend_sql(view, dim, stage, conversion, top):
    if conversion:
        cv, pv = from_h(rate_h("cv", "cl")), from_h(rate_h("pv", "pl"))
    else:
        cv, pv = "cast(cv as double)", "cast(pv as double)"
    return with_views(f"""
select g.name, g.year, coalesce(b.value, 0.0) as value, g.rank
from (select r.name, r.rank, y.year from ranked r cross join years y) g
left join best b on b.name = g.name and b.year = g.year
""", view, extra=[
        _REG_M,
        ("per", f"select {dim} as name, dataset_id, {lsum(f'cy_{stage}')} as cv, {lsum('cy_leads')} as cl, "
                f"{lsum(f'py_{stage}')} as pv, {lsum('py_leads')} as pl from {view} where {dim} is not null group by all"),
        ("e", f"select name, end_year as year, 0 as tier, seq, {cv} as value from per join reg using (dataset_id) "
              f"union all select name, start_year, 1, seq, {pv} from per join reg using (dataset_id)"),
        ("best", "select name, year, value from (select *, row_number() over (partition by name, year "
                 "order by tier, seq desc) as rn from e) x where rn = 1"),
        ("years", "select distinct year from (select start_year as year from reg union all select end_year from reg) y"),
        ("latest", "select max(year) as y from years"),
        ("ranked", "select name, row_number() over (order by lv desc, name) as rank from ("
                   "select n.name, coalesce(b.value, 0.0) as lv from (select distinct name from best) n "
                   "left join best b on b.name = n.name and b.year = (select y from latest)) z "
                   f"order by lv desc, name limit {top}"),
    ])


@register("historical_trend", _trend_sql("M", "campus_name", "leads", False, 50))
def q_historical_trend(spark, sf_dir):
    return C.historical_trend(B.metrics(spark, sf_dir), B.metrics_registry(spark, sf_dir), "leads", "campus_name", top=50)


@register("historical_trend_conversion", _trend_sql("MB", "state", "admission", True, 10))
def q_historical_trend_conversion(spark, sf_dir):
    return C.historical_trend(B.metrics(spark, sf_dir, blanks=True), B.metrics_registry(spark, sf_dir),
                              "conversion_rate", "state", top=10)


# ---------------------------------------------------------------- G5
def _member_yoy_cte(view, ds, dim, extra_where="true"):
    ph = rate_h("previous_year_admissions", "previous_year_leads")
    ch = rate_h("current_year_admissions", "current_year_leads")
    return (f"select *, {from_h(ph)} as previous_year_admission_rate, {from_h(ch)} as current_year_admission_rate, "
            f"current_year_admissions - previous_year_admissions as admission_change, "
            f"{from_h(f'({ch}) - ({ph})')} as rate_change from ("
            f"select {dim} as member, {lsum('py_leads')} as previous_year_leads, {lsum('cy_leads')} as current_year_leads, "
            f"{lsum('py_admission')} as previous_year_admissions, {lsum('cy_admission')} as current_year_admissions "
            f"from {view} where dataset_id = '{ds}' and {dim} is not null and trim({dim}) <> '' and {extra_where} "
            "group by 1) r")


def _yoy_sql(ds, dim, direction, n, contains=None):
    op = "<" if direction == "decrease" else ">"
    order = "asc" if direction == "decrease" else "desc"
    f_body = "select * from c"
    if contains:
        f_body = (f"select * from c where lower(member) like '%{contains.lower()}%' or "
                  f"(select count(*) from c where lower(member) like '%{contains.lower()}%') = 0")
    return with_views(f"""
select * from flt where case when (select count(*) from flt where rate_change {op} 0) > 0 then rate_change {op} 0
                           when (select count(*) from flt where admission_change {op} 0) > 0 then admission_change {op} 0
                           else true end
order by rate_change {order}, admission_change {order}, member limit {n}
""", "M", extra=[("c", _member_yoy_cte("M", ds, dim)), ("flt", f_body)])


@register("yoy_decrease", _yoy_sql("ds2026", "program_name", "decrease", 5))
def q_yoy_decrease(spark, sf_dir):
    return C.yoy(B.metrics(spark, sf_dir), "ds2026", "program_name", "decrease", 5)


@register("yoy_increase_contains", _yoy_sql("ds2024", "program_name", "increase", 10, "brand#3"))
def q_yoy_increase_contains(spark, sf_dir):
    return C.yoy(B.metrics(spark, sf_dir), "ds2024", "program_name", "increase", 10, contains="BRAND#3")


# ---------------------------------------------------------------- G6
@register("movers", with_views(f"""
select * from (select *, row_number() over (partition by side order by abs(change) desc, member) as rank
  from (select *, case when change > 0 then 'positive' else 'negative' end as side from (
    select *, cast(admission_change as double) as change,
           {pct('admission_change', 'previous_year_admissions')} as growth_pct from c) a
    where change <> 0) b) x where rank <= 5
""", "M", extra=[("c", _member_yoy_cte("M", "ds2026", "state"))]))
def q_movers(spark, sf_dir):
    return C.movers(B.metrics(spark, sf_dir), "ds2026", "state", "admission", 5)


# ---------------------------------------------------------------- G7
@register("performance_rankings", with_views("""
select * from (select *, row_number() over (partition by list order by
    case when list = 'improvements' then -admission_change else admission_change end, member) as rank
  from c cross join (values ('improvements'), ('declines')) l(list) where member <> '') x where rank <= 10
""", "M", extra=[("c", _member_yoy_cte("M", "ds2026", "owner", "lower(source) = lower('Building')"))]))
def q_performance_rankings(spark, sf_dir):
    return C.performance_rankings(B.metrics(spark, sf_dir), "ds2026", "counsellor",
                                  {"source": "Building", "state": "all"})


# ---------------------------------------------------------------- G8
def _pair_sql():
    cols = ("py_leads", "cy_leads", "py_admission", "cy_admission")
    agg = ", ".join(f"{lsum(c)} as {c}" for c in cols)

    def side(tag, k):
        return (f"select {', '.join(f'coalesce(max({c}), 0) as {c}' for c in cols)} "
                f"from (select {agg} from M where dataset_id = 'ds2026' and lower(state) = '{k}' "
                f"having count(*) > 0) s")
    out = ["'NATION_12' as entity_a", "'Atlantis' as entity_b"]
    for t in ("a", "b"):
        out += [f"{t}.{c} as {t}_{c}" for c in cols]
        out += [f"{from_h(rate_h(f'{t}.py_admission', f'{t}.py_leads'))} as {t}_py_rate",
                f"{from_h(rate_h(f'{t}.cy_admission', f'{t}.cy_leads'))} as {t}_cy_rate"]
    out += [f"a.{c} - b.{c} as diff_{c}" for c in cols]
    for p in ("py", "cy"):
        ra = rate_h(f"a.{p}_admission", f"a.{p}_leads")
        rb = rate_h(f"b.{p}_admission", f"b.{p}_leads")
        out.append(f"{from_h(f'({ra}) - ({rb})')} as diff_{p}_rate")
    return with_views(f"select {', '.join(out)} from a_side a cross join b_side b", "M",
                      extra=[("a_side", side("a", "nation_12")), ("b_side", side("b", "atlantis"))])


@register("pair_compare", _pair_sql())
def q_pair_compare(spark, sf_dir):
    return C.pair_compare(B.metrics(spark, sf_dir), "ds2026", "state", "NATION_12", "Atlantis")
