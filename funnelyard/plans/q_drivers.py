"""Registered driver-analysis queries (K1-K5) for one program."""

from __future__ import annotations

from funnelyard.operators import drivers as K
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.plans.sqlfrag import from_h, lsum, pct_h, rate_h
from funnelyard.sources import bindings as B

DS, DIM, MEMBER = "ds2026", "program_name", "Brand#25"
M6 = ("cy_leads", "py_leads", "cy_admission", "py_admission", "cy_registration", "py_registration")


def g0(new, old):
    return f"coalesce({pct_h(f'{new} - {old}', old)}, 0)"


_ROWS = ("mr", f"select * from M where dataset_id = '{DS}' and {DIM} = '{MEMBER}'")
_TOT = ("tot", "select " + ", ".join(f"{lsum(c)} as {c}" for c in M6) + " from mr")
_TOTALS_SELECT = f"""
select '{DIM}' as dimension, '{MEMBER}' as member, {', '.join(M6)},
  {from_h(rate_h('cy_admission', 'cy_leads'))} as cy_conv, {from_h(rate_h('py_admission', 'py_leads'))} as py_conv,
  cy_leads - py_leads as leads_change, {from_h(g0('cy_leads', 'py_leads'))} as leads_growth,
  cy_admission - py_admission as admission_change, {from_h(g0('cy_admission', 'py_admission'))} as admission_growth,
  {from_h(f"{rate_h('cy_admission', 'cy_leads')} - {rate_h('py_admission', 'py_leads')}")} as conv_change,
  {rate_h('cy_admission', 'cy_leads')} as cy_conv_h,
  {rate_h('cy_admission', 'cy_leads')} - {rate_h('py_admission', 'py_leads')} as conv_change_h
from tot"""
_CONTRIB = ("contrib", "select dimension, category, cy_leads, py_leads, cy_leads - py_leads as leads_change, "
            f"{from_h(g0('cy_leads', 'py_leads'))} as leads_growth, cy_admission, py_admission, "
            f"cy_admission - py_admission as admission_change, {from_h(g0('cy_admission', 'py_admission'))} as admission_growth, "
            f"{from_h(rate_h('cy_admission', 'cy_leads'))} as cy_conv, {from_h(rate_h('py_admission', 'py_leads'))} as py_conv, "
            f"{from_h(f'{rate_h('cy_admission', 'cy_leads')} - {rate_h('py_admission', 'py_leads')}')} as conv_change, "
            f"{from_h(rate_h('cy_admission', 'tcy'))} as cy_share, {from_h(rate_h('py_admission', 'tpy'))} as py_share, "
            f"{from_h(f'{rate_h('cy_admission', 'tcy')} - {rate_h('py_admission', 'tpy')}')} as share_change, "
            f"{rate_h('cy_admission', 'cy_leads')} as cy_conv_h, "
            f"{rate_h('cy_admission', 'cy_leads')} - {rate_h('py_admission', 'py_leads')} as conv_change_h, "
            f"{g0('cy_leads', 'py_leads')} as leads_growth_h "
            "from (" + "\nunion all\n".join(
                f"select '{d}' as dimension, coalesce({d}, 'UNKNOWN') as category, "
                + ", ".join(f"{lsum(c)} as {c}" for c in M6) + f" from mr group by 2"
                for d in K.CONTRIBUTION_DIMENSIONS if d != DIM)
            + ") g cross join (select cy_admission as tcy, py_admission as tpy from tot) t")


def _m(spark, sf_dir):
    return B.metrics(spark, sf_dir)


@register("driver_totals", with_views(_TOTALS_SELECT, "M", extra=[_ROWS, _TOT]))
def q_driver_totals(spark, sf_dir):
    return K.driver_totals(_m(spark, sf_dir), DS, DIM, MEMBER)


@register("driver_contributions", with_views("select * from contrib", "M", extra=[_ROWS, _TOT, _CONTRIB]))
def q_driver_contributions(spark, sf_dir):
    return K.driver_contributions(_m(spark, sf_dir), DS, DIM, MEMBER)


@register("driver_ranking", with_views("""
select * from (select *, row_number() over (order by impact desc, driver) as rank from (
  select 'Lead volume change' as driver, cast(null as varchar) as dimension, cast(null as varchar) as category,
         cast(abs(leads_change) as double) as impact, cast(py_leads as double) as previous,
         cast(cy_leads as double) as current, cast(leads_change as double) as change, false as low_sample from tt
  union all
  select 'Conversion efficiency', null, null, cast(abs(conv_change_h) * 10 as double), py_conv, cy_conv, conv_change,
         false from tt
  union all
  select concat(case dimension when 'source' then 'Source' when 'main_source' then 'Main Source'
                when 'owner' then 'Owner' when 'campus_name' then 'Campus Name' when 'state' then 'State' end,
                ': ', category),
         dimension, category, cast(abs(admission_change) as double), cast(py_admission as double),
         cast(cy_admission as double), cast(admission_change as double), cy_leads < 10
  from (select *, row_number() over (partition by dimension order by abs(admission_change) desc, category) as rn
        from contrib) c where rn = 1) a) b where rank <= 5
""", "M", extra=[_ROWS, _TOT, _CONTRIB, ("tt", _TOTALS_SELECT)]))
def q_driver_ranking(spark, sf_dir):
    m = _m(spark, sf_dir)
    parts = K.contributions(m, DS, DIM, MEMBER)
    return K.driver_ranking(K.driver_totals(m, DS, DIM, MEMBER, parts), K.driver_contributions(m, DS, DIM, MEMBER, parts))


@register("driver_anomalies", with_views("""
select dimension, category, cy_leads, leads_growth, cy_conv, conv_change, 'growth_with_falling_conversion' as anomaly
from contrib where cy_leads >= 10 and leads_change > 0 and leads_growth_h >= 5000 and conv_change_h <= -500
union all
select contrib.dimension, category, contrib.cy_leads, contrib.leads_growth, contrib.cy_conv, contrib.conv_change,
       'small_but_high_conversion'
from contrib, tt where contrib.cy_leads >= 10 and contrib.cy_leads * 100 < tt.cy_leads * 5
  and contrib.cy_conv_h * 2 > tt.cy_conv_h * 3
""", "M", extra=[_ROWS, _TOT, _CONTRIB, ("tt", _TOTALS_SELECT)]))
def q_driver_anomalies(spark, sf_dir):
    m = _m(spark, sf_dir)
    parts = K.contributions(m, DS, DIM, MEMBER)
    return K.driver_anomalies(K.driver_totals(m, DS, DIM, MEMBER, parts), K.driver_contributions(m, DS, DIM, MEMBER, parts))


@register("driver_tables", with_views("""
select "table", rank, dimension, category, py_admission, cy_admission, admission_change, cy_share, share_change,
       ("table" = 'source_growth' and rank <= 2 and abs(share_change) >= 1.0) as share_shift_noted
from (select *, row_number() over (partition by "table" order by k, category) as rank from (
  select 'source_growth' as "table", *, -cast(admission_change as double) as k from contrib
  where dimension = 'source' and admission_change <> 0
  union all
  select dimension, *, -cast(abs(admission_change) as double) from contrib
  where dimension in ('campus_name', 'state', 'owner')) a) b
where rank <= case when "table" = 'source_growth' then 5 else 3 end
""", "M", extra=[_ROWS, _TOT, _CONTRIB]))
def q_driver_tables(spark, sf_dir):
    return K.driver_tables(K.driver_contributions(_m(spark, sf_dir), DS, DIM, MEMBER), 5)
