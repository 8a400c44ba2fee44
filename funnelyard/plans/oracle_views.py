"""The binding views written as plain SQL for the independent DuckDB oracle.

They restate the view definitions of :mod:`funnelyard.sources.bindings`
from scratch in ANSI SQL (DuckDB dialect: ``//`` is integer division).
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["F"] = """
select year(l_shipdate)+25 as yr, o_orderstatus as lead_type, o_orderpriority as main_source,
       c_mktsegment as source, n_name as state, r_name as campus_name,
       p_brand as program_name, p_type as cluster, s_name as owner,
       1 as leads, case when l_linestatus='F' then 1 else 0 end as registration,
       case when l_linestatus='F' and l_returnflag='R' then 1 else 0 end as admission
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
 join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
 join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey
"""

_M_BODY = """
select concat('ds', cast(cy as varchar)) as dataset_id, owner, cluster, lead_type, main_source, {source} as source,
  campus_name, {state} as state, program_name,
  cast(case when yr=cy then leads else 0 end as bigint) as cy_leads,
  cast(case when yr=cy then registration else 0 end as bigint) as cy_registration,
  cast(case when yr=cy then admission else 0 end as bigint) as cy_admission,
  cast(case when yr=cy-1 then leads else 0 end as bigint) as py_leads,
  cast(case when yr=cy-1 then registration else 0 end as bigint) as py_registration,
  cast(case when yr=cy-1 then admission else 0 end as bigint) as py_admission
from (select *, yr + yr % 2 as cy from F) p
"""
VIEWS["M"] = _M_BODY.format(source="source", state="state")
VIEWS["MB"] = _M_BODY.format(source="nullif(source,'BUILDING')", state="nullif(state,'NATION_3')")

VIEWS["E_leads"] = """
select o_orderkey as lead_id, o_orderpriority as main_source, c_mktsegment as source,
       cast(o_orderdate as date) as event_date
from orders join customer on o_custkey=c_custkey
"""
VIEWS["E_reg"] = """
select l_orderkey as lead_id, cast(l_shipdate as date) as event_date from lineitem where l_linestatus='F'
"""
VIEWS["E_adm"] = """
select l_orderkey as lead_id, cast(l_shipdate as date) as event_date
from lineitem where l_linestatus='F' and l_returnflag='R'
"""

_PLACE = """ join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey"""
VIEWS["E_leads_dims"] = """
select o_orderkey as lead_id, p_brand as program_name, r_name as campus_name, p_type as cluster, n_name as state,
  c_mktsegment as source, o_orderpriority as main_source, o_orderstatus as lead_type, cast(o_orderdate as date) as event_date
from orders""" + _PLACE + """
 left join (select l_orderkey, min(l_partkey) as first_part from lineitem group by 1) f on f.l_orderkey=o_orderkey
 left join part on p_partkey=first_part
"""
_LINE_DIMS = """
select l_orderkey as lead_id, p_brand as program_name, r_name as campus_name, p_type as cluster, n_name as state,
  o_orderstatus as admission_status, cast(l_shipdate as date) as event_date
from lineitem join orders on l_orderkey=o_orderkey""" + _PLACE + """ join part on p_partkey=l_partkey where l_linestatus='F'"""
VIEWS["E_registration_dims"] = _LINE_DIMS
VIEWS["E_admission_dims"] = _LINE_DIMS + " and l_returnflag='R'"

VIEWS["R"] = """
select *, row_number() over (partition by label order by dataset_id) as upload_version,
       row_number() over (partition by label order by dataset_id desc) = 1 as is_period_active
from (select p_partkey as dataset_id,
        case when p_type='PROMO' then concat('test_', p_name) else p_name end as dataset_name,
        concat(p_name,'_',cast(2015+p_size%8 as varchar),'-',cast(16+p_size%8 as varchar),'.csv') as original_filename,
        concat(cast(2015+p_size%8 as varchar),'-',cast(16+p_size%8 as varchar)) as label,
        2015+p_size%8 as start_year, 2016+p_size%8 as end_year, p_partkey as created_seq,
        p_retailprice%100 as quality_score from part) x
"""

VIEWS["T"] = """
select concat(cast(m.conv_id as varchar), '-', cast(m.turn as varchar)) as message_id, m.conv_id, m.turn, m.text as question, m.nxt as answer,
  case when l.quality=1 then 'correct' when l.quality=0 then 'incorrect' else 'unreviewed' end as eval_status,
  case when l.toxic=1 then 'other' end as eval_error_category
from (select *, lead(text) over (partition by conv_id order by turn) as nxt,
             lead(role) over (partition by conv_id order by turn) as nrole from conversations) m
 left join labels l on l.doc_id=m.conv_id where m.role='user' and m.nrole='assistant'
"""

VIEWS["C"] = """
select c_custkey as row_number, c_name as name,
  case when c_custkey%7=0 then 'bad mail' else concat('u',cast(c_custkey as varchar),'@example.com') end as email,
  case when c_custkey%5=0 then '' when c_custkey%5=1 then concat(' ',c_mktsegment,' ')
       when c_custkey%11=0 then 'N/A' else c_mktsegment end as segment,
  case when c_custkey%13=0 then 'n.a.' when c_custkey%3=0 then '1,234' else cast(c_custkey as varchar) end as amount
from customer
"""

# View dependencies, so a query only names what it reads.
_DEPS = {"M": ["F"], "MB": ["F"]}


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None,
               once: tuple[str, ...] = ()) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first), then the
    query's own ``extra`` CTEs in the given order; those named in ``once``
    are computed once however often they are read."""
    order: list[str] = []
    for n in names:
        for dep in _DEPS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    how = {n: "as materialized" if n in once else "as" for n in [*order, *(n for n, _ in extra or [])]}
    parts = [f"{n} {how[n]} ({VIEWS[n].strip()})" for n in order]
    parts += [f"{n} {how[n]} ({body.strip()})" for n, body in (extra or [])]
    ctes = ",\n".join(parts)
    return f"with {ctes}\n{sql.strip()}" if parts else sql.strip()
