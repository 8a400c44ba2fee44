"""Registered entity-resolution and follow-up queries."""

from __future__ import annotations


from funnelyard.operators import compare as C
from funnelyard.operators import entities as H
from funnelyard.operators import metrics as Mx
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.plans.sqlfrag import from_h, lsum, rate_h
from funnelyard.sources import bindings as B

_PREF = ", ".join(f"('{d}', {i})" for i, d in enumerate(C.COMPARE_DIMENSIONS))


def _names(spark, values):
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], "name string, position int")


def _names_sql(values):
    rows = ", ".join(f"('{v}', {i + 1})" for i, v in enumerate(values))
    return ("names", f"select * from (values {rows}) as n(name, position)")


def _facts_sql(ds, dims, measure):
    """One scan of M: every row is spread over its dimensions."""
    names, members = ", ".join(f"'{d}'" for d in dims), ", ".join(dims)
    return (f"select dimension, member, {lsum(measure)} as metric_value from (select unnest([{names}]) as dimension, "
            f"unnest([{members}]) as member, {measure} from M where dataset_id = '{ds}') u where member is not null group by dimension, member")


# ---------------------------------------------------------------- G9
_G9_NAMES = ["asia", "EUROPE", "Brand#25"]
_G9_SHARED = ["nation_1", "NATION_2 "]


def _g9_sql(values):
    return with_views("""
select position, name, dimension, member, metric_value from pick join facts using (dimension, member)
""", "M", extra=[
        _names_sql(values),
        ("facts", _facts_sql("ds2026", C.COMPARE_DIMENSIONS, "cy_admission")),
        ("pref", f"select * from (values {_PREF}) as p(dimension, p)"),
        ("mm", "select n.name, n.position, f.dimension, f.member, case when f.member = trim(n.name) then 1 "
              "when f.member = upper(trim(n.name)) then 2 else 3 end as tier "
              "from names n join facts f on lower(f.member) = lower(trim(n.name))"),
        ("mb", "select name, position, dimension, member from (select *, row_number() over "
               "(partition by name, dimension order by tier, member) as rn from mm) x where rn = 1"),
        ("wanted", "select count(distinct name) as n from names"),
        ("shared", "select arg_min(x.dimension, pref.p) as d from (select dimension, count(distinct name) as k "
                   "from mb group by dimension) x join pref on x.dimension = pref.dimension join wanted on x.k = wanted.n"),
        ("choices", "select mb.name, mb.position, mb.dimension, mb.member, pref.p from mb join pref on mb.dimension = pref.dimension "
                 "join shared on mb.dimension = coalesce(shared.d, mb.dimension)"),
        ("pick", "select name, position, dimension, member from (select *, row_number() over "
                 "(partition by name order by p) as rn from choices) x where rn = 1"),
    ], once=("M", "facts", "mm", "mb", "shared", "pick"))


@register("compare_members_cross_dimension", _g9_sql(_G9_NAMES))
def q_compare_members(spark, sf_dir):
    return C.compare_members(B.metrics(spark, sf_dir), "ds2026", _names(spark, _G9_NAMES), "admission")


@register("compare_members_shared_dimension", _g9_sql(_G9_SHARED))
def q_compare_members_shared(spark, sf_dir):
    return C.compare_members(B.metrics(spark, sf_dir), "ds2026", _names(spark, _G9_SHARED), "admission")


# ---------------------------------------------------------------- G10
_TOP3 = ("top3", f"select program_name as member, {lsum('cy_admission')} as admissions from M "
                 "where dataset_id = 'ds2026' and program_name is not null and lower(trim(program_name)) not in "
                 "('', 'none', 'null', 'n/a', 'na', 'unknown', '-', 'none/unknown', 'total', 'grand total', "
                 "'grand_total') group by 1 order by admissions desc, member limit 3")


@register("members_yoy", with_views(f"""
select entity, py_admission, cy_admission, py_leads, cy_leads, cy_admission - py_admission as admission_change,
       {from_h(f"({rate_h('cy_admission', 'cy_leads')}) - ({rate_h('py_admission', 'py_leads')})")} as conversion_rate_change
from (select k.entity, {lsum('py_admission')} as py_admission, {lsum('cy_admission')} as cy_admission,
             {lsum('py_leads')} as py_leads, {lsum('cy_leads')} as cy_leads
      from (select distinct member as entity, lower(member) as k from top3) k
      left join M on lower(M.program_name) = k.k and M.dataset_id = 'ds2026' group by 1) x
""", "M", extra=[_TOP3]))
def q_members_yoy(spark, sf_dir):
    m = B.metrics(spark, sf_dir)
    top = Mx.top_members(m, "ds2026", "program_name", 3)
    return C.members_yoy(m, "ds2026", "program_name", top)


# ---------------------------------------------------------------- G11
@register("biggest_mover", with_views(f"""
select state, {lsum('cy_admission')} as cy_admission, {lsum('py_admission')} as py_admission,
       {lsum('cy_admission')} - {lsum('py_admission')} as change
from M where dataset_id = 'ds2026' and state in (select member from top5) group by 1
order by change asc, state limit 1
""", "M", extra=[("top5", f"select state as member, {lsum('cy_admission')} as a from M where dataset_id = 'ds2026' "
                          "and state is not null group by 1 order by a desc, member limit 5")]))
def q_biggest_mover(spark, sf_dir):
    m = B.metrics(spark, sf_dir)
    top = Mx.top_members(m, "ds2026", "state", 5)
    return C.biggest_mover(m, "ds2026", "state", top, "decrease")


# ---------------------------------------------------------------- G12
_RANK5 = ("r5", f"select program_name as entity_name, {lsum('cy_admission')} as metric_value from M "
                "where dataset_id = 'ds2026' and program_name is not null group by 1 "
                "order by metric_value desc, entity_name limit 5")


@register("nth_second", with_views("""
select entity_name, metric_value from (select *, row_number() over (order by metric_value desc, entity_name) as rn
  from r5) x where rn = 2""", "M", extra=[_RANK5]))
def q_nth_second(spark, sf_dir):
    r = Mx.ranking(B.metrics(spark, sf_dir), "ds2026", "program_name", "admissions", n=5).drop("has_value")
    return C.nth(r, "second", [("metric_value", "desc"), "entity_name"])


@register("nth_last", with_views("""
select entity_name, metric_value from (select *, row_number() over (order by metric_value desc, entity_name) as rn
  from r5) x where rn = 5""", "M", extra=[_RANK5]))
def q_nth_last(spark, sf_dir):
    r = Mx.ranking(B.metrics(spark, sf_dir), "ds2026", "program_name", "admissions", n=5).drop("has_value")
    return C.nth(r, "last", [("metric_value", "desc"), "entity_name"])


# ---------------------------------------------------------------- H1
_H1_NAMES = ["asia", "ASIA", "Brand#25", "nation_7", "zz"]


@register("match_member", with_views("""
select name, position, dimension, member, tier from (
  select *, row_number() over (partition by name, dimension order by tier, member) as rn from (
    select n.name, n.position, f.dimension, f.member,
           case when f.member = trim(n.name) then 1 when f.member = upper(trim(n.name)) then 2 else 3 end as tier
    from names n join mem f on lower(f.member) = lower(trim(n.name))) a) b where rn = 1
""", "M", extra=[_names_sql(_H1_NAMES), ("mem", "\nunion all\n".join(
    f"select distinct '{d}' as dimension, {d} as member from M where dataset_id = 'ds2026' "
    f"and {d} is not null and {d} <> ''" for d in H.RESOLVE_DIMENSIONS))]))
def q_match_member(spark, sf_dir):
    mem = H.distinct_members(B.metrics(spark, sf_dir), "ds2026")
    return H.match_member(_names(spark, _H1_NAMES), mem)


# ---------------------------------------------------------------- H2
_H2_NAMES = ["ASIA", "asia", "nation 7", "brand#2", "MEDIUM", "000000001", "zzz", "  "]


def _resolve_sql(values, fuzzy=False):
    norm = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
    n_norm, m_norm = norm.format(x="trim(n.name)"), norm.format(x="m.member")
    tokens = ("list_transform(list_filter(regexp_split_to_array(m.member, '[^a-zA-Z0-9]'), lambda t: t <> ''), "
              "lambda t: lower(t))")
    cands = f"""
select n.name, 1 as tier, m.dimension, m.member, false as prefix from names n join mem m on m.member = trim(n.name)
union all select n.name, 2, m.dimension, m.member, false from names n join mem m on lower(m.member) = lower(trim(n.name))
union all select n.name, 3, m.dimension, m.member, false from names n join mem m
  on {m_norm} = {n_norm} and {n_norm} <> ''
union all select n.name, 4, m.dimension, m.member, starts_with({m_norm}, {n_norm}) from names n join mem m
  on contains({m_norm}, {n_norm}) and {n_norm} <> ''
union all select n.name, 5, m.dimension, m.member, starts_with({m_norm}, {n_norm}) from names n join mem m
  on list_contains({tokens}, lower(trim(n.name)))
union all select n.name, 6, m.dimension, m.member, starts_with({m_norm}, {n_norm}) from names n join mem m
  on contains(lower(m.member), lower(trim(n.name)))
"""
    cands = f"select *, 0 as share from ({cands}) c0"
    if fuzzy:
        longer = f"greatest(length({m_norm}), length({n_norm}))"
        cands += f"""
union all select n.name, 7, m.dimension, m.member, false, levenshtein({m_norm}, {n_norm}) * 1000000 // {longer}
from names n join mem m on least(length({m_norm}), length({n_norm})) >= 4 and levenshtein({m_norm}, {n_norm}) * 3 <= {longer}
"""
    return with_views("""
select d.name, d.tier, d.resolved, d.dimension, d.value, d.ambiguous, d.n as candidate_count from dec d
union all select n.name, null, false, null, null, false, 0 from names n where n.name not in (select name from dec)
""", "M", extra=[
        _names_sql(values),
        ("mem", "\nunion all\n".join(
            f"select distinct '{d}' as dimension, {d} as member from M where dataset_id = 'ds2026' "
            f"and {d} is not null and {d} <> ''" for d in H.RESOLVE_DIMENSIONS)),
        ("cands", f"select * from ({cands}) c where trim(name) <> ''"),
        ("firsts", "select c.* from cands c join (select name, min(tier * 10000000 + share) as best from cands group by 1) f "
                   "on c.name = f.name and c.tier * 10000000 + c.share = f.best"),
        ("grp", "select name, tier, count(distinct dimension || chr(1) || member) as n, "
                "count(distinct case when prefix then dimension || chr(1) || member end) as np, "
                "arg_min(dimension, dimension || chr(1) || member) filter (where prefix) as pd, "
                "arg_min(member, dimension || chr(1) || member) filter (where prefix) as pm, "
                "arg_min(dimension, dimension || chr(1) || member) as d1, "
                "arg_min(member, dimension || chr(1) || member) as m1 from firsts group by 1, 2"),
        ("dec", "select name, tier, (n = 1 or (tier = 4 and np = 1)) as resolved, "
                "case when n = 1 then d1 when tier = 4 and np = 1 then pd end as dimension, "
                "case when n = 1 then m1 when tier = 4 and np = 1 then pm end as value, "
                "not (n = 1 or (tier = 4 and np = 1)) as ambiguous, n from grp"),
    ])


@register("resolve_members", _resolve_sql(_H2_NAMES))
def q_resolve_members(spark, sf_dir):
    mem = H.distinct_members(B.metrics(spark, sf_dir), "ds2026")
    return H.resolve_members(_names(spark, _H2_NAMES), mem, fuzzy=False)


@register("resolve_member_candidates", _resolve_sql(_H2_NAMES).replace(
    "select d.name, d.tier, d.resolved, d.dimension, d.value, d.ambiguous, d.n as candidate_count from dec d\n"
    "union all select n.name, null, false, null, null, false, 0 from names n where n.name not in (select name from dec)",
    "select distinct name, tier, dimension, member from firsts"))
def q_resolve_member_candidates(spark, sf_dir):
    mem = H.distinct_members(B.metrics(spark, sf_dir), "ds2026")
    return H.resolve_members(_names(spark, _H2_NAMES), mem, fuzzy=False, candidates=True)


_FUZZY_NAMES = ["Brnad#25", "NATOIN_12", "Eurpoe", "qqqq", "Asia", "brand25x"]


@register("resolve_members_fuzzy", _resolve_sql(_FUZZY_NAMES, fuzzy=True))
def q_resolve_members_fuzzy(spark, sf_dir):
    """With the edit-distance tier for names that no other tier finds."""
    mem = H.distinct_members(B.metrics(spark, sf_dir), "ds2026")
    return H.resolve_members(_names(spark, _FUZZY_NAMES), mem)


# ---------------------------------------------------------------- H3
@register("choose_dimension", with_views("""
select min_by(dimension, p) as dimension from (
  select dimension, count(distinct name) as k from (
    select n.name, f.dimension from names n join mem f on lower(f.member) = lower(trim(n.name))) a group by 1) b
  join pref using (dimension) where k = (select count(distinct name) from names)
""", "M", extra=[_names_sql(["nation_1", "NATION_2"]),
                 ("mem", "\nunion all\n".join(
                     f"select distinct '{d}' as dimension, {d} as member from M where dataset_id = 'ds2026' "
                     f"and {d} is not null and {d} <> ''" for d in H.RESOLVE_DIMENSIONS)),
                 ("pref", "select * from (values " + ", ".join(
                     f"('{d}', {i})" for i, d in enumerate(H.RESOLVE_DIMENSIONS)) + ") as p(dimension, p)")]))
def q_choose_dimension(spark, sf_dir):
    mem = H.distinct_members(B.metrics(spark, sf_dir), "ds2026")
    names = _names(spark, ["nation_1", "NATION_2"])
    return H.choose_dimension(H.match_member(names, mem), names)


# ---------------------------------------------------------------- H5
@register("result_members", with_views("""
select member, min(rank) as rank from (
  select member, row_number() over (partition by side order by abs(change) desc, member) as rank from (
    select state as member, cast({c} - {p} as double) as change,
           case when {c} - {p} > 0 then 'positive' else 'negative' end as side
    from M where dataset_id = 'ds2026' and state is not null and trim(state) <> '' group by 1
    having {c} - {p} <> 0) a) b where rank <= 5 group by 1
""".format(c=lsum("cy_admission"), p=lsum("py_admission")), "M"))
def q_result_members(spark, sf_dir):
    mv = C.movers(B.metrics(spark, sf_dir), "ds2026", "state", "admission", 5)
    return H.result_members(mv, "member")


# ---------------------------------------------------------------- H4
@register("dimension_alias", with_views("""
select column_name, case lower(trim(column_name)) """ + " ".join(
    f"when '{k}' then '{v}'" for k, v in H.DIMENSION_ALIASES.items()) + """ end as canonical_column, count(*) as filled_cells
from (""" + "\nunion all\n".join(f"select '{c}' as column_name from M where {c} is not null" for c in
                                 ("dataset_id",) + tuple(B.DIMENSIONS) + tuple(B.MEASURES)) + ") v group by 1, 2", "M", once=("M",)))
def q_dimension_alias(spark, sf_dir):
    """H4 over the columns that hold values in the metrics table, with the cells that each holds."""
    from pyspark.sql import functions as F
    m = B.metrics(spark, sf_dir)
    counts = m.agg(*[F.count(c).alias(c) for c in m.columns])
    cells = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled_cells")) for c in m.columns])).alias("x"))
    return cells.select("x.*").where("filled_cells > 0").select(
        "column_name", H.alias_column(F.col("column_name")).alias("canonical_column"), "filled_cells")
