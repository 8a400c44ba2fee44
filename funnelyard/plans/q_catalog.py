"""Registered catalog, column-mapping and relationship queries."""

from __future__ import annotations

from funnelyard.operators import catalog as Cat
from funnelyard.operators import ingest as A
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.sources import bindings as B
from funnelyard.sources.tables import TABLES, read_table

_TYPE_MAP = ("case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' "
             "when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' "
             "else lower(data_type) end")
_CATALOG = ("cat", "select table_schema, table_name, column_name, " + _TYPE_MAP + " as data_type, "
                   "is_nullable = 'YES' as is_nullable, ordinal_position::int as position "
                   "from information_schema.columns where table_name in ("
            + ", ".join(f"'{t}'" for t in TABLES) + ")")


# The columns of the given tables, for the oracle's counts.
TABLE_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _filled_sql(tables):
    """CTE of (table_name, column_name, filled_count, row_count); ``tables``: name -> (relation, columns)."""
    parts = []
    for name, (relation, columns) in tables.items():
        names, counts = ", ".join(f"'{c}'" for c in columns), ", ".join(f'count("{c}")' for c in columns)
        parts.append(f"select table_name, unnest(names) as column_name, unnest(counts) as filled_count, row_count from ("
                     f"select '{name}' as table_name, [{names}] as names, [{counts}] as counts, count(*) as row_count from {relation}) t_{name}")
    return ("filled", "\nunion all\n".join(parts))


_FILLED = _filled_sql({t: (t, c.split()) for t, c in TABLE_COLUMNS.items()})
_CATALOG = ("cat", "select c.*, f.row_count, f.filled_count from (" + _CATALOG[1] + ") c join filled f using (table_name, column_name)")
_CATALOG = ("cat", _CATALOG[1].replace("select c.*", "select c.table_schema, c.table_name, c.column_name, c.data_type, c.is_nullable, c.position"))


def _catalog(spark, sf_dir):
    return Cat.catalog_from_tables(spark, {t: read_table(spark, sf_dir, t) for t in TABLES})


# ---------------------------------------------------------------- C7
@register("catalog_from_tables", with_views("select * from cat", extra=[_FILLED, _CATALOG]))
def q_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir)


def _columns(spark, sf_dir):
    return Cat.columns_with_values(spark, {t: read_table(spark, sf_dir, t) for t in TABLES})


# ---------------------------------------------------------------- C1
def _rules_sql():
    rows = [(0, i, k, c, conf) for i, (k, c, conf) in enumerate(Cat.EXACT_RULES)]
    rows += [(1, i, k, c, round(conf - Cat.PARTIAL_PENALTY, 2)) for i, (k, c, conf) in enumerate(Cat.EXACT_RULES)]
    rows += [(2, i * 100 + j, kw, c, conf) for i, (kws, c, conf) in enumerate(Cat.KEYWORD_RULES)
             for j, kw in enumerate(kws)]
    vals = ", ".join(f"({t}, {o}, '{k}', '{c}', {conf}::double)" for t, o, k, c, conf in rows)
    return ("rules", f"select * from (values {vals}) as r(tier, rule_order, rule_key, canonical_field, confidence)")


_MAPPED = ("mapped", """
select table_name, original_column, w.canonical_field as canonical_field, coalesce(w.confidence, 0.0) as confidence,
  w.tier is null as is_ambiguous,
  case w.tier when 0 then 'exact_rule' when 1 then 'partial_rule' when 2 then 'keyword' else 'unmapped' end as method
from (select table_name, original_column, arg_min(struct_pack(tier := tier, canonical_field := canonical_field,
        confidence := confidence), [tier, rule_order]) as w, count(tier) as n
      from (select c.table_name, c.column_name as original_column, r.* from (
              select *, lower(trim(column_name)) as cl, trim(regexp_replace(lower(trim(column_name)), '[-_]', ' ', 'g')) as sp
              from cat where filled_count > 0) c
            left join rules r on (r.tier = 0 and c.cl = r.rule_key)
              or (r.tier = 1 and (contains(c.cl, r.rule_key) or contains(r.rule_key, c.cl)))
              or (r.tier = 2 and contains(c.sp, r.rule_key))) j
      group by 1, 2) g""")


@register("map_columns", with_views("select * from mapped", extra=[_FILLED, _CATALOG, _rules_sql(), _MAPPED]))
def q_map_columns(spark, sf_dir):
    return Cat.map_columns(_columns(spark, sf_dir))


# ---------------------------------------------------------------- C2
@register("resolve_canonical", with_views("""
select table_name, canonical_field, arg_min(original_column, (-confidence, original_column)) as original_column,
  max(confidence) as confidence, count(*) as candidates,
  case when arg_min(is_ambiguous, (-confidence, original_column)) then 'ambiguous' else 'resolved' end as status
from mapped where canonical_field is not null group by 1, 2""", extra=[_FILLED, _CATALOG, _rules_sql(), _MAPPED]))
def q_resolve_canonical(spark, sf_dir):
    return Cat.resolve_canonical(Cat.map_columns(_columns(spark, sf_dir)))


# ---------------------------------------------------------------- C5
@register("column_role", with_views("""
select *, case when contains(n, 'date') or contains(n, 'time') then 'date'
  when contains(n, 'status') or n in ('exam status', 'admission status', 'lead status') then 'status'
  when n = 'id' then 'technical_identifier'
  when ends_with(n, ' id') or ends_with(n, ' code') then 'identifier'
  when n in ('program', 'program name', 'campus', 'campus name', 'cluster', 'state', 'state name', 'city',
             'district', 'country', 'source', 'main source', 'lead type', 'owner') then 'dimension'
  when starts_with(data_type, 'tinyint') or starts_with(data_type, 'smallint') or starts_with(data_type, 'int')
    or starts_with(data_type, 'bigint') or starts_with(data_type, 'float') or starts_with(data_type, 'double')
    or starts_with(data_type, 'decimal') then 'numeric'
  else 'attribute' end as role
from (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(column_name)), '[_-]', ' ', 'g'),
        '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) as normalized_name,
        trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(column_name)), '[_-]', ' ', 'g'),
        '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) as n from cat where filled_count > 0) x
""".replace("select *, case", "select table_schema, table_name, column_name, data_type, is_nullable, position, "
            "row_count, filled_count, normalized_name, case"), extra=[_FILLED, _CATALOG]))
def q_column_role(spark, sf_dir):
    return Cat.column_role(Cat.filled(_catalog(spark, sf_dir)))


# ---------------------------------------------------------------- C4
def _list_str(x):
    return f"array_to_string(list_transform({x}, lambda v: coalesce(v, 'NULL')), '|')"


@register("build_catalog", with_views(f"""
select dataset_id, column_name, case when count(value) = 0 then 'unknown'
    when count(*) filter (where kind = 'int') = count(value) then 'int'
    when count(*) filter (where kind in ('int', 'float')) = count(value) then 'float'
    when count(*) filter (where kind = 'bool') = count(value) then 'bool' else 'str' end as data_type,
  {_list_str('list(value order by row_number)[1:20]')} as samples,
  {_list_str('list(value order by row_number)[1:5]')} as sample_values
from (select dataset_id, row_number, k as column_name, v as value,
        case when v is null then null when regexp_full_match(v, '-?\\d+') then 'int' when regexp_full_match(v, '-?\\d+\\.\\d+') then 'float'
             when v in ('true', 'false') then 'bool' else 'str' end as kind
      from (select dataset_id, row_number, unnest(['row_number', 'name', 'email', 'segment', 'amount']) as k,
              unnest([cast(rn0 as varchar), name, email, segment, amount]) as v
            from (select *, row_number as rn0, row_number() over (partition by dataset_id order by row_number) as rnk
                  from (select {'coalesce(nullif(trim(segment), ' + chr(39) * 2 + '), ' + chr(39) + 'BLANK' + chr(39) + ')'} as dataset_id, * from C) c0) c1
            ) kv0
      ) kv
group by 1, 2""".replace("select dataset_id, row_number, unnest", "select dataset_id, rnk as row_number, unnest"), "C"))
def q_build_catalog(spark, sf_dir):
    from pyspark.sql import functions as F
    c = B.dirty_records(spark, sf_dir)
    ds = F.coalesce(F.nullif(F.trim("segment"), F.lit("")), F.lit("BLANK"))
    out = Cat.build_catalog(A.stage_records(c, ds, ["row_number"]))
    return out.select("dataset_id", "column_name", "data_type",
                      F.array_join("samples", "|", "NULL").alias("samples"),
                      F.array_join("sample_values", "|", "NULL").alias("sample_values"))


# ---------------------------------------------------------------- C8
def _event_views(spark, sf_dir):
    return {"e_leads": B.lead_events(spark, sf_dir), "e_registrations": B.registration_events(spark, sf_dir),
            "e_admissions": B.admission_events(spark, sf_dir), "turns": B.turns(spark, sf_dir),
            "dirty_records": B.dirty_records(spark, sf_dir)}


_LINKS = with_views("""
select 'lead_id' as relationship_key, r.t as left_table, 'lead_id' as left_column, s.t as right_table, 'lead_id' as right_column,
  0.9::double as confidence, r.n as left_row_count, s.n as right_row_count, r.d as left_distinct, s.d as right_distinct, m as matching_values,
  r.d - m as left_unmatched, s.d - m as right_unmatched, cast(s4 as double) / 10000 as validation_score,
  case when s4 >= 8000 then 'verified' when s4 >= 5000 then 'possible' else 'rejected' end as status
from (select s.t, s.n, s.d, coalesce(x.m, 0) as m,
        case when least(s.d, r.d) = 0 then 0 else least(10000, (coalesce(x.m, 0) * 20000 + least(s.d, r.d)) // (2 * least(s.d, r.d))) end as s4
      from sizes s cross join ref r left join (
        select v.t, count(*) as m from vals v join (select value from vals where t = (select t from ref)) w using (value) group by 1) x on x.t = s.t
      where s.t <> r.t) s
cross join ref r""", "E_leads", "E_reg", "E_adm", extra=[
    ("vals", "select t, value, count(*) as n from (select 'e_leads' as t, lead_id as value from E_leads union all "
             "select 'e_registrations', lead_id from E_reg union all select 'e_admissions', lead_id from E_adm) a "
             "where value is not null group by 1, 2"),
    ("sizes", "select t, count(*) as d, cast(sum(n) as bigint) as n from vals group by 1"),
    ("ref", "select t, d, n from sizes order by d desc, t limit 1")], once=("vals", "sizes", "ref"))


@register("discover_relationships", _LINKS)
def q_discover_relationships(spark, sf_dir):
    return Cat.discover_relationships(_event_views(spark, sf_dir))


# ---------------------------------------------------------------- C9
_PAIRS = (("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
          ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
          ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
          ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
          ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
          ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
          ("supplier_customer_key", "supplier", "s_suppkey", "customer", "c_custkey"))


def _validate_sql(pid, lt, lc, rt, rc):
    return f"""
select '{pid}' as pair, (select count(*) from {lt}) as left_row_count, (select count(*) from {rt}) as right_row_count,
  ld as left_distinct, rd as right_distinct, m as matching_values, ld - m as left_unmatched, rd - m as right_unmatched,
  cast(s4 as double) / 10000 as validation_score,
  case when s4 >= 8000 then 'verified' when s4 >= 5000 then 'possible' else 'rejected' end as status
from (select ld, rd, m, case when least(ld, rd) = 0 then 0
        else least(10000, (m * 20000 + least(ld, rd)) // (2 * least(ld, rd))) end as s4
      from (select (select count(distinct {lc}) from {lt}) as ld, (select count(distinct {rc}) from {rt}) as rd,
                   (select count(*) from (select distinct {lc} as v from {lt} where {lc} is not null) l
                    join (select distinct {rc} as v from {rt} where {rc} is not null) r using (v)) as m) a) b"""


@register("validate_relationships", "\nunion all\n".join(_validate_sql(*p) for p in _PAIRS))
def q_validate_relationships(spark, sf_dir):
    return Cat.validate_relationships([(pid, read_table(spark, sf_dir, lt), lc, read_table(spark, sf_dir, rt), rc)
                                       for pid, lt, lc, rt, rc in _PAIRS])


# Pairs of columns whose values have little or nothing in common, beside the true ones.
_OTHER_PAIRS = [("customer-supplier names", "customer", "c_name", "supplier", "s_name"), ("nation-region names", "nation", "n_name", "region", "r_name"),
                ("priority-segment", "orders", "o_orderpriority", "customer", "c_mktsegment"), ("lineitem-nation", "lineitem", "l_orderkey", "nation", "n_nationkey")]


@register("screen_relationships", "select * from (" + "\nunion all\n".join(_validate_sql(*p) for p in [*_PAIRS, *_OTHER_PAIRS]) + ") v where status <> 'rejected'")
def q_screen_relationships(spark, sf_dir):
    """True and unlikely pairs: sketches leave out those that can't be related, the others are matched exactly."""
    return Cat.screen_relationships([(pid, read_table(spark, sf_dir, lt), lc, read_table(spark, sf_dir, rt), rc)
                                     for pid, lt, lc, rt, rc in [*_PAIRS, *_OTHER_PAIRS]]).where("status <> 'rejected'")


@register("validate_discovered_relationships", f"select left_table, right_table, relationship_key, validation_score, status from ({_LINKS}) l where status = 'verified'")
def q_validate_discovered(spark, sf_dir):
    """The links that their values verify."""
    links = Cat.discover_relationships(_event_views(spark, sf_dir))
    return links.where("status = 'verified'").select("left_table", "right_table", "relationship_key", "validation_score", "status")


# ---------------------------------------------------------------- C3
from funnelyard.operators import semantics as S  # noqa: E402

_VIEW_COLUMNS = {
    "metrics": ("dataset_id",) + tuple(B.DIMENSIONS) + tuple(B.MEASURES),
    "dirty_records": ("row_number", "name", "email", "segment", "amount"),
    "turns": ("message_id", "conv_id", "turn", "question", "answer", "eval_status", "eval_error_category"),
}


def _semantic_catalog(spark, sf_dir):
    tables = {t: read_table(spark, sf_dir, t) for t in TABLES}
    tables.update({"metrics": B.metrics(spark, sf_dir), "dirty_records": B.dirty_records(spark, sf_dir),
                   "turns": B.turns(spark, sf_dir)})
    return Cat.columns_with_values(spark, tables)


def _norm_sql(x):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[_-]', ' ', 'g'), "
            f"'[^a-z0-9% ]+', ' ', 'g'), '\\s+', ' ', 'g'))")


def _tok_sql(x):
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: length(t) > 1))"


def _c3_sql():
    syn = ", ".join(f"({i}, '{k}', '{d}', '{c}', '{S.ROLE_OF_CATEGORY.get(c, 'unknown')}', '{s}')"
                    for i, (k, d, c, syns) in enumerate(S.CONCEPTS) for s in syns)
    cols = ("select table_name, column_name from information_schema.columns where table_name in ("
            + ", ".join(f"'{t}'" for t in TABLES) + ") union all select * from (values "
            + ", ".join(f"('{t}', '{c}')" for t, cs in _VIEW_COLUMNS.items() for c in cs) + ") v(table_name, column_name)")
    cols = f"select a.table_name, a.column_name from ({cols}) a join filled f using (table_name, column_name) where f.filled_count > 0"
    views = {"metrics": ("M", _VIEW_COLUMNS["metrics"]), "dirty_records": ("C", _VIEW_COLUMNS["dirty_records"]), "turns": ("T", _VIEW_COLUMNS["turns"])}
    held = _filled_sql({t: (t, c.split()) for t, c in TABLE_COLUMNS.items()} | views)
    rule = ("case when regexp_matches(r, '\\bcy\\b') and contains(r, 'lead') and contains(r, 'admission') and contains(r, '%') "
            "then 'lead_admission_rate|current_year' "
            "when regexp_matches(r, '\\bcy\\b') and contains(r, 'lead') and contains(r, 'cucet') and contains(r, '%') "
            "then 'lead_cucet_rate|current_year' "
            "when regexp_matches(r, '\\bcy\\b') and contains(r, 'cucet') and contains(r, 'admission') and contains(r, '%') "
            "then 'cucet_admission_rate|current_year' "
            "when contains(r, 'lead') and regexp_matches(r, '\\bpy\\b') then 'leads|previous_year' "
            "when contains(r, 'lead') and regexp_matches(r, '\\bcy\\b') then 'leads|current_year' "
            "when contains(r, 'cucet') and regexp_matches(r, '\\bpy\\b') then 'cucet|previous_year' "
            "when contains(r, 'cucet') and regexp_matches(r, '\\bcy\\b') then 'cucet|current_year' "
            "when (contains(r, 'admission') or regexp_matches(r, '\\badm\\b')) and regexp_matches(r, '\\bpy\\b') "
            "then 'admission|previous_year' "
            "when (contains(r, 'admission') or regexp_matches(r, '\\badm\\b')) and regexp_matches(r, '\\bcy\\b') "
            "then 'admission|current_year' end")
    tctx = ("case when regexp_matches(r, '\\bpy\\b') then 'previous_year' when regexp_matches(r, '\\bcy\\b') "
            "then 'current_year' when regexp_extract(r, '\\b(20\\d{2})\\b', 1) <> '' "
            "then regexp_extract(r, '\\b(20\\d{2})\\b', 1) end")
    score = ("case when c.n = s.sn then 1.0 when len(s.st) > 0 and list_has_all(c.tok, s.st) then "
             "(case when len(s.st) > 1 then 0.95 else 0.90 end) when len(c.tok) > 0 and len(s.st) > 0 and "
             "len(list_intersect(c.tok, s.st)) / len(s.st) >= 0.5 then len(list_intersect(c.tok, s.st)) / len(s.st) * 0.70 "
             "else 0.0 end")
    return with_views(f"""
select table_name, column_name, concept_key, display_name, category, data_role, score, time_context, rank from (
  select c.table_name, c.column_name, k.concept_key, k.display_name, k.category, 'metric' as data_role, 1.0::double as score,
         split_part(c.rule, '|', 2) as time_context, 1 as rank
  from cc c join (select distinct concept_key, display_name, category from syn) k on k.concept_key = split_part(c.rule, '|', 1)
  where c.rule is not null
  union all
  select table_name, column_name, concept_key, display_name, category, data_role, round(score, 4), time_context, rank from (
    select *, row_number() over (partition by table_name, column_name order by score desc, concept_order) as rank,
           max(case when score = 1.0 then 1 else 0 end) over (partition by table_name, column_name) as ex from (
      select c.table_name, c.column_name, c.tctx as time_context, s.concept_order, s.concept_key, s.display_name,
             s.category, s.data_role, max({score})::double as score
      from cc c, (select *, {_norm_sql('synonym')} as sn, {_tok_sql(_norm_sql('synonym'))} as st from syn) s
      where c.rule is null group by all) x where score >= 0.70) y
  where (ex = 1 and rank = 1) or (ex = 0 and rank <= 5)) z
""", "M", "C", "T", extra=[held, ("syn", f"select * from (values {syn}) as s(concept_order, concept_key, display_name, category, data_role, synonym)"),
            ("cat0", cols),
            ("cc", f"select table_name, column_name, r, n, {_tok_sql('n')} as tok, {rule} as rule, {tctx} as tctx from ("
                   f"select table_name, column_name, lower(trim(column_name)) as r, {_norm_sql('column_name')} as n from cat0) q")])


@register("infer_semantics", _c3_sql())
def q_infer_semantics(spark, sf_dir):
    return S.infer_semantics(_semantic_catalog(spark, sf_dir)).drop("data_type")


# ---------------------------------------------------------------- C6
_PHYS_TABLES = {"enquiries": (("lead_id", "bigint"), ("main_source", "string"), ("source", "string"),
                              ("event_date", "date")),
                "cucet_registrations": (("lead_id", "bigint"), ("event_date", "date")),
                "admissions": (("lead_id", "bigint"), ("event_date", "date")),
                "uploaded_metrics": (("dataset_id", "string"),) + tuple((d, "string") for d in B.DIMENSIONS)
                + tuple((m, "bigint") for m in B.MEASURES)}


_PHYS_SOURCES = {"enquiries": "E_leads", "cucet_registrations": "E_reg", "admissions": "E_adm", "uploaded_metrics": "M"}


def _c6_sql():
    cat = ", ".join(f"('{t}', '{c}', '{ty}', {i + 1})" for t, cs in _PHYS_TABLES.items()
                    for i, (c, ty) in enumerate(cs))
    prof = ", ".join(f"('{c}', '{k}', '{n}')" for c, p in S.PHYSICAL_PROFILES.items() for k, ns in p.items() for n in ns)
    nn = ("trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[_-]', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), "
          "' +', ' ', 'g'))")
    role = ("case when contains(nc, 'date') or contains(nc, 'time') then 'date' "
            "when contains(nc, 'status') or nc in ('exam status', 'admission status', 'lead status') then 'status' "
            "when nc = 'id' then 'technical_identifier' when ends_with(nc, ' id') or ends_with(nc, ' code') then 'identifier' "
            "when nc in ('program', 'program name', 'campus', 'campus name', 'cluster', 'state', 'state name', 'city', "
            "'district', 'country', 'source', 'main source', 'lead type', 'owner') then 'dimension' "
            "when data_type in ('bigint', 'int', 'smallint', 'tinyint', 'double', 'float') then 'numeric' "
            "else 'attribute' end")
    return with_views(f"""
select concept_key, table_schema, table_name, column_name, column_role, data_type, confidence, rank from (
  select *, row_number() over (partition by concept_key order by confidence desc,
     case column_role when 'entity' then 3 when 'date' then 2 when 'status' then 1 else 0 end desc,
     table_name, position, column_role) as rank
  from (select distinct concept_key, table_schema, table_name, column_name, column_role, data_type, position,
          round(least(1.0, (case when tmatch then 0.5 else 0.0 end) +
                (case when exists (select 1 from prof p where p.concept_key = x.concept_key and p.kind =
                  (case when x.column_role in ('entity', 'date', 'status') then x.column_role else 'columns' end)
                  and p.name = x.nc) then 0.5 else 0.0 end)), 4)::double as confidence
        from (
          select p.concept_key, 'main' as table_schema, c.table_name, c.column_name, c.data_type, c.position, c.nc,
                 r.role as column_role, true as tmatch
          from cat c join prof p on p.kind = 'table' and p.name = c.nt
            and p.concept_key in ('leads', 'cucet', 'admission')
          cross join (values ('entity'), ('date'), ('status')) r(role)
          union all
          select k.concept_key, 'main', c.table_name, c.column_name, c.data_type, c.position, c.nc, c.inferred,
                 exists (select 1 from prof p where p.kind = 'table' and p.concept_key = k.concept_key and p.name = c.nt)
          from cat c cross join (values ('program'), ('campus'), ('state')) k(concept_key)) x) y
  where confidence >= 0.5) z where rank <= 10
""", "E_leads", "E_reg", "E_adm", "M", extra=[("prof0", f"select * from (values {prof}) as p(concept_key, kind, name0)"),
            ("prof", f"select distinct concept_key, kind, {nn.format(x='name0')} as name from prof0"),
            _filled_sql({t: (_PHYS_SOURCES[t], [c for c, _ in cs]) for t, cs in _PHYS_TABLES.items()}),
            ("cat1", f"select c.* from (values {cat}) as c(table_name, column_name, data_type, position) "
                     "join filled f on f.table_name = c.table_name and f.column_name = c.column_name where f.filled_count > 0"),
            ("cat", f"select *, {role} as inferred from (select *, {nn.format(x='table_name')} as nt, "
                    f"{nn.format(x='column_name')} as nc from cat1) q")])


@register("map_physical", _c6_sql())
def q_map_physical(spark, sf_dir):
    views = {"enquiries": B.lead_events(spark, sf_dir), "cucet_registrations": B.registration_events(spark, sf_dir),
             "admissions": B.admission_events(spark, sf_dir), "uploaded_metrics": B.metrics(spark, sf_dir)}
    return S.map_physical(Cat.columns_with_values(spark, views))
