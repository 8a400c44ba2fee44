"""Registered period-registry queries (D1-D16) on the registry view R."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelyard.functions.ordinal import ordinal_within
from funnelyard.operators import periods as D
from funnelyard.plans.oracle_views import with_views
from funnelyard.plans.registry import register
from funnelyard.sources import bindings as B
from funnelyard.sources.tables import read_table

R_COLS = ("dataset_id, dataset_name, original_filename, label, start_year, end_year, created_seq, "
          "quality_score, upload_version, is_period_active")


def _r(spark, sf_dir):
    return B.registry(spark, sf_dir)


def _rg(spark, sf_dir):
    """R with a global active flag: the newest non-benchmark dataset."""
    r = _r(spark, sf_dir)
    newest = r.filter(~D.is_benchmark("dataset_name")).agg(F.max("dataset_id").alias("_a"))
    return r.crossJoin(F.broadcast(newest)).withColumn(
        "is_active", F.col("dataset_id") == F.col("_a")).drop("_a")


_RG = ("RG", "select *, dataset_id = (select max(dataset_id) from R where not regexp_matches(dataset_name, "
             "'^(Bench_|benchmark_|test_|synthetic_)', 'i')) as is_active from R")


def _nz_sql(expr):
    return f"nullif({expr}, '')"


# ---------------------------------------------------------------- D1
@register("label_years", with_views("""
select label, cast(start_year as integer) as start_year, cast(end_year as integer) as end_year,
       concat(cast(start_year as varchar), '-', right(cast(end_year as varchar), 2)) as round_trip
from (select distinct label, cast(regexp_extract(label, '^(20\\d{2})-(\\d{2})$', 1) as integer) as start_year,
        cast(regexp_extract(label, '^(20\\d{2})-(\\d{2})$', 1) as integer) // 100 * 100
          + cast(regexp_extract(label, '^(20\\d{2})-(\\d{2})$', 2) as integer) as e0 from R) x,
     lateral (select case when e0 <= start_year then e0 + 100 else e0 end as end_year) y
""", "R"))
def q_label_years(spark, sf_dir):
    lab = _r(spark, sf_dir).select("label").distinct()
    p = D.label_years("label")
    return lab.select("label", p.getField("start_year").alias("start_year"),
                      p.getField("end_year").alias("end_year"),
                      D.year_label(p.getField("start_year"), p.getField("end_year")).alias("round_trip"))


# ---------------------------------------------------------------- D2
def _detect_sql(col):
    a1 = f"{_nz_sql(f'regexp_extract({col}, {chr(39)}(^|[^0-9])(20[0-9]{{2}})[-_]([0-9]{{2}})([^0-9]|$){chr(39)}, 2)')}"
    return f"""
select *, case when a1 is not null then a1 when b1 is not null and b2 = b1 + 1 then b1 when c1 is not null then c1 - 1 end as start_year,
  case when a1 is not null then (case when a1 // 100 * 100 + a2 <= a1 then a1 // 100 * 100 + a2 + 100 else a1 // 100 * 100 + a2 end)
       when b1 is not null and b2 = b1 + 1 then b2 when c1 is not null then c1 end as end_year,
  case when a1 is not null or (b1 is not null and b2 = b1 + 1) then 0.95::double when c1 is not null then 0.6::double else 0.0::double end as confidence,
  case when a1 is not null or b1 is not null and b2 = b1 + 1 or c1 is not null then 'filename' else 'none' end as method
from (select *, cast({a1} as integer) as a1,
  cast(nullif(regexp_extract({col}, '(^|[^0-9])(20[0-9]{{2}})[-_]([0-9]{{2}})([^0-9]|$)', 3), '') as integer) as a2,
  cast(nullif(regexp_extract({col}, '(^|[^0-9])(20[0-9]{{2}})[-_](20[0-9]{{2}})([^0-9]|$)', 2), '') as integer) as b1,
  cast(nullif(regexp_extract({col}, '(^|[^0-9])(20[0-9]{{2}})[-_](20[0-9]{{2}})([^0-9]|$)', 3), '') as integer) as b2,
  cast(nullif(regexp_extract({col}, '(^|[^0-9])(20[0-9]{{2}})([^0-9]|$)', 2), '') as integer) as c1
  from src) d"""


def _uploads(spark, sf_dir):
    """New uploads derived from ``customer``: file names in several styles."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    y = (F.lit(2015) + n % 9)
    name = (F.when(k % 4 == 0, F.concat(F.col("c_name"), F.lit("_"), y.cast("string"), F.lit("-"),
                                        F.substring((y + 1).cast("string"), 3, 2), F.lit(".csv")))
            .when(k % 4 == 1, F.concat(F.lit("Report_"), y.cast("string"), F.lit("-"), (y + 1).cast("string"),
                                       F.lit(".csv")))
            .when(k % 4 == 2, F.concat(F.lit("Admissions_"), y.cast("string"), F.lit(".xlsx")))
            .otherwise(F.concat(F.lit("Data - Dump "), F.col("c_name"), F.lit(".csv"))))
    return c.select((k + 10_000_000).alias("dataset_id"), F.col("c_name").alias("dataset_name"),
                    name.alias("original_filename"), (k + 10_000_000).alias("created_seq"))


_UPLOADS_SQL = """
select c_custkey + 10000000 as dataset_id, c_name as dataset_name,
  case when c_custkey % 4 = 0 then concat(c_name, '_', cast(2015 + c_nationkey % 9 as varchar), '-',
         substr(cast(2016 + c_nationkey % 9 as varchar), 3, 2), '.csv')
       when c_custkey % 4 = 1 then concat('Report_', cast(2015 + c_nationkey % 9 as varchar), '-',
         cast(2016 + c_nationkey % 9 as varchar), '.csv')
       when c_custkey % 4 = 2 then concat('Admissions_', cast(2015 + c_nationkey % 9 as varchar), '.xlsx')
       else concat('Data - Dump ', c_name, '.csv') end as original_filename,
  c_custkey + 10000000 as created_seq
from customer"""


@register("detect_period_from_name", with_views(
    "select dataset_id, dataset_name, original_filename, created_seq, start_year, end_year, "
    "case when start_year is null then null else concat(cast(start_year as varchar), '-', "
    "right(cast(end_year as varchar), 2)) end as label, confidence, method from (" + _detect_sql("original_filename")
    + ") z", extra=[("src", _UPLOADS_SQL)]))
def q_detect_period(spark, sf_dir):
    return D.detect_period(_uploads(spark, sf_dir), "original_filename")


# ---------------------------------------------------------------- D3
def _staged_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    key = F.when(F.col("event_type") == "view", F.concat(F.lit("value "), F.year("ts").cast("string"))) \
        .otherwise(F.lit("value"))
    raw = F.to_json(F.create_map(F.lit("event_id"), F.col("event_id").cast("string"),
                                 F.lit("ts"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                                 key, F.col("value").cast("string")))
    staged = ev.select(F.col("event_type").alias("dataset_id"), "event_id", raw.alias("raw_data"))
    return ordinal_within(staged, ["dataset_id"], ["event_id"], name="row_number")


def _event_files(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_type").distinct()
    name = (F.when(F.col("event_type") == "signup", F.lit("signup_2023-24.csv"))
            .when(F.col("event_type") == "click", F.lit("click_2025.csv"))
            .otherwise(F.concat(F.col("event_type"), F.lit("_export.csv"))))
    return ev.select(F.col("event_type").alias("dataset_id"), name.alias("original_filename"))


_D3_SQL = with_views("""
select f.dataset_id, f.original_filename,
  case when f.confidence >= 0.7 then f.start_year
       when h.conf is not null and h.conf > coalesce(f.confidence, 0) then h.s
       when v.yr is not null and 0.55 > coalesce(f.confidence, 0) then v.yr - 1 else f.start_year end as start_year,
  case when f.confidence >= 0.7 then f.end_year
       when h.conf is not null and h.conf > coalesce(f.confidence, 0) then h.e
       when v.yr is not null and 0.55 > coalesce(f.confidence, 0) then v.yr else f.end_year end as end_year,
  case when f.confidence >= 0.7 then f.label
       when h.conf is not null and h.conf > coalesce(f.confidence, 0) then concat(cast(h.s as varchar), '-', right(cast(h.e as varchar), 2))
       when v.yr is not null and 0.55 > coalesce(f.confidence, 0) then concat(cast(v.yr - 1 as varchar), '-', right(cast(v.yr as varchar), 2))
       else f.label end as label,
  case when f.confidence >= 0.7 then f.confidence
       when h.conf is not null and h.conf > coalesce(f.confidence, 0) then h.conf
       when v.yr is not null and 0.55 > coalesce(f.confidence, 0) then 0.55::double else coalesce(f.confidence, 0.0::double) end as confidence,
  case when f.confidence >= 0.7 then f.method
       when h.conf is not null and h.conf > coalesce(f.confidence, 0) then 'column_header'
       when v.yr is not null and 0.55 > coalesce(f.confidence, 0) then 'data_value' else coalesce(f.method, 'none') end as method
from fdet f left join hdr h using (dataset_id) left join vals v using (dataset_id)
""", extra=[
    ("files", "select distinct event_type as dataset_id, case when event_type = 'signup' then 'signup_2023-24.csv' "
              "when event_type = 'click' then 'click_2025.csv' else concat(event_type, '_export.csv') end "
              "as original_filename from events"),
    ("src", "select * from files"),
    ("fdet0", _detect_sql("original_filename")),
    ("fdet", "select dataset_id, original_filename, start_year, end_year, case when start_year is null then null "
             "else concat(cast(start_year as varchar), '-', right(cast(end_year as varchar), 2)) end as label, "
             "case when start_year is null then null else confidence end as confidence, "
             "case when start_year is null then null else method end as method from fdet0"),
    ("staged", "select event_type as dataset_id, row_number() over (partition by event_type order by event_id) as rn, "
               "event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_s, value, "
               "case when event_type = 'view' then concat('value ', cast(year(ts) as varchar)) else 'value' end as vkey "
               "from events"),
    ("kv", "select dataset_id, rn, 'event_id' as k, cast(event_id as varchar) as v from staged "
           "union all select dataset_id, rn, 'ts', ts_s from staged "
           "union all select dataset_id, rn, vkey, cast(value as varchar) from staged"),
    ("hdr0", "select dataset_id, "
             "cast(nullif(regexp_extract(k, '\\b(20\\d{2})[-_](\\d{2})\\b', 1), '') as integer) as r1, "
             "cast(nullif(regexp_extract(k, '\\b(20\\d{2})[-_](\\d{2})\\b', 2), '') as integer) as r2, "
             "cast(nullif(regexp_extract(k, '\\b(20\\d{2})\\b', 1), '') as integer) as y1 from (select distinct dataset_id, k from kv) x"),
    ("hdr", "select dataset_id, min(case when r1 is not null then 0 else 1 end) as tier, "
            "arg_min(case when r1 is not null then r1 else y1 - 1 end, (case when r1 is not null then 0 else 1 end) * 100000 + "
            "case when r1 is not null then r1 else y1 - 1 end) as s, "
            "arg_min(case when r1 is not null then (case when r1 // 100 * 100 + r2 <= r1 then r1 // 100 * 100 + r2 + 100 "
            "else r1 // 100 * 100 + r2 end) else y1 end, (case when r1 is not null then 0 else 1 end) * 100000 + "
            "case when r1 is not null then r1 else y1 - 1 end) as e, "
            "case when min(case when r1 is not null then 0 else 1 end) = 0 then 0.8::double else 0.65::double end as conf "
            "from hdr0 where r1 is not null or y1 is not null group by 1"),
    ("vals", "select dataset_id, arg_min(yr, -n * 100000 + yr) as yr from (select dataset_id, yr, count(*) as n from ("
             "select dataset_id, cast(nullif(regexp_extract(v, '\\b(20\\d{2})\\b', 1), '') as integer) as yr from kv) a "
             "where yr is not null group by 1, 2) b group by 1"),
])


@register("detect_period_full", _D3_SQL)
def q_detect_period_full(spark, sf_dir):
    return D.detect_period_full(_event_files(spark, sf_dir), _staged_events(spark, sf_dir))


# ---------------------------------------------------------------- D15 (sources)
@register("orphan_sources", with_views("""
select s_suppkey as source_id, s_name as source_name from supplier where s_suppkey not in (
  select source_id from (select case when dataset_id % 7 = 0 then null else dataset_id * 3 % 100 end as source_id from R) u
  where source_id is not null)""", "R"))
def q_orphan_sources(spark, sf_dir):
    sources = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    reg = B.registry(spark, sf_dir).withColumn(
        "source_id", F.when(F.col("dataset_id") % 7 != 0, F.col("dataset_id") * 3 % 100))
    return D.orphan_sources(sources, reg)


# ---------------------------------------------------------------- D4
def _unlabelled(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    y = F.lit(2018) + F.col("p_size") % 8
    name = (F.when(F.col("p_size") % 5 == 0, F.lit("upload.csv"))
            .when(F.col("p_size") % 4 == 0, F.concat(F.lit("upload "), y.cast("string"), F.lit("-"),
                                                    (F.lit(19) + F.col("p_size") % 8).cast("string"), F.lit(".csv")))
            .when(F.col("p_size") % 4 == 1, F.concat(F.lit("upload "), y.cast("string"), F.lit("-"),
                                                    (y + 1).cast("string"), F.lit(".csv")))
            .when(F.col("p_size") % 4 == 2, F.concat(F.lit("upload "), y.cast("string"), F.lit(".csv")))
            .otherwise(F.concat(F.lit("upload "), y.cast("string"), F.lit(" final.csv"))))
    return part.select(F.col("p_partkey").alias("dataset_id"), F.col("p_name").alias("dataset_name"),
                       name.alias("original_filename"), F.lit(None).cast("string").alias("label"),
                       F.lit(None).cast("int").alias("start_year"), F.lit(None).cast("int").alias("end_year"),
                       F.lit(None).cast("int").alias("upload_version"))


@register("backfill_periods", with_views("""
select dataset_id, dataset_name, original_filename,
  case when r1 is not null then concat(cast(r1 as varchar), '-', r1s)
       when r2 is not null then concat(cast(r2 as varchar), '-', right(cast(r2e as varchar), 2))
       when r3 is not null then concat(cast(r3 - 1 as varchar), '-', right(cast(r3 as varchar), 2))
       else '2025-26' end as label,
  case when r1 is not null then r1 when r2 is not null then r2 when r3 is not null then r3 - 1 else 2025 end as start_year,
  case when r1 is not null then r1 + 1 when r2 is not null then r2e when r3 is not null then r3 else 2026 end as end_year,
  1 as upload_version, true as backfilled
from (select *,
  cast(nullif(regexp_extract(original_filename, '(20\\d{2})[-_](2[0-9])\\b', 1), '') as integer) as r1,
  nullif(regexp_extract(original_filename, '(20\\d{2})[-_](2[0-9])\\b', 2), '') as r1s,
  cast(nullif(regexp_extract(original_filename, '(20\\d{2})[-_](20\\d{2})\\b', 1), '') as integer) as r2,
  cast(nullif(regexp_extract(original_filename, '(20\\d{2})[-_](20\\d{2})\\b', 2), '') as integer) as r2e,
  cast(nullif(regexp_extract(original_filename, '\\b(20\\d{2})\\b', 1), '') as integer) as r3
  from (select p_partkey as dataset_id, p_name as dataset_name,
    case when p_size % 5 = 0 then 'upload.csv'
         when p_size % 4 = 0 then concat('upload ', cast(2018 + p_size % 8 as varchar), '-', cast(19 + p_size % 8 as varchar), '.csv')
         when p_size % 4 = 1 then concat('upload ', cast(2018 + p_size % 8 as varchar), '-', cast(2019 + p_size % 8 as varchar), '.csv')
         when p_size % 4 = 2 then concat('upload ', cast(2018 + p_size % 8 as varchar), '.csv')
         else concat('upload ', cast(2018 + p_size % 8 as varchar), ' final.csv') end as original_filename
    from part) p) x
"""))
def q_backfill(spark, sf_dir):
    return D.backfill_periods(_unlabelled(spark, sf_dir), 2026)


# ---------------------------------------------------------------- D5
def _shifted_candidates(r):
    s = F.col("start_year") + 1
    return r.select(F.col("dataset_id").alias("new_id"),
                    D.year_label(s, s + 1).alias("label"))


_CAND_SQL = ("cand", "select dataset_id as new_id, concat(cast(start_year + 1 as varchar), '-', "
                     "right(cast(start_year + 2 as varchar), 2)) as label from R")


@register("period_conflicts", with_views("""
select c.new_id, c.label, s.n is not null as has_conflict, s.ds as existing_dataset_id, s.v as existing_version,
       s.act as existing_is_active, coalesce(s.maxv + 1, 1) as next_version,
       case when s.n is not null then ['cancel', 'replace', 'new_version'] else []::varchar[] end as allowed_actions
from cand c left join (select label, count(*) as n, max(upload_version) as maxv,
    arg_max(dataset_id, cast(is_period_active as integer) * 1000000 + upload_version) as ds,
    arg_max(upload_version, cast(is_period_active as integer) * 1000000 + upload_version) as v,
    arg_max(is_period_active, cast(is_period_active as integer) * 1000000 + upload_version) as act
  from R group by 1) s using (label)
""", "R", extra=[_CAND_SQL]))
def q_period_conflicts(spark, sf_dir):
    r = _r(spark, sf_dir)
    return D.period_conflicts(_shifted_candidates(r), r)


# ---------------------------------------------------------------- D6
@register("session_overlaps", with_views("""
select c.candidate_label, e.existing_label,
       list_sort(list_intersect(range(c.s, c.e + 1), range(e.s, e.e + 1)))::INTEGER[] as overlapping_years, e.existing_versions, e.first_dataset_id
from (select distinct label as candidate_label, cast(left(label, 4) as integer) as s,
        cast(left(label, 4) as integer) + 1 as e from cand) c
join (select label as existing_label, start_year as s, end_year as e, count(*) as existing_versions,
        min(dataset_id) as first_dataset_id from R group by all) e
  on c.s <= e.e and e.s <= c.e and lower(e.existing_label) <> lower(c.candidate_label)
""", "R", extra=[_CAND_SQL]))
def q_session_overlaps(spark, sf_dir):
    r = _r(spark, sf_dir)
    return D.session_overlaps(_shifted_candidates(r), r)


# ---------------------------------------------------------------- D7
def _activate_sql(action):
    act_col = ("case when dataset_id = 1 then true when label = (select label from RG where dataset_id = 1) "
               "then false else is_period_active end")
    ver = ("case when dataset_id = 1 then coalesce((select max(upload_version) from RG where label = "
           "(select label from RG where dataset_id = 1) and dataset_id <> 1), 0) + 1 else upload_version end")
    glob = ("case when label = (select label from RG where dataset_id = 1) and dataset_id <> 1 then false "
            "else is_active end") if action == "replace" else "is_active"
    return with_views(f"select dataset_id, dataset_name, original_filename, label, start_year, end_year, "
                      f"created_seq, quality_score, {ver} as upload_version, {act_col} as is_period_active, "
                      f"{glob} as is_active from RG", "R", extra=[_RG])


@register("activate_new_version", _activate_sql("new_version"))
def q_activate_new_version(spark, sf_dir):
    return D.activate(_rg(spark, sf_dir), 1, "new_version")


@register("activate_replace", _activate_sql("replace"))
def q_activate_replace(spark, sf_dir):
    return D.activate(_rg(spark, sf_dir), 1, "replace")


# ---------------------------------------------------------------- D8
@register("set_active", with_views(f"select {R_COLS}, dataset_id = 3 as is_active from R", "R"))
def q_set_active(spark, sf_dir):
    return D.set_active(_r(spark, sf_dir), 3, allow_benchmark=True)


# ---------------------------------------------------------------- D9
@register("period_summary", with_views("""
select label, start_year, end_year, max(upload_version) as latest_version, count(*) as total_versions,
  max(case when is_period_active then dataset_id end) as active_dataset_id,
  max(case when is_period_active then original_filename end) as active_filename,
  max(case when is_period_active then created_seq end) as active_created_seq
from R where label is not null group by all""", "R"))
def q_period_summary(spark, sf_dir):
    return D.period_summary(_r(spark, sf_dir))


# ---------------------------------------------------------------- D10
@register("period_versions", with_views(f"select {R_COLS} from R where label = '2018-19'", "R"))
def q_period_versions(spark, sf_dir):
    return D.versions(_r(spark, sf_dir), "2018-19")


@register("active_for_labels", with_views("""
select l.label, a.dataset_id from (values ('2018-19'), ('2030-31'), ('2022-23')) l(label)
left join (select label, arg_max(dataset_id, created_seq) as dataset_id from R where is_period_active group by 1) a
using (label)""", "R"))
def q_active_for(spark, sf_dir):
    labels = spark.createDataFrame([("2018-19",), ("2030-31",), ("2022-23",)], "label string")
    return D.active_for(_r(spark, sf_dir), labels)


@register("period_pair", with_views("""
select (select arg_max(dataset_id, created_seq) from R where is_period_active and label = '2022-23') as current_id,
       (select arg_max(dataset_id, created_seq) from R where is_period_active and label = '2040-41') as baseline_id
""", "R"))
def q_period_pair(spark, sf_dir):
    return D.period_pair(_r(spark, sf_dir), "2022-23", "2040-41")


@register("known_labels", with_views("select label, max(end_year) as end_year from R where label is not null group by 1", "R"))
def q_known_labels(spark, sf_dir):
    return D.known_labels(_r(spark, sf_dir))


# ---------------------------------------------------------------- D11
@register("analytical_years", with_views("""
select year, row_number() over (order by year desc) <= 2 as is_default from (
  select distinct unnest([start_year, end_year]) as year from R where start_year is not null and end_year is not null) y
""", "R"))
def q_analytical_years(spark, sf_dir):
    return D.analytical_years(_r(spark, sf_dir))


# ---------------------------------------------------------------- D12
@register("resolve_years", with_views("""
select year, arg_min(dataset_id, k) as dataset_id, arg_min(role, k) as role from (
  select y.year, r.dataset_id, 'cy' as role, [0, case when r.is_period_active then 0 else 1 end,
         case when r.is_active then 0 else 1 end, -r.created_seq] as k
  from ys y join RG r on r.end_year = y.year
  union all
  select y.year, r.dataset_id, 'py', [1, case when r.is_period_active then 0 else 1 end,
         case when r.is_active then 0 else 1 end, -r.created_seq]
  from ys y join RG r on r.start_year = y.year) c group by 1
""", "R", extra=[_RG, ("ys", "select * from (values (2015), (2016), (2023), (2030)) v(year)")]))
def q_resolve_years(spark, sf_dir):
    years = spark.createDataFrame([(2015,), (2016,), (2023,), (2030,)], "year int")
    return D.resolve_years(_rg(spark, sf_dir), years)


# ---------------------------------------------------------------- D14
@register("dataset_listing", with_views(f"""
select {R_COLS.replace('quality_score, ', '')}, quality_score,
  case when regexp_matches(dataset_name, '^(Bench_|benchmark_|test_|synthetic_)', 'i') then 'test_benchmark'
       else 'production' end as category from R""", "R"))
def q_dataset_listing(spark, sf_dir):
    r = _r(spark, sf_dir)
    return D.dataset_listing(r, r.select("dataset_id", "quality_score"))


# ---------------------------------------------------------------- D15
@register("cleanup_plan", with_views("""
select r.dataset_id, r.dataset_name, r.original_filename, coalesce(c.n, 0) as dependent_rows
from RG r left join (select l_partkey as dataset_id, count(*) as n from lineitem group by 1) c using (dataset_id)
where regexp_matches(r.dataset_name, '^(Bench_|benchmark_|test_|synthetic_)', 'i') and not coalesce(r.is_active, false)
""", "R", extra=[_RG]))
def q_cleanup_plan(spark, sf_dir):
    children = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("dataset_id"))
    return D.cleanup_plan(_rg(spark, sf_dir), children)


# ---------------------------------------------------------------- D16
@register("register_version", with_views(f"""
select dataset_id, dataset_name, original_filename, label, start_year, end_year, created_seq, quality_score,
  upload_version, case when touched then upload_version = maxv else is_period_active end as is_period_active
from (select *, max(upload_version) over (partition by label) as maxv,
        label in (select label from newr where label is not null) as touched from (
  select {R_COLS} from R
  union all
  select n.dataset_id, n.dataset_name, n.original_filename, n.label, n.start_year, n.end_year, n.created_seq,
         null, cast(coalesce(b.base, 0) + row_number() over (partition by n.label order by n.created_seq, n.dataset_id)
                    as integer), null
  from newr n left join (select label, max(upload_version) as base from R group by 1) b
    on b.label is not distinct from n.label) u) z
""", "R", extra=[("src", _UPLOADS_SQL), ("det", _detect_sql("original_filename")),
                 ("newr", "select dataset_id, dataset_name, original_filename, created_seq, start_year, end_year, "
                          "case when start_year is null then null else concat(cast(start_year as varchar), '-', "
                          "right(cast(end_year as varchar), 2)) end as label from det")]))
def q_register_version(spark, sf_dir):
    return D.register_version(_r(spark, sf_dir), _uploads(spark, sf_dir))


@register("session_overlap_version_pairs", with_views("""
select count(*) as overlapping_version_pairs, count(distinct (a.label, b.label)) as overlapping_label_pairs
from R a join R b on a.start_year <= b.end_year and b.start_year <= a.end_year and lower(a.label) <> lower(b.label)
""", "R"))
def q_session_overlap_pairs(spark, sf_dir):
    r = _r(spark, sf_dir)
    return D.overlap_version_pairs(r.select("dataset_id", "label"), r)
