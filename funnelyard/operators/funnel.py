"""Event-table funnels and source performance.

Event tables (``tables`` dict): ``leads`` (lead_id, main_source, source,
event_date), ``registration`` (lead_id, event_date) and ``admission``
(lead_id, event_date).

Per-lead funnels (F10/F11/F13/F16) need, for every lead of a year, whether
the same lead also registered / was admitted in that year.  Rather than two
``distinct`` key sets and two left joins, the three tables are unioned as
``(lead_id, year, kind, attributes)`` and aggregated once by ``(lead_id,
year)`` — one shuffle on the lead key with map-side combining, and no hot
key even when one lead has very many registrations.  A second small
aggregate then groups by the source dimensions.

Date ranges are half-open literal ranges ``[Y-01-01, Y+1-01-01)`` so Parquet
row-group statistics prune the scan (``year(col) = Y`` would not push down).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.functions.core import (flag_by_rate, flag_by_zero, from_h, growth, lsum, pct,
                                       rate_h)
from funnelyard.functions.ordinal import ordinal_within

STAGES = ("leads", "registration", "admission")

# --- fixed values -----------------------------------------------------------
# Dimensions each event metric may be grouped / filtered by.
EVENT_DIMENSIONS = {
    "leads": ("program_name", "campus_name", "cluster", "state", "source", "main_source", "lead_type"),
    "registration": ("program_name", "campus_name"),
    "admission": ("program_name", "campus_name", "cluster", "state", "admission_status"),
}
DERIVED_RATES = {
    "lead_registration_rate": ("registration", "leads"),
    "lead_admission_rate": ("admission", "leads"),
    "registration_admission_rate": ("admission", "registration"),
}
GROWTH_STATUS = ("new_source", "dropped", "increased", "decreased", "unchanged")
# ---------------------------------------------------------------------------


# ---------------------------------------------------------------------- E3
def year_bounds(year: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, 1, 1), dt.date(year + 1, 1, 1)


def year_filter(df: DataFrame, date_col: str, year: int | None = None, when: str | None = None,
                today: dt.date | None = None) -> DataFrame:
    """E3 — rows in a calendar year as a half-open range predicate.

    ``when`` may be ``current_year`` / ``previous_year`` relative to
    ``today`` (a parameter, so results are reproducible)."""
    if year is None:
        if when not in ("current_year", "previous_year") or today is None:
            raise ValueError("give a year, or when=current_year|previous_year with today")
        year = today.year - (1 if when == "previous_year" else 0)
    lo, hi = year_bounds(year)
    return df.filter((F.col(date_col) >= F.lit(lo)) & (F.col(date_col) < F.lit(hi)))


# ---------------------------------------------------------------------- F2
def event_metric(tables: Mapping[str, DataFrame], metric: str, dims: Sequence[str] = (),
                 year: int | None = None, filters: Mapping[str, str] | None = None) -> DataFrame:
    """F2 — count of non-null ids of one event table per dimension list,
    for a year and exact filters; dimensions are validated per metric."""
    if metric not in EVENT_DIMENSIONS:
        raise ValueError(f"unknown metric {metric!r}")
    bad = [d for d in list(dims) + list((filters or {}).keys()) if d not in EVENT_DIMENSIONS[metric]]
    if bad:
        raise ValueError(f"dimension(s) {bad} not available for {metric!r}")
    d = tables[metric]
    if year is not None:
        d = year_filter(d, "event_date", year)
    for c, v in (filters or {}).items():
        d = d.filter(F.col(c) == v)
    out = d.groupBy(*dims).agg(F.count("lead_id").alias("metric_value"))
    return out.orderBy(F.col("metric_value").desc(), *[F.col(x).asc() for x in dims]) if dims else out


# ---------------------------------------------------------------------- F3
def derived_rate(tables: Mapping[str, DataFrame], name: str, year: int) -> DataFrame:
    """F3 — numerator count / denominator count x 100, two decimals, null on
    a zero denominator; both counts come from one-row aggregates."""
    num, den = DERIVED_RATES[name]
    n = year_filter(tables[num], "event_date", year).agg(F.count("lead_id").alias("numerator"))
    d = year_filter(tables[den], "event_date", year).agg(F.count("lead_id").alias("denominator"))
    return n.crossJoin(d).select(F.lit(name).alias("metric"), "numerator", "denominator",
                                 pct("numerator", "denominator").alias("metric_value"))


# ---------------------------------------------------------------------- F6
def funnel_yoy(tables: Mapping[str, DataFrame], year: int) -> DataFrame:
    """F6 — event counts of ``year`` and ``year-1`` per stage, three
    conversion rates (0 on zero) and three growths (null on zero).
    One conditional aggregate per table over the two-year range."""
    aggs = []
    for s in STAGES:
        d = tables[s].filter((F.col("event_date") >= F.lit(dt.date(year - 1, 1, 1)))
                             & (F.col("event_date") < F.lit(dt.date(year + 1, 1, 1))))
        cur = F.col("event_date") >= F.lit(dt.date(year, 1, 1))
        aggs.append(d.agg(F.count(F.when(cur, F.col("lead_id"))).alias(f"cy_{s}"),
                          F.count(F.when(~cur, F.col("lead_id"))).alias(f"py_{s}")))
    t = aggs[0].crossJoin(aggs[1]).crossJoin(aggs[2])
    return t.select(
        F.lit(year).alias("current_year"), F.lit(year - 1).alias("previous_year"),
        *[F.col(f"{p}_{s}") for p in ("cy", "py") for s in STAGES],
        pct("cy_registration", "cy_leads", "zero").alias("lead_registration_rate"),
        pct("cy_admission", "cy_leads", "zero").alias("lead_admission_rate"),
        pct("cy_admission", "cy_registration", "zero").alias("registration_admission_rate"),
        *[growth(f"cy_{s}", f"py_{s}").alias(f"{s}_growth") for s in STAGES])


# ---------------------------------------------------------------------- per-lead facts
def lead_stage_facts(tables: Mapping[str, DataFrame], years: Sequence[int]) -> DataFrame:
    """One row per (lead, year) for leads dated in ``years``: its source
    dimensions and whether it registered / was admitted in the same year."""
    lo, hi = dt.date(min(years), 1, 1), dt.date(max(years) + 1, 1, 1)

    def rng(d):
        return d.filter((F.col("event_date") >= F.lit(lo)) & (F.col("event_date") < F.lit(hi)))

    yr = F.year("event_date").alias("year")
    leads = rng(tables["leads"]).select("lead_id", yr, F.lit(1).alias("k"),
                                        "main_source", "source")
    reg = rng(tables["registration"]).select("lead_id", yr, F.lit(2).alias("k"),
                                             F.lit(None).cast("string").alias("main_source"),
                                             F.lit(None).cast("string").alias("source"))
    adm = rng(tables["admission"]).select("lead_id", yr, F.lit(3).alias("k"),
                                          F.lit(None).cast("string").alias("main_source"),
                                          F.lit(None).cast("string").alias("source"))
    u = leads.unionByName(reg).unionByName(adm).filter(F.col("year").isin(*years))
    per = u.groupBy("lead_id", "year").agg(
        F.max((F.col("k") == 1).cast("int")).alias("is_lead"),
        F.max((F.col("k") == 2).cast("int")).alias("registered"),
        F.max((F.col("k") == 3).cast("int")).alias("admitted"),
        F.max_by("main_source", (F.col("k") == 1).cast("int")).alias("main_source"),
        F.max_by("source", (F.col("k") == 1).cast("int")).alias("source"))
    return per.filter(F.col("is_lead") == 1).drop("is_lead")


# ---------------------------------------------------------------------- F10
def source_performance_year(tables: Mapping[str, DataFrame], year: int) -> DataFrame:
    """F10 — per (main_source, source): leads of the year, and how many of
    them registered / were admitted in the same year."""
    f = lead_stage_facts(tables, [year])
    return (f.groupBy("main_source", "source")
            .agg(F.count(F.lit(1)).alias("leads"), F.sum("registered").cast("long").alias("registration"),
                 F.sum("admitted").cast("long").alias("admission")))


def _rates(prefix: str, leads: str, reg: str, adm: str, zero_div: str) -> list[Column]:
    return [pct(reg, leads, zero_div).alias(f"{prefix}lead_registration_percent"),
            pct(adm, leads, zero_div).alias(f"{prefix}lead_admission_percent"),
            pct(adm, reg, zero_div).alias(f"{prefix}registration_admission_percent")]


def _growth_status(cur: Column, prev: Column) -> Column:
    return (F.when((prev == 0) & (cur > 0), F.lit("new_source"))
            .when((prev > 0) & (cur == 0), F.lit("dropped"))
            .when(cur > prev, F.lit("increased"))
            .when(cur < prev, F.lit("decreased"))
            .otherwise(F.lit("unchanged")))


def _performance_table(agg: DataFrame, year: int, zero_div: str) -> DataFrame:
    h = rate_h("admission", "leads", "null" if zero_div == "null" else "zero")
    return agg.select(
        "main_source", "source", F.lit(year).alias("current_year"),
        F.lit(year - 1).alias("previous_year"),
        "leads", "registration", "admission",
        *_rates("", "leads", "registration", "admission", zero_div),
        "previous_leads", "previous_registration", "previous_admission",
        *_rates("previous_", "previous_leads", "previous_registration", "previous_admission", zero_div),
        growth("leads", "previous_leads").alias("lead_growth_percent"),
        growth("admission", "previous_admission").alias("admission_growth_percent"),
        flag_by_rate("leads", h).alias("performance_flag"),
        _growth_status(F.col("leads"), F.col("previous_leads")).alias("growth_status"))


# ---------------------------------------------------------------------- F11
def source_performance(tables: Mapping[str, DataFrame], year: int) -> DataFrame:
    """F11 — F10 for ``year`` and ``year-1`` on the union of source keys
    (null-safe), rates (null on zero), growth, flag and growth status.
    Both years come from one conditional aggregate, so keys present in only
    one year get zeros on the other without a full outer join."""
    f = lead_stage_facts(tables, [year - 1, year])
    cur = F.col("year") == year
    agg = f.groupBy("main_source", "source").agg(
        F.count(F.when(cur, F.lit(1))).alias("leads"),
        lsum(F.when(cur, F.col("registered"))).alias("registration"),
        lsum(F.when(cur, F.col("admitted"))).alias("admission"),
        F.count(F.when(~cur, F.lit(1))).alias("previous_leads"),
        lsum(F.when(~cur, F.col("registered"))).alias("previous_registration"),
        lsum(F.when(~cur, F.col("admitted"))).alias("previous_admission"))
    return _performance_table(agg, year, "null")


def source_performance_metrics(m: DataFrame, dataset_id: str, year: int, cy_year: int,
                               py_year: int) -> DataFrame:
    """F11 (metrics-table form) — the same table from the wide metrics of
    one dataset, blank keys labelled ``Unknown``, rates 0 on zero."""
    from funnelyard.operators.metrics import shift_measures
    d = shift_measures(m.filter(F.col("dataset_id") == dataset_id), year, cy_year, py_year)
    agg = d.groupBy(F.coalesce("main_source", F.lit("Unknown")).alias("main_source"),
                    F.coalesce("source", F.lit("Unknown")).alias("source")).agg(
        lsum("cur_leads").alias("leads"), lsum("cur_registration").alias("registration"),
        lsum("cur_admission").alias("admission"), lsum("prev_leads").alias("previous_leads"),
        lsum("prev_registration").alias("previous_registration"),
        lsum("prev_admission").alias("previous_admission"))
    return _performance_table(agg, year, "zero")


# ---------------------------------------------------------------------- F12
def source_insights(perf: DataFrame) -> DataFrame:
    """F12 — weak (high), new (info) and dropped (high) insights per source
    row; :func:`insight_lists` names the sources of every list, the strong
    ones included."""
    name = F.concat_ws(" / ", F.coalesce("main_source", F.lit("None")), F.coalesce("source", F.lit("None")))
    items = F.array(
        F.when(F.col("performance_flag") == "high_leads_low_conversion", F.struct(
            F.lit("high_leads_low_conversion").alias("type"), F.lit("high").alias("severity"),
            F.concat(name, F.lit(": "), F.col("admission").cast("string"), F.lit(" of "),
                     F.col("leads").cast("string"), F.lit(" leads were admitted")).alias("message"))),
        F.when(F.col("growth_status") == "new_source", F.struct(
            F.lit("new_source").alias("type"), F.lit("info").alias("severity"),
            F.concat(name, F.lit(": leads this year, none the year before")).alias("message"))),
        F.when(F.col("growth_status") == "dropped", F.struct(
            F.lit("dropped_source").alias("type"), F.lit("high").alias("severity"),
            F.concat(name, F.lit(": leads the year before, none this year")).alias("message"))))
    return perf.select("main_source", "source", "lead_admission_percent",
                       F.explode(F.array_compact(items)).alias("i")).select(
        "i.type", "main_source", "source", "i.severity", "i.message",
        F.when(F.col("i.type") == "high_leads_low_conversion", F.col("lead_admission_percent"))
        .alias("lead_admission_percent"))


def insight_lists(perf: DataFrame) -> DataFrame:
    """F12 — ``(list, main_source, source)``: the strong, weak, new and dropped
    sources; a source may stand in two lists (weak and new, say)."""
    flag, status = F.col("performance_flag"), F.col("growth_status")
    lists = F.array(F.when(flag == "strong", F.lit("strong")), F.when(flag == "high_leads_low_conversion", F.lit("weak")),
                    F.when(status == "new_source", F.lit("new")), F.when(status == "dropped", F.lit("dropped")))
    return perf.select(F.explode(F.array_compact(lists)).alias("list"), "main_source", "source")


def insight_summary(perf: DataFrame) -> DataFrame:
    """F12 — the five counters in one aggregate."""
    return perf.agg(F.count(F.lit(1)).alias("total_sources"),
                    F.count_if(F.col("performance_flag") == "strong").alias("strong_sources"),
                    F.count_if(F.col("performance_flag") == "high_leads_low_conversion").alias("weak_sources"),
                    F.count_if(F.col("growth_status") == "new_source").alias("new_sources"),
                    F.count_if(F.col("growth_status") == "dropped").alias("dropped_sources"))


# ---------------------------------------------------------------------- F13
def source_tree(tables: Mapping[str, DataFrame], year: int) -> DataFrame:
    """F13 — main_source -> source rows with counts, rates (null on zero),
    flag, and each source's position under its main source (leads desc).
    Positions come from a distributed sort, so a main source may have any
    number of sources."""
    agg = source_performance_year(tables, year)
    h = rate_h("admission", "leads", "null")
    rows = agg.select("main_source", "source", F.lit(year).alias("year"), "leads", "registration",
                      "admission", *_rates("", "leads", "registration", "admission", "null"),
                      F.when(F.col("leads") > 0, flag_by_rate("leads", h)).otherwise("normal")
                      .alias("performance"))
    return ordinal_within(rows, ["main_source"], [F.col("leads").desc(), F.col("source").asc()], name="position")


# ---------------------------------------------------------------------- F14
def _level1(c: Column) -> Column:
    v = F.regexp_replace(c, r"^\s+|\s+$", "")
    up = F.upper(v)
    return (F.when((v == "") | up.isin("NONE", "NULL", "UNKNOWN"), F.lit("OTHERS"))
            .when(up == "IN HOUSE", F.lit("IN-HOUSE")).when(up == "OUT SOURCED", F.lit("OUT-SOURCED"))
            .otherwise(v))


def norm_level(c: Column | str, level: int) -> Column:
    """B9 — hierarchy label rules: level 1 blank/none/null/unknown ->
    OTHERS; level 2 strips an ``X: `` prefix, blank/none/null -> OTHER;
    level 3 blank/none/null -> UNKNOWN; ``IN HOUSE``/``OUT SOURCED`` are
    hyphenated on levels 1 and 2.  Input nulls arrive as ``Unknown``."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("Unknown"))
    if level == 1:
        return _level1(c)
    v = F.regexp_replace(c, r"^\s+|\s+$", "")
    if level == 2:
        v = F.regexp_replace(v, r"^.: ", "")
        up = F.upper(v)
        v = F.when(up == "OUT SOURCED", F.lit("OUT-SOURCED")).when(up == "IN HOUSE", F.lit("IN-HOUSE")).otherwise(v)
        return F.when((v == "") | F.upper(v).isin("NONE", "NULL"), F.lit("OTHER")).otherwise(v)
    return F.when((v == "") | F.upper(v).isin("NONE", "NULL"), F.lit("UNKNOWN")).otherwise(v)


def source_tree3(m: DataFrame, dataset_id: str, year: int, cy_year: int, py_year: int) -> DataFrame:
    """F14 — lead_type -> source -> main_source with B9 labels, sums at
    every level from one ``rollup`` (Expand + partial aggregate), flag per
    node, position among siblings by leads, and the grand total (level 0)."""
    from funnelyard.operators.metrics import shift_measures
    d = shift_measures(m.filter(F.col("dataset_id") == dataset_id), year, cy_year, py_year)
    d = d.select(norm_level("lead_type", 1).alias("l1"), norm_level("source", 2).alias("l2"),
                 norm_level("main_source", 3).alias("l3"), "cur_leads", "cur_registration",
                 "cur_admission", "prev_leads", "prev_registration", "prev_admission")
    r = d.rollup("l1", "l2", "l3").agg(
        F.grouping_id().alias("_g"), lsum("cur_leads").alias("leads"),
        lsum("cur_registration").alias("registration"), lsum("cur_admission").alias("admission"),
        lsum("prev_leads").alias("py_leads"), lsum("prev_registration").alias("py_registration"),
        lsum("prev_admission").alias("py_admission"))
    level = F.when(F.col("_g") == 0, 3).when(F.col("_g") == 1, 2).when(F.col("_g") == 3, 1).otherwise(0)
    r = r.withColumn("level", level)
    name = (F.when(F.col("level") == 3, F.col("l3")).when(F.col("level") == 2, F.col("l2"))
            .when(F.col("level") == 1, F.col("l1")).otherwise(F.lit("All Sources")))
    h = rate_h("admission", "leads", "zero")
    out = r.select("level", "l1", "l2", "l3", name.alias("name"), "leads", "registration", "admission",
                   "py_leads", "py_registration", "py_admission", from_h(h).alias("lead_admission_percent"),
                   F.when(F.col("level") == 0, F.lit("normal")).otherwise(flag_by_rate("leads", h))
                   .alias("performance"))
    # Siblings share level and parent keys; they are numbered by a distributed
    # sort of the nodes, so a node may have any number of children.
    out = out.withColumns({"_p1": F.when(F.col("level") >= 2, F.col("l1")), "_p2": F.when(F.col("level") == 3, F.col("l2"))})
    return ordinal_within(out, ["level", "_p1", "_p2"], [F.col("leads").desc(), F.col("name").asc()], name="position").drop("_p1", "_p2")


# ---------------------------------------------------------------------- F15
def tree_search(tree: DataFrame, text: str) -> DataFrame:
    """F15 — nodes whose name contains ``text`` (case-insensitive) plus all
    their ancestors; the grand total is not searchable.

    The keys of the matching nodes, cut to levels 1, 2 and 3, are the nodes to
    keep: a distinct (combined on the map side) and a semi join on the keys,
    so no subtree meets in one task.  ``tree`` is numbered by a written sort,
    so reading it twice doesn't derive it twice."""
    t = tree.filter(F.col("level") >= 1)
    hits = t.filter(F.lower(F.col("name")).contains(text.lower())).select("level", "l1", "l2", "l3")
    upto = F.explode(F.transform(F.sequence(F.lit(1), F.col("level")), lambda k: F.struct(
        k.alias("level"), F.col("l1"), F.when(k >= 2, F.col("l2")).alias("l2"), F.when(k >= 3, F.col("l3")).alias("l3"))))
    keep = hits.select(upto.alias("k")).select("k.*").distinct().alias("k")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("level", "l1", "l2", "l3")]
    return t.alias("t").join(keep, same[0] & same[1] & same[2] & same[3], "left_semi")


# ---------------------------------------------------------------------- F16
def source_detail(tables: Mapping[str, DataFrame], year: int, main_source: str,
                  source: str) -> DataFrame:
    """F16 — one (main_source, source) of the event tables: counts, rates
    (null on zero) and the detail flag (leads without admissions = weak).
    The filter on the lead side is applied before the per-lead aggregate."""
    leads = tables["leads"].filter((F.col("main_source") == main_source) & (F.col("source") == source))
    t = dict(tables)
    t["leads"] = leads
    agg = source_performance_year(t, year)
    return _detail(agg.select("leads", "registration", "admission"), main_source, source, year, "null")


def source_detail_metrics(m: DataFrame, dataset_id: str, year: int, cy_year: int, py_year: int,
                          main_source: str, source: str) -> DataFrame:
    """F16 (metrics form) — case-insensitive match, rates 0 on zero."""
    from funnelyard.operators.metrics import shift_measures
    d = shift_measures(m.filter((F.col("dataset_id") == dataset_id)
                                & (F.lower("main_source") == main_source.lower())
                                & (F.lower("source") == source.lower())), year, cy_year, py_year)
    agg = d.agg(lsum("cur_leads").alias("leads"), lsum("cur_registration").alias("registration"),
                lsum("cur_admission").alias("admission"))
    return _detail(agg, main_source, source, year, "zero")


def _detail(agg: DataFrame, main_source: str, source: str, year: int, zero_div: str) -> DataFrame:
    h = rate_h("admission", "leads", "null" if zero_div == "null" else "zero")
    return agg.select(F.lit(main_source).alias("main_source"), F.lit(source).alias("source"),
                      F.lit(year).alias("year"), "leads", "registration", "admission",
                      *_rates("", "leads", "registration", "admission", zero_div),
                      flag_by_zero("leads", "admission", h).alias("performance"))
