"""Measures, funnels, rankings, member facts and filters on the metrics table.

The metrics table ``M`` has eight text dimensions and six long measures
(``cy_/py_`` × ``leads/registration/admission``), one partition per
``dataset_id``.  Every operator here is a lazy DataFrame transformation.

Top-n per dimension is ``row_number() <= n`` over the already aggregated
member facts; Spark plans that as a WindowGroupLimit, so each group is cut
to ``n`` rows on the map side before the shuffle.  Single-winner questions use
``min_by``/``max_by`` aggregates, which combine partially per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelyard.functions.core import (blank_label, from_h, growth, lsum, not_placeholder, pct,
                                       rate_h)
from funnelyard.sources.bindings import DIMENSIONS

STAGES = ("leads", "registration", "admission")

# --- fixed values -----------------------------------------------------------
# Dimensions of the dashboard (insights, top performers) and entity detail.
DASHBOARD_DIMENSIONS = ("program_name", "source", "campus_name", "state", "owner")
DETAIL_DIMENSIONS = ("source", "campus_name", "state", "owner")
# Filters of the dashboard: filter name -> column.
DASHBOARD_FILTERS = {"campus": "campus_name", "state": "state", "source": "source",
                     "program": "program_name"}
# Minimum leads for conversion-based "best of" lists.
MIN_LEADS_BEST_PROGRAM = 10
MIN_LEADS_TOP_CONVERSION = 50
# Seasonal allocation: month, then lead / registration / admission weights in
# hundredths (0.02 -> 2).  The last month takes the remainder.
SEASON_MONTHS = ("November", "December", "January", "February", "March", "April", "May",
                 "June", "July")
SEASON_LEAD_W = (2, 3, 5, 8, 14, 18, 14, 21, 15)
SEASON_REG_W = (1, 2, 4, 6, 15, 18, 15, 24, 15)
SEASON_ADM_W = (1, 2, 3, 5, 12, 16, 15, 30, 16)
# ---------------------------------------------------------------------------


def for_dataset(m: DataFrame, dataset_id: str) -> DataFrame:
    """Dataset isolation; on a table partitioned by ``dataset_id`` this is
    partition pruning."""
    return m.filter(F.col("dataset_id") == dataset_id)


# ---------------------------------------------------------------------- E1/E2
def member_filter(df: DataFrame, filters: Mapping[str, str | None] | None = None,
                  columns: Mapping[str, str] | None = None, blank: str | None = None) -> DataFrame:
    """E1/E2 — case-insensitive equality per named dimension.

    Empty values and ``all`` are ignored.  With ``blank`` set, the column is
    compared after ``blank_label`` so the blank member is selectable by name.
    """
    for name, value in (filters or {}).items():
        if value is None or not str(value).strip() or str(value).strip().lower() == "all":
            continue
        c = (columns or {}).get(name, name)
        target = blank_label(c, blank) if blank else F.col(c)
        df = df.filter(F.lower(target) == F.lit(str(value).strip().lower()))
    return df


# ---------------------------------------------------------------------- D13
def shift_measures(df: DataFrame, year: int, cy_year: int, py_year: int) -> DataFrame:
    """D13 — measures seen from ``year``: ``cur_*`` and ``prev_*``.

    year == cy -> (cy, py); year == py -> (py, 0); year == cy + 1 -> (0, cy);
    otherwise zeros.
    """
    zero = F.lit(0).cast("long")
    out = []
    for s in STAGES:
        if year == cy_year:
            cur, prev = F.col(f"cy_{s}"), F.col(f"py_{s}")
        elif year == py_year:
            cur, prev = F.col(f"py_{s}"), zero
        elif year == cy_year + 1:
            cur, prev = zero, F.col(f"cy_{s}")
        else:
            cur, prev = zero, zero
        out += [cur.alias(f"cur_{s}"), prev.alias(f"prev_{s}")]
    keep = [c for c in df.columns if not c.startswith(("cy_", "py_"))]
    return df.select(*keep, *out)


def measure_column(metric: str, year: int | None = None, py_year: int | None = None) -> str:
    """Measure column for a metric word; the previous-year column only when
    the requested year is the dataset's previous year."""
    m = metric.lower().strip()
    prefix = "py" if (year is not None and py_year is not None and year == py_year) else "cy"
    if "lead" in m or "enquir" in m:
        return f"{prefix}_leads"
    if "cucet" in m or "regist" in m:
        return f"{prefix}_registration"
    return f"{prefix}_admission"


# ---------------------------------------------------------------------- F1
def metric_total(m: DataFrame, dataset_id: str, metric: str, year: int | None = None,
                 py_year: int | None = None, filters: Mapping[str, str] | None = None) -> DataFrame:
    """F1 — one-row total of a measure under exact filters."""
    d = for_dataset(m, dataset_id)
    for c, v in (filters or {}).items():
        d = d.filter(F.col(c) == v)
    mc = measure_column(metric, year, py_year)
    return d.agg(lsum(mc).alias("total_value")).select(
        F.lit(metric).alias("metric"), F.lit(mc).alias("measure_column"), "total_value")


# ---------------------------------------------------------------------- F4
def breakdown(m: DataFrame, dataset_id: str, dims: Sequence[str], metric: str = "admission",
              year: int | None = None, py_year: int | None = None,
              filters: Mapping[str, str] | None = None, keep_missing: bool = False,
              limit: int | None = None) -> DataFrame:
    """F4 — measure by one or more dimensions, placeholder members dropped
    (unless ``keep_missing``), largest first."""
    d = for_dataset(m, dataset_id)
    if not keep_missing:
        d = d.filter(not_placeholder(dims))
    for c, v in (filters or {}).items():
        d = d.filter(F.col(c) == v)
    mc = measure_column(metric, year, py_year)
    out = d.groupBy(*dims).agg(lsum(mc).alias("metric_value"))
    out = out.orderBy(F.col("metric_value").desc(), *[F.col(x).asc_nulls_last() for x in dims])
    return out.limit(limit) if limit else out


# ---------------------------------------------------------------------- F5
def ranking(m: DataFrame, dataset_id: str, dim: str, metric: str = "admission", n: int = 1,
            direction: str = "desc", year: int | None = None, py_year: int | None = None,
            keep_missing: bool = False) -> DataFrame:
    """F5 — top/bottom ``n`` members.  ``has_value`` is false when the top
    value is zero ("nothing recorded")."""
    d = for_dataset(m, dataset_id)
    if not keep_missing:
        d = d.filter(not_placeholder([dim]))
    mc = measure_column(metric, year, py_year)
    agg = d.groupBy(F.col(dim).alias("entity_name")).agg(lsum(mc).alias("metric_value"))
    key = F.col("metric_value").desc() if direction == "desc" else F.col("metric_value").asc()
    order = [key, F.col("entity_name").asc_nulls_last()]
    top = agg.orderBy(*order).limit(n)
    # The window spans at most n rows.
    first = F.first("metric_value").over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return top.withColumn("has_value", first != 0)


# ---------------------------------------------------------------------- totals
def _totals(d: DataFrame) -> DataFrame:
    return d.agg(*[lsum(f"{p}_{s}").alias(f"{p}_{s}") for p in ("cy", "py") for s in STAGES])


# ---------------------------------------------------------------------- F7
def funnel_yoy_metrics(m: DataFrame, dataset_id: str, year: int, cy_year: int,
                       py_year: int) -> DataFrame:
    """F7 — funnel of ``year`` and ``year-1`` from the metrics table (the
    requested year is honoured through :func:`shift_measures`)."""
    t = shift_measures(_totals(for_dataset(m, dataset_id)), year, cy_year, py_year)
    return t.select(
        F.lit(year).alias("current_year"), F.lit(year - 1).alias("previous_year"),
        F.col("cur_leads").alias("cy_leads"), F.col("cur_registration").alias("cy_registration"),
        F.col("cur_admission").alias("cy_admission"), F.col("prev_leads").alias("py_leads"),
        F.col("prev_registration").alias("py_registration"),
        F.col("prev_admission").alias("py_admission"),
        pct("cur_registration", "cur_leads", "zero").alias("lead_registration_percent"),
        pct("cur_admission", "cur_leads", "zero").alias("lead_admission_percent"),
        pct("cur_admission", "cur_registration", "zero").alias("registration_admission_percent"),
        growth("cur_leads", "prev_leads").alias("leads_change_percent"),
        growth("cur_registration", "prev_registration").alias("registration_change_percent"),
        growth("cur_admission", "prev_admission").alias("admission_change_percent"),
    )


# ---------------------------------------------------------------------- F8
def stage_funnel(m: DataFrame, dataset_id: str,
                 filters: Mapping[str, str | None] | None = None) -> DataFrame:
    """F8 — stage rows: count, % of leads, % of previous stage.  The
    registration stage is omitted when no registration was recorded in
    either year."""
    d = member_filter(for_dataset(m, dataset_id), filters, DASHBOARD_FILTERS)
    t = _totals(d)
    has_reg = (F.col("cy_registration") > 0) | (F.col("py_registration") > 0)
    stages = F.array(
        F.struct(F.lit(1).alias("stage_order"), F.lit("Leads").alias("stage"),
                 F.col("cy_leads").alias("count"), F.lit(10000).cast("long").alias("of_leads_h"),
                 F.lit(10000).cast("long").alias("of_prev_h")),
        F.when(has_reg, F.struct(
            F.lit(2).alias("stage_order"), F.lit("Registration").alias("stage"),
            F.col("cy_registration").alias("count"),
            rate_h("cy_registration", "cy_leads").alias("of_leads_h"),
            rate_h("cy_registration", "cy_leads").alias("of_prev_h"))),
        F.struct(F.lit(3).alias("stage_order"), F.lit("Admissions").alias("stage"),
                 F.col("cy_admission").alias("count"),
                 rate_h("cy_admission", "cy_leads").alias("of_leads_h"),
                 F.when(has_reg, rate_h("cy_admission", "cy_registration"))
                 .otherwise(rate_h("cy_admission", "cy_leads")).alias("of_prev_h")),
    )
    rows = t.select(F.explode(F.filter(stages, lambda s: s.isNotNull())).alias("s")).select("s.*")
    return rows.select("stage_order", "stage", "count",
                       from_h("of_leads_h").alias("pct_of_leads"),
                       from_h("of_prev_h").alias("conversion_rate"))


# ---------------------------------------------------------------------- F9
def kpi_overview(m: DataFrame, dataset_id: str,
                 filters: Mapping[str, str | None] | None = None) -> DataFrame:
    """F9 — CY, PY, change and growth for leads, admissions and conversion
    (plus registration and registration->admission conversion when any
    registration exists).  Rates are carried in hundredths."""
    d = member_filter(for_dataset(m, dataset_id), filters, DASHBOARD_FILTERS)
    t = _totals(d)
    has_reg = (F.col("cy_registration") > 0) | (F.col("py_registration") > 0)

    def kpi(name: str, cy_h: Column, py_h: Column, scale: bool, present: Column | None = None):
        # Values in hundredths for rates (scale) and plain counts otherwise.
        cy_v = from_h(cy_h) if scale else cy_h.cast("double")
        py_v = from_h(py_h) if scale else py_h.cast("double")
        s = F.struct(F.lit(name).alias("kpi"), cy_v.alias("cy"), py_v.alias("py"),
                     (from_h(cy_h - py_h) if scale else (cy_h - py_h).cast("double")).alias("change"),
                     pct(cy_h - py_h, py_h).alias("growth_pct"))
        return F.when(present, s) if present is not None else s

    arr = F.array(
        kpi("leads", F.col("cy_leads"), F.col("py_leads"), False),
        kpi("admissions", F.col("cy_admission"), F.col("py_admission"), False),
        kpi("conversion_rate", rate_h("cy_admission", "cy_leads"),
            rate_h("py_admission", "py_leads"), True),
        kpi("registration", F.col("cy_registration"), F.col("py_registration"), False, has_reg),
        kpi("registration_conversion_rate", rate_h("cy_admission", "cy_registration"),
            rate_h("py_admission", "py_registration"), True, has_reg),
    )
    return t.select(F.explode(F.filter(arr, lambda s: s.isNotNull())).alias("k")).select("k.*")


# ---------------------------------------------------------------------- member facts
def member_facts(d: DataFrame, dims: Sequence[str],
                 measures: Sequence[str] = ("cy_leads", "cy_admission", "py_leads", "py_admission"),
                 drop_blank: bool = True) -> DataFrame:
    """(dimension, member) -> summed measures for several dimensions in ONE
    scan: rows are unpivoted (Expand) and partially aggregated in the same
    stage, so the shuffle carries one row per member and partition."""
    long = d.unpivot(ids=list(measures), values=list(dims), variableColumnName="dimension",
                     valueColumnName="member")
    if drop_blank:
        long = long.filter(F.col("member").isNotNull() & (F.col("member") != ""))
    return long.groupBy("dimension", "member").agg(*[lsum(x).alias(x) for x in measures])


def _top_per_dimension(facts: DataFrame, order: Sequence[Column], n: int,
                       name: str = "rank") -> DataFrame:
    w = Window.partitionBy("dimension").orderBy(*order, F.col("member").asc())
    return (facts.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
            .withColumn(name, F.col(name).cast("long")))


# ---------------------------------------------------------------------- F17
def insight_winners(m: DataFrame, dataset_id: str,
                    filters: Mapping[str, str | None] | None = None) -> DataFrame:
    """F17 — the eight "best of" facts from one member-facts aggregate.

    Each winner is a ``min_by`` over a sort key (ties: member ascending); a
    fact is emitted only when its value is positive (decline: negative).
    """
    d = member_filter(for_dataset(m, dataset_id), filters, DASHBOARD_FILTERS)
    facts = member_facts(d, ("source", "program_name", "state", "campus_name", "owner"),
                         ("cy_leads", "cy_admission", "py_admission"))
    facts = facts.withColumn("admission_change", F.col("cy_admission") - F.col("py_admission"))
    # Conversion order compares the double a/l (ties: member ascending).
    conv_key = F.when(F.col("cy_leads") >= MIN_LEADS_BEST_PROGRAM,
                      F.col("cy_admission").cast("double") / F.col("cy_leads"))
    rules = [
        ("highest_lead_source", "source", F.col("cy_leads"), "desc", "cy_leads"),
        ("highest_admission_program", "program_name", F.col("cy_admission"), "desc", "cy_admission"),
        ("best_performing_program", "program_name", conv_key, "desc", "cy_leads"),
        ("biggest_admission_improvement", "program_name", F.col("admission_change"), "desc",
         "admission_change"),
        ("biggest_admission_decline", "program_name", F.col("admission_change"), "asc",
         "admission_change"),
        ("strongest_state", "state", F.col("cy_admission"), "desc", "cy_admission"),
        ("strongest_campus", "campus_name", F.col("cy_admission"), "desc", "cy_admission"),
        ("best_counsellor", "owner", F.col("cy_admission"), "desc", "cy_admission"),
    ]
    payload = F.struct("member", "cy_leads", "cy_admission", "admission_change")
    aggs = []
    for rid, dim, key, direction, _ in rules:
        k = F.when(F.col("dimension") == dim, -key if direction == "desc" else key)
        # The ordering is null outside the rule's dimension, so min_by skips it.
        aggs.append(F.min_by(payload, F.when(k.isNotNull(), F.struct(k.alias("k"), F.col("member"))))
                    .alias(rid))
        aggs.append(F.min(k).alias(rid + "__k"))
    one = facts.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(rid).alias("insight_id"), F.lit(dim).alias("dimension"),
                              F.col(rid).alias("w"), F.col(rid + "__k").isNotNull().alias("found"),
                              F.lit(test).alias("test"))
                     for rid, dim, _, _, test in rules])
    out = one.select(F.explode(rows).alias("r")).select(
        "r.insight_id", "r.dimension", F.col("r.w.member").alias("member"),
        F.col("r.w.cy_leads").alias("leads"), F.col("r.w.cy_admission").alias("admissions"),
        F.col("r.w.admission_change").alias("admission_change"), "r.found", "r.test")
    positive = (F.when(F.col("insight_id") == "biggest_admission_decline",
                       F.col("admission_change") < 0)
                .when(F.col("test") == "cy_leads", F.col("leads") > 0)
                .when(F.col("test") == "cy_admission", F.col("admissions") > 0)
                .otherwise(F.col("admission_change") > 0))
    return (out.filter(F.col("found") & positive)
            .withColumn("conversion_rate", pct("admissions", "leads", "zero"))
            .drop("found", "test"))


# ---------------------------------------------------------------------- F18
def top_performers(m: DataFrame, dataset_id: str, metric: str = "leads", n: int = 5) -> DataFrame:
    """F18 — top ``n`` members of each dashboard dimension by leads,
    admissions, or conversion (members with at least 50 leads)."""
    facts = member_facts(for_dataset(m, dataset_id), DASHBOARD_DIMENSIONS,
                         ("cy_leads", "cy_admission"))
    if metric == "conversion_rate":
        facts = facts.filter(F.col("cy_leads") >= MIN_LEADS_TOP_CONVERSION)
        order = [(F.col("cy_admission").cast("double") / F.col("cy_leads")).desc()]
        value = pct("cy_admission", "cy_leads", "zero")
    else:
        mc = "cy_leads" if metric == "leads" else "cy_admission"
        order = [F.col(mc).desc()]
        value = F.col(mc).cast("double")
    top = _top_per_dimension(facts, order, n)
    return top.select("dimension", "rank", F.col("member").alias("entity"), value.alias("value"),
                      F.col("cy_admission").alias("admissions"), F.col("cy_leads").alias("leads"))


# ---------------------------------------------------------------------- F19
def top_members(m: DataFrame, dataset_id: str, dim: str, n: int = 3) -> DataFrame:
    """F19 — top ``n`` members by current-year admissions, placeholders
    removed."""
    d = for_dataset(m, dataset_id).filter(not_placeholder([dim]))
    agg = d.groupBy(F.col(dim).alias("member")).agg(lsum("cy_admission").alias("admissions"))
    return agg.orderBy(F.col("admissions").desc(), F.col("member").asc()).limit(n)


# ---------------------------------------------------------------------- F20
def entity_overview(m: DataFrame, dataset_id: str, dim: str, value: str) -> DataFrame:
    """F20a — CY/PY/change/growth of one member (case-insensitive match)."""
    d = for_dataset(m, dataset_id).filter(F.lower(F.col(dim)) == value.lower())
    return kpi_overview(d, dataset_id).filter(F.col("kpi").isin("leads", "admissions",
                                                                 "conversion_rate"))


def entity_breakdowns(m: DataFrame, dataset_id: str, dim: str, value: str,
                      n: int = 10) -> DataFrame:
    """F20b — top ``n`` members of every other detail dimension for one
    member, by admissions then leads."""
    d = for_dataset(m, dataset_id).filter(F.lower(F.col(dim)) == value.lower())
    others = [x for x in DETAIL_DIMENSIONS if x != dim]
    facts = member_facts(d, others, ("cy_leads", "cy_admission"))
    top = _top_per_dimension(facts, [F.col("cy_admission").desc(), F.col("cy_leads").desc()], n)
    return top.select("dimension", "rank", F.col("member").alias("entity"),
                      F.col("cy_leads").alias("leads"), F.col("cy_admission").alias("admissions"),
                      pct("cy_admission", "cy_leads", "zero").alias("conversion_rate"))


# ---------------------------------------------------------------------- F21
def regroup_source(m: DataFrame, dataset_id: str, names: Sequence[str]) -> DataFrame:
    """F21 — ``coalesce(main_source, source)`` groups limited to the given
    names (matched case-insensitively on either column)."""
    low = [x.lower() for x in names]
    d = for_dataset(m, dataset_id).filter(F.lower("main_source").isin(*low)
                                          | F.lower("source").isin(*low))
    return (d.groupBy(F.coalesce("main_source", "source").alias("source"))
            .agg(lsum("cy_leads").alias("leads"), lsum("cy_admission").alias("admission"))
            .orderBy(F.col("leads").desc(), F.col("source").asc()))


# ---------------------------------------------------------------------- F22
def seasonal_allocation(m: DataFrame, dataset_id: str,
                        filters: Mapping[str, str | None] | None = None) -> DataFrame:
    """F22 — split the totals over nine months by fixed weights (integer
    hundredths, floored); the last month takes the remainder.  Synthetic
    shape, not observed monthly data."""
    d = member_filter(for_dataset(m, dataset_id), filters, DASHBOARD_FILTERS)
    t = _totals(d)
    months = F.array(*[F.struct(F.lit(i + 1).alias("month_order"), F.lit(name).alias("month"),
                                F.lit(lw).alias("lw"), F.lit(rw).alias("rw"), F.lit(aw).alias("aw"))
                       for i, (name, lw, rw, aw) in enumerate(
                           zip(SEASON_MONTHS, SEASON_LEAD_W, SEASON_REG_W, SEASON_ADM_W))])
    last = len(SEASON_MONTHS)
    rows = t.select("*", F.explode(months).alias("mo")).select("*", "mo.*").drop("mo")
    out = []
    for p in ("cy", "py"):
        for s, w in (("leads", "lw"), ("registration", "rw"), ("admission", "aw")):
            share = F.call_function("div", F.col(f"{p}_{s}") * F.col(w), F.lit(100))
            # remainder = total - sum of floored shares of the first eight months
            floors = [F.call_function("div", F.col(f"{p}_{s}") * F.lit(wt), F.lit(100))
                      for wt in {"lw": SEASON_LEAD_W, "rw": SEASON_REG_W,
                                 "aw": SEASON_ADM_W}[w][:-1]]
            acc = floors[0]
            for f in floors[1:]:
                acc = acc + f
            out.append(F.when(F.col("month_order") == last, F.col(f"{p}_{s}") - acc)
                       .otherwise(share).cast("long").alias(f"{p}_{s}"))
    res = rows.select("month_order", "month", *out)
    return res.select("*", pct("cy_admission", "cy_leads", "zero").alias("cy_conversion_rate"),
                      pct("py_admission", "py_leads", "zero").alias("py_conversion_rate"))


# ---------------------------------------------------------------------- E5/E6
def contains_filter(df: DataFrame, column: str, text: str, fallback: bool = True) -> DataFrame:
    """E6 — case-insensitive substring match; with ``fallback`` all rows are
    kept when nothing matches (decided by a one-row aggregate of ``df``, which
    is read twice: pass a stored result)."""
    hit = F.lower(F.col(column)).contains(text.lower())
    if not fallback:
        return df.filter(hit)
    anyhit = df.agg(F.max(hit.cast("int")).alias("_any"))
    return (df.crossJoin(F.broadcast(anyhit))
            .filter(hit | F.coalesce(F.col("_any"), F.lit(0)).eqNullSafe(0)).drop("_any"))


def direction_filter(df: DataFrame, direction: str, rate_col: str = "rate_change",
                     change_col: str = "admission_change") -> DataFrame:
    """E5 — members whose rate moved in ``direction`` ("increase" or
    "decrease"); if none, those whose admissions moved; if none, all.  The
    choice comes from a one-row aggregate of ``df`` broadcast back; ``df`` is
    read twice, so pass a stored result."""
    sign = -1 if direction == "decrease" else 1
    r_hit = (F.col(rate_col) * sign) > 0
    a_hit = (F.col(change_col) * sign) > 0
    counts = df.agg(F.count_if(r_hit).alias("_nr"), F.count_if(a_hit).alias("_na"))
    j = df.crossJoin(F.broadcast(counts))
    keep = (F.when(F.col("_nr") > 0, r_hit).when(F.col("_na") > 0, a_hit).otherwise(F.lit(True)))
    return j.filter(keep).drop("_nr", "_na")


# ---------------------------------------------------------------------- E7/E8/E9
def filter_options(m: DataFrame, dataset_ids: Sequence[str], dims: Sequence[str],
                   cap: int | None = None) -> DataFrame:
    """E7 — distinct non-blank values per dimension; with ``cap`` the first
    ones of each in order, with their positions.  One scan (unpivot + distinct + WindowGroupLimit)."""
    d = m.filter(F.col("dataset_id").isin(*dataset_ids))
    long = (d.unpivot(ids=[], values=list(dims), variableColumnName="dimension",
                      valueColumnName="value")
            .select("dimension", F.nullif(F.btrim("value", F.lit(" ")), F.lit("")).alias("value"))
            .filter(F.col("value").isNotNull()).distinct())
    if cap is None:
        return long
    w = Window.partitionBy("dimension").orderBy(F.col("value").asc())
    return (long.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= cap)
            .withColumn("position", F.col("position").cast("long")))


def dimension_presence(m: DataFrame, dataset_id: str, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """E8 — one row per dimension: does it hold any non-blank value?"""
    d = for_dataset(m, dataset_id)
    one = d.agg(*[F.max((F.col(x).isNotNull() & (F.col(x) != "")).cast("int")).alias(x)
                  for x in dims])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"),
                                                   (F.coalesce(F.col(x), F.lit(0)) == 1)
                                                   .alias("present")) for x in dims])).alias("p")
                      ).select("p.*")


def restrict_to(df: DataFrame, dim: str, members: DataFrame, member_col: str = "member") -> DataFrame:
    """E9 — rows whose ``dim`` is one of an earlier result's members
    (semi join; the member list is never collected)."""
    keys = members.select(F.col(member_col).alias("_m")).distinct()
    return df.join(keys, df[dim] == keys["_m"], "left_semi")


