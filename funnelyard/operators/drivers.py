"""Driver analysis for one member (K1-K5).

All five outputs come from one grouping-sets style aggregate of the member's
rows (:func:`contributions`: unpivot + aggregate, one scan, written once).
Every row falls into one category of each dimension, so the member's totals
are the sums of any one dimension.  Shares are divided by that one row
through a broadcast cross join, never by a window over a whole dimension.
Results describe associations, not causes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelyard.functions.core import derived_once, from_h, lsum, pct_h, rate_h

# --- fixed values -----------------------------------------------------------
CONTRIBUTION_DIMENSIONS = ("source", "main_source", "owner", "campus_name", "state")
MIN_INSIGHT_LEADS = 10
UNKNOWN_CATEGORY = "UNKNOWN"
CONVERSION_WEIGHT = 1000          # conversion points are scaled to rank with counts
TOP_DRIVERS = 5
# ---------------------------------------------------------------------------

_M6 = ("cy_leads", "py_leads", "cy_admission", "py_admission", "cy_registration", "py_registration")


def _growth0_h(new: Column, old: Column) -> Column:
    """Growth in hundredths, 0 when the base is 0 (this tool's rule)."""
    return F.coalesce(pct_h(new - old, old), F.lit(0).cast("long"))


def _member_rows(m: DataFrame, dataset_id: str, dim: str, member: str) -> DataFrame:
    return m.filter((F.col("dataset_id") == dataset_id) & (F.col(dim) == member))


def contributions(m: DataFrame, dataset_id: str, dim: str, member: str) -> DataFrame:
    """``(dimension, category, measures)`` of one member's rows by every other
    contribution dimension (blank -> ``UNKNOWN``), derived once."""
    rows = _member_rows(m, dataset_id, dim, member)
    others = [d for d in CONTRIBUTION_DIMENSIONS if d != dim]
    long = rows.select(*_M6, *[F.coalesce(F.col(d), F.lit(UNKNOWN_CATEGORY)).alias(d) for d in others]) \
        .unpivot(ids=list(_M6), values=others, variableColumnName="dimension",
                 valueColumnName="category")
    return derived_once(long.groupBy("dimension", "category").agg(*[lsum(c).alias(c) for c in _M6]))


def _totals(parts: DataFrame, dim: str) -> DataFrame:
    any_one = next(d for d in CONTRIBUTION_DIMENSIONS if d != dim)
    return parts.filter(F.col("dimension") == any_one).agg(*[lsum(c).alias(c) for c in _M6])


# ---------------------------------------------------------------------- K1
def driver_totals(m: DataFrame, dataset_id: str, dim: str, member: str, parts: DataFrame | None = None) -> DataFrame:
    """K1 — PY/CY leads and admissions of one member, rates and changes.
    ``parts``: its :func:`contributions`, where they are at hand."""
    t = (_totals(parts, dim) if parts is not None
         else _member_rows(m, dataset_id, dim, member).agg(*[lsum(c).alias(c) for c in _M6]))
    cy_h, py_h = rate_h("cy_admission", "cy_leads"), rate_h("py_admission", "py_leads")
    return t.select(
        F.lit(dim).alias("dimension"), F.lit(member).alias("member"), *_M6,
        from_h(cy_h).alias("cy_conv"), from_h(py_h).alias("py_conv"),
        (F.col("cy_leads") - F.col("py_leads")).alias("leads_change"),
        from_h(_growth0_h(F.col("cy_leads"), F.col("py_leads"))).alias("leads_growth"),
        (F.col("cy_admission") - F.col("py_admission")).alias("admission_change"),
        from_h(_growth0_h(F.col("cy_admission"), F.col("py_admission"))).alias("admission_growth"),
        from_h(cy_h - py_h).alias("conv_change"),
        cy_h.alias("cy_conv_h"), (cy_h - py_h).alias("conv_change_h"))


# ---------------------------------------------------------------------- K2
def driver_contributions(m: DataFrame, dataset_id: str, dim: str, member: str, parts: DataFrame | None = None) -> DataFrame:
    """K2 — the member's :func:`contributions` with CY/PY admission shares of
    the member's total and the share change (mix shift)."""
    g = parts if parts is not None else contributions(m, dataset_id, dim, member)
    tot = _totals(g, dim).select(F.col("cy_admission").alias("_tcy"), F.col("py_admission").alias("_tpy"))
    g = g.crossJoin(F.broadcast(tot))
    cy_h, py_h = rate_h("cy_admission", "cy_leads"), rate_h("py_admission", "py_leads")
    cys, pys = rate_h("cy_admission", "_tcy"), rate_h("py_admission", "_tpy")
    return g.select(
        "dimension", "category", "cy_leads", "py_leads",
        (F.col("cy_leads") - F.col("py_leads")).alias("leads_change"),
        from_h(_growth0_h(F.col("cy_leads"), F.col("py_leads"))).alias("leads_growth"),
        "cy_admission", "py_admission",
        (F.col("cy_admission") - F.col("py_admission")).alias("admission_change"),
        from_h(_growth0_h(F.col("cy_admission"), F.col("py_admission"))).alias("admission_growth"),
        from_h(cy_h).alias("cy_conv"), from_h(py_h).alias("py_conv"),
        from_h(cy_h - py_h).alias("conv_change"),
        from_h(cys).alias("cy_share"), from_h(pys).alias("py_share"),
        from_h(cys - pys).alias("share_change"),
        cy_h.alias("cy_conv_h"), (cy_h - py_h).alias("conv_change_h"),
        _growth0_h(F.col("cy_leads"), F.col("py_leads")).alias("leads_growth_h"))


# ---------------------------------------------------------------------- K3
def driver_ranking(totals: DataFrame, contrib: DataFrame, n: int = TOP_DRIVERS) -> DataFrame:
    """K3 — lead volume, conversion efficiency (|points| x 1000) and the top
    category of each dimension by |admission change| (ties: name), ranked by
    absolute impact; top ``n``.  ``low_sample`` below 10 current leads."""
    lead_item = F.struct(
        F.lit("Lead volume change").alias("driver"), F.lit(None).cast("string").alias("dimension"),
        F.lit(None).cast("string").alias("category"),
        F.abs(F.col("leads_change")).cast("double").alias("impact"),
        F.col("py_leads").cast("double").alias("previous"),
        F.col("cy_leads").cast("double").alias("current"),
        F.col("leads_change").cast("double").alias("change"), F.lit(False).alias("low_sample"))
    conv_item = F.struct(
        F.lit("Conversion efficiency").alias("driver"), F.lit(None).cast("string").alias("dimension"),
        F.lit(None).cast("string").alias("category"),
        (F.abs(F.col("conv_change_h")) * (CONVERSION_WEIGHT // 100)).cast("double").alias("impact"),
        F.col("py_conv").alias("previous"), F.col("cy_conv").alias("current"),
        F.col("conv_change").alias("change"), F.lit(False).alias("low_sample"))
    t = totals.select(F.explode(F.array(lead_item, conv_item)).alias("d")).select("d.*")
    best = (contrib.groupBy("dimension").agg(F.min_by(
        F.struct("category", "admission_change", "py_admission", "cy_admission", "cy_leads"),
        F.struct((-F.abs(F.col("admission_change"))).alias("k"), F.col("category"))).alias("w")))
    cats = best.select(
        F.concat(F.initcap(F.regexp_replace("dimension", "_", " ")), F.lit(": "), F.col("w.category"))
        .alias("driver"), "dimension", F.col("w.category").alias("category"),
        F.abs(F.col("w.admission_change")).cast("double").alias("impact"),
        F.col("w.py_admission").cast("double").alias("previous"),
        F.col("w.cy_admission").cast("double").alias("current"),
        F.col("w.admission_change").cast("double").alias("change"),
        (F.col("w.cy_leads") < MIN_INSIGHT_LEADS).alias("low_sample"))
    allr = t.unionByName(cats)
    # At most 2 + number of dimensions rows: a global order is cheap here.
    ranked = allr.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("impact").desc(), F.col("driver").asc())))
    return ranked.filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------------- K4
def driver_anomalies(totals: DataFrame, contrib: DataFrame) -> DataFrame:
    """K4 — (a) >= 10 leads, lead growth >= 50 % and conversion down >= 5
    points; (b) >= 10 leads, < 5 % of the member's leads, conversion above
    1.5x the member's.  Exact integer comparisons on hundredths."""
    t = totals.select(F.col("cy_leads").alias("_tl"), F.col("cy_conv_h").alias("_tc"))
    j = contrib.crossJoin(F.broadcast(t))
    a = ((F.col("cy_leads") >= MIN_INSIGHT_LEADS) & (F.col("leads_change") > 0)
         & (F.col("leads_growth_h") >= 5000) & (F.col("conv_change_h") <= -500))
    b = ((F.col("cy_leads") >= MIN_INSIGHT_LEADS) & (F.col("cy_leads") * 100 < F.col("_tl") * 5)
         & (F.col("cy_conv_h") * 2 > F.col("_tc") * 3))
    kinds = F.array(F.when(a, F.lit("growth_with_falling_conversion")),
                    F.when(b, F.lit("small_but_high_conversion")))
    return (j.select("dimension", "category", "cy_leads", "leads_growth", "cy_conv", "conv_change",
                     F.explode(F.array_compact(kinds)).alias("anomaly")))


# ---------------------------------------------------------------------- K5
def driver_tables(contrib: DataFrame, n: int = 5) -> DataFrame:
    """K5 — top ``n`` sources by admission change (non-zero; ``main_source``
    when the member is a source), top 3 campuses / states / owners by
    |admission change|.  The first two growers note a share shift >= 1 point."""
    src = contrib.filter(F.col("dimension").isin("source", "main_source"))
    # Prefer 'source'; fall back to 'main_source' only when no 'source' rows exist.
    pref = src.agg(F.max((F.col("dimension") == "source").cast("int")).alias("_has"))
    src = (src.crossJoin(F.broadcast(pref))
           .filter(F.when(F.col("_has") == 1, F.col("dimension") == "source")
                   .otherwise(F.col("dimension") == "main_source"))
           .filter(F.col("admission_change") != 0).drop("_has")
           .withColumn("table", F.lit("source_growth"))
           .withColumn("_k", -F.col("admission_change").cast("double")))
    geo = (contrib.filter(F.col("dimension").isin("campus_name", "state", "owner"))
           .withColumn("table", F.col("dimension"))
           .withColumn("_k", -F.abs(F.col("admission_change")).cast("double")))
    both = src.unionByName(geo)
    limit = F.when(F.col("table") == "source_growth", F.lit(n)).otherwise(F.lit(3))
    w = Window.partitionBy("table").orderBy("_k", "category")
    # The literal bound lets Spark plan a WindowGroupLimit; the per-table bound follows.
    top = (both.withColumn("rank", F.row_number().over(w))
           .filter((F.col("rank") <= max(n, 3)) & (F.col("rank") <= limit))
           .withColumn("rank", F.col("rank").cast("long")))
    note = ((F.col("table") == "source_growth") & (F.col("rank") <= 2)
            & (F.abs(F.col("share_change")) >= 1.0))
    return top.select("table", "rank", "dimension", "category", "py_admission", "cy_admission",
                      "admission_change", "cy_share", "share_change", note.alias("share_shift_noted"))
