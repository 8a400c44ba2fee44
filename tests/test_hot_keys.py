"""Skewed inputs: one member holds ~40 % of the rows.  Results must equal a
brute-force computation, and aggregation must be partial before the shuffle."""

from pyspark.sql import functions as F

from conftest import rows
from funnelyard.operators import compare as C
from funnelyard.operators import metrics as Mx


def _skewed(spark):
    d = spark.range(0, 20000).select(
        F.when(F.col("id") % 5 < 2, F.lit("HOT")).otherwise(F.concat(F.lit("s"), (F.col("id") % 97).cast("string")))
        .alias("source"),
        F.concat(F.lit("st"), (F.col("id") % 7).cast("string")).alias("state"),
        F.concat(F.lit("p"), (F.col("id") % 13).cast("string")).alias("program_name"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("campus_name"),
        F.concat(F.lit("o"), (F.col("id") % 11).cast("string")).alias("owner"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("dataset_id"),
        (F.col("id") % 4).alias("cy_leads"), (F.col("id") % 2).alias("cy_admission"),
        (F.col("id") % 3).alias("py_leads"), (F.col("id") % 5 == 0).cast("long").alias("py_admission"))
    for c in ("owner", "cluster", "lead_type", "main_source"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit("x"))
    for c in ("cy_registration", "py_registration"):
        d = d.withColumn(c, F.lit(0).cast("long"))
    return d.repartition(8)


def test_workspace_on_hot_member_equals_brute_force(spark):
    m = _skewed(spark)
    ws = {(r["source"], r["state"]): r for r in rows(C.period_workspace(m, C.PeriodRef("A"), C.PeriodRef("B")))}
    brute = {(r["source"], r["state"]): (r["a"], r["b"]) for r in rows(
        m.groupBy("source", "state").agg(F.sum(F.when(F.col("dataset_id") == "A", F.col("cy_leads"))).alias("a"),
                                         F.sum(F.when(F.col("dataset_id") == "B", F.col("cy_leads"))).alias("b")))}
    assert len(ws) == len(brute)
    assert all((ws[k]["period_a_leads"], ws[k]["period_b_leads"]) == tuple(v or 0 for v in brute[k])
               for k in brute)


def test_member_facts_partial_aggregation_and_values(spark):
    m = _skewed(spark)
    facts = Mx.member_facts(m.filter(F.col("dataset_id") == "A"), ("source", "state"))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan  # map-side combine before the exchange
    got = {(r["dimension"], r["member"]): r["cy_leads"] for r in rows(facts)}
    hot = m.filter((F.col("dataset_id") == "A") & (F.col("source") == "HOT")).agg(F.sum("cy_leads")).first()[0]
    assert got[("source", "HOT")] == hot


def test_top_performers_with_hot_member(spark):
    m = _skewed(spark)
    top = rows(Mx.top_performers(m, "A", "leads", 3))
    src = [r["entity"] for r in sorted(top, key=lambda r: r["rank"]) if r["dimension"] == "source"]
    assert src[0] == "HOT" and len(src) == 3
