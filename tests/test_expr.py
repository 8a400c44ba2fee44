from pyspark.sql import functions as F

from funnelyard.functions.core import (blank_label, flag_by_rate, flag_by_zero, growth, is_placeholder,
                                       pct, rate_h)
from funnelyard.functions.ordinal import ordinal_within


def test_pct_rounds_half_away_from_zero_on_exact_integers(spark):
    df = spark.createDataFrame([(1005, 100000), (125, 100000), (-125, 100000), (1, 3), (2, 3), (5, 0)],
                               "n long, d long")
    got = [r[0] for r in df.select(pct("n", "d")).collect()]
    assert got == [1.01, 0.13, -0.13, 33.33, 66.67, None]


def test_zero_denominator_modes(spark):
    df = spark.createDataFrame([(3, 0)], "n long, d long")
    r = df.select(pct("n", "d", "zero").alias("z"), pct("n", "d").alias("n0"),
                  rate_h("n", "d").alias("h"), growth("n", "d").alias("g")).first()
    assert (r.z, r.n0, r.h, r.g) == (0.0, None, 0, None)


def test_blank_label_and_placeholders(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" x ",), ("N/A",), ("Grand Total",)], "v string")
    got = [tuple(r) for r in df.select(blank_label("v"), is_placeholder("v")).collect()]
    assert got == [("Unspecified", True), ("Unspecified", True), ("x", False), ("N/A", True),
                   ("Grand Total", True)]


def test_flags(spark):
    df = spark.createDataFrame([(10, 1), (10, 5), (10, 3), (0, 0), (10, 0)], "l long, a long")
    got = [tuple(r) for r in df.select(flag_by_rate("l", rate_h("a", "l", "null")),
                                       flag_by_zero("l", "a", rate_h("a", "l", "null"))).collect()]
    assert got == [("high_leads_low_conversion", "normal"), ("strong", "strong"), ("normal", "normal"),
                   ("normal", "normal"), ("high_leads_low_conversion", "high_leads_low_conversion")]


def test_ordinal_within_matches_row_number_with_hot_group(spark):
    from pyspark.sql import Window
    # One group holds most rows: the distributed numbering must equal row_number().
    df = spark.range(0, 5000).select((F.when(F.col("id") % 10 < 8, F.lit("hot"))
                                      .otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))).alias("g"),
                                     ((F.col("id") * 7919) % 5000).alias("o")).repartition(6)
    got = ordinal_within(df, ["g"], ["o"], name="rn")
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    bad = got.join(ref, ["g", "o"]).filter(F.col("rn") != F.col("rn2")).count()
    assert bad == 0 and got.count() == 5000


def test_ordinal_without_groups_is_global_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("o")).repartition(5)
    got = sorted(r.rn for r in ordinal_within(df, [], ["o"], name="rn").collect())
    assert got == list(range(1, 1001))
