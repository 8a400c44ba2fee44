"""Nulls, gaps, hot groups and whole-table results of the core operators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, metrics_df, rows
from funnelyard.operators import audit as T
from funnelyard.operators import catalog as Cat
from funnelyard.operators import compare as C
from funnelyard.operators import funnel as Fn
from funnelyard.operators import periods as D
from funnelyard.sources import bindings as B


def test_a_missing_status_is_rejected_with_its_reason(spark):
    upd = spark.createDataFrame([("1", None, None, 1), ("2", "correct", "bad", 1), ("3", "no", None, 1), ("4", "correct", None, 1)],
                                "message_id string, status string, error_category string, seq long")
    evals = upd.where("false").select("message_id", "status", "error_category")
    merged, rejected = T.record_evaluations(evals, upd)
    assert {r["message_id"]: r["reason"] for r in rows(rejected)} == {"1": "missing_status", "2": "invalid_error_category", "3": "invalid_status"}
    assert [r["message_id"] for r in rows(merged)] == ["4"]


def test_transcript_filters_need_their_columns(spark):
    t = spark.createDataFrame([("1", 1, "ds1", "2021-22")], "message_id string, conv_id long, dataset_id string, academic_label string")
    assert T.transcripts(t, dataset_id="ds1", period="2021-22").count() == 1 and T.transcripts(t, dataset_id="other").count() == 0
    for options in ({"dataset_id": "ds1"}, {"period": "2021-22"}):
        with pytest.raises(ValueError):
            T.transcripts(t.select("message_id", "conv_id"), **options)


def test_export_of_turns_without_years_and_with_nested_fields(spark):
    t = spark.createDataFrame([("1", 1, "q", "a", [], {"k": "v"}, True), ("2", 1, "q", "a", ["2022", "2024"], None, None)],
                              "message_id string, conv_id long, question string, answer string, selected_years array<string>, "
                              "filters map<string,string>, success boolean")
    r = {x["message_id"]: x for x in rows(T.export_projection(t))}
    assert (r["1"]["year_a"], r["1"]["year_b"], r["1"]["filters"], r["1"]["success"]) == (None, None, {"k": "v"}, True)
    assert (r["2"]["year_a"], r["2"]["year_b"], r["2"]["intent"]) == ("2022", "2024", None)


def test_followers_skip_gaps_and_cross_blocks(spark):
    turns = [(1, t, "user" if i % 2 == 0 else "assistant", f"m{t}") for i, t in enumerate([0, 1, 5, 999, 1000, 5003, 5004])]
    turns += [(2, 3, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["next_text"] for r in rows(B.followed(df))}
    assert got == {(1, 0): "m1", (1, 1): "m5", (1, 5): "m999", (1, 999): "m1000", (1, 1000): "m5003", (1, 5003): "m5004", (1, 5004): None, (2, 3): None}


def test_message_names_do_not_collide(spark):
    t = B.turns(spark, SF001)
    assert t.count() == t.select("message_id").distinct().count()


def test_every_fact_lands_in_one_session(spark):
    facts, m = B.fact(spark, SF001), B.metrics(spark, SF001)
    assert m.count() == facts.count()
    assert m.agg(F.sum(F.col("cy_leads") + F.col("py_leads"))).first()[0] == facts.count()
    registry = {r["dataset_id"]: (r["start_year"], r["end_year"], r["label"]) for r in rows(B.metrics_registry(spark, SF001))}
    assert set(registry) == {r[0] for r in m.select("dataset_id").distinct().collect()}
    assert registry["ds2024"] == (2023, 2024, "2023-24")


def test_column_kinds_come_from_all_rows(spark):
    staged = spark.createDataFrame([("d", i, '{"a": "1", "b": "true", "c": null, "e": "%s"}' % ("x" if i == 1500 else "2.5" if i % 2 else "2")) for i in range(1, 1601)],
                                   "dataset_id string, row_number long, raw_data string")
    got = {r["column_name"]: r for r in rows(Cat.build_catalog(staged))}
    assert {c: r["data_type"] for c, r in got.items()} == {"a": "int", "b": "bool", "c": "unknown", "e": "str"}
    assert len(got["e"]["samples"]) == 20 and got["e"]["sample_values"] == ["2.5", "2", "2.5", "2", "2.5"]


def test_period_of_values_does_not_depend_on_the_first_rows(spark):
    staged = spark.createDataFrame([("d", i, '{"x": "%d"}' % (2021 if i <= 30 else 2024)) for i in range(1, 101)],
                                   "dataset_id string, row_number long, raw_data string")
    files = spark.createDataFrame([("d", "d.csv")], "dataset_id string, original_filename string")
    assert rows(D.detect_period_full(files, staged))[0]["label"] == "2023-24"


def test_relationships_by_shared_values(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "lead_id long")
    links = rows(Cat.discover_relationships({"a": ids(1, 2, 3, 4, 4, None), "b": ids(1, 2, 9), "c": ids(7), "d": spark.range(3)}))
    got = {r["right_table"]: (r["left_table"], r["matching_values"], r["left_row_count"], r["validation_score"], r["status"]) for r in links}
    assert got == {"b": ("a", 2, 5, 0.6667, "possible"), "c": ("a", 0, 5, 0.0, "rejected")}  # n - 1 links


def test_catalog_counts_filled_cells(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, v string")
    cat = Cat.catalog_from_tables(spark, {"t": df})
    assert [(r["column_name"], r["row_count"], r["filled_count"]) for r in rows(cat)] == [("k", 2, 2), ("v", 2, 0)]
    assert [r["column_name"] for r in rows(Cat.filled(cat))] == ["k"]


def test_pages_and_lists_without_limits(spark):
    df = spark.range(12_000)
    assert C.page(df, ["id"], 11_000).count() == 11_000
    m = metrics_df(spark, [dict(dataset_id="ds2024", state=f"s{i:03d}", cy_leads=i) for i in range(300)])
    reg = spark.createDataFrame([("ds2024", 2023, 2024, 1, True)], "dataset_id string, start_year int, end_year int, created_seq long, is_period_active boolean")
    trend = rows(C.historical_trend(m, reg, "leads", "state"))
    assert len(trend) == 600 and {r["rank"] for r in trend} == set(range(1, 301))
    assert next(r for r in trend if r["rank"] == 1)["name"] == "s299"
    assert len(rows(C.compare_periods(m, reg, 2024, 2023, "state", "leads"))) == 300


def test_workspace_by_label(spark):
    m = metrics_df(spark, [dict(dataset_id="ds2022", source="a", state="x", cy_leads=3), dict(dataset_id="ds2024", source="a", state="x", py_leads=5, cy_leads=9)])
    reg = spark.createDataFrame([("ds2022", 2021, 2022, 1, True), ("ds2024", 2023, 2024, 2, True)],
                                "dataset_id string, start_year int, end_year int, created_seq long, is_period_active boolean")
    got = rows(C.workspace_by_period(m, reg, "2021-22", 2023))[0]
    assert (got["period_a_leads"], got["period_b_leads"]) == (3, 5)
    with pytest.raises(ValueError):
        C.workspace_by_period(m, reg, 2030, 2023)


def test_insight_lists_name_strong_sources(spark):
    perf = spark.createDataFrame([("m", "a", "strong", "increased"), ("m", "b", "high_leads_low_conversion", "new_source"), ("m", "c", "normal", "dropped")],
                                 "main_source string, source string, performance_flag string, growth_status string")
    assert sorted((r["list"], r["source"]) for r in rows(Fn.insight_lists(perf))) == [("dropped", "c"), ("new", "b"), ("strong", "a"), ("weak", "b")]


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from funnelyard import session

    class Context:
        master = "spark://somewhere:7077"
        def getCheckpointDir(self): return None
        def getConf(self): return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_the_documented_layout_of_row_ids(spark):
    """`ordinal_within` reads partition and position from them."""
    df = spark.range(0, 50, 1, 4).select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    for p in {r.p for r in df.collect()}:
        assert [r.m for r in df.where(F.col("p") == p).orderBy("id").collect()] == [(p << 33) + i for i in range(sum(r.p == p for r in df.collect()))]


def test_sketches_screen_relationships(spark):
    a, b, c = spark.range(20_000).select(F.col("id").alias("k")), spark.range(10_000, 40_000).select(F.col("id").alias("k")), spark.range(90_000, 99_000).select(F.col("id").alias("k"))
    pairs = [("ab", a, "k", b, "k"), ("ac", a, "k", c, "k"), ("small", spark.range(50).toDF("k"), "k", spark.range(40).toDF("k"), "k")]
    est = {r["pair"]: r for r in rows(Cat.estimate_relationships(pairs))}
    assert abs(est["ab"]["left_distinct"] - 20_000) < 1_000 and abs(est["ab"]["score"] - 0.5) < est["ab"]["score_error"] < 0.2
    assert est["ac"]["matching_values"] < 100 and (est["small"]["score"], est["small"]["score_error"]) == (1.0, 0.0)
    kept = {r["pair"]: r["matching_values"] for r in rows(Cat.screen_relationships(pairs))}
    assert kept == {"ab": 10_000, "small": 40}
    assert rows(Cat.screen_relationships(pairs[1:2])) == []


def test_columns_with_values_needs_no_scan(spark):
    t = spark.createDataFrame([(i, None, "x" if i == 4_000 else None) for i in range(5_000)], "id long, none string, late string")
    got = rows(Cat.columns_with_values(spark, {"t": t, "empty": t.limit(0)}))
    assert [(r["table_name"], r["column_name"], r["position"]) for r in got] == [("t", "id", 1), ("t", "late", 3)]
