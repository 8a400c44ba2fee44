from conftest import metrics_df, rows
from funnelyard.operators import catalog as Cat
from funnelyard.operators import drivers as K
from funnelyard.operators import metrics as Mx
from funnelyard.operators import periods as D
from funnelyard.operators import semantics as S


def _driver_data(spark):
    recs = [dict(dataset_id="d", program_name="P", source="A", main_source="M1", owner="o1", campus_name="C1",
                 state="S1", cy_leads=100, cy_admission=30, py_leads=50, py_admission=20),
            dict(dataset_id="d", program_name="P", source="B", main_source="M1", owner="o2", campus_name="C1",
                 state="S2", cy_leads=20, cy_admission=2, py_leads=40, py_admission=10),
            dict(dataset_id="d", program_name="P", source=None, main_source="M2", owner="o1", campus_name="C2",
                 state="S1", cy_leads=12, cy_admission=9, py_leads=2, py_admission=1),
            dict(dataset_id="d", program_name="Q", source="A", cy_leads=999, cy_admission=1)]
    return metrics_df(spark, recs)


def test_driver_totals_and_contributions(spark):
    m = _driver_data(spark)
    t = rows(K.driver_totals(m, "d", "program_name", "P"))[0]
    assert (t["cy_leads"], t["py_leads"], t["cy_admission"], t["py_admission"]) == (132, 92, 41, 31)
    assert t["leads_growth"] == 43.48 and t["conv_change"] == round(31.06 - 33.70, 2)
    c = {(r["dimension"], r["category"]): r for r in rows(K.driver_contributions(m, "d", "program_name", "P"))}
    assert ("source", "UNKNOWN") in c and c[("source", "A")]["cy_share"] == 73.17
    # shares of every dimension sum to 100 (+- rounding)
    for dim in ("source", "owner", "state"):
        tot = sum(r["cy_share"] for (d, _), r in c.items() if d == dim)
        assert abs(tot - 100.0) <= 0.02


def test_driver_ranking_anomalies_tables(spark):
    m = _driver_data(spark)
    tot, con = K.driver_totals(m, "d", "program_name", "P"), K.driver_contributions(m, "d", "program_name", "P")
    rk = rows(K.driver_ranking(tot, con))
    assert [r["rank"] for r in rk] == list(range(1, len(rk) + 1)) and len(rk) <= 5
    assert rk[0]["driver"] == "Conversion efficiency"  # |Δ points| x 1000 dominates
    an = {(r["category"], r["anomaly"]) for r in rows(K.driver_anomalies(tot, con))}
    # source A: leads +100 % while conversion fell 10 points; nothing is under 5 % of 132 leads
    assert ("A", "growth_with_falling_conversion") in an
    assert not any(kind == "small_but_high_conversion" for _, kind in an)
    tb = rows(K.driver_tables(con, 5))
    assert {r["table"] for r in tb} >= {"source_growth", "campus_name", "state", "owner"}
    assert all(r["rank"] <= (5 if r["table"] == "source_growth" else 3) for r in tb)


def test_insight_winners_only_meaningful_facts(spark):
    m = metrics_df(spark, [dict(dataset_id="d", program_name="X", source="s", state="st", campus_name="c",
                                owner="o", cy_leads=5, cy_admission=0, py_admission=0)])
    ids = {r["insight_id"] for r in rows(Mx.insight_winners(m, "d"))}
    assert ids == {"highest_lead_source"}  # no admissions, no change, <10 leads for best conversion


def test_filter_options_cap_and_blank_removal(spark):
    m = metrics_df(spark, [dict(dataset_id="d", owner=f"o{i:02d}", state=" " if i % 2 else "S") for i in range(30)])
    r = rows(Mx.filter_options(m, ["d"], ["owner", "state"], cap=10))
    assert sum(1 for x in r if x["dimension"] == "owner") == 10
    assert [x["value"] for x in r if x["dimension"] == "state"] == ["S"]


def test_detect_period_full_signals(spark):
    files = spark.createDataFrame([("a", "a_2024-25.csv"), ("b", "b_2026.csv"), ("c", "c.csv"), ("d", "d.csv")],
                                  "dataset_id string, original_filename string")
    staged = spark.createDataFrame(
        [("b", 1, '{"Leads 2023-24": "1"}'), ("c", 1, '{"x": "2022"}'), ("c", 2, '{"x": "2022"}'),
         ("c", 3, '{"x": "2021"}'), ("d", 1, '{"x": "none"}')],
        "dataset_id string, row_number long, raw_data string")
    r = {x["dataset_id"]: (x["label"], x["confidence"], x["method"]) for x in rows(D.detect_period_full(files, staged))}
    assert r["a"] == ("2024-25", 0.95, "filename")
    assert r["b"] == ("2023-24", 0.8, "column_header")   # header range beats a single-year file name
    assert r["c"] == ("2021-22", 0.55, "data_value")     # most frequent value year
    assert r["d"] == (None, 0.0, "none")


def test_map_columns_rules(spark):
    cat = spark.createDataFrame([(c,) for c in ("CY Leads", "Program Name (Short)", "Prev Leads 2024",
                                                "Counsellor", "Cluster", "zzz")], "column_name string")
    r = {x["original_column"]: (x["canonical_field"], x["confidence"], x["method"])
         for x in rows(Cat.map_columns(cat, keys=()))}
    assert r["CY Leads"] == ("cy_leads", 0.99, "exact_rule")
    assert r["Program Name (Short)"] == ("program_name", 0.98, "exact_rule")
    assert r["Prev Leads 2024"] == ("py_leads", 0.85, "keyword")   # specific rule before generic 'lead'
    assert r["Counsellor"] == ("owner", 0.8, "keyword")
    assert r["zzz"] == (None, 0.0, "unmapped")


def test_infer_semantics_rules_and_tokens(spark):
    cat = spark.createDataFrame([("t", c, "string") for c in ("CY Lead - Admission%", "PY Leads", "Program_Name",
                                                              "Admission 2024", "student name", "zzz")],
                                "table_name string, column_name string, data_type string")
    r = {}
    for x in rows(S.infer_semantics(cat)):
        r.setdefault(x["column_name"], []).append((x["rank"], x["concept_key"], x["score"], x["time_context"]))
    assert r["CY Lead - Admission%"] == [(1, "lead_admission_rate", 1.0, "current_year")]
    assert r["PY Leads"] == [(1, "leads", 1.0, "previous_year")]
    assert r["Program_Name"][0][1] == "program" and r["Program_Name"][0][2] == 0.9
    assert r["student name"] == [(1, "name", 1.0, None)]
    assert "zzz" not in r
    assert r["Admission 2024"][0][3] == "2024" and r["Admission 2024"][0][1] == "admission"


def test_map_physical_scores(spark):
    cat = spark.createDataFrame([("main", "enquiries", "enquiry_id", "bigint", True, 1),
                                 ("main", "enquiries", "program_name", "string", True, 2),
                                 ("main", "other", "program_name", "string", True, 1)],
                                "table_schema string, table_name string, column_name string, data_type string, "
                                "is_nullable boolean, position int")
    r = {(x["concept_key"], x["table_name"], x["column_name"], x["column_role"]): x["confidence"]
         for x in rows(S.map_physical(cat))}
    assert r[("leads", "enquiries", "enquiry_id", "entity")] == 1.0
    assert r[("program", "enquiries", "program_name", "dimension")] == 1.0
    assert r[("program", "other", "program_name", "dimension")] == 0.5
