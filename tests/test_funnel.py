import datetime as dt

from conftest import metrics_df, rows
from funnelyard.operators import funnel as Fn
from funnelyard.operators import metrics as Mx


def _hier(spark):
    recs = [("IN HOUSE", "D: NNEXT", "GSN", 10, 8, 4, 5, 4, 2),
            ("OUT SOURCED", "SHIKSHA", "Shiksha - ED", 5, 4, 1, 10, 8, 3),
            ("OTHERS", "DIRECT", "YouTube", 8, 6, 2, 0, 0, 0),
            ("OTHERS", "FB", "FB Ads", 10, 5, 3, 5, 2, 0),
            (None, "  ", "", 2, 1, 1, 1, 1, 0)]
    return metrics_df(spark, [dict(dataset_id="h", lead_type=a, source=b, main_source=c, cy_leads=d,
                                   cy_registration=e, cy_admission=f, py_leads=g, py_registration=h,
                                   py_admission=i) for a, b, c, d, e, f, g, h, i in recs])


def test_tree3_labels_sums_and_blank_row(spark):
    t = rows(Fn.source_tree3(_hier(spark), "h", 2026, 2026, 2025))
    l1 = {r["name"]: r for r in t if r["level"] == 1}
    assert (l1["IN-HOUSE"]["leads"], l1["IN-HOUSE"]["py_leads"]) == (10, 5)
    assert (l1["OUT-SOURCED"]["leads"], l1["OUT-SOURCED"]["py_leads"]) == (5, 10)
    leaf = [r for r in t if r["level"] == 3 and r["l1"] == "IN-HOUSE"][0]
    assert (leaf["l2"], leaf["l3"]) == ("NNEXT", "GSN")
    blank = [r for r in t if r["level"] == 3 and r["l3"] == "UNKNOWN"][0]
    assert (blank["l1"], blank["l2"], blank["leads"], blank["py_leads"]) == ("OTHERS", "OTHER", 2, 1)
    total = [r for r in t if r["level"] == 0][0]
    assert total["leads"] == sum(r["leads"] for r in t if r["level"] == 1) == 35
    # roll-up invariant: each level sums to the total
    for lvl in (1, 2, 3):
        assert sum(r["leads"] for r in t if r["level"] == lvl) == 35


def test_tree3_year_shifting(spark):
    def inhouse(year):
        t = rows(Fn.source_tree3(_hier(spark), "h", year, 2026, 2025))
        r = [x for x in t if x["level"] == 1 and x["name"] == "IN-HOUSE"][0]
        return r["leads"], r["py_leads"]
    assert inhouse(2026) == (10, 5) and inhouse(2025) == (5, 0) and inhouse(2027) == (0, 10)


def test_tree_search_keeps_ancestors(spark):
    t = Fn.source_tree3(_hier(spark), "h", 2026, 2026, 2025)
    got = {(r["level"], r["name"]) for r in rows(Fn.tree_search(t, "youtube"))}
    assert got == {(1, "OTHERS"), (2, "DIRECT"), (3, "YouTube")}


def _events(spark):
    d = dt.date
    leads = spark.createDataFrame([(1, "Digital", "Google", d(2026, 1, 5)), (2, "Digital", "Google", d(2026, 2, 1)),
                                   (3, "Offline", "Fair", d(2026, 3, 1)), (4, "Digital", "FB", d(2026, 4, 1)),
                                   (5, "Digital", "Google", d(2025, 5, 1)), (6, "Offline", "Fair", d(2025, 6, 1))],
                                  "lead_id long, main_source string, source string, event_date date")
    reg = spark.createDataFrame([(1, d(2026, 2, 1)), (2, d(2026, 3, 1)), (3, d(2026, 4, 1)), (5, d(2025, 7, 1))],
                                "lead_id long, event_date date")
    adm = spark.createDataFrame([(1, d(2026, 6, 1)), (2, d(2026, 6, 2)), (3, d(2026, 6, 3)), (6, d(2025, 8, 1))],
                                "lead_id long, event_date date")
    return {"leads": leads, "registration": reg, "admission": adm}


def test_funnel_yoy_counts_rates_growth(spark):
    r = rows(Fn.funnel_yoy(_events(spark), 2026))[0]
    assert (r["cy_leads"], r["cy_registration"], r["cy_admission"]) == (4, 3, 3)
    assert (r["py_leads"], r["py_registration"], r["py_admission"]) == (2, 1, 1)
    assert (r["lead_registration_rate"], r["lead_admission_rate"], r["registration_admission_rate"]) == (75.0, 75.0, 100.0)
    assert (r["leads_growth"], r["registration_growth"], r["admission_growth"]) == (100.0, 200.0, 200.0)


def test_source_performance_union_of_keys_and_status(spark):
    r = {(x["main_source"], x["source"]): x for x in rows(Fn.source_performance(_events(spark), 2026))}
    assert r[("Digital", "FB")]["growth_status"] == "new_source"
    assert r[("Digital", "Google")]["previous_leads"] == 1 and r[("Digital", "Google")]["leads"] == 2
    assert r[("Offline", "Fair")]["admission"] == 1 and r[("Offline", "Fair")]["previous_admission"] == 1
    ins = rows(Fn.source_insights(Fn.source_performance(_events(spark), 2026)))
    assert {i["type"] for i in ins} <= {"high_leads_low_conversion", "new_source", "dropped_source"}


def test_year_filter_relative(spark):
    ev = _events(spark)["leads"]
    assert Fn.year_filter(ev, "event_date", when="previous_year", today=dt.date(2026, 7, 1)).count() == 2


def test_stage_funnel_omits_empty_registration(spark):
    m = metrics_df(spark, [dict(dataset_id="d", cy_leads=10, cy_admission=2)])
    st = rows(Mx.stage_funnel(m, "d"))
    assert [s["stage"] for s in st] == ["Leads", "Admissions"] and st[1]["conversion_rate"] == 20.0


def test_seasonal_allocation_sums_to_total(spark):
    m = metrics_df(spark, [dict(dataset_id="d", cy_leads=997, cy_admission=101, py_leads=13)])
    r = rows(Mx.seasonal_allocation(m, "d"))
    assert len(r) == 9 and sum(x["cy_leads"] for x in r) == 997 and sum(x["py_leads"] for x in r) == 13
    assert r[0]["cy_leads"] == 997 * 2 // 100
