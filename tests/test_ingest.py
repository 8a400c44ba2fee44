import os
import tempfile

from pyspark.sql import functions as F

from conftest import metrics_df, rows
from funnelyard.operators import clean as Cl
from funnelyard.operators import ingest as A
from funnelyard.sources.delimited import read_delimited
from funnelyard.sources.sinks import export_turns, write_metrics
from funnelyard.streaming.ingest_stream import ingest_stream, read_loaded


def _tmp():
    return tempfile.mkdtemp(prefix="funnelyard-test-")


def test_read_delimited_header_rules(spark):
    d = _tmp()
    p = os.path.join(d, "up.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿ Owner ,,CY Leads\n")
        f.write("a,x,10\n\n")
        f.write("b\n")
        f.write("c,y,3,extra\n")
    df = read_delimited(spark, p)
    assert df.columns == ["Owner", "col_1", "CY Leads"]
    assert [tuple(r) for r in df.collect()] == [("a", "x", "10"), ("b", None, None), ("c", "y", "3")]


def test_stage_and_normalise_with_rejects(spark):
    src = spark.createDataFrame([("o1", " 1,234 ", "Direct "), ("o2", "n.a.", ""), ("o3", None, "Web")],
                                "Owner string, Leads string, Src string")
    st = A.stage_records(src, "ds1", ["Owner"])
    assert [r.row_number for r in st.orderBy("row_number").collect()] == [1, 2, 3]
    n = rows(A.normalise_metrics(st, {"owner": "Owner", "cy_leads": "Leads", "source": "Src"}).orderBy("row_number"))
    assert [(r["cy_leads"], r["source"], r["rejected"]) for r in n] == [(1234, "Direct", False), (0, None, True),
                                                                         (0, "Web", False)]


def test_normalising_parses_each_record_once(spark):
    st = spark.createDataFrame([("d", 1, '{"o": " a ", "n": "1,234.5", "m": "x"}'), ("d", 2, '{"o": " "}'), ("d", 3, None)], "dataset_id string, row_number long, raw_data string")
    n = A.normalise_metrics(st, {"owner": "o", "source": "o", "cy_leads": "n", "py_leads": "m", "cy_admission": F.lit("n")})
    assert n._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1  # it was one for each use of a cell
    assert [(r.owner, r.source, r.cy_leads, r.py_leads, r.cy_admission, r.rejects) for r in n.orderBy("row_number").collect()] == [
        ("a", "a", 1235, 0, 1235, ["py_leads"]), (None, None, 0, 0, 0, []), (None, None, 0, 0, 0, [])]


def test_reconcile_load(spark):
    st = A.stage_records(spark.range(100).select(F.col("id").cast("string").alias("v")), "ds", ["v"])
    norm = A.normalise_metrics(st, {"cy_leads": "v"})
    r = rows(Cl.reconcile_load(st, norm))[0]
    assert (r["staged_rows"], r["normalised_rows"], r["duplicate_keys"], r["may_clear"]) == (100, 100, 0, True)
    r2 = rows(Cl.reconcile_load(st, norm.unionByName(norm.limit(3))))[0]
    assert r2["duplicate_keys"] == 3 and r2["may_clear"] is False


def test_write_metrics_replaces_only_touched_datasets(spark):
    path = os.path.join(_tmp(), "m")
    write_metrics(metrics_df(spark, [dict(dataset_id="a", cy_leads=1), dict(dataset_id="b", cy_leads=2)]), path)
    write_metrics(metrics_df(spark, [dict(dataset_id="a", cy_leads=5)]), path)
    got = {r.dataset_id: r.cy_leads for r in spark.read.parquet(path).collect()}
    assert got == {"a": 5, "b": 2}


def test_upsert_last_write_wins_and_keep_old(spark):
    base = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k long, a string, b double")
    upd = spark.createDataFrame([(2, "y1", None, 1), (2, "y2", None, 2), (3, "z", 3.0, 1)],
                                "k long, a string, b double, seq long")
    r = {x["k"]: x for x in rows(A.upsert(base, upd, ["k"], "seq"))}
    assert (r[2]["a"], r[2]["b"], r[2]["_source"]) == ("y2", None, "updated")
    assert r[3]["_source"] == "inserted" and r[1]["_source"] == "base"
    r2 = {x["k"]: x for x in rows(A.upsert(base, upd, ["k"], "seq", keep_old_if_null=True))}
    assert r2[2]["b"] == 2.0


def test_find_duplicates_hot_digest(spark):
    texts = [("same",) if i % 3 else (f"t{i}",) for i in range(300)]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    r = {x["id"]: x for x in rows(A.find_duplicates(df, "id", "text", "id"))}
    same = sorted(i for i in r if i % 3)
    assert r[same[0]]["is_duplicate"] is False
    assert all(r[b]["duplicate_of"] == a for a, b in zip(same, same[1:]))
    assert not any(r[i]["is_duplicate"] for i in r if i % 3 == 0)


def test_clean_records_issue_kinds(spark):
    df = spark.createDataFrame([(1, " a ", "u1@example.com"), (2, "", "bad mail"), (3, "b", None)],
                               "row_number long, name string, email string")
    iss = {(r["row_number"], r["type"]) for r in rows(Cl.explode_issues(Cl.clean_records(df)))}
    assert iss == {(1, "whitespace_normalized"), (2, "missing_value"), (2, "invalid_email"), (3, "missing_value")}
    s = rows(Cl.clean_summary(Cl.clean_records(df)))[0]
    assert (s["records_processed"], s["issues_found"], s["clean_rows"]) == (3, 4, 0)


def test_profile_counts_duplicates_and_missing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x long, y string")
    p = rows(Cl.profile_table(df, ["x"]))[0]
    assert (p["rows"], p["duplicate_rows"], p["missing_values"]) == (3, 1, 1)
    assert p["missing_percentage"] == 16.67 and p["duplicate_percentage"] == 33.33
    assert p["quality_score"] == 50.0 and len(p["sample_rows"]) == 3


def _ingest(spark, root, run=0, mapping=None, **options):
    ingest_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck{run}", mapping, **options).awaitTermination()
    return read_loaded(spark, f"{root}/out")


def _file(root, name, text):
    path = os.path.join(root, "in", name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_streaming_ingest_is_idempotent(spark):
    root = _tmp()
    _file(root, "ds=a/one.csv", "rn,owner,leads\n1,o1,5\n2,o2,7\n")
    _file(root, "ds=b/two.csv", "rn,owner,leads\n3,o3,1\n")
    for run in range(2):  # a replay (fresh checkpoint) must give the same table
        got = _ingest(spark, root, run, {"owner": "owner", "cy_leads": "leads"})
        assert _got(got, "dataset_id", "row_number", "cy_leads") == [("a", 1, 5), ("a", 2, 7), ("b", 1, 1)]


def test_a_dataset_is_assembled_from_several_batches_and_late_files(spark):
    root = _tmp()
    _file(root, "ds=a/1.csv", "owner,leads\no1,5\no2,6\n")
    _file(root, "ds=a/2.csv", "owner,leads\no3,7\n")
    mapping = {"owner": "owner", "cy_leads": "leads"}
    first = {r.cy_leads: r.row_number for r in _ingest(spark, root, 0, mapping, max_files_per_trigger=1).collect()}
    # numbered by arrival: either file may come first, each keeps its own order
    assert sorted(first.values()) == [1, 2, 3] and first[6] == first[5] + 1 and set(first) == {5, 6, 7}
    _file(root, "ds=a/3.csv", "owner,leads\no4,8\n")  # the same checkpoint: only the new file is read
    got = _ingest(spark, root, 0, mapping)
    assert {r.cy_leads: r.row_number for r in got.collect()} == first | {8: 4}
    rec = spark.read.parquet(f"{root}/out/reports/reconciliation").collect()
    assert [(r.dataset_id, r.staged_rows, r.normalised_rows, r.duplicate_keys, r.may_clear) for r in rec] == [("a", 4, 4, 0, True)]


def test_files_of_one_name_are_datasets_of_their_own(spark):
    root = _tmp()
    for name, n in (("p/a.csv", 1), ("q/a.csv", 2), ("q/a.txt", 3)):
        _file(root, name, f"owner,leads\no,{n}\n")
    got = _ingest(spark, root, 0, {"cy_leads": "leads"}, max_files_per_trigger=1)
    assert sorted(r.cy_leads for r in got.collect()) == [1, 2, 3]
    assert got.select("dataset_id").distinct().count() == 3
    assert all(r.dataset_id.startswith("a-") for r in got.collect())


def test_each_file_is_read_by_its_own_header(spark):
    root = _tmp()
    _file(root, "ds=a/1.csv", "Owner,CY Leads\nx,5\n")
    _file(root, "ds=a/2.csv", "CY Leads,extra,Owner\n6,e,y\n")
    got = _ingest(spark, root)
    assert _got(got, "owner", "cy_leads", "rejected") == [("x", 5, False), ("y", 6, False)]


def test_names_with_spaces_and_signs(spark):
    root = _tmp()
    _file(root, "ds=N%2FA b/1+2 %.csv", "owner,leads\nx,5\n")
    _file(root, "1+2 é.csv", "owner,leads\ny,6\n")
    got = _ingest(spark, root, 0, {"owner": "owner", "cy_leads": "leads"})
    assert {(r.dataset_id if r.owner == "x" else r.dataset_id[:6], r.owner, r.cy_leads) for r in got.collect()} == {("N/A b", "x", 5), ("1+2 é-", "y", 6)}


def test_quoted_line_breaks_stay_in_their_cell(spark):
    root = _tmp()
    _file(root, "ds=a/1.csv", 'owner,leads\n"two\nlines",5\nx,6\n')
    got = _ingest(spark, root, 0, {"owner": "owner", "cy_leads": "leads"})
    assert _got(got, "owner", "cy_leads") == [("two\nlines", 5), ("x", 6)]
    df = read_delimited(spark, f"{root}/in/ds=a/1.csv")
    assert df.count() == 2
    assert read_delimited(spark, f"{root}/in/ds=a/1.csv", no_line_breaks=True).count() == 3


def test_numbers_of_any_length_and_fraction(spark):
    values = {"1,234": 1234, "0.4999999": 0, "0.49999999999999999999999": 0, "0.5": 1, "-2.5": -3, "2.": 2, ".5": 1, "+7": 7, "1e3": 1000,
              "9223372036854775807": 9223372036854775807, "9223372036854775808": None, "123456789012345678901234567890": None,
              "9" * 50: None, "n.a.": None, "": None, "-": None, ".": None, " 12 ": 12}
    df = spark.createDataFrame([(k,) for k in values], "v string").select("v", A.parse_number(F.col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == values
    st = A.stage_records(spark.createDataFrame([("1" * 30,), ("5",)], "v string"), "ds", ["v"])
    assert sorted((r.cy_leads, r.rejected) for r in A.normalise_metrics(st, {"cy_leads": "v"}).collect()) == [(0, True), (5, False)]


def test_upsert_with_null_orders_and_ties(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "k long, a string")
    upd = spark.createDataFrame([(1, "new", None), (2, "x", None), (2, "y", 1), (3, "p", 5), (3, "q", 5)], "k long, a string, seq long")
    for keep in (False, True):
        runs = [{r["k"]: (r["a"], r["_source"]) for r in rows(A.upsert(base, upd.repartition(n), ["k"], "seq", keep_old_if_null=keep))} for n in (1, 3)]
        assert runs[0] == runs[1]  # a tie picks the same row however the rows are dealt
        assert runs[0][1] == ("new", "updated") and runs[0][2] == ("y", "updated") and runs[0][3][1] == "inserted"


def test_export_files(spark):
    root = _tmp()
    df = spark.createDataFrame([(1, ["x", "y"], "q")], "message_id long, resolved_entities array<string>, question string")
    export_turns(df, "csv", f"{root}/csv")
    export_turns(df, "jsonl", f"{root}/json")
    assert spark.read.option("header", "true").csv(f"{root}/csv").first()["resolved_entities"] == '["x","y"]'
    assert spark.read.json(f"{root}/json").first()["resolved_entities"] == ["x", "y"]


def test_expand_staged_any_key(spark):
    st = spark.createDataFrame([("d", 1, '{"Lead Type": "A", "k": 5}'), ("d", 2, '{"k": null}')],
                               "dataset_id string, row_number long, raw_data string")
    r = rows(A.expand_staged(st, {"lead_type": "Lead Type", "k": "k"}).orderBy("row_number"))
    assert [(x["lead_type"], x["k"]) for x in r] == [("A", "5"), (None, None)]


def test_streaming_numbers_rows_in_file_order(spark):
    root = _tmp()
    _file(root, "upload_a.csv", "owner,leads\n" + "".join(f"owner{i:05d},{i}\n" for i in range(3000)))
    got = _ingest(spark, root, 0, {"owner": "owner", "cy_leads": "leads"})
    assert got.count() == 3000 and got.filter(F.col("row_number") != F.col("cy_leads") + 1).count() == 0


def test_streaming_ingest_auto_mapping_and_reports(spark):
    root = _tmp()
    _file(root, "ds=a/x_2023-24.csv", "rn,Owner,CY Leads,Email\n1,o1, 5,x@y.com\n2,,7,bad\n")
    _file(root, "ds=b/y.csv", "rn,Owner,CY Leads,Email\n3,o3,1,z@y.com\n3,o3,1,z@y.com\n")
    got = _ingest(spark, root)
    assert sorted(((r.dataset_id, r.owner or "", r.cy_leads) for r in got.collect())) == [("a", "", 7), ("a", "o1", 5), ("b", "o3", 1), ("b", "o3", 1)]
    rec = {r.dataset_id: (r.staged_rows, r.normalised_rows, r.may_clear)
           for r in spark.read.parquet(f"{root}/out/reports/reconciliation").collect()}
    assert rec == {"a": (2, 2, True), "b": (2, 2, True)}
    qual = {r.dataset_id: (r.rows, r.duplicate_rows, r.rows_with_issues)
            for r in spark.read.parquet(f"{root}/out/reports/quality").collect()}
    # b holds one duplicate row; in a, row 1 has outer spaces and row 2 a blank owner and a bad e-mail
    assert qual["b"][:2] == (2, 1) and qual["a"][2] == 2
    per = {r.dataset_id: (r.method, r.label) for r in spark.read.parquet(f"{root}/out/reports/periods").collect()}
    assert per["a"] == ("filename", "2023-24") and set(per) == {"a", "b"}
