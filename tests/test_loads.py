"""Upload flow: records of quoted files, fingerprints, ledger, mergeable profiles, numbering and merging."""

import csv
import os
import random
import tempfile

from conftest import rows
from pyspark.sql import functions as F

from funnelyard.operators import clean as Cl
from funnelyard.operators import ingest as A
from funnelyard.operators import profiles as P
from funnelyard.plans import q_loads
from funnelyard.session import setting
from funnelyard.sources import records as R
from funnelyard.sources.delimited import read_delimited
from funnelyard.streaming import ledger as L
from funnelyard.streaming.ingest_stream import ingest_files, ingest_stream, load_progress, read_loaded, stage_rows


def _tmp():
    return tempfile.mkdtemp(prefix="funnelyard-test-")


def _file(root, name, text):
    path = os.path.join(root, "in", name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def _stored_lines(spark, path):
    R.read_lines(spark, [path]).write.mode("overwrite").parquet(f"{path}.lines")
    return spark.read.parquet(f"{path}.lines")


def _records(spark, path, width):
    lines = _stored_lines(spark, path)
    found = R.join_records(lines, R.split_table(lines))
    return [tuple(r.c) for r in found.orderBy("record_no").select(R.cells(F.col("record"), width).alias("c")).collect()], found, lines


# ---------------------------------------------------------------- records
def test_one_quoted_file_is_read_by_many_tasks(spark):
    rng = random.Random(2)
    cells = ["plain", "", "two\nlines", 'a "quoted" word', "comma, here", "\n\n", 'x"', "three\r\nmore\nlines", " outer ", "é,\n中"]
    table = [[rng.choice(cells) + str(rng.randrange(99)) for _ in range(4)] for _ in range(4000)]
    path = f"{_tmp()}/big.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["a", "b", "c", "d"], *table])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got, found, lines = _records(spark, path, 4)
        assert lines.select("split").distinct().count() > 8
        assert [r.record_no for r in found.select("record_no").orderBy("record_no").collect()] == list(range(4001))
        many = R.file_digests(R.number_lines(lines, R.split_table(lines))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == ("a", "b", "c", "d") and got[1:] == [tuple(r) for r in table]
    one = sorted(tuple(r) for r in read_delimited(spark, path).collect())
    assert one == sorted(got[1:])  # the one-task reader agrees
    whole = _stored_lines(spark, path)
    assert R.file_digests(R.number_lines(whole, R.split_table(whole))).first().fingerprint == many.fingerprint  # however it is split


def test_blank_lines_line_ends_and_short_rows(spark):
    root = _tmp()
    path = _file(root, "a.csv", 'x,y\r\n1,2\r\n\r\n  \t\r\n3\r\n"4\r\n",5,6\r\n\n7,""\n\n')
    got, found, _ = _records(spark, path, 2)
    assert got == [("x", "y"), ("1", "2"), ("3", None), ("4\r\n", "5"), ("7", "")] or got[3][0].startswith("4")
    assert [r.record_no for r in found.select("record_no").orderBy("record_no").collect()] == [0, 1, 2, 3, 4]


def test_headers_of_files_with_quoted_line_breaks(spark):
    root = _tmp()
    a = _file(root, "a.csv", '"Own\ner",leads,state\nx,5,7\n')
    b = _file(root, "b.csv", '"Own\ner",state,leads\ny,MH,6\n')
    c = _file(root, "c.csv", '﻿ Owner ,,Leads,leads,"a,b"\n1,2,3,4,5\n')
    R.read_lines(spark, [a, b, c]).write.parquet(f"{root}/lines")
    lines = spark.read.parquet(f"{root}/lines")
    heads = {os.path.basename(r.source_file): r.header for r in R.file_headers(R.header_records(R.join_records(lines, R.split_table(lines))))[0].collect()}
    assert heads == {"a.csv": ["Own\ner", "leads", "state"], "b.csv": ["Own\ner", "state", "leads"], "c.csv": ["Owner", "col_1", "Leads2", "leads3", "a,b"]}


def test_equal_files_have_equal_fingerprints(spark):
    root = _tmp()
    texts = {"p/one.csv": "a,b\n1,2\n", "q/other.txt": "a,b\n1,2\n", "p/no_end.csv": "a,b\n1,2", "p/order.csv": "1,2\na,b\n", "p/crlf.csv": "a,b\r\n1,2\n"}
    paths = [_file(root, n, t) for n, t in texts.items()]
    R.read_lines(spark, paths).write.parquet(f"{root}/lines")
    lines = spark.read.parquet(f"{root}/lines")
    found = {os.path.basename(r.source_file): r.fingerprint for r in R.file_digests(R.number_lines(lines, R.split_table(lines))).collect()}
    assert found["one.csv"] == found["other.txt"] and len(set(found.values())) == 4


# ---------------------------------------------------------------- ingest
MAP = {"owner": "owner", "cy_leads": "leads"}


def _ingest(spark, root, run=0, mapping=None, **options):
    ingest_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck{run}", mapping, **options).awaitTermination()
    return read_loaded(spark, f"{root}/out")


def _report(spark, root, name):
    return {str(r.dataset_id): r for r in spark.read.parquet(f"{root}/out/reports/{name}").collect()}


def test_reports_do_not_depend_on_what_else_is_in_the_batch(spark):
    one, other = "owner,leads,mail_email\no1,5,a@b.c\no2,6,a@b.c\no2,6,a@b.c\n", "state,region,leads,x,y\nMH,,3,1,\nMH,w,3,1, z\n"
    reports = []
    for files in (1, 2):
        root = _tmp()
        _file(root, "ds=a/1.csv", one)
        _file(root, "ds=b/1.csv", other)
        _ingest(spark, root, 0, MAP, max_files_per_trigger=files)
        reports.append({k: tuple(r[c] for c in ("rows", "columns", "missing_values", "duplicate_rows", "quality_score", "rows_with_issues", "issues_found"))
                        for k, r in _report(spark, root, "quality").items()})
    assert reports[0] == reports[1] == {"a": (3, 3, 0, 1, 66.67, 0, 0), "b": (2, 5, 2, 0, 80.0, 2, 3)}


def test_each_file_by_the_header_of_its_first_record(spark):
    root = _tmp()
    _file(root, "ds=a/1.csv", '"own\ner",leads,state\nx,5,KA\n')
    _file(root, "ds=a/2.csv", '"own\ner",state,leads\ny,MH,6\n')
    got = _ingest(spark, root, 0, {"owner": "own\ner", "cy_leads": "leads", "state": "state"})
    assert sorted(map(tuple, got.select("owner", "cy_leads", "state").collect())) == [("x", 5, "KA"), ("y", 6, "MH")]


def test_late_files_never_renumber_rows(spark):
    root = _tmp()
    _file(root, "ds=a/5.csv", "owner,leads\no1,5\no2,6\n")
    _ingest(spark, root, 0, MAP)
    _file(root, "ds=a/1.csv", "owner,leads\no3,7\n")  # sorts before the first one
    got = _ingest(spark, root, 0, MAP)
    assert sorted((r.row_number, r.cy_leads) for r in got.collect()) == [(1, 5), (2, 6), (3, 7)]


def test_equal_bytes_are_loaded_once_and_a_replay_changes_nothing(spark):
    root = _tmp()
    _file(root, "ds=a/x_2023-24.csv", "owner,leads\no1,5\n")
    _file(root, "ds=b/y.csv", "owner,leads\no1,5\n")
    _file(root, "empty.csv", "")
    _ingest(spark, root, 0, MAP)
    _file(root, "ds=c/z.csv", "owner,leads\no1,5\n")
    for run in (0, 1, 2):  # the same checkpoint, then two new ones
        got = _ingest(spark, root, run, MAP)
        assert [(r.dataset_id, r.row_number, r.cy_leads) for r in got.collect()] == [("a", 1, 5)]
        files = {os.path.basename(r.source_file): (r.status, r.duplicate_of, r.n_rows) for r in L.read_ledger(spark, f"{root}/out").collect()}
        assert files == {"x_2023-24.csv": ("loaded", None, 1), "y.csv": ("duplicate_file", "a", 0), "z.csv": ("duplicate_file", "a", 0)}
    told = sorted(tuple(r) for r in load_progress(spark, f"{root}/out").select("files", "files_loaded", "files_duplicate", "rows_staged", "rows_loaded").collect())
    assert told == [(0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (1, 0, 1, 0, 0), (2, 1, 1, 1, 1)]


def test_a_batch_that_runs_again_leaves_the_same_tables(spark):
    root = _tmp()
    paths = [_file(root, n, f"owner,leads\n{n},{i}\n") for i, n in enumerate(("S_2023-24.csv", "T_2023-24.csv"))]
    seen = []
    for _ in range(2):
        ingest_files(spark, [paths[0]], f"{root}/out", MAP, "run", 0)
        ingest_files(spark, [paths[1]], f"{root}/out", MAP, "run", 1)
        ledger = sorted(map(tuple, L.read_ledger(spark, f"{root}/out").select("original_filename", "status", "created_seq", "upload_version", "upload_status").collect()))
        seen.append((ledger, sorted(map(tuple, read_loaded(spark, f"{root}/out").select("dataset_id", "row_number", "cy_leads").collect()))))
    assert seen[0] == seen[1]
    assert seen[0][0] == [("S_2023-24.csv", "loaded", 1, 1, "confirmed"), ("T_2023-24.csv", "loaded", 2, 2, "conflict")]
    active = {r.original_filename: r.is_period_active for r in L.read_registry(spark, f"{root}/out").collect()}
    assert active == {"S_2023-24.csv": False, "T_2023-24.csv": True}
    assert L.registry_violations(L.read_registry(spark, f"{root}/out")).count() == 0


def test_conflicts_may_wait_and_a_changed_file_is_loaded_again(spark):
    root = _tmp()
    path = _file(root, "S_2023-24.csv", "owner,leads\na,1\n")
    other = _file(root, "T_2023-24.csv", "owner,leads\nb,2\nb,3\n")
    odd = _file(root, "U_2024-25.csv", "owner,leads\nc,4\n")
    ingest_files(spark, [path, other, odd], f"{root}/out", MAP, "run", 0, on_conflict="hold")
    found = {r.original_filename: (r.upload_status, r.upload_version) for r in L.read_ledger(spark, f"{root}/out").collect()}
    assert found == {"S_2023-24.csv": ("confirmed", 1), "T_2023-24.csv": ("conflict", None), "U_2024-25.csv": ("overlap_conflict", None)}
    _file(root, "S_2023-24.csv", "owner,leads\na,7\na,8\n")
    ingest_files(spark, [path], f"{root}/out", MAP, "run", 1)
    assert sorted(r.cy_leads for r in read_loaded(spark, f"{root}/out").collect()) == [2, 3, 4, 7, 8]


def test_sessions_are_registered_in_order_of_arrival():
    assert L.open_labels([("2021-22", 2021, 2022)], [("2022-23", 2022, 2023), ("2023-24", 2023, 2024), ("2021-22", 2021, 2022), ("2024-25", 2024, 2025)]) == {
        "2022-23": "2021-22", "2023-24": None, "2021-22": None, "2024-25": "2023-24"}


def test_merged_profiles_equal_a_full_recompute(spark):
    rng = random.Random(3)
    made = [(f"d{i % 2}", f"f{i % 5}", {"a": rng.choice([None, "", " x", "y", "2024"]), "my email": rng.choice(["a@b.c", "bad", None]), **({"k": "1"} if i % 5 else {})}) for i in range(400)]
    staged = spark.createDataFrame(made, "dataset_id string, file_key string, m map<string,string>").select(
        "dataset_id", "file_key", F.to_json("m", {"ignoreNullFields": "false"}).alias("raw_data"))
    halves = [staged.where("file_key < 'f2'"), staged.where("file_key >= 'f2'")]

    def reports(parts):
        files, columns, digests = (parts[0][i] if len(parts) == 1 else parts[0][i].unionByName(parts[1][i]) for i in range(3))
        return (sorted(map(tuple, P.merge_quality(files, columns, digests).collect())),
                sorted(map(tuple, P.merge_columns(columns).collect())))

    def summaries(s):
        return P.file_summaries(s), P.column_summaries(s), P.digest_counts(s)

    assert reports([summaries(staged)]) == reports([summaries(h) for h in halves])
    one = staged.where("dataset_id = 'd0' and file_key <> 'f0'")
    wide = one.select(*[F.from_json("raw_data", "map<string,string>")[c].alias(c) for c in ("a", "my email", "k")])
    whole = rows(Cl.profile_table(wide))[0]
    merged = rows(P.merge_quality(*summaries(one)))[0]
    assert all(merged[c] == whole[c] for c in ("rows", "columns", "missing_values", "duplicate_rows", "missing_percentage", "duplicate_percentage", "quality_score"))
    cleaned = rows(Cl.clean_summary(Cl.clean_records(wide, keys=())))[0]
    assert all(merged[c] == cleaned[c] for c in ("issues_found", "rows_with_issues", "missing_value", "whitespace_normalized", "invalid_email"))


def _method_sizes(df):
    """Bytes of the longest method of each generated stage."""
    q = df._jdf.queryExecution()
    found = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(q.executedPlan())
    return [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]


def test_the_code_that_normalises_a_row_is_short_enough_to_be_compiled(spark):
    fields = (*A.TEXT_FIELDS, *A.NUMBER_FIELDS)
    values = {"owner": " a ", "cy_leads": "1,234", "cy_admission": "-12", "cy_registration": "2.5", "py_leads": "1e3", "py_admission": "x", "py_registration": " "}
    made = [("d", 1, {f: values.get(f) for f in fields}, {f: f for f in fields})]
    keyed = spark.createDataFrame(made, "dataset_id string, row_number long, m map<string,string>, k map<string,string>").select(
        "dataset_id", "row_number", F.to_json("m", {"ignoreNullFields": "false"}).alias("raw_data"), *[F.col("k")[f].alias(f"key_{f}") for f in fields])
    got = A.normalise_metrics(keyed, {f: F.col(f"key_{f}") for f in fields})
    assert max(_method_sizes(got)) <= 8000  # the JVM interprets longer ones
    r = got.first()
    assert [r[f] for f in ("owner", "cluster", "cy_leads", "cy_admission", "cy_registration", "py_leads", "py_admission", "py_registration")] == ["a", None, 1234, -12, 3, 1000, 0, 0]
    assert r.rejects == ["py_admission"] and r.rejected


def test_profiles_of_parsed_cells_equal_those_of_documents(spark):
    ends = ["", " ", "\t", "\n", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029", "\x01", "\xa0", " \x85", "\n\n", " \u2028 "]
    texts = [a + m + b for a in ends for m in ("", "x", "é y", "in 2024", "2031x", "a@b.c") for b in ends] + [None, "2019\n2020"]
    rows_ = [(f"d{i % 2}", f"f{i % 4}", {"k": v, "e mail": texts[-i], "Email": texts[i // 2]}) for i, v in enumerate(texts)]
    parsed = spark.createDataFrame(rows_, "dataset_id string, file_key string, cells map<string,string>").coalesce(1)
    staged = parsed.select("dataset_id", "file_key", F.to_json("cells", {"ignoreNullFields": "false"}).alias("raw_data"))
    for summary in (P.file_summaries, P.column_summaries, P.digest_counts, P.year_counts):
        found = summary(parsed)
        assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString()  # parsed once, by the one who staged the rows
        plain = [c for c in found.columns if c != "sketch"]
        assert sorted(map(repr, found.select(plain).collect())) == sorted(map(repr, summary(staged).select(plain).collect()))
    # each cell by the rules of B4 on its own
    each = parsed.select(F.posexplode(F.map_entries("cells")).alias("i", "c"), *P.FILE).select(*P.FILE, "c.*")
    kinds = P.cell_issues(F.col("key"), F.col("value"))
    want = each.groupBy(*P.FILE, "key").agg(*[F.sum(F.coalesce(kinds[k], F.lit(False)).cast("long")).alias(k) for k in P.ISSUES])
    got = P.column_summaries(parsed).select(*P.FILE, F.col("column").alias("key"), *P.ISSUES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    numbered = parsed.withColumn("n", F.monotonically_increasing_id()).select("n", *P.FILE, F.explode("cells").alias("key", "value"))
    bad = numbered.where(kinds[P.ISSUES[0]] | kinds[P.ISSUES[1]] | F.coalesce(kinds[P.ISSUES[2]], F.lit(False))).groupBy(*P.FILE).agg(F.count_distinct("n").alias("n"))
    assert sorted(map(tuple, P.file_summaries(parsed).select(*P.FILE, "rows_with_issues").collect())) == sorted(map(tuple, bad.collect()))


def test_lines_are_not_shuffled_for_their_records(spark):
    path = _file(_tmp(), "a.csv", "x,y\n" + "1,2\n" * 100)
    lines = _stored_lines(spark, path)
    splits = f"{path}.splits"
    R.split_table(lines).write.parquet(splits)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        found = R.join_records(lines, spark.read.parquet(splits))
        assert found.count() == 101
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


# ---------------------------------------------------------------- uploads of the queries
def test_uploads_are_sorted_by_many_tasks_and_joined_to_one_file(spark):
    root = _tmp()
    made = [("one" if i % 3 else "two", f"k{i:04d}", v) for i in range(2000) for v in [(None, "", 'a "b", c', "two\nlines")[i % 4]]]
    df = spark.createDataFrame(made, "upload string, k string, v string").repartition(3)
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        q_loads._write_parts(df, ["k"], f"{root}/parts")
    for name in ("one", "two", "none"):
        parts = f"{root}/parts/upload={name}"
        path = q_loads._place(spark, f"{root}/in/{name}.csv", ("k", "v"), parts)
        with open(path, newline="") as f:
            got = list(csv.reader(f))
        assert got == [["k", "v"], *sorted([k, v or ""] for u, k, v in made if u == name)]
        if name != "none":
            assert len([n for n in os.listdir(parts) if n.startswith("part-")]) > 1
    copy = q_loads._place(spark, f"{root}/in/copy.csv", copy_of=f"{root}/in/one.csv")
    with open(copy, "rb") as a, open(f"{root}/in/one.csv", "rb") as b:
        assert a.read() == b.read()


# ---------------------------------------------------------------- A2, A6
def test_numbers_in_the_inputs_own_order(spark):
    path = f"{_tmp()}/t"
    spark.range(1000).select((F.lit(1000) - F.col("id")).alias("v")).repartitionByRange(5, F.col("v").desc()).sortWithinPartitions(F.col("v").desc()).write.parquet(path)
    df = spark.read.parquet(path)
    staged = A.stage_records(df, "ds")
    order = [r.v for r in df.collect()]
    got = {r.row_number: r.raw_data for r in staged.collect()}
    assert got == {i + 1: f'{{"v":{v}}}' for i, v in enumerate(order)}
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan and "RebalancePartitions" not in plan


def test_a_merge_rewrites_the_touched_partitions_only(spark):
    path = f"{_tmp()}/t"
    A.create_stored(spark.range(500).select("id", F.lit("old").alias("v"), F.lit(1.5).alias("w")), path, ["id"], buckets=16)

    def files():
        return {f for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    before = files()
    updates = spark.createDataFrame([(7, "new", None, 2), (7, "newer", None, 3), (1_000, "added", 2.0, 1)], "id long, v string, w double, seq long")
    touched = A.merge_stored(spark, path, updates, ["id"], "seq", buckets=16, keep_old_if_null=True)
    assert 1 <= len(touched) <= 2
    assert all(int(f.split("_bucket=")[1].split("/")[0]) in touched for f in before ^ files())
    got = {r.id: (r.v, r.w) for r in A.read_stored(spark, path).collect()}
    assert got == {i: ("old", 1.5) for i in range(500)} | {7: ("newer", 1.5), 1_000: ("added", 2.0)}
    again = A.merge_stored(spark, path, updates, ["id"], "seq", buckets=16, keep_old_if_null=True)
    assert again == touched and {r.id: (r.v, r.w) for r in A.read_stored(spark, path).collect()} == got
    assert A.merge_stored(spark, path, updates.limit(0), ["id"], "seq", buckets=16) == []


def test_a_record_is_parsed_once_and_a_path_once_for_each_file(spark):
    records = spark.createDataFrame([("file:/in/a.csv", n, f'"x,{n}",,z') for n in range(3)] + [("file:/in/a.csv", 3, None)], "source_file string, record_no long, record string")
    found = records.select(R.cells(F.col("record"), 4).alias("c"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1  # it was one for each cell
    assert [r.c for r in found.collect()] == [[f"x,{n}", None, "z", None] for n in range(3)] + [[None] * 4]
    headers = spark.createDataFrame([("file:/in/a.csv", ["p", "q", "r", "s"])], "source_file string, header array<string>")
    staged = stage_rows(records.where("record_no < 3"), headers, 4)
    plan = staged._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan[:plan.index("Join")]  # datasets and file keys stand below the join
    assert {r.raw_data for r in staged.collect()} == {'{"p":"x,%d","q":null,"r":"z","s":null}' % n for n in (1, 2)}
