"""Benchmark decontamination against brute force."""

import hashlib
import random

from brute import contamination

from funnelyard.llm.decontaminate import find_contamination, window_shingles
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def result(docs, items, **settings):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in find_contamination(docs, items, **settings).collect()), key=repr)


def test_query_equals_brute_force(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    expected = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0)
                for d, n, h, i in contamination(read("documents", "doc_id"), read("benchmark", "item_id"))}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op7_benchmark_contamination"](spark, SF).collect()}
    assert got == expected and any(v[4] for v in got.values())


def test_random_texts_over_a_small_vocabulary(spark):
    rng = random.Random(8)
    text = lambda most: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, most)))
    docs, items = [(i, text(60)) for i in range(50)], [(str(i), text(14)) for i in range(25)]
    got = result(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=6, shingle=3)
    assert got == sorted(contamination(docs, items, 6), key=repr)


def test_short_items_case_and_punctuation(spark):
    docs = [(1, "Über-STRASSE 7, ok"), (2, "uber strasse"), (3, "x Y z"), (4, "a" * 30_000 + " x y z")]
    items = [("p", "X, y!"), ("q", "über Strasse"), ("r", "7"), ("e", ""), ("n", None)]
    got = result(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got == sorted(contamination(docs, items), key=repr)
    assert (3, 3, 2, ["p"]) in got


def test_nulls_repeated_rows_and_shared_windows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    items = [("b", text), ("a", text), ("a", text), (None, text)]
    got = result(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got == sorted(contamination(docs, items), key=repr)
    assert got.count((1, 25, 25, ["", "a", "b"])) == 2


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 3)], "doc_id long, text string, win string, hits int")
    items = spark.createDataFrame([("i", "b c", 2)], "item_id string, text string, n int")
    assert result(docs, items) == [(1, 3, 2, ["i"])]
    assert result(docs, items.limit(0)) == [(1, 3, 0, [])]
    assert result(docs.limit(0), items) == []


def test_shingles_of_windows(spark):
    rows = window_shingles(spark.createDataFrame([("a b c d", 4), ("x", 1)], "win string, n int"), 3).collect()
    assert sorted((r.win, r["at"], r["size"]) for r in rows) == [("a b c d", 0, 3), ("a b c d", 1, 3), ("x", 0, 1)]
