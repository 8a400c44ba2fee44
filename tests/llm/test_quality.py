"""Base counts and the robust estimates."""

import math
import random

import numpy as np
import pytest
from brute import base_counts
from pyspark.sql import functions as F

from funnelyard.llm import quality as Q
from funnelyard.llm.queries import QUERIES

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_counts_of_the_query_equal_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_robust_outliers"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert counts(r) == base_counts(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_labelled_documents(spark):
    """Held out: the labels are not used by the method."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_robust_outliers"](spark, SF01).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = [r for r in rows if labels[r.doc_id]], [r for r in rows if not labels[r.doc_id]]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "é" * 70_000, "a b c d e a b c d e f g h", "x\nx\n \nx", "# $ | <a> " * 5, "w " * 5000, "日本 語\x0b\x0cz"]
    rows = Q.assess(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id: counts(r) for r in rows} == {i: base_counts(t) for i, t in enumerate(texts)}
    assert not any(r.kept for r in rows if r.base_failed)


def test_empty_table(spark):
    assert Q.assess(spark.createDataFrame([], SCHEMA)).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_outliers_of_a_group_go_even_when_a_quarter_is_bad_and_repeated_rows_agree(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(20, 400)), "en", "s") for i in range(90)]
    rows += [(i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "s") for i in range(90, 115)]
    rows += [rows[0], rows[100]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"g_lang": F.lit(1), "bin": F.lit(2), "x0": F.lit(3)})
    got = {}
    for r in Q.assess(df).collect():
        assert got.setdefault(r.doc_id, r.kept) == r.kept
    assert all(got[i] for i in range(90)) and not any(got[i] for i in range(90, 115))


def test_small_groups_are_pooled(spark):
    rows = [(i, "a", "en", "big") for i in range(5)] + [(9, "a", "en", "x"), (10, "a", "en", "y"), (11, "a", "de", "x"), (12, "a", None, None)]
    stats = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.g_lang, r.g_source) for r in Q.in_pools(stats, Q.pool_table(stats, 2)).collect()}
    assert got[0] == ("en", "big") and got[9] == got[10] == ("en", "*") and got[11] == got[12] == ("*", "*")


def test_chi_square():
    assert Q.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert Q.chi2_cdf(Q.chi2_quantile(0.3, 6), 6) == pytest.approx(0.3)


def test_estimate_is_that_of_the_inner_rows_and_ignores_the_outer():
    rng = np.random.default_rng(1)
    clean, bad = rng.normal(0, 3 * Q.SCALE, (3000, Q.DIM)), rng.normal(60 * Q.SCALE, Q.SCALE, (600, Q.DIM))
    x = np.vstack([clean, bad])
    bins = np.floor(np.log1p((x ** 2).sum(axis=1) / (9 * Q.SCALE ** 2)) * 64).astype(int)
    order = np.unique(bins)
    n = np.array([(bins == b).sum() for b in order])
    sums = np.array([x[bins == b].sum(axis=0) for b in order])
    products = np.array([x[bins == b].T @ x[bins == b] for b in order])
    centre, inverse = Q.estimate(n, sums, products, 0.75)
    assert np.abs(centre).max() < 0.3 * Q.SCALE
    sd = np.sqrt(np.diag(np.linalg.inv(inverse))) / Q.SCALE
    assert all(2.3 < s < 3.6 for s in sd) and math.isfinite(np.linalg.det(inverse))
