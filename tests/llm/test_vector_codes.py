"""Codes of vectors against the plain Lloyd iteration in integers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from funnelyard.llm import vector_codes as V
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label) in id order. -> [(vec_id, code, error, label_error)], digest"""
    x = np.array([[int(np.floor(scale * float(c))) for c in v] for _, v, _ in rows], object)
    w = x.shape[1] // parts
    codes, error, books = [], np.zeros(len(x), object), []
    for p in range(parts):
        own = x[:, p * w:(p + 1) * w].tolist()
        book = [list(r) for r in own[:entries]]

        def assign(book, own=own):
            return [min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)) for v in own]

        for _ in range(rounds):
            at = assign(book)
            for k in range(len(book)):
                mine = [v for v, (_, e) in zip(own, at) if e == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        at = assign(book)
        codes.append([e for _, e in at])
        error += np.array([d for d, _ in at], object)
        books += book
    by_label = Counter()
    for (_, _, label), e in zip(rows, error):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b).encode()).hexdigest()
    return [(i, "".join(f"{c[k]:02x}" for c in codes), error[k], by_label[label]) for k, (i, _, label) in enumerate(rows)], digest


def coded(spark, df):
    found, books = V.compress_vectors(df)
    rows = V.label_errors(found).select("vec_id", V.hex_code(found.codes).alias("code"), "error", "label_error").collect()
    return sorted((tuple(r) for r in rows), key=str), V.codebooks_digest(books)


def test_query_equals_plain_iteration(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    want, digest = plain_codes([(r.vec_id, r.embedding, r.label) for r in rows])
    got = QUERIES["op12_dual_tree_codes"](spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


SCHEMA = "vec_id long, embedding array<float>, label int, n int, perm string, __label int"


def test_dropped_rows_equal_vectors_and_null_labels(spark):
    r = random.Random(5)
    some = [[round(r.uniform(-1, 1), 2) for _ in range(16)] for _ in range(30)]
    rows = [(i, some[min(i, 3) if i % 3 else i % 30], None if i % 4 == 0 else i % 2, 1, "x", 2) for i in range(90)]
    bad = [(100, None, 1, 1, "x", 2), (101, [float("nan")] * 16, 1, 1, "x", 2), (-5, [None] + [0.0] * 15, 1, 1, "x", 2),
           (-4, [float("-inf")] + [0.0] * 15, 1, 1, "x", 2), (-3, [], 1, 1, "x", 2), (-2, [1.0] * 3, 1, 1, "x", 2), (102, [1.0] * 8, 1, 1, "x", 2),
           (103, [1e30] * 16, 1, 1, "x", 2)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(3)
    want, digest = plain_codes([(i, [np.float32(c) for c in v], label) for i, v, label, *_ in rows])
    assert coded(spark, df) == (sorted(want, key=str), digest)


def test_few_repeated_and_no_rows(spark):
    rows = [(2, [0.5] * 8, 1), (2, [0.5] * 8, 1), (None, [-0.25] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, digest = plain_codes(rows)
    assert coded(spark, df) == (sorted(want, key=str), digest)
    got, books = V.compress_vectors(df.limit(0))
    assert got.count() == 0 and books.size == 0 and V.label_errors(got).count() == 0


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_pruning_never_changes_an_assignment(kind):
    rng = np.random.default_rng(11)
    points = {"random": rng.integers(-4096, 4096, (3000, 8)), "ties": rng.integers(-2, 3, (3000, 8)),
              "clusters": rng.integers(-4000, 4000, (9, 8))[rng.integers(0, 9, 3000)] + rng.integers(-60, 60, (3000, 8))}[kind]
    entries = points[rng.integers(0, 3000, 16)]
    order, low, high, sums = V.build_tree(points, V.bounds_of(len(points)))
    code, total, count, decided = V.assign_block(points, order, low, high, sums, entries)
    far = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (code == far.argmin(1)).all()
    assert all((total[e] == points[code == e].sum(0)).all() and count[e] == (code == e).sum() for e in range(16))
    assert kind != "clusters" or decided < len(points)  # whole nodes were assigned by their sums
