"""Filter interactions on the document-term matrix, against a plain count."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
from brute import words

from funnelyard.llm import filter_audit as A
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). -> {(part, order, step): figures}"""
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    big = 1 << 70
    first = {}
    for d, text, _ in docs:
        key = text or ""
        first[key] = min(first.get(key, big), big if d is None else d)
    fails = []
    for d, text, source in docs:
        text = text or ""
        w = words(text)
        fails.append((source or "", d, (
            "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
            + "D" * bool(re.search("[#$%&*|]", text)) + "E" * ((big if d is None else d) > first[text]))))
    out = defaultdict(Counter)
    for part in {p for p, _, _ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                out[part, order, step].update({k: 0 for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")})
    for part, d, own in fails:
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                x = out[part, order, step]
                x["unique_fails"] += own == f
                if f in own:
                    x["redundant" if gone else "removed"] += 1
                    if not gone:
                        x["good_lost"] += d in good
                        x["toxic_lost"] += d in bad
                    gone = True
                x["kept"] += not gone
    each = Counter()
    for (part, order, step), x in out.items():
        each[part, order[step - 1]] += x["removed"]
    return {k: {**v, "shapley": each[k[0], k[1][k[2] - 1]]} for k, v in out.items()}


def found(df):
    got = {(r.part, r.filter_order, r.step): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in df.collect()}
    assert len(got) == df.count()
    return got


def test_query_equals_plain_audit(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(QUERIES["op11_filter_interactions"](spark, SF)) == plain_audit(docs, labels)


def test_nulls_ties_repeats_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None, None), (2, "", "s"), (3, "", "s"), (3, "", "s"), (None, "", "s"), (None, long, "s"), (None, long, "t"), (4, long.upper(), "t"),
            (4, "x $ " * 40, ""), (5, "x $ " * 40, None), (6, "é" * 19 + "A", "t"), (7, "\x85  \t" * 3, "t"), (8, "a " * 300_000, "t"), (9, "b" * 500_000, "t")]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, None), (4, None, 1), (None, 1, 1), (8, 0, 1)]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, source string, block int, n int, words string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(A.audit_filters(df, lab)) == plain_audit(docs, labels)
    assert A.audit_filters(df.limit(0), lab).count() == 0
    assert found(A.audit_filters(df, lab.limit(0))) == plain_audit(docs, [])


def test_matrix_is_the_documents_words(spark):
    texts = ["b a b", "", None, "c a", "b"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(2)
    blocks = A.count_blocks(df)
    numbers = A.column_numbers(blocks)
    listed = A.dictionary(blocks, numbers).collect()
    word = {r.column: r.word.decode() for r in listed}
    assert len(listed) == 3 and sorted(word) == [0, 1, 2] and set(word.values()) == {"a", "b", "c"}
    seen = {}
    for r in A.document_term_matrix(blocks, numbers).collect():
        bounds, columns, counts = (np.frombuffer(r[k], t).tolist() for k, t in (("bounds", "<i8"), ("columns", "<i8"), ("counts", "<i4")))
        for d, a, b in zip(r.docs, bounds, bounds[1:]):
            assert columns[a:b] == sorted(set(columns[a:b]))
            seen[d.doc_id] = {word[c]: n for c, n in zip(columns[a:b], counts[a:b])}
    assert seen == {i: dict(Counter(words(t))) for i, t in enumerate(texts)}


def test_many_slices_number_every_word_once(spark, monkeypatch):
    monkeypatch.setattr(A, "SLICE", 50)
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(60)), "s") for i in range(40)], "doc_id long, text string, source string").repartition(4)
    blocks = A.count_blocks(df)
    numbers = A.column_numbers(blocks)
    assert numbers.select("slice").distinct().count() > 3
    listed = A.dictionary(blocks, numbers).collect()
    assert sorted(r.column for r in listed) == list(range(97)) and len({r.word for r in listed}) == 97
