"""LSH-forest components against brute force."""

import random

import pytest
from brute import near_components

from funnelyard.llm import near_dedup as N
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def result(df, **settings):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, **settings).collect())


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_query_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op10_lsh_forest_components"](spark, SF).collect())
    assert got == sorted(near_components(texts)) and not all(r[3] for r in got)


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("leaf", [16, 3])
def test_groups_of_near_copies_and_a_crowded_region(spark, leaf):
    rng = random.Random(4)
    rows, doc = [], 0
    for size in (2, 3, 5, 120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(size):
            rows.append((doc, edited(rng, base, rng.randint(0, 3))))
            doc += 1
    rows += [(doc + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(30)]
    rng.shuffle(rows)
    assert result(made(spark, rows), leaf=leaf) == sorted(near_components(rows))


def test_chains_of_links_are_followed(spark):
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(words[3 * i:3 * i + 100])) for i in range(15)]
    expected = near_components(rows)
    assert {r[2] for r in expected} == {0} and result(made(spark, rows)) == sorted(expected)


def test_short_texts_case_copies_and_order(spark):
    rows = [(7, "A b"), (3, "a  B"), (4, "a b c"), (5, "b a"), (9, "x " * 50), (8, "x " * 60)]
    assert result(made(spark, rows)) == sorted(near_components(rows))


def test_nulls_and_texts_without_words(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "p q r"), (None, "p q r"), (6, "p Q r"), (None, "lonely text"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in N.near_duplicates(made(spark, rows)).collect()), key=repr)
    expected = [(1, 1, True, 0), (2, 2, True, 0), (3, 3, True, 0), (6, 6, True, 1), (None, 6, False, 1), (None, 6, False, 1),
                (None, None, True, 0), (None, None, True, 1)]
    assert got == sorted(expected, key=repr)


def test_empty_table_and_clashing_columns(spark):
    assert result(made(spark, [])) == []
    df = spark.createDataFrame([(1, "a b c", 9, 9), (2, "a b c", 8, 8)], "doc_id long, text string, node int, signature int")
    assert result(df) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_one_of_each_keeps_all_columns_and_one_row(spark):
    rows = [(5, "a b c", "x"), (4, "A b c", "y"), (4, "A b c", "y"), (6, None, "z"), (7, "", "q"), (7, "", "q"), (None, "a b c", "r"), (8, "other words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 string")
    got = N.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(4, "A b c", "y"), (6, None, "z"), (7, "", "q"), (7, "", "q"), (8, "other words", None)], key=repr)


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    assert result(made(spark, [(1, long), (2, long + " tail"), (3, "x")])) == [(1, 49_996, 1, True), (2, 49_997, 1, False), (3, 1, 3, True)]


@pytest.mark.parametrize("variants", [100, 2000])
def test_a_star_whose_centre_is_not_the_least_id(spark, variants):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**9)}" for _ in range(604)]
    rows = [(variants // 2, " ".join(base))]
    for i in range(variants + 1):
        if i != variants // 2:
            text = list(base)
            for k in range(8):  # 8 words of 604 stand in 40 shingles of 600: a similarity of 560 / 640 to the base
                text[20 + 70 * k + rng.randrange(60)] = f"e{rng.randrange(10**9)}"
            rows.append((i, " ".join(text)))
    assert {r[2] for r in result(made(spark, rows))} == {0}


def test_the_deeper_levels_of_the_forest_dont_meet_the_signatures_again(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs = made(spark, [(i, edited(rng, base, 1)) for i in range(40)])
    signed = N.signatures(docs, 5, "doc_id", "text")
    nodes = N.stage(signed.selectExpr("doc_id as node", "doc_id as rep", "signature"), "nodes")
    _, _, used = N.forest_pairs(nodes, 3, 85)
    assert len(used) > 2 and {f"r{k}" for k in range(1, len(N.DEPTHS))} <= set(used[1].columns)  # regions of the levels below come along
