"""Suffix-tree repeats against brute force."""

import random

import pytest
from brute import repeats

from funnelyard.llm.queries import QUERIES
from funnelyard.llm.substring_dedup import remove_repeats

SF = "/root/testdata/sf0.001"


def result(df, **settings):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, **settings).collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_query_equals_brute_force(spark):
    import hashlib
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in repeats(texts, 13)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_suffix_tree_repeats"](spark, SF).collect()}
    assert got == expected and sum(v[1] for v in got.values()) > 0


@pytest.mark.parametrize("long_prefix_from", [10**6, 2])
def test_random_repeats_with_short_and_long_prefixes(spark, long_prefix_from):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    assert result(made(spark, rows), window=5, long_prefix_from=long_prefix_from) == sorted(repeats(rows, 5), key=repr)


def test_a_passage_of_sixty_words_goes_from_all_but_the_first_document(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage}  c{i}\nd{i}") for i in (5, 3, 9)] + [(1, "short text")]
    got = {r.doc_id: r for r in remove_repeats(made(spark, rows)).collect()}
    assert got[3].n_removed == 0 and got[5].kept_text == "a5 b5 c5 d5" and got[9].n_removed == 60
    assert [(s.start, s.n) for s in got[9].repeats] == [(2, 60)]


def test_copies_ties_nulls_and_empty_texts(spark):
    same = " ".join("abcdefghijklmnop")
    rows = [(1, same), (1, same), (2, same), (2, same), (None, same), (3, None), (4, ""), (5, " \n\t"), (6, "one two")]
    got = result(made(spark, rows))
    assert got == sorted(repeats(rows, 13), key=repr)
    assert (2, 16, 16, "") in got and (None, 16, 0, same) in got and got.count((1, 16, 0, same)) == 2


def test_repeats_inside_a_document_stay_in_its_first(spark):
    rows = [(1, "x " * 40), (2, "x " * 12), (3, "x " * 13)]
    assert result(made(spark, rows)) == sorted(repeats(rows, 13), key=repr)


def test_empty_table_long_text_and_clashing_columns(spark):
    assert remove_repeats(made(spark, []), window=13).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, "q " + long, 7, "k"), (2, long, 7, "k")], "doc_id long, text string, rid int, key string")
    assert result(df) == sorted(repeats([(1, "q " + long), (2, long)], 13), key=repr)
