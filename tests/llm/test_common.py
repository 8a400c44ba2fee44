"""Connected components: results against union-find, and no round that changes nothing."""

import random

import pytest

from funnelyard.llm import common


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        if a != b:
            root[y] = x
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    return {x: find(x) for x in nodes}


@pytest.fixture
def rounds(monkeypatch):
    seen, real = [], common.stage

    def counted(df, label, *rows):
        seen.append(label)
        return real(df, label, *rows)

    monkeypatch.setattr(common, "stage", counted)
    return lambda: sum(x == "cc-round" for x in seen)


def components(spark, edges):
    return sorted(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))


def test_stars_need_no_round_and_no_edges_none(spark, rounds):
    stars = [(1, k) for k in range(10, 30)] + [(k, 2) for k in range(30, 35)] + [(2, 34), (7, 7)]
    assert components(spark, stars) == sorted(union_find(stars).items())
    assert components(spark, []) == components(spark, [(4, 4)]) == [] and rounds() == 0


def test_chains_and_random_graphs(spark, rounds):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(20)]
    mixed = [(rng.randrange(60) + 100, rng.randrange(60) + 100) for _ in range(45)] + [(300, 400), (500, 400), (500, 600), (-3, 300)]
    assert components(spark, chain + mixed) == sorted(union_find(chain + mixed).items()) and rounds() > 0
