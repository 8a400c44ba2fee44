"""Tokenising by unit and the reduced best-fit packing."""

import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from funnelyard.llm import packing as P
from funnelyard.llm.queries import QUERIES, vocabulary_path
from funnelyard.llm.words import column_bytes

SF = "/root/testdata/sf0.001"
ODD = ["", " \n ", "a<|endoftext|>b", "it's don't .'s 'S '.t", "x́ é. ≮= a.́", "Ünï ÄÖ—dash…,\"q\" 3.14 a1b2 _x_ ^^~`",
       "nb sp\x1cq\x0bv\x85w", "ab'll'd", "ΣΑΣ. ΟΔΟΣ, İI", "日本。語, 5€!!", "<|startoftext|><|", None, "word " * 3000]


@pytest.mark.parametrize("by_unit", [True, False])
def test_ids_equal_those_of_whole_texts(by_unit):
    known = P.UnitIds(vocabulary_path())
    ids, bounds = P.text_ids(known, *column_bytes(pa.array(ODD)), 0, by_unit)
    for i, text in enumerate(ODD):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == known.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], text


def test_memory_of_units_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr(P, "KNOWN_UNITS", 3)
    known = P.UnitIds(vocabulary_path())
    for text in ("alpha beta gamma delta", "alpha eps", "zeta alpha beta"):
        ids, _ = P.text_ids(known, *column_bytes(pa.array([text])), 0)
        assert ids.tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert len(known.digests) <= 6


def filled(runs):
    """Sequences as lists of lengths."""
    return [list(itertools.chain(*[[length] * copies for length, copies in holds])) for _, n, holds in runs for _ in range(n)]


def best(pieces, capacity):
    """Fewest sequences, by trying all assignments."""
    least = [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(pieces):
            least[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, capacity - pieces[i]])
    place(0, [])
    return least[0]


def test_plans_hold_every_piece_and_come_close_to_the_best():
    rng = random.Random(5)
    above = 0
    for _ in range(150):
        capacity = rng.choice((7, 10, 20))
        pieces = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        runs, figures = P.plan_packing(Counter(pieces), capacity)
        sequences = filled(runs)
        assert Counter(itertools.chain(*sequences)) == Counter(pieces)
        assert all(0 < sum(s) <= capacity for s in sequences) and figures["sequences"] == len(sequences) >= figures["least"]
        above += len(sequences) - best(pieces, capacity)
    assert 0 <= above <= 3


def test_what_the_reduction_fixes_keeps_the_best_reachable():
    rng = random.Random(11)
    for _ in range(60):
        capacity = rng.choice((9, 12))
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        runs, figures = P.plan_packing(Counter(pieces), capacity)
        fixed, left = filled(runs)[:figures["fixed_sequences"]], Counter(pieces)
        for s in fixed:
            left -= Counter(s)
        assert len(fixed) + best(sorted(left.elements(), reverse=True), capacity) == best(sorted(pieces, reverse=True), capacity)


def test_dominance_cases():
    assert P.plan_packing({10: 3}, 10)[1] == {"fixed_pieces": 3, "fixed_sequences": 3, "sequences": 3, "least": 3}  # nothing fits beside
    assert P.plan_packing({6: 2, 4: 2}, 10)[1]["fixed_sequences"] == 2  # exact pairs
    assert P.plan_packing({6: 1, 3: 1, 4: 1, 5: 1}, 10)[1]["sequences"] == 2  # the longest partner, as no two fit
    assert P.plan_packing({5: 5}, 10)[1]["sequences"] == 3
    assert P.plan_packing({}, 10) == ([], {"fixed_pieces": 0, "fixed_sequences": 0, "sequences": 0, "least": 0})
    with pytest.raises(ValueError):
        P.plan_packing({11: 1}, 10)


def test_runs_stay_few_when_counts_are_huge():
    counts = {k: 10**9 + k for k in range(1, 2049)}
    runs, figures = P.plan_packing(counts, 2048)
    assert len(P.place_rows(runs)) < 20_000 and figures["sequences"] <= figures["least"] * 1.000001


def check(rows, texts, capacity, end_id=0):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    expected = Counter()
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            expected[doc, k, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(spark):
    rows = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check(rows, texts, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark):
    texts = [(1, "one two"), (1, "one two"), (None, None), (None, "x"), (2, ""), (3, "alpha beta " * 100)]
    df = spark.createDataFrame([(d, t, 7, b"z") for d, t in texts], "doc_id long, text string, row int, ids binary")
    check(P.pack_documents(df, vocabulary_path(), capacity=8).collect(), texts, 8)
    check(P.pack_documents(df, vocabulary_path(), capacity=8, end_id=5).collect(), texts, 8, 5)


def test_empty_table_and_kept_ids(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert P.pack_documents(df.limit(0), vocabulary_path(), capacity=8).count() == 0
    row = P.pack_documents(df, vocabulary_path(), capacity=64, keep_ids=True).first()
    assert zlib.crc32(bytes(row.ids)) == row.ids_crc32 and np.frombuffer(row.ids, "<u4")[-1] == 0
