"""Jump consistent hashing."""

from collections import Counter, defaultdict

from brute import jump, jump_key
from pyspark.sql import functions as F

from funnelyard.llm.queries import QUERIES
from funnelyard.llm.sharding import assign_shards, number_slots

SF = "/root/testdata/sf0.001"


def test_query_equals_the_published_loop(spark):
    rows = QUERIES["op4_jump_shards"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == jump(jump_key(r.doc_id), 16) and r.grown_shard == jump(jump_key(r.doc_id), 17)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_and_checksums(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib
    for r in QUERIES["op4_jump_shards"](spark, SF).collect():
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")


def test_growth_moves_a_fair_share_into_the_new_shard_only(spark):
    rows = assign_shards(spark.range(20_000), ["id"], 9).collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 9 for r in moved)
    assert abs(len(moved) / len(rows) - 1 / 10) < 0.01
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) / min(counts.values()) < 1.2


def test_many_shards_run_the_loop_to_its_end(spark):
    rows = assign_shards(spark.range(300), ["id"], 5000).collect()
    assert [r.shard for r in rows] == [jump(jump_key(r.id), 5000) for r in rows]
    assert [r.grown_shard for r in rows] == [jump(jump_key(r.id), 5001) for r in rows]


def test_one_shard(spark):
    assert {r.shard for r in assign_shards(spark.range(50), ["id"], 1).collect()} == {0}


def test_null_repeated_and_composite_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "bc", 9), ("ab", "c", 9), (None, "x", 9), (None, "x", 9), ("", "x", 9)], "k string, m string, Shard int")
    rows = assign_shards(df, ["k", "m"], 7).collect()
    assert rows[2].shard == rows[3].shard
    assert [r.shard for r in rows] == [jump(jump_key(r.k, r.m), 7) for r in rows]
    assert assign_shards(df, ["k"], 7).columns == ["k", "m", "shard", "grown_shard"]


def test_slots_of_repeated_rows_and_of_an_empty_table(spark):
    df = assign_shards(spark.range(40).select((F.col("id") % 3).alias("id")), ["id"], 4)
    by = defaultdict(list)
    for r in number_slots(df, ["id"], 4).collect():
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == 40 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert number_slots(assign_shards(spark.range(0), ["id"], 4), ["id"], 4).count() == 0
