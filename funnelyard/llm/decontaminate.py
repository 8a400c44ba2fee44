"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with all documents.

A window is `window` consecutive words of an item (a shorter item is one window), and a set of word
shingles with positions. Shingles are ordered by rarity in the corpus; as a window must be contained
whole, its prefix is its one rarest shingle, and a window with an unseen shingle can't occur at all.
Documents are joined on that token only, bounded by position (the window must start at or after the
document's start) and by length (and end within it), and the words are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import key128, stage
from funnelyard.llm.words import LOWER, NON_WORD, chunks, column_bytes, digest_spans, find_words, releasing, whole, windows

#: Bits of the filter of benchmark shingles that goes to every task: 8 MB, whatever the benchmark's size.
FILTER_BITS = 26
_WINDOW_ROWS = "item_id string, win string, n int"
_SHINGLE_ROWS = "win string, n int, at int, size int, h long"
_HIT_ROWS = "row long, doc_id long, t1 long, t2 long, n_words long, hits array<struct<h: long, pos: int, before: int, words: string>>"


def _texts(batch: pa.RecordBatch, column: str) -> tuple:
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
    data = LOWER[data]
    return (data, *find_words(data, offsets, NON_WORD))


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct rows (item_id, win, n): the windows of each item as lower-case words joined by a space.

    Null and empty texts have none; a null item_id counts as the empty string.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts, ends, rows = _texts(part, "text")
                out: list[list] = [[], [], []]
                ids = part.column(0).to_pylist()
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                for i, item in enumerate(ids):
                    lo, hi = bounds[i], bounds[i + 1]
                    words = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[lo:hi], ends[lo:hi])]
                    n = min(window, len(words))
                    for win in {" ".join(words[k:k + n]) for k in range(len(words) - n + 1)} if n else ():
                        for to, value in zip(out, (item, win, n)):
                            to.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int32()))],
                                                 names=["item_id", "win", "n"])

    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id")
    return items.select(ids, F.col(text_col).alias("text")).mapInArrow(releasing(cut), _WINDOW_ROWS).distinct()


def window_shingles(wins: DataFrame, shingle: int) -> DataFrame:
    """Rows (win, n, at, size, h): the digest of each run of min(shingle, n) words of the window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "win"):
                data, starts, ends, rows = _texts(part, "win")
                digests, n = digest_spans(data, starts, ends), np.asarray(part.column(1))
                for size in np.unique(np.minimum(n, shingle)):
                    h, ok = windows(digests, size), whole(rows, size)
                    own = rows[:len(h)]
                    ok &= np.minimum(n, shingle)[own] == size
                    at = np.flatnonzero(ok)
                    first = np.searchsorted(rows, own[at])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(own[at])), pa.array(n[own[at]], pa.int32()), pa.array(at - first, pa.int32()),
                         pa.array(np.full(len(at), size), pa.int32()), pa.array(h[at].view(np.int64), pa.int64())],
                        names=["win", "n", "at", "size", "h"])

    return wins.select("win", "n").mapInArrow(releasing(cut), _SHINGLE_ROWS)


def _filter(shingles: DataFrame) -> np.ndarray:
    """A bit for each leading FILTER_BITS of a shingle's digest: gathered as 64-bit words, 8 MB at most."""
    high = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = (shingles.groupBy(F.shiftright(high, 6).alias("w"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if len(words) else np.zeros(1 << FILTER_BITS, bool)


def shingle_hits(docs: DataFrame, passing, sizes: list[int], window: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document with its shingles that pass the filter, each with the words around it."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = passing.value
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts, ends, rows = _texts(part, "text")
                digests = digest_spans(data, starts, ends)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                found: list[list] = [[] for _ in range(part.num_rows)]
                for size in sizes:
                    h = windows(digests, size)
                    for k in np.flatnonzero(table[h >> np.uint64(64 - FILTER_BITS)] & whole(rows, size)):
                        row = rows[k]
                        lo, hi = max(bounds[row], k - window + 1), min(bounds[row + 1], k + window)
                        words = b" ".join(data[s:e].tobytes() for s, e in zip(starts[lo:hi], ends[lo:hi]))
                        found[row].append({"h": int(h[k].view(np.int64)), "pos": int(k - bounds[row]), "before": int(k - lo),
                                           "words": words.decode("utf-8", "replace")})
                kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(np.diff(bounds), pa.int64()), pa.array(found, kind)],
                    names=["row", "doc_id", "t1", "t2", "n_words", "hits"])

    t1, t2 = key128(F.col(text_col))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    return slim.mapInArrow(releasing(scan), _HIT_ROWS)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5,
                       id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, spans array<(start, n)>, item_ids array<string>, t1, t2.

    (t1, t2) is `key128` of the text, on which alone the rest depends.
    `spans` are the places of benchmark windows in words (overlapping ones as found), n_hit the words
    inside any of them. Repeated rows each get a row; null and empty texts have no words and no hits;
    without items nothing is hit. Only the named columns are read, so other columns can't clash.
    """
    spark = docs.sparkSession
    wins = stage(item_windows(items, window, item_col, item_text_col), "windows")
    shingles = stage(window_shingles(wins.select("win", "n").distinct(), shingle), "shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # at most `shingle` numbers
    passing = spark.sparkContext.broadcast(_filter(shingles))
    seen = stage(shingle_hits(docs, passing, sizes, window, id_col, text_col), "hits")
    hits = seen.select("row", "n_words", F.explode("hits").alias("x")).select("row", "n_words", "x.*")

    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("seen"))
    prefix = (shingles.join(counts, "h", "left").groupBy("win", "n")
              .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "at")).alias("p"))
              .where("p.seen > 0").select("win", "n", "p.h", "p.at"))
    bounded = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("n") <= F.col("n_words"))
    around = F.split("words", " ")
    spans = (hits.join(prefix, "h").where(bounded)
             .where(F.array_join(F.slice(around, F.col("before") - F.col("at") + 1, F.col("n")), " ") == F.col("win"))
             .select("row", (F.col("pos") - F.col("at")).alias("start"), "n", "win"))
    spans = stage(spans, "spans")

    places = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    named = (spans.select("row", "win").distinct().join(wins.select("win", "item_id"), "win")
             .groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    hit_words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    return (seen.select("row", "doc_id", "t1", "t2", "n_words").join(places, "row", "left").join(named, "row", "left")
            .select("doc_id", "t1", "t2", "n_words",
                    F.when(F.col("spans").isNull(), F.lit(0)).otherwise(F.size(hit_words)).cast("long").alias("n_hit"),
                    F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, n: int>>)")).alias("spans"),
                    F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids")))
