"""Substring dedup: suffix trees partitioned by variable-length prefixes, over words.

The corpus' suffixes are split by prefix, and one group of prefixes at a time is built in memory:

1. Short prefixes. Every window of `window` words is filed under its least-digest run of `prefix_words`
   words (its anchor), which all equal windows share; neighbouring windows mostly share it too. A prefix
   that stands in one text only can't lead to a repeat, and its subtree is never built. Equal texts are
   one string: all but the least document of them are repeats as a whole.
2. Groups. The prefixes left are dealt to groups of about GROUP_ROWS anchors. A prefix with more than
   `long_prefix_from` occurrences is split further, by the whole window as its prefix.
3. Subtrees. In a group the suffixes are sorted below their prefix; suffixes that agree over the whole
   window lie side by side and form an internal node of that depth. A node's leaves in any but its least
   document are repeats. Of a node as wide as its prefix only the least document is wanted, which
   is an aggregation with map-side combining and a join that skew handling may split.
4. Runs of repeat windows are merged in each document into maximal repeats and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import discard, key128, stage
from funnelyard.llm.words import SPACES, chunks, column_bytes, covered, digest_spans, find_words, whole, windows

#: Anchors that a group holds on average.
GROUP_ROWS = 50_000

_ANCHOR = "key long, doc_id long, rid long, firsts array<int>, digests binary"
_RUN = "doc_id long, rid long, first int, n int"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _anchors(part: pa.RecordBatch, window: int, prefix_words: int) -> tuple:
    """Of a slice: (row of each anchor, its key, its first window and the end of its windows, row bounds, word digests).

    Windows are numbered by their first word in the slice. An anchor's windows follow one another.
    """
    data, offsets = column_bytes(_column(part, "text"))
    starts, ends, rows = find_words(data, offsets, SPACES)
    digests = digest_spans(data, starts, ends)
    at = np.flatnonzero(whole(rows, window))
    bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, none, bounds, digests
    keys = windows(digests, prefix_words)
    least = np.lib.stride_tricks.sliding_window_view(keys, window - prefix_words + 1)
    anchor = at + np.concatenate([least[at[i:i + 200_000]].argmin(axis=1) for i in range(0, len(at), 200_000)])
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.concatenate((new[1:], [len(at)]))
    return rows[anchor[new]], keys[anchor[new]], new, last, at, bounds, digests


def document_prefixes(docs: DataFrame, window: int, prefix_words: int) -> DataFrame:
    """Distinct (doc_id, rid, key) of each row of docs(doc_id, rid, text): the prefixes under which its windows are filed."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, keys, *_ = _anchors(part, window, prefix_words)
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                once = np.ones(len(keys), bool)
                once[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
                row = pa.array(rows[once])
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id").take(row), _column(part, "rid").take(row), pa.array(keys[once].view(np.int64))],
                                                 names=["doc_id", "rid", "key"])

    return docs.mapInArrow(scan, "doc_id long, rid long, key long")


def repeated_anchors(filed: DataFrame, window: int, prefix_words: int) -> DataFrame:
    """Anchors whose key is in the row's `keys`, of rows (doc_id, rid, text, keys), with the digests of their windows.

    Anchors of a document with equal windows are one row with all their places, so that a text that
    repeats itself costs no more than its different windows.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, keys, new, last, at, bounds, digests = _anchors(part, window, prefix_words)
                wanted = _column(part, "keys")
                flat = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of = np.repeat(np.arange(part.num_rows), np.asarray(wanted.value_lengths().fill_null(0)))
                pairs = np.empty(len(flat), [("r", np.int64), ("k", np.uint64)])
                pairs["r"], pairs["k"] = of, flat
                mine = np.empty(len(keys), pairs.dtype)
                mine["r"], mine["k"] = rows, keys
                own = np.flatnonzero(np.isin(_joined(mine), _joined(pairs)))
                whole_windows = windows(digests, window, seed=1)[at].tobytes()
                places: dict[tuple, list[int]] = {}
                firsts = at[new[own]] - bounds[rows[own]]
                for row, key, lo, hi, first in zip(rows[own].tolist(), keys[own].view(np.int64).tolist(), (8 * new[own]).tolist(), (8 * last[own]).tolist(), firsts.tolist()):
                    places.setdefault((row, key, whole_windows[lo:hi]), []).append(first)
                row, key, blobs = zip(*places) if places else ((), (), ())
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), _column(part, "doc_id").take(row), _column(part, "rid").take(row),
                     pa.array(places.values(), pa.list_(pa.int32())), pa.array(blobs, pa.binary())],
                    names=["key", "doc_id", "rid", "firsts", "digests"])

    return filed.mapInArrow(scan, _ANCHOR)


def _joined(pairs: np.ndarray) -> np.ndarray:
    """One 64-bit value for each (row, key): equal for equal pairs, and different keys of a row differ."""
    return pairs["k"] ^ (pairs["r"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(doc: np.ndarray, rid: np.ndarray, at: np.ndarray) -> pa.Table:
    order = np.lexsort((at, rid, doc))
    doc, rid, at = doc[order], rid[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(at)])))
    return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "rid": pa.array(rid[first], pa.int64()),
                     "first": pa.array(at[first], pa.int32()), "n": pa.array(n, pa.int32())})


def build_subtree(group: pa.Table) -> pa.Table:
    """Runs (doc_id, rid, first, n) of windows that a smaller document has too, of the anchors of one group."""
    blobs = group.column("digests").combine_chunks()
    data, offsets = column_bytes(blobs)
    per = np.diff(offsets) // 8
    node = data.view(np.uint64) if len(data) else np.zeros(0, np.uint64)
    column = lambda name: np.repeat(group.column(name).to_numpy(), per)
    key, doc, row = column("key"), column("doc_id"), np.repeat(np.arange(len(per)), per)
    step = np.arange(len(node)) - np.repeat(np.cumsum(per) - per, per)  # of a window among its anchor's
    order = np.lexsort((doc, node, key))
    key, node, doc, row, step = key[order], node[order], doc[order], row[order], step[order]
    new = np.ones(len(node), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(node) else doc
    hit = doc > least
    row, step, doc = row[hit], step[hit], doc[hit]
    lists = group.column("firsts").combine_chunks()
    firsts, many = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths())
    copies = many[row]
    place = np.repeat((np.cumsum(many) - many)[row], copies) + np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
    return _runs(np.repeat(doc, copies), np.repeat(group.column("rid").to_numpy()[row], copies), firsts[place] + np.repeat(step, copies))


def find_copies(placed: DataFrame) -> DataFrame:
    """Distinct (doc_id, rid) of the rows whose whole text a smaller doc_id has too. No text is shuffled."""
    t1, t2 = key128(F.col("text"))
    slim = placed.select("doc_id", "rid", t1.alias("t1"), t2.alias("t2")).where("doc_id is not null")
    least = stage(slim.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                  .where("least < most").drop("most"), "least")
    return slim.join(least, ["t1", "t2"]).where("doc_id > least").select("doc_id", "rid").distinct()


def find_repeats(placed: DataFrame, copies: DataFrame, window: int, prefix_words: int, long_prefix_from: int) -> DataFrame:
    """Runs (doc_id, rid, first, n) of windows that start in a smaller doc_id too, of placed(doc_id, rid, text) without the copies."""
    prefixes = document_prefixes(placed.where("doc_id is not null"), window, prefix_words)
    counts = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("a"), F.max("rid").alias("b"))
    repeated = stage(counts.where("a <> b").select("key", "n"), "prefixes")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = int(total // GROUP_ROWS + 1)

    filed = prefixes.select("doc_id", "key").join(repeated, "key").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    gone = copies.groupBy("doc_id").agg(F.collect_set("rid").alias("gone"))
    found = placed.join(filed.join(gone, "doc_id", "left"), "doc_id").where(~F.coalesce(F.array_contains("gone", F.col("rid")), F.lit(False)))
    anchors = stage(repeated_anchors(found.select("doc_id", "rid", "text", "keys"), window, prefix_words), "anchors")
    wide = repeated.where(F.col("n") > long_prefix_from).select("key", F.lit(True).alias("wide"))
    sorted_out = anchors.join(wide, "key", "left")

    small = (sorted_out.where("wide is null").drop("wide").withColumn("g", F.pmod("key", F.lit(groups)))
             .groupBy("g").applyInArrow(build_subtree, _RUN))

    spelled = F.expr("transform(sequence(0, cast(octet_length(digests) / 8 as int) - 1), i -> struct(i as step, substring(digests, 8 * i + 1, 8) as node))")
    leaves = (sorted_out.where("wide").select("key", "doc_id", "rid", "firsts", F.explode(spelled).alias("x"))
              .select("key", "doc_id", "rid", "firsts", "x.step", "x.node"))
    least = stage(leaves.groupBy("key", "node").agg(F.min("doc_id").alias("least")), "least")
    large = (leaves.join(least, ["key", "node"]).where("doc_id > least")
             .select("doc_id", "rid", F.explode("firsts").alias("first"), "step")
             .select("doc_id", "rid", (F.col("first") + F.col("step")).cast("int").alias("first"), F.lit(1).alias("n")))
    runs = stage(small.union(large), "runs")
    discard(anchors, repeated)
    return runs


_KEPT = "doc_id long, n_words long, n_removed long, repeats array<struct<start: int, n: int>>, kept_text string"


def _cut(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = column_bytes(_column(part, "text"))
                starts, ends, rows = find_words(data, offsets, SPACES)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                spans, kept, removed = [], [], []
                copied = _column(part, "copied").to_pylist()
                for i, runs in enumerate(_column(part, "runs").to_pylist()):
                    lo, n = bounds[i], int(bounds[i + 1] - bounds[i])
                    gone = np.full(n, bool(copied[i]) and n >= window)
                    if runs:
                        hits = np.concatenate([np.arange(r["first"], r["first"] + r["n"]) for r in runs])
                        gone = covered(hits, window, n)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    spans.append([{"start": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                    kept.append(b" ".join([data[s:e].tobytes() for s, e in zip(starts[lo:lo + n][~gone], ends[lo:lo + n][~gone])]).decode("utf-8", "replace"))
                    removed.append(int(gone.sum()))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [_column(part, "doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "repeats", "kept_text"])
    return scan


def remove_repeats(docs: DataFrame, window: int = 13, prefix_words: int | None = None, long_prefix_from: int = 50_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, repeats (maximal cut spans, in words), kept_text.

    A word goes if a window of `window` words over it also starts in a document with a smaller id.
    Rows with equal ids don't cut each other, and repeated rows get equal results. Rows with a null id
    neither cut nor are cut. Null, empty and short texts lose nothing. Only the named columns are read.
    """
    prefix_words = prefix_words or window // 2 + 1
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    copies = stage(find_copies(placed), "copies")
    runs = find_repeats(placed, copies, window, prefix_words, long_prefix_from)
    run = F.when(F.col("n") > 0, F.struct("first", "n"))
    marks = runs.withColumn("copied", F.lit(False)).union(copies.select("doc_id", "rid", F.lit(0), F.lit(0), F.lit(True)))
    gathered = marks.groupBy("doc_id", "rid").agg(F.collect_list(run).alias("runs"), F.max("copied").alias("copied"))
    joined = placed.join(gathered, ["doc_id", "rid"], "left")
    return joined.select("doc_id", "text", "runs", "copied").mapInArrow(_cut(window), _KEPT)
