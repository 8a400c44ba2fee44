"""Vector code compression: product quantisation whose codebooks come from a dual-tree Lloyd iteration.

A vector is cut into equal consecutive parts, and each part position has a codebook of a few entries.
Vectors are stored in blocks; for each part position a block holds a tree over its parts (boxes, counts
and sums of the nodes). Each round makes a tree over the entries of every codebook and walks both
together: the least and the largest distance of a pair of boxes tell which entries can't be the nearest
of any part in a node; where one entry is left, the node's stored sum goes to it as a whole. Leaves that
stay uncertain are decided part by part in integers, so the result is that of the plain iteration.

A round returns sums and counts per entry, which Spark adds up over the blocks; the codebooks
(parts x entries x components, whatever the number of vectors) go back to the tasks with the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import stage

#: Vectors of a block, and parts of a leaf of its trees.
BLOCK, LEAF = 4096, 32
#: Components from here on (after scaling) could take a squared distance beyond 64 bits.
MOST = 1 << 27

_BLOCKS = "vec_ids array<long>, labels array<string>, n int, data binary, perm binary, low binary, high binary, sums binary"


def bounds_of(n: int) -> list[tuple[int, int, int, int]]:
    """Nodes (start, end, left child, right child) of a balanced tree over n places, parents first; -1 has no child."""
    nodes, todo = [[0, n, -1, -1]], [0]
    for k in todo:
        a, b = nodes[k][:2]
        if b - a > LEAF:
            mid = (a + b) // 2
            nodes[k][2:] = [len(nodes), len(nodes) + 1]
            todo += nodes[k][2:]
            nodes += [[a, mid, -1, -1], [mid, b, -1, -1]]
    return [tuple(x) for x in nodes]


def build_tree(points: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, low, high and sum of every node): each node is halved along its widest side."""
    order = np.arange(len(points))
    low = np.zeros((len(nodes), points.shape[1]), np.int64)
    high, sums = low.copy(), low.copy()
    for k, (a, b, left, _) in enumerate(nodes):
        own = points[order[a:b]]
        low[k], high[k], sums[k] = own.min(0), own.max(0), own.sum(0)
        if left >= 0:
            order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(high[k] - low[k])], (b - a) // 2)]
    return order, low, high, sums


def entry_tree(entries: np.ndarray) -> list[list[np.ndarray]]:
    """Levels of a binary tree over the entries, as lists of entry numbers; equal entries are one, the first of them."""
    _, first = np.unique(entries, axis=0, return_index=True)
    levels = [[np.sort(first)]]
    while any(len(x) > 1 for x in levels[-1]):
        level = []
        for own in levels[-1]:
            if len(own) > 1:
                spread = entries[own]
                own = own[np.argsort(spread[:, np.argmax(np.ptp(spread, axis=0))], kind="stable")]
                level += [own[:len(own) // 2], own[len(own) // 2:]]
            else:
                level.append(own)
        levels.append(level)
    return levels


def _pair_bounds(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of each box (first axis) to each box (second axis), exact."""
    gap = np.maximum(np.maximum(to_low[None] - high[:, None], low[:, None] - to_high[None]), 0)
    far = np.maximum(to_high[None] - low[:, None], high[:, None] - to_low[None])
    return (gap * gap).sum(2), (far * far).sum(2)


def possible_entries(low: np.ndarray, high: np.ndarray, entries: np.ndarray, levels: list[list[np.ndarray]], may: np.ndarray) -> np.ndarray:
    """Of the entries that `may` be nearest somewhere in a box (box x entry), those that still may.

    Down the tree of the entries, a node goes if its least distance is beyond the largest distance of another
    one: every part of the box is strictly nearer to that. What is left is tested against the entry nearest
    to the middle of the box: it goes if no place of the box is as near to it.
    """
    alive = may.copy()
    for level in levels:
        own = np.stack([alive[:, x].any(1) for x in level], axis=1)
        least, most = _pair_bounds(low, high, np.stack([entries[x].min(0) for x in level]), np.stack([entries[x].max(0) for x in level]))
        bound = np.where(own, most, np.iinfo(np.int64).max).min(1)
        gone = least > bound[:, None]
        for k, x in enumerate(level):
            alive[np.ix_(gone[:, k], x)] = False
    middle = low + high  # twice the middle
    toward = np.where(alive, ((middle[:, None] - 2 * entries[None]) ** 2).sum(2), np.iinfo(np.int64).max)
    best = toward.argmin(1)
    step = entries[None] - entries[best][:, None]
    corner = np.where(step > 0, high[:, None], low[:, None])  # the place of the box that favours the entry most
    nearer = ((corner - entries[None]) ** 2).sum(2) > ((corner - entries[best][:, None]) ** 2).sum(2)
    return alive & ~nearer


def assign_block(points: np.ndarray, perm: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray,
                 entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry of each point, sums and counts by entry, points that were decided one by one)."""
    nodes = bounds_of(len(points))
    levels = entry_tree(entries)
    code = np.zeros(len(points), np.int64)
    total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    may = np.zeros((1, len(entries)), bool)
    may[0, levels[0][0]] = True
    level, single = np.zeros(1, np.int64), []
    while len(level):
        may = possible_entries(low[level], high[level], entries, levels, may)
        sure = may.sum(1) == 1
        for k, e in zip(level[sure].tolist(), may[sure].argmax(1).tolist()):
            a, b = nodes[k][:2]
            code[perm[a:b]] = e
            total[e] += sums[k]
            count[e] += b - a
        below, masks = [], []
        for k, mask in zip(level[~sure].tolist(), may[~sure]):
            a, b, left, right = nodes[k]
            if left < 0:
                single.append((perm[a:b], mask))
            else:
                below += [left, right]
                masks += [mask, mask]
        level, may = np.array(below, np.int64), np.array(masks, bool).reshape(len(below), len(entries))
    decided = 0
    if single:
        at = np.concatenate([x for x, _ in single])
        masks = np.repeat(np.stack([m for _, m in single]), [len(x) for x, _ in single], axis=0)
        own = points[at]
        far = np.where(masks, ((own[:, None] - entries[None]) ** 2).sum(2), np.iinfo(np.int64).max)
        code[at] = far.argmin(1)  # the first of equal distances
        np.add.at(total, code[at], own)
        count += np.bincount(code[at], minlength=len(entries))
        decided = len(at)
    return code, total, count, decided


def _finite(vector: Column) -> Column:
    wide = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _to_integers(col: pa.Array, dims: int, scale: int) -> np.ndarray:
    wide = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(wide * scale).astype(np.int64).reshape(-1, dims)


def store_blocks(vectors: DataFrame, dims: int, parts: int, scale: int) -> DataFrame:
    """Blocks of BLOCK vectors (vec_id, label, vector) of a task, each with its trees, stored for all rounds."""
    size = dims // parts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                data = _to_integers(part.column(2), dims, scale)
                nodes = bounds_of(len(data))
                trees = [build_tree(data[:, p * size:(p + 1) * size], nodes) for p in range(parts)]
                packed = [np.stack([t[i] for t in trees]) for i in range(4)]
                blobs = [data.astype("<i4"), packed[0].astype("<i4"), packed[1].astype("<i4"), packed[2].astype("<i4"), packed[3].astype("<i8")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.string())),
                     pa.array([len(data)], pa.int32()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]],
                    names=["vec_ids", "labels", "n", "data", "perm", "low", "high", "sums"])

    return stage(vectors.mapInArrow(scan, _BLOCKS), "blocks")


def _unpack(row: dict, parts: int, dims: int) -> tuple[np.ndarray, ...]:
    size, n = dims // parts, row["n"]
    data = np.frombuffer(row["data"], "<i4").reshape(n, dims).astype(np.int64)
    perm = np.frombuffer(row["perm"], "<i4").reshape(parts, n)
    low, high = (np.frombuffer(row[k], "<i4").reshape(parts, -1, size).astype(np.int64) for k in ("low", "high"))
    return data, perm, low, high, np.frombuffer(row["sums"], "<i8").reshape(parts, -1, size)


def lloyd_round(blocks: DataFrame, codebooks: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks (part x entry x component) after one assignment of all blocks; unused entries stay."""
    parts, entries, size = codebooks.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                data, perm, low, high, sums = _unpack(row, parts, dims)
                for p in range(parts):
                    _, t, c, _ = assign_block(data[:, p * size:(p + 1) * size], perm[p], low[p], high[p], sums[p], codebooks[p])
                    total[p] += t
                    count[p] += c
        place = np.indices((parts, entries, size)).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in place]
                                         + [pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), size))], names=["p", "e", "i", "total", "n"])

    slim = blocks.select("n", "data", "perm", "low", "high", "sums")
    sums = slim.mapInArrow(scan, "p int, e int, i int, total long, n long").groupBy("p", "e", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = codebooks.copy()
    for r in sums.where("n > 0").collect():  # a row for each component of the codebooks
        new[r.p, r.e, r.i] = r.total // r.n
    return new


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
                     id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, codes array<int>, error) and the codebooks, as part x entry x component integers.

    Components become floor(scale * x). The codebooks start as the parts of the `entries` vectors with the
    smallest ids (equal ids: by their components); each round assigns every part to its nearest entry, ties to the lower
    index, and replaces entries by the floored mean of their parts; unused entries stay. `error` is the final squared distance.

    Dropped are rows whose vector is null or has a null or non-finite component, whose length isn't that of the vector
    with the smallest id (among those of a positive multiple of `parts`), and rows with a scaled component of 2**27 or
    more, whose distances could exceed 64 bits. Null ids count as larger than all others and stay null; null labels stay
    null. Repeated rows count each. With fewer vectors than entries the codebook has as many entries as there are vectors;
    an empty table gives no rows and an empty codebook. Labels are returned as strings; other columns aren't read.
    """
    vector = F.col(f"`{vector_col}`")
    kept = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), vector.alias("vector"))
            .where(_finite(F.col("vector")) & (F.size("vector") > 0) & (F.size("vector") % parts == 0)))
    kept = kept.where(F.forall(F.col("vector").cast("array<double>"), lambda x: F.abs(x * scale) < MOST))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    head = kept.orderBy(*order).limit(1).collect()
    dims = len(head[0].vector) if head else parts
    kept = kept.where(F.size("vector") == dims)
    first = kept.orderBy(*order).limit(entries).collect() if head else []
    start = np.floor(np.array([r.vector for r in first], np.float64).reshape(len(first), dims) * scale).astype(np.int64)
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    blocks = store_blocks(kept, dims, parts, scale)
    for _ in range(rounds if len(first) else 0):
        codebooks = lloyd_round(blocks, codebooks, dims)
    size, last = dims // parts, codebooks

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, perm, low, high, sums = _unpack(row, parts, dims)
                codes, error = np.zeros((len(data), parts), np.int32), np.zeros(len(data), np.int64)
                for p in range(parts):
                    own = data[:, p * size:(p + 1) * size]
                    codes[:, p] = assign_block(own, perm[p], low[p], high[p], sums[p], last[p])[0]
                    error += ((own - last[p][codes[:, p]]) ** 2).sum(1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * parts), pa.array(codes.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.string()), flat, pa.array(error)],
                                                 names=["vec_id", "label", "codes", "error"])

    return blocks.mapInArrow(scan, "vec_id long, label string, codes array<int>, error long"), codebooks


def hex_code(codes: Column) -> Column:
    """Two lowercase hex digits for each code, in part order."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds `label_error`, the sum of `error` over the rows with an equal label (nulls together).

    The sums are added up where the rows are and stored before they are joined back, so that a label that
    holds most rows is one small row beside a shuffle that can be split.
    """
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "__label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
