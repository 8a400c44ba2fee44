"""MinHash near-dedup with an LSH forest (Bawa, Condie and Ganesan, 2005).

A document is the set of its distinct word shingles. Of its minhash signature, TREES orders are made;
each order is a prefix tree over up to MAX_DEPTH signature values. Nodes of a tree that share a prefix
form a region; a region with more than `leaf` members is followed to greater depth, so depth adapts to
how crowded the region is. Candidates are the neighbours with the longest common prefix: all members of
a leaf region, and at every depth on the way the region's first member (its pivot), which ties the
members of a crowded region together without pairing them all.

Equal sets are one node from the start, whatever their number. Candidates that the signatures put far
below the threshold are dropped, the others are confirmed on the full sets: first the pivots' links,
then every candidate pair that these don't join already. What a crowded region of the least depth still
holds in different components is compared in full, on the full sets, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import components, discard, key128, stage
from funnelyard.llm.words import LOWER, SPACES, chunks, column_bytes, digest_spans, find_words, mix, releasing, whole, windows

#: Orders of the forest, signature values that start each, and the depths at which regions are formed; the first one
#: depends on the threshold.
TREES, STEP = 16, 8
DEPTHS = (6, 8, 12, 16, 24, 32)
MAX_DEPTH = DEPTHS[-1]
VALUES = TREES * STEP
#: How often a pair at the threshold may share no region, at most, and by how many standard deviations its share of
#: equal signature values may fall short.
MISS, DEVIATIONS = 2e-5, 4.75

#: Shingles of a block of a crowded region, and the trees whose regions are compared in one round: what the
#: first rounds join, the later ones needn't compare again.
BLOCK = 300_000
ROUNDS = ((0, 0), (1, 3), (4, TREES - 1))

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(1 << 32, size=VALUES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1 << 62, size=VALUES, dtype=np.uint64)

_SIGNED = "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, signature binary"


def shingle_sets(part: pa.RecordBatch, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the distinct shingles of each row, ascending, and the bounds of the rows in them.

    A row with fewer than `size` words has its whole sequence as the one shingle; without words, none.
    """
    data, offsets = column_bytes(part.column(part.schema.get_field_index(column)))
    data = LOWER[data]
    starts, ends, rows = find_words(data, offsets, SPACES)
    digests = digest_spans(data, starts, ends)
    at = np.flatnonzero(whole(rows, size))
    h, of = windows(digests, size)[at], rows[at]
    words = np.bincount(rows, minlength=part.num_rows)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        first = np.searchsorted(rows, short)
        own = np.array([windows(digests[a:a + n], n)[0] for a, n in zip(first, words[short])], np.uint64)
        h, of = np.concatenate((h, own)), np.concatenate((of, short))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[once], of[once]
    return h, np.searchsorted(of, np.arange(part.num_rows + 1))


def first_depth(percent: int) -> int:
    """The greatest least depth of the forest at which pairs at the threshold are missed rarely enough: 4 at 85, 3 at 80."""
    return max((d for d in range(1, DEPTHS[0]) if (1 - (percent / 100) ** d) ** TREES <= MISS), default=1)


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: set size, digest of the set (s1, s2), minhash signature; t1 and t2 digest the text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, bounds = shingle_sets(part, "text", shingle)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                signed = np.zeros((part.num_rows, VALUES), np.uint32)
                s1, s2 = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                if len(full):
                    at = bounds[:-1][full]
                    s1[full] = np.add.reduceat(mix(h), at)
                    s2[full] = np.bitwise_xor.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), at)
                    for k in range(VALUES):
                        signed[full, k] = np.minimum.reduceat(((h * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), at)
                blobs = [signed[i].astype("<u4").tobytes() if n[i] else None for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(blobs, pa.binary())],
                    names=["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "signature"])

    t1, t2 = key128(F.col(text_col))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    return slim.mapInArrow(releasing(scan), _SIGNED)


def _region(tree: Column, signature: Column, depth: int) -> Column:
    """Digest of a tree's first `depth` values; the orders are rotations of the signature."""
    twice = F.concat(signature, F.substring(signature, 1, 4 * MAX_DEPTH))
    return F.xxhash64(tree, twice.substr(tree * (4 * STEP) + 1, F.lit(4 * depth)))


def forest_pairs(nodes: DataFrame, leaf: int, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Candidate pairs (a, b, pivot) with a < b of nodes (node, rep, signature), possibly more than once.

    Second, the stored rows (node, tree, region) of the crowded regions of the least depth: they hold every pair that
    is left out of the first, apart from those that share no region at all. Third, the stored tables that the
    pairs read, to be discarded after them.
    """
    depths, used = (first_depth(percent), *DEPTHS), []
    rows = nodes.select("node", "rep", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature")
    rows = rows.select("node", "rep", "tree", _region(F.col("tree"), F.col("signature"), depths[0]).alias("region"))
    pairs = None
    for i in range(len(depths)):
        sizes = (rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "node")).alias("first"))
                 .where("n > 1").select("region", "n", F.col("first.node").alias("first")))
        sizes = stage(sizes, "regions")
        placed = stage(rows.join(sizes, "region"), "forest")
        discard(sizes, *([deeper] if i == 1 else []))
        used.append(placed)
        own = placed.where("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"), F.lit(True).alias("pivot"))
        # a leaf region has `leaf` members at most
        members = placed.where((F.col("n") > 2) & (F.col("n") <= leaf)).groupBy("region").agg(F.array_sort(F.collect_set("node")).alias("m"))
        near = members.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"), F.lit(False).alias("pivot"))
        pairs = own.union(near) if pairs is None else pairs.union(own).union(near)
        crowded = placed.where(F.col("n") > leaf)
        if i == 0:
            whole_regions = stage(crowded.select("node", "tree", "region"), "crowded")
        if i + 1 == len(depths) or crowded.isEmpty():
            break
        later = [f"r{k}" for k in range(i, len(DEPTHS))]
        if i == 0:  # the signatures are met once: what is followed carries its regions of all greater depths
            deeper = (crowded.select("node", "rep", "tree").join(nodes.select("node", "signature"), "node")
                      .select("node", "rep", "tree", *[_region(F.col("tree"), F.col("signature"), d).alias(r) for r, d in zip(later, DEPTHS)]))
            crowded = deeper = stage(deeper, "deeper")
        rows = crowded.select("node", "rep", "tree", F.col(later[0]).alias("region"), *later[1:])
    return pairs, whole_regions, used


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, pivot) whose set sizes allow the threshold and whose signatures come near it."""
    share = percent / 100
    least = share - DEVIATIONS * (share * (1 - share) / VALUES) ** 0.5

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(column_bytes(batch.column(k))[0], np.uint32).reshape(n, VALUES) if n else np.zeros((0, VALUES), np.uint32) for k in (3, 4))
            near = np.flatnonzero((x == y).mean(axis=1) >= least) if n else []
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(near, pa.int64())) for k in range(3)], names=["a", "b", "pivot"])

    once = pairs.groupBy("a", "b").agg(F.max("pivot").alias("pivot"))
    size = nodes.select("node", "n_shingles", "signature")
    left = size.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = size.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    sized = once.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "pivot", "sa", "sb").mapInArrow(releasing(compare), "a long, b long, pivot boolean")


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles): the ascending shingle digests of one text of each node, as little-endian 64-bit numbers."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, bounds = shingle_sets(part, "text", shingle)
                blobs = [h[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    t1, t2 = key128(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    texts = texts.withColumn("rep", F.coalesce("rep", F.lit(_NO_ID)))
    return texts.join(nodes.select("rep", "t1", "t2", "node"), ["rep", "t1", "t2"]).select("node", "text").mapInArrow(releasing(scan), "node long, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(releasing(compare), "a long, b long")


def _linked(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links between rows (node, root, other, shingles) of `left` and `right` that join their components."""
    a, b = ([side.column(c).to_numpy() for c in ("node", "root")] for side in (left, right))
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in right.column("shingles")]
    n = np.array([len(x) for x in sets])
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts, marked = np.cumsum(n) - n, np.zeros(len(words), np.uint8)
    roots, links = b[1].copy(), []
    joined = {}  # components of the left side that links have renamed
    second = right.column("other").to_numpy(zero_copy_only=False)
    for node, root, x in zip(*a, left.column("shingles")):
        x = np.frombuffer(x.as_buffer(), "<u8")
        while root in joined:
            root = joined[root]
        worth = (roots != root) & (100 * np.minimum(n, len(x)) >= percent * np.maximum(n, len(x))) & ~(second & (b[0] < node))
        if not worth.any():
            continue
        at = np.searchsorted(words, x)
        at = at[at < len(words)]
        at = at[words[at] == x[:len(at)]]
        marked[at] = 1
        both = np.add.reduceat(marked[ids], starts, dtype=np.int64)
        marked[at] = 0
        for k in np.flatnonzero(worth & (100 * both >= percent * (n + len(x) - both))):
            if roots[k] != root:
                links.append((min(node, b[0][k]), max(node, b[0][k])))
                joined[roots[k]] = root
                roots[roots == roots[k]] = root
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def crowd_links(crowd: DataFrame, root: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, shingle: int,
                id_col: str, text_col: str) -> DataFrame | None:
    """Links (a, b) between the components of each region of `crowd` (node, region); None if no region has two.

    All members are compared with those outside the region's largest component, in cells of two blocks of
    about BLOCK shingles each: a region of one component costs nothing, and no task holds a region.
    """
    member = (crowd.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .join(nodes.select("node", F.col("n_shingles").alias("size")), "node"))
    member = stage(member, "crowd")
    parts = stage(member.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "parts")
    total = (parts.groupBy("region").agg(F.count(F.lit(1)).alias("roots"), F.sum("size").alias("all"), F.max(F.struct("n", "size", "root")).alias("x"))
             .where("roots > 1").select("region", F.col("x.root").alias("most"), F.ceil(F.col("all") / BLOCK).cast("int").alias("k_all"),
                                        F.ceil((F.col("all") - F.col("x.size")) / BLOCK).cast("int").alias("k_other")))
    total = stage(total, "regions")
    discard(parts)
    if total.isEmpty():
        discard(member, total)
        return None
    all_members = member
    member = stage(member.join(total, "region").withColumn("other", F.col("root") != F.col("most")), "crowd")
    discard(all_members, total)
    sets = stage(full_sets(docs, nodes.join(member.select("node").distinct(), "node", "left_semi"), shingle, id_col, text_col), "sets")
    block = F.pmod(F.xxhash64("node", "region"), F.col("k_all")).cast("int")
    own = F.pmod(F.xxhash64("region", "node"), F.col("k_other")).cast("int")
    cells = [member.where("other").select("region", own.alias("i"), F.explode(F.expr("sequence(0, k_all - 1)")).alias("j"), "node", "root", "other"),
             member.select("region", F.explode(F.expr("sequence(0, k_other - 1)")).alias("i"), block.alias("j"), "node", "root", "other")]
    names = ["region", "i", "j", "node", "root", "other", "shingles"]
    left, right = (c.join(sets, "node").select(*[F.col(x).alias(x) for x in names]).groupBy("region", "i", "j") for c in cells)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return _linked(left, right, percent)

    found = stage(left.cogroup(right).applyInArrow(compare, "a long, b long").distinct(), "links")
    discard(member, sets)
    return found


#: Stands for a null id: larger than any other.
_NO_ID = (1 << 63) - 1


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, leaf: int = 16,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, t1, t2, class1, class2.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles of
    `shingle` lower-cased words (A-Z); component_id is the least doc_id that links reach. kept marks the
    rows with that id. (class1, class2) digest one set of the component and are equal for its rows only;
    (t1, t2) is `key128` of the row's text.
    Documents without words are linked with nothing and kept. Null ids count as larger than all others;
    a component of null ids has a null component_id and its rows are kept. Repeated rows get equal
    results. Only the named columns are read; an empty table gives no rows.
    """
    full = stage(signatures(docs, shingle, id_col, text_col), "signatures")
    grouped = (full.where("n_shingles > 0").groupBy("s1", "s2")
               .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rep"), "t1", "t2")).alias("x"),
                    F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature")))
    nodes = stage(grouped.select("s1", "s2", "x.rep", "x.t1", "x.t2", "n_shingles", "signature", F.monotonically_increasing_id().alias("node")), "nodes")
    signed = stage(full.drop("signature"), "sizes")
    discard(full)  # from here on every table goes as soon as nothing reads it any more

    candidates, crowd, forest = forest_pairs(nodes, leaf, percent)
    pairs = stage(likely(candidates, nodes, percent), "pairs")
    discard(*forest)
    known = stage(nodes.drop("signature"), "nodes")
    discard(nodes)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stage(full_sets(docs, known.join(wanted, "node", "left_semi"), shingle, id_col, text_col), "sets")
    links = stage(confirmed(pairs.where("pivot"), sets, percent), "links")
    root = components(links)
    rooted = (pairs.where("not pivot").join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
              .join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
              .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")))
    more = stage(confirmed(rooted, sets, percent), "links")
    discard(sets, pairs)

    def join_up(links: DataFrame, more: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = stage(links.union(more), "links")
        discard(links, more, root)
        return both, components(both)

    links, root = join_up(links, more, root)
    for first, last in ROUNDS:
        more = crowd_links(crowd.where(F.col("tree").between(first, last)).select("node", "region"), root, known, docs, percent, shingle, id_col, text_col)
        if more is not None and not more.isEmpty():
            links, root = join_up(links, more, root)
    discard(crowd, links)

    joined = known.select("s1", "s2", "rep", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stage(joined.groupBy("root").agg(F.min(F.struct("rep", "s1", "s2")).alias("x")), "least")
    classes = joined.join(least, "root").select("s1", "s2", F.nullif("x.rep", F.lit(_NO_ID)).alias("component_id"),
                                                F.col("x.s1").alias("class1"), F.col("x.s2").alias("class2"))
    alone = F.col("n_shingles") == 0
    found = stage(signed.join(classes, ["s1", "s2"], "left")
                  .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
                  .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
                  .select("doc_id", "n_shingles", "component_id", "kept", "t1", "t2", "class1", "class2"), "classes")
    discard(signed, known, least, root)
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs`, all columns, but only one of each component: that of the least id, once.

    Rows without words are linked with nothing and all stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    chosen = stage(found.where("n_shingles > 0").groupBy("class1", "class2")
                   .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rep"), "t1", "t2")).alias("x")).select("x.*"), "chosen")
    discard(found)
    text = F.col(f"`{text_col}`")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    t1, t2 = key128(text)
    # the input's columns stay in one struct, whatever their names
    keyed = docs.where(worded).select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("rep"),
                                      t1.alias("t1"), t2.alias("t2"))
    once = keyed.join(chosen, ["rep", "t1", "t2"], "left_semi").dropDuplicates(["rep", "t1", "t2"])
    return once.select("row.*").union(docs.where(~worded))
