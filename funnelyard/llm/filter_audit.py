"""Filter interaction audit on a sparse document-term matrix.

Texts are counted in blocks: each block has its own small word list and, for each document, the places of its
words in that list. The word lists of all blocks make one dictionary, which numbers the words of
the corpus; a block's places are then replaced by these numbers. The result is the document-term matrix in
shards of compressed sparse rows (CSR): row bounds, column numbers, counts. A document's words are its row's
sum, its distinct words the row's number of nonzero entries. These decide the filters on length and variety;
the other flags come with the texts, and the audit counts what every order of the filters removes, loses
and repeats.

The dictionary knows words by 64-bit digests. Every block sends its digests, ascending, in slices of the digest
range; the task of a slice numbers them and sends the numbers back, so no occurrence and no text is shuffled.
Rows and entries are told apart by the words themselves: a digest that two words shared would change no count.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelyard.llm.common import key128, stage
from funnelyard.llm.words import SPACES, byte_set, chunks, column_bytes, digest_spans, find_words

#: Bytes of text in a block (whole documents; a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Digests that one task of the dictionary numbers, about.
SLICE = 1_000_000

# --- fixed values: the filters ---------------------------------------------------------------------------------
FILTERS = "ABCDE"
LEAST_WORDS = 50          # A fails under so many words
LEAST_VARIETY = 65        # B fails if 100 * distinct words < 65 * words
MOST_CAPITALS = 5         # C fails if 100 * [A-Z] > 5 * code points
SYMBOLS = b"#$%&*|"       # D fails if one of these is in the text
# ---------------------------------------------------------------------------------------------------------------

_CAPITAL = byte_set((0x41, 0x5A))
_CONTINUED = byte_set((0x80, 0xBF))
_MARK = np.zeros(256, bool)
_MARK[list(SYMBOLS)] = True
_NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other

_DOC = [("doc_id", pa.int64(), "long"), ("part", pa.string(), "string"), ("t1", pa.int64(), "long"), ("t2", pa.int64(), "long"),
        ("capitals", pa.int64(), "long"), ("points", pa.int64(), "long"), ("marks", pa.int64(), "long")]
_DOCS = "array<struct<" + ",".join(f"{n}:{t}" for n, _, t in _DOC) + ">>"


def _per_row(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**31 as compressed differences: neighbours in a row of the matrix are close."""
    steps = np.diff(values, prepend=0).astype("<i4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(steps) else b""


def _unpack(blob: pa.Buffer, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, n).T).view("<i4").ravel(), dtype=np.int64)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The place of each word in the list of distinct words, that list, and its digests, which ascend."""
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = data[~SPACES[data]]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    del bounds, letters
    own, at = column_bytes(coded.dictionary)
    digests = digest_spans(own, at[:-1], at[1:])
    order = np.argsort(digests, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], digests[order], coded.dictionary.take(pa.array(order))


def count_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", keep_words: bool = True) -> DataFrame:
    """A row for each block: number, documents with their plain flags, CSR arrays over the block's own word list,
    the digests of that list and, with `keep_words`, the list itself (one word a line)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                data, offsets = column_bytes(part.column(4))
                starts, ends, rows = find_words(data, offsets, SPACES)
                place, digests, listed = _words(data, starts, ends)
                width = max(len(listed), 1)
                cell = rows * width + place
                del starts, ends, rows, place
                cell.sort()
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                n = np.diff(first, append=len(cell))
                cell = cell[first]
                bounds = np.searchsorted(cell, np.arange(part.num_rows + 1) * width)
                flags = [pa.array(_per_row(hit, offsets)) for hit in (_CAPITAL[data], ~_CONTINUED[data], _MARK[data])]
                docs_of = pa.StructArray.from_arrays([*part.columns[:4], *flags], names=[n for n, _, _ in _DOC])
                blobs = [bounds.astype("<i8").tobytes(), _pack(cell % width), _pack(n), digests.astype("<u8").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), docs_of),
                     *[pa.array([x], pa.binary()) for x in blobs], pa.array([b"\n".join(listed.to_pylist()) if keep_words else None], pa.binary()),
                     pa.array([len(listed)], pa.int64())], names=["block", "docs", "bounds", "places", "counts", "digests", "words", "n_words"])
                number += 1

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    t1, t2 = key128(text)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       t1.alias("t1"), t2.alias("t2"), text.alias("text"))
    return stage(slim.mapInArrow(scan, f"block long, docs {_DOCS}, bounds binary, places binary, counts binary, digests binary, words binary, n_words long"), "blocks")


def column_numbers(blocks: DataFrame) -> DataFrame:
    """(block, slice, numbers, owned): the column numbers of a block's words, by slices of the digest range.

    Numbers are dense from 0 over all words. `owned` marks a word's first block, so that each word is named once.
    """
    slices = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // SLICE))
    edges = np.array([k * (1 << 64) // slices for k in range(1, slices)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0), batch.column(1)):
                digests = np.frombuffer(blob.as_buffer(), "<u8")
                cuts = [0, *np.searchsorted(digests, edges).tolist(), len(digests)]
                own = [(k, digests[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([block.as_py()] * len(own), pa.int64()),
                                                  pa.array([x for _, x in own], pa.binary())], names=["slice", "block", "digests"])

    def number(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        parts = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("digests")]
        flat = np.concatenate(parts)
        found, first, place = np.unique(flat, return_index=True, return_inverse=True)
        owned = np.zeros(len(flat), bool)
        owned[first] = True
        cuts = np.cumsum([0, *map(len, parts)])
        each = list(zip(cuts, cuts[1:]))
        return pa.table({"slice": group.column("slice"), "block": group.column("block"),
                         "numbers": pa.array([place[a:b].astype("<i4").tobytes() for a, b in each], pa.binary()),
                         "owned": pa.array([np.packbits(owned[a:b]).tobytes() for a, b in each], pa.binary()),
                         "size": pa.array([len(found)] * len(each), pa.int64())})

    sent = blocks.select("block", "digests").mapInArrow(send, "slice int, block long, digests binary")
    numbered = stage(sent.groupBy("slice").applyInArrow(number, "slice int, block long, numbers binary, owned binary, size long"), "dictionary")
    sizes = numbered.groupBy("slice").agg(F.max("size").alias("size"))  # a row for each slice
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return numbered.drop("size").join(starts, "slice")


def _joined(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    own = numbers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slice", "start", "numbers", "owned"))).alias("slices"))
    return blocks.join(own, "block", "left")


def _columns_of(slices: pa.Scalar) -> np.ndarray:
    """The column numbers of a block's list, from its slices in order."""
    parts = slices.values
    if parts is None or not len(parts):
        return np.zeros(0, np.int64)
    return np.concatenate([np.frombuffer(n.as_buffer(), "<i4").astype(np.int64) + s.as_py() for s, n in zip(parts.field("start"), parts.field("numbers"))])


def dictionary(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """(word binary, column): each word of the corpus once, by the first block that holds it."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, slices in zip(batch.column(0), batch.column(1)):
                columns = _columns_of(slices)
                if len(columns):
                    parts = zip(slices.values.field("numbers"), slices.values.field("owned"))
                    owned = np.concatenate([np.unpackbits(np.frombuffer(o.as_buffer(), np.uint8), count=len(n.as_buffer()) // 4) for n, o in parts])
                    own = np.flatnonzero(owned)
                    listed = words.as_py().split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([listed[i] for i in own], pa.binary()), pa.array(columns[own])], names=["word", "column"])

    return _joined(blocks.select("block", "words"), numbers).select("words", "slices").mapInArrow(scan, "word binary, column long")


_SHARD = ("block", "docs", "bounds", "places", "counts", "slices")


def _csr(shard: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, column numbers and counts of one block, as a CSR shard of the matrix."""
    bounds = np.frombuffer(shard.column(2)[0].as_buffer(), "<i8")
    places, counts = (_unpack(shard.column(k)[0].as_buffer(), int(bounds[-1])) for k in (3, 4))
    # places follow the digests, and so do the numbers: the columns of a row ascend already
    return bounds, _columns_of(shard.column(5)[0])[places], counts


def document_term_matrix(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """CSR shards (block, docs, bounds, columns, counts): int64 bounds and column numbers, int32 counts, little-endian.

    The columns of a row ascend.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                bounds, columns, counts = _csr(one)
                blobs = [bounds.astype("<i8").tobytes(), columns.astype("<i8").tobytes(), counts.astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *[pa.array([x], pa.binary()) for x in blobs]],
                                                 names=["block", "docs", "bounds", "columns", "counts"])

    shards = _joined(blocks.select("block", "docs", "bounds", "places", "counts"), numbers).select(*_SHARD)
    return shards.mapInArrow(scan, f"block long, docs {_DOCS}, bounds binary, columns binary, counts binary")


def row_statistics(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """A row for each document: its fields, n_words (sum of its row of the matrix) and n_distinct (nonzero entries of the row).

    A shard is made and counted in the same task; it isn't stored.
    """
    names = [n for n, _, _ in _DOC]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                bounds, _, counts = _csr(one)
                docs, sums = one.column(1)[0].values, np.concatenate(([0], np.cumsum(counts)))
                nonzero = np.concatenate(([0], np.cumsum(counts > 0)))
                yield pa.RecordBatch.from_arrays([*[docs.field(n) for n in names], pa.array(sums[bounds[1:]] - sums[bounds[:-1]]),
                                                  pa.array(nonzero[bounds[1:]] - nonzero[bounds[:-1]])], names=[*names, "n_words", "n_distinct"])

    schema = ", ".join(f"{n} {t}" for n, _, t in _DOC)
    shards = _joined(blocks.select("block", "docs", "bounds", "places", "counts"), numbers).select(*_SHARD)
    return shards.mapInArrow(scan, f"{schema}, n_words long, n_distinct long")


def _flag(condition: Column, letter: str) -> Column:
    return F.when(condition, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def failure_patterns(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, n, good, toxic): documents by part and by the set of filters that they fail (bits in the order of FILTERS).

    E needs the least id of each text. Equal rows, then the rows of one text, part and label, are combined
    where they are before they are shuffled, so that a text that fills a third of the table is a few rows.
    """
    plain = (_flag(F.col("n_words") < LEAST_WORDS, "A") + _flag(100 * F.col("n_distinct") < LEAST_VARIETY * F.col("n_words"), "B")
             + _flag(100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), "C") + _flag(F.col("marks") > 0, "D"))
    once = stats.groupBy("doc_id", "part", "t1", "t2", plain.alias("plain")).agg(F.count(F.lit(1)).alias("n"))
    known = (labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad")))
    rows = once.join(known, "doc_id", "left").select("part", "t1", "t2", "plain", "n", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"),
                                                     F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    # an id occurs once in each of these groups: the rows of the least id are those of the least pair
    grouped = stage(rows.groupBy("t1", "t2", "plain", "part", "good", "bad").agg(F.min(F.struct("id", "n")).alias("least"), F.sum("n").alias("n")), "texts")
    first = stage(grouped.groupBy("t1", "t2").agg(F.min("least.id").alias("first")), "first")
    split = grouped.join(first, ["t1", "t2"]).select(
        "part", "plain", "good", "bad", "n", F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0)).alias("kept"))
    e = 1 << FILTERS.index("E")
    both = split.select("part", "good", "bad", F.explode(F.array(
        F.struct(F.col("plain").alias("pattern"), F.col("kept").alias("n")),
        F.struct((F.col("plain") + e).alias("pattern"), (F.col("n") - F.col("kept")).alias("n")))).alias("x"))
    return both.groupBy("part", F.col("x.pattern").alias("pattern")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bad"), F.col("x.n")).otherwise(0)).alias("toxic"))


def interactions(patterns: DataFrame) -> DataFrame:
    """The audit (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order and step, zeros included. What a step does depends on the documents'
    patterns alone: a part is 32 counts, whatever its size, and the steps are a fixed list.
    """
    size = len(FILTERS)
    steps = [{"filter_order": "".join(order), "step": i + 1, "own": 1 << FILTERS.index(f), "before": sum(1 << FILTERS.index(x) for x in order[:i])}
             for order in itertools.permutations(FILTERS) for i, f in enumerate(order)]
    rule = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")

    def by_pattern(column: str) -> Column:
        sums = ", ".join(f"sum(if(pattern = {k}, {column}, 0L))" for k in range(1 << size))
        return F.expr(f"array({sums})").alias(column)

    parts = patterns.groupBy("part").agg(*[by_pattern(c) for c in ("n", "good", "toxic")])
    steps_of = parts.select("part", "n", "good", "toxic", F.explode(rule).alias("s")).select("part", "n", "good", "toxic", "s.*")

    def total(column: str, condition: str, times: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {(1 << size) - 1}), 0L, (a, k) -> a + if({condition}, {column}[k] * {times}, 0L))")

    orders = len(steps) // size
    return steps_of.select(
        "part", "filter_order", "step", total("n", "(k & (own | before)) = 0").alias("kept"), total("n", "(k & own) <> 0 and (k & before) = 0").alias("removed"),
        total("n", "(k & own) <> 0 and (k & before) <> 0").alias("redundant"), total("n", "k = own").alias("unique_fails"),
        total("good", "(k & own) <> 0 and (k & before) = 0").alias("good_lost"), total("toxic", "(k & own) <> 0 and (k & before) = 0").alias("toxic_lost"),
        total("n", "(k & own) <> 0", f"({orders} div greatest(bit_count(k), 1))").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter does at each step of every order of the filters, for each part of `docs`.

    A null text is empty, a null part the empty string. Empty texts fail A only (and E after the first of them).
    E goes by ids: rows that share the least id of their text, repeated rows included, don't fail it, and
    null ids count as larger than all others. A document is good (toxic) if some row of `labels` with its id says
    1. Texts and words of any length count whole; words are told apart byte by byte. Other columns aren't read, and an empty
    table gives no rows. Of `labels`, doc_id, quality and toxic are read; nulls there say nothing, and null ids meet none.
    In `shapley` a document that fails m filters counts for each of them in 120 / m of the 120 orders.
    """
    blocks = count_blocks(docs, id_col, text_col, part_col, keep_words=False)
    return interactions(failure_patterns(row_statistics(blocks, column_numbers(blocks)), labels))
