"""Best-fit packing of token sequences after the dominance reduction of Martello and Toth (1990).

Documents are tokenised and cut on the executors. What decides a packing is only how many pieces there
are of each length, so the instance is a table of at most `capacity` counts, whatever the corpus size.
`plan_packing` fixes dominating sets on that table, best-fits the rest and returns runs of equal
sequences; the executors then number the pieces of each length and look up their places in the runs.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.common import rank_within, stage
from funnelyard.llm.words import LOWER, chunks, column_bytes, digest_spans, releasing

#: Distinct units whose token ids a Python worker remembers; the memory is emptied when it is full.
KNOWN_UNITS = 1_500_000

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"

#: Byte classes of the cut into units: 0 white space, 1 ASCII letters and digits, 2 ASCII symbols but the
#: apostrophe, 3 the rest. A unit ends at white space and between classes 1 and 2.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(b" \t\n\r")] = 0
_CLASS[0x21:0x7F] = 2
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = 1
_CLASS[ord("'")] = 3


class UnitIds:
    """Token ids of the units met so far, as one flat array; units are known by their 64-bit digest."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.digests, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each unit in `ids`."""
        code, digests = pd.factorize(digest_spans(data, starts, ends))
        place = np.searchsorted(self.digests, digests)
        new = np.ones(len(digests), bool)
        inside = place < len(self.digests)
        new[inside] = self.digests[place[inside]] != digests[inside]
        if new.any():
            if len(self.digests) > KNOWN_UNITS:
                self.clear()
                new[:] = True
            first = np.full(len(digests), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            got = self.encode([data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in first[new]])
            length = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for ids in got for x in ids), np.uint32, int(length.sum()))
            known = np.concatenate((self.digests, digests[new]))
            order = np.argsort(known)
            self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(length) - length))[order]
            self.length = np.concatenate((self.length, length))[order]
            self.ids, self.digests = np.concatenate((self.ids, flat)), known[order]
            place = np.searchsorted(self.digests, digests)
        return self.at[place][code], self.length[place][code]


_UNITS: dict[str, UnitIds] = {}


def _known(vocabulary: str) -> UnitIds:
    if vocabulary not in _UNITS:
        _UNITS[vocabulary] = UnitIds(vocabulary)
    return _UNITS[vocabulary]


def _find_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = _CLASS[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] == 0) | (kind[:-1] == 0) | (kind[1:] + kind[:-1] == 3) & (kind[1:] != 3) & (kind[:-1] != 3)
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    word = kind[starts] != 0
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_ids(known: UnitIds, data: np.ndarray, offsets: np.ndarray, end_id: int, by_unit: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, `end_id` after each, as one array and the bounds of the texts in it."""
    n = len(offsets) - 1
    raw = data.tobytes()
    whole = np.zeros(n, bool)
    if not by_unit or any(a in raw for a in known.added):
        for i in range(n):
            text = raw[offsets[i]:offsets[i + 1]]
            whole[i] = not by_unit or any(a in text for a in known.added)
    starts, ends, rows = _find_units(LOWER[data], offsets) if len(data) else (np.zeros(0, np.int64),) * 3
    own = ~whole[rows]
    starts, ends, rows = starts[own], ends[own], rows[own]
    place, length = known.look_up(LOWER[data], starts, ends) if len(starts) else (starts, starts)
    per = np.bincount(rows, weights=length, minlength=n).astype(np.int64)
    direct = dict(zip(np.flatnonzero(whole).tolist(), known.encode([raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace") for i in np.flatnonzero(whole)]))) if whole.any() else {}
    for i, ids in direct.items():
        per[i] = len(ids)
    bounds = np.concatenate(([0], np.cumsum(per + 1)))
    out = np.full(bounds[-1], end_id, np.uint32)
    before = np.cumsum(length) - length  # of each unit, among the ids of all units
    first = np.searchsorted(rows, np.arange(n))
    shift = bounds[rows] - before[first[rows]] if len(rows) else rows
    step = np.arange(int(length.sum())) - np.repeat(before, length)
    out[np.repeat(before + shift, length) + step] = known.ids[np.repeat(place, length) + step]
    for i, ids in direct.items():
        out[bounds[i]:bounds[i] + len(ids)] = ids
    return out, bounds


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = True, by_unit: bool = True) -> DataFrame:
    """Rows (row, doc_id, piece, start, length, ids_crc32, ids): each text's token ids and `end_id`, cut at `capacity`.

    `ids` (unless with_ids is off) holds little-endian unsigned 32-bit ids and ids_crc32 their checksum;
    `row` numbers the input rows, so repeated and null doc_ids stay apart. `vocabulary` is a tokenizers
    file that every executor can open. With by_unit each distinct unit (a run of letters and digits, or
    of symbols, of a word) is encoded once; that gives a text's own ids for vocabularies that lower-case,
    drop white space and cut letters from symbols, as BPE with word ends does. Texts that spell an added
    token, and all texts without by_unit, are encoded whole. Null and empty texts give the one piece
    [end_id]; an empty table gives no rows.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                ids, bounds = text_ids(known, *column_bytes(part.column(2)), end_id, by_unit)
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                of = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, total[of] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                own = [raw[4 * a:4 * (a + n)] for a, n in zip((bounds[of] + start).tolist(), length.tolist())]
                columns = [part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(map(zlib.crc32, own), pa.int64())]
                if with_ids:
                    columns.append(pa.array(map(bytes, own), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    return slim.mapInArrow(releasing(cut), PIECES + ", ids binary" * with_ids)


class Runs:
    """Runs of equal sequences: for each, how many there are and the (length, copies) that each holds."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.holds = capacity, [], []
        self.open: dict[int, list[int]] = defaultdict(list)  # runs by the room that their sequences have left

    def add(self, n: int, holds: tuple, room: int, fixed: bool = False) -> None:
        if n:
            self.count.append(n)
            self.holds.append(holds)
            if room and not fixed:
                self.open[room].append(len(self.count) - 1)

    def put(self, run: int, room: int, n: int, length: int, copies: int) -> None:
        """Give `copies` of the length to n sequences of the run, which is taken off the open ones."""
        rest, holds = self.count[run] - n, self.holds[run]
        self.count[run], self.holds[run] = n, (*holds, (length, copies))
        if left := room - copies * length:
            self.open[left].append(run)
        self.add(rest, holds, room)


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, tuple]], dict]:
    """Runs (first sequence, sequences, ((length, copies), ...)) for so many pieces of each length.

    Reduction, from the longest length j down, over the lengths that are left:
    - no other piece fits beside j: {j} dominates every set with j, so it is fixed;
    - a piece k with j + k = capacity exists: {j, k} dominates, as any other partners of j fit where k was;
    - no two further pieces fit beside j: {j, k} dominates for the longest k that fits.
    What the reduction leaves is packed best-fit decreasing, whole runs at a time. Also returns figures:
    the pieces and sequences that were fixed, all sequences, and the lower bound of tokens / capacity.
    """
    left = {k: n for k, n in counts.items() if n}
    if any(not 1 <= k <= capacity for k in left):
        raise ValueError("a piece must have between 1 and capacity tokens")
    runs = Runs(capacity)
    fixed = 0

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]

    by_size = sorted(left)
    for j in reversed(by_size):
        while n := left.get(j, 0):
            rest = capacity - j
            k = rest
            if rest in left and rest != j:
                m = min(n, left[rest])
            elif rest == j and n >= 2:
                m = n // 2
            else:
                two = []  # the two least others and the longest that fits
                for size in sorted(left):
                    two += [size] * min(2 - len(two), left[size] - (size == j))
                    if len(two) >= 2 or size > rest:
                        break
                k = max((s for s in left if s <= rest and (s != j or n > 1)), default=0)
                if not k:
                    runs.add(n, ((j, 1),), rest, fixed=True)
                    take(j, n)
                    fixed += n
                    continue
                if len(two) == 2 and sum(two) <= rest:
                    break  # three or more pieces may share a sequence: left to the best fit
                m = min(n, left[k]) if k != j else n // 2
            runs.add(m, ((j, 2),) if k == j else ((j, 1), (k, 1)), capacity - j - k, fixed=True)
            take(j, m)
            take(k, m)
            fixed += 2 * m
    fixed_runs = sum(runs.count)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r, own in runs.open.items() if own and r >= length), default=0)
            if not room:
                each = capacity // length
                full, last = divmod(n, each)
                runs.add(full, ((length, each),), capacity - each * length)
                runs.add(int(last > 0), ((length, last),), capacity - last * length)
                break
            run = runs.open[room].pop()
            each = min(room // length, n)
            m = min(runs.count[run], n // each)
            runs.put(run, room, m, length, each)
            n -= m * each
    out, first = [], 0
    for n, holds in zip(runs.count, runs.holds):
        out.append((first, n, holds))
        first += n
    tokens = sum(k * n for k, n in counts.items())
    return out, {"fixed_pieces": fixed, "fixed_sequences": fixed_runs, "sequences": first, "least": -(-tokens // capacity)}


def place_rows(runs: list[tuple[int, int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first sequence, offset) of every length in every run.

    The pieces of a length are dealt by rank to the runs in order. A run holds at most
    sqrt(2 * capacity) different lengths, and there are a few runs for each length, so the table has a
    bound that doesn't depend on the number of pieces.
    """
    used: dict[int, int] = defaultdict(int)
    out = []
    for first, n, holds in runs:
        offset = 0
        for length, copies in holds:
            out.append((length, used[length], used[length] + n * copies, copies, first, offset))
            used[length] += n * copies
            offset += length * copies
    return out


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds `sequence_id` and `offset` (gapless from 0 in a sequence) to rows with a `length`.

    `order` names columns that tell the pieces apart. The pieces are read twice, so pass a stored table.
    An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_packing(counts, capacity)
    places = spark.createDataFrame(place_rows(runs), "p_length long, p_from long, p_to long, p_copies long, p_first long, p_offset long")
    ranked = rank_within(pieces, ["length"], order, max(1, len(counts)), "p_rank")
    inside = (F.col("length") == F.col("p_length")) & (F.col("p_rank") >= F.col("p_from")) & (F.col("p_rank") < F.col("p_to"))
    at = F.col("p_rank") - F.col("p_from")
    return (ranked.join(F.broadcast(places), inside)
            .withColumn("sequence_id", F.col("p_first") + F.floor(at / F.col("p_copies")).cast("long"))
            .withColumn("offset", F.col("p_offset") + F.pmod(at, F.col("p_copies")) * F.col("length"))
            .drop("p_length", "p_from", "p_to", "p_copies", "p_first", "p_offset", "p_rank"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    The pieces are stored once (with their ids if `keep_ids`), then packed.
    """
    stored = stage(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids=keep_ids), "pieces")
    return pack(stored, capacity, ["row", "piece"]).drop("row")
