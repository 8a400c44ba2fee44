"""BPE encoding by forced-boundary splitting, and decoding.

A merge joins two neighbouring symbols into a token of the vocabulary. So if the byte pair (a, b) stands
inside no token, no merge ever reaches over a place where a is followed by b: that place is a certain cut,
whatever surrounds it. Texts are cut there, the fragments are encoded independently of each other, and
their ids are concatenated. Fragments are short and repeat, so a worker keeps the ids of those it has met.

A vocabulary with an end-of-word suffix marks the last symbol of a word. A fragment before a cut inside a
word therefore takes the plain symbols, one that ends a word takes the suffix.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.words import LOWER, byte_set, chunks, column_bytes

#: Fragments that are looked up at once, and the bytes of ids and keys that a worker remembers.
RUN, REMEMBER = 100_000, 128 << 20

# --- fixed values: what the normaliser and the splitter of a lower-casing word vocabulary say in its file ---
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# ------------------------------------------------------------------------------------------------------------

_SPACE = byte_set((0x09, 0x0D), (0x20, 0x20))
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_DIGIT = byte_set((0x30, 0x39))
_HIGH = byte_set((0x80, 0xFF))
_SYMBOL = ~(_SPACE | _LETTER | _DIGIT | _HIGH)
_QUOTE = 0x27
#: First byte of the keys of fragments before a cut inside a word, and of added tokens: no UTF-8 text holds them.
_INNER, _ADDED = b"\xff", b"\xfe"
#: Words that normalising only lower-cases: Latin letters that no mark follows.
_PLAIN_WORD = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch


def byte_of_symbol() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 characters stand for themselves, the others for 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def inner_pairs(tokens: list[str], suffix: str) -> np.ndarray:
    """A 256 x 256 table: whether byte a is followed by byte b inside some token."""
    table = np.zeros((256, 256), bool)
    alphabet = byte_of_symbol()
    for token in tokens:
        found = [alphabet.get(c, -1) for c in token.removesuffix(suffix)]
        for a, b in zip(found, found[1:]):
            if a >= 0 and b >= 0:
                table[a, b] = True
    return table


class Codec:
    """One vocabulary on one worker: its table of certain cuts, its models, and the fragments met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer, models
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("needs a byte-level BPE vocabulary without unknown tokens")
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.whole = Tokenizer.from_file(path)
        ending = {"end_of_word_suffix": self.suffix} if self.suffix else {}
        self.models = {True: Tokenizer(models.BPE(model["vocab"], merges, **ending)), False: Tokenizer(models.BPE(model["vocab"], merges))}
        self.pairs = inner_pairs(list(model["vocab"]), self.suffix)
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be matched literally")
        splitter = spec["pre_tokenizer"] or {}
        self.by_bytes = ((spec["normalizer"] or {}).get("normalizers") == WORD_NORMALIZER
                         and [p.get("pattern", {}).get("Regex") for p in splitter.get("pretokenizers", [])][:1] == [WORD_SPLIT])
        alphabet = byte_of_symbol()
        self.symbol = {b: c for c, b in alphabet.items()}
        self.joined = {(self.symbol[a], self.symbol[b]) for a, b in np.argwhere(self.pairs).tolist()}
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.forget()

    def forget(self) -> None:
        self.known = {_ADDED + k: int(v).to_bytes(4, "little") for k, v in self.added.items()}
        self.held = 0

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(starts, ends, kind, bytes) of the fragments; kind 0 ends a word, 1 ends inside one, 2 is an added token.

        On raw bytes a cut is taken between two ASCII bytes that no token holds in this order, and at white
        space. None is taken next to a byte of another character, which normalising may change, nor where
        an apostrophe may start a contraction: such fragments are cut further once they are normalised.
        """
        raw = data.tobytes()
        low = LOWER[data]
        n = len(data)
        cut, inside = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        a, b = low[:-1], low[1:]
        if self.by_bytes:
            space = _SPACE[low]
            cut[1:n] = ~self.pairs[a, b] & ~_HIGH[a] & ~_HIGH[b]
            quote = np.flatnonzero(low == _QUOTE)
            for k in (1, 2, 3):
                at = quote + k
                cut[at[at < n]] = False
            before = quote[quote > 0]
            cut[before[_SYMBOL[low[before - 1]]]] = False
            cut[1:n] |= space[:-1] | space[1:]
            inside[1:n] = _LETTER[a] & _LETTER[b] | _SYMBOL[a] & _SYMBOL[b]
        cut[offsets] = True
        inside[offsets] = False
        special = {}
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                end = at + len(token)
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end, "left"):  # in one text
                    special[at] = token
                    cut[at + 1:end] = False
                    cut[[at, end]] = True
                    inside[[at, end]] = False
                at = raw.find(token, end)
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        kind = inside[ends].astype(np.int8)
        if special:
            kind[np.searchsorted(starts, np.fromiter(special, np.int64, len(special)))] = 2
        if self.by_bytes:
            word = ~_SPACE[low[starts]]
            starts, ends, kind = starts[word], ends[word], kind[word]
        return starts, ends, kind, raw

    def pieces(self, word: str, final: bool) -> list[tuple[bool, str]]:
        """A word in the byte-level alphabet, cut at its certain places; the last piece ends the word if `final`."""
        marks = [k for k, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joined]
        edges = [0, *marks, len(word)]
        return [(final and b == len(word), word[a:b]) for a, b in zip(edges, edges[1:])]

    def learn(self, keys: list[bytes]) -> None:
        """Encode new fragments: normalise, split into words, cut the words, and join the ids of the pieces."""
        single: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # by whether they end a word: words that are one piece
        plans, wanted = [], ({}, {})
        for key in keys:
            inner = key[:1] == _INNER
            raw = key[1:] if inner else key
            if self.by_bytes and raw.isalpha():  # ASCII letters, cut already
                single[not inner][raw.decode()] = key
                continue
            text = raw.decode("utf-8", "replace")
            if self.by_bytes and _PLAIN_WORD(text):
                words = [text.lower().encode().decode("latin-1").translate(self.symbol)]
            else:
                if self.whole.normalizer:
                    text = self.whole.normalizer.normalize_str(text)
                words = [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)] if self.whole.pre_tokenizer else [text]
            plan = [x for i, word in enumerate(words) for x in self.pieces(word, not (inner and i == len(words) - 1))]
            plans.append((key, plan))
            for final, piece in plan:
                wanted[final][piece] = b""
        for final in (False, True):
            pieces = [*single[final], *(p for p in wanted[final] if p not in single[final])]
            got = self.models[final].encode_batch_fast(pieces, add_special_tokens=False)
            found = {p: array("I", g.ids).tobytes() for p, g in zip(pieces, got)}
            for piece in wanted[final]:
                wanted[final][piece] = found[piece]
            self.known.update((key, found[piece]) for piece, key in single[final].items())
        for key, plan in plans:
            self.known[key] = b"".join([wanted[final][piece] for final, piece in plan])
        self.held += sum(map(len, keys)) + 250 * len(keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in range(len(offsets) - 1)]
        if not len(data):
            return [b""] * len(out)
        starts, ends, kind, raw = self.cuts(data, offsets)
        rows = np.searchsorted(offsets, starts, "right") - 1
        low = LOWER[data].tobytes() if self.by_bytes else raw
        for at in range(0, len(starts), RUN):
            part = slice(at, at + RUN)
            keys = [low[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())]
            for i in np.flatnonzero(kind[part]).tolist():
                a = int(starts[at + i])
                keys[i] = _INNER + keys[i] if kind[at + i] == 1 else _ADDED + raw[a:int(ends[at + i])]
            ids = list(map(self.known.get, keys))
            if None in ids:
                if self.held > REMEMBER:
                    self.forget()
                self.learn([k for k in dict.fromkeys(keys) if k not in self.known])
                ids = list(map(self.known.get, keys))
            own = rows[part]
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:]):
                out[own[a]].append(b"".join(ids[a:b]))
        return [b"".join(x) for x in out]


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


_TOKENS: dict[str, tuple] = {}


def tokens_of(vocabulary: str) -> tuple:
    """The tokens by id, and the library's decoding where the vocabulary has a decoder of its own."""
    if vocabulary not in _TOKENS:
        from tokenizers import Tokenizer
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        token = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        _TOKENS[vocabulary] = token, Tokenizer.from_file(vocabulary).decode if spec["decoder"] else None
    return _TOKENS[vocabulary]


def decode_ids(vocabulary: str, ids: bytes) -> str:
    """The text that the library makes of little-endian unsigned 32-bit ids, special tokens included."""
    token, decode = tokens_of(vocabulary)
    found = np.frombuffer(ids, "<u4").tolist()
    return decode(found, skip_special_tokens=False) if decode else " ".join([token[i] for i in found if i in token])


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids) for each row of `docs`: `ids` holds little-endian unsigned 32-bit token ids.

    With `decoded` also the text that the ids give, made in the same task. The ids equal those of the tokenizers library on
    the whole text without special tokens being added. `vocabulary` is a tokenizers file with a byte-level BPE model that
    every executor can open. Null and empty texts, and texts
    of white space that the vocabulary drops, have no ids; an added token that a text spells gets its id. Texts of
    any length are encoded whole. Null ids and repeated rows stay as they are; other columns aren't read, and an
    empty table gives no rows.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                ids = known.encode(*column_bytes(part.column(1)))
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([decode_ids(vocabulary, x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][:len(columns)])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds `decoded`, the text that the tokenizers library makes of `ids`, special tokens included.

    A vocabulary without a decoder gives its tokens with a space between them; ids without a token are left
    out, as in the library. A null or empty `ids` gives an empty text. A column named `decoded` is replaced.
    """
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    ids_at = [c.lower() for c in kept].index("ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [decode_ids(vocabulary, x.as_py()) if x.is_valid else "" for x in part.column(ids_at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    slim = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return slim.mapInArrow(scan, f"{schema}, decoded string")
