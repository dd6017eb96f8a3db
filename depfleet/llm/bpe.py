"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into words by the tokenizer's pattern.  The distinct words of a stretch of a partition lie in one flat
array of symbols, linked within each word.  An index maps each mergeable pair to all its positions; ranks that occur are
taken in ascending order, every position of that pair is merged from left to right, and the lists of the neighbouring
pairs are updated.  As a pair's result has a rank of its own above its parts (checked on loading), the order over all
words at once gives each word what it would give alone.

Identifiers are stored packed, as little-endian unsigned 32-bit integers.  Defined results: a null or empty text has no
identifiers and decodes to the empty text; null identifiers decode to null; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import map_texts

CACHE_WORDS = 250_000
CHUNK_SYMBOLS = 400_000
CHUNK_CHARS = 2_000_000

# fixed value: how the byte-level pre-tokenizer cuts text
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    byte_id: np.ndarray                     # identifier of each single byte
    span: int                               # a pair (a, b) has the number a * span + b, which no ended word's pair has
    merges: dict[int, int]                  # number of a pair -> rank
    numbers: np.ndarray                     # numbers of pairs in order, and their ranks
    ranks: np.ndarray
    result: list[int]                       # rank -> identifier made
    pairs: list[tuple[int, int]]            # rank -> pair
    special: dict[str, int]
    id_bytes: dict[int, bytes]


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
        raise ValueError("a byte-level BPE without prefix space or normalizer is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens must be plain strings")
    signs, vocab = byte_signs(), model["vocab"]
    parts = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    pairs = [(vocab[a], vocab[b]) for a, b in parts]
    result = [vocab[a + b] for a, b in parts]
    made = {r: k for k, r in enumerate(result)}
    if len(made) < len(result) or any(made.get(x, -1) >= k for k, p in enumerate(pairs) for x in p):
        raise ValueError("each merge must make a new piece from earlier ones")
    by_byte = np.zeros(256, np.int64)
    for sign, b in signs.items():
        by_byte[b] = vocab[sign]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    id_bytes = {i: bytes(signs[c] for c in piece) for piece, i in vocab.items() if piece not in special}
    id_bytes |= {i: s.encode() for s, i in special.items()}
    span = max(id_bytes) + 3
    merges = {a * span + b: k for k, (a, b) in enumerate(pairs)}
    numbers = np.array(sorted(merges), np.int64)
    return Vocabulary(by_byte, span, merges, numbers, np.array([merges[n] for n in numbers.tolist()], np.int64), result, pairs, special, id_bytes)


def encode_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """Packed identifiers of each word, all words merged together through one pair occurrence index."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes + 1) - 1
    flat = v.byte_id[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    flat[ends] = -1  # ends a word
    # the index: every mergeable pair's rank with all its positions
    number = flat[:-1] * v.span + flat[1:]
    number[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
    place = np.minimum(np.searchsorted(v.numbers, number), len(v.numbers) - 1)
    found = np.flatnonzero(v.numbers[place] == number)
    order = np.argsort(v.ranks[place[found]], kind="stable")
    found, rank_at = found[order], v.ranks[place[found]][order]
    active, first = np.unique(rank_at, return_index=True)
    stops = [*first.tolist()[1:], len(found)]
    found, active = found.tolist(), active.tolist()
    where = {r: found[a:b] for r, a, b in zip(active, first.tolist(), stops)}
    n, span, rank_of, pairs, result = len(flat), v.span, v.merges.get, v.pairs, v.result
    sym = flat.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heappop, heappush = heapq.heappop, heapq.heappush
    while active:
        rank = heappop(active)
        a, b = pairs[rank]
        new = result[rank]
        for i in sorted(where.pop(rank)):
            if sym[i] != a:
                continue
            j = after[i]
            if sym[j] != b:
                continue
            k = after[j]
            sym[i], sym[j] = new, -2
            after[i] = k
            before[k] = i
            if (r := rank_of(new * span + sym[k])) is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
                    heappush(active, r)
            h = before[i]
            if h >= 0 and (r := rank_of(sym[h] * span + new)) is not None:
                if r in where:
                    where[r].append(h)
                else:
                    where[r] = [h]
                    heappush(active, r)
    # a merge keeps its left place, so what is left of a word stands in order
    done = np.array(sym, np.int64)
    packed = done[done >= 0].astype("<u4").tobytes()
    stop = 4 * np.cumsum(done >= 0)[ends]
    return [packed[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]


class Encoder:
    """Encodes texts of one task; identifiers of short words are kept, up to a bound."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.special = {w: struct.pack("<I", i) for w, i in v.special.items()}
        self.known: dict[str, bytes] = dict(self.special)
        self.cut = regex.compile(WORDS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def words(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.v.special):
            return self.cut.findall(text)
        return list(chain.from_iterable([p] if p in self.v.special else self.cut.findall(p) for p in self.split.split(text) if p))

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known.update(self.special)
        new = set(chain.from_iterable(cut)).difference(known)
        held, size = [], 0
        for w in chain(new, [None]):
            if w is None or size > CHUNK_SYMBOLS:
                known.update(zip(held, encode_words(held, self.v) if held else [], strict=True))
                held, size = [], 0
            if w is not None:
                held.append(w)
                size += len(w)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > 64:
                del known[w]
        return out


def encode(docs: DataFrame, path: str, col: str = "text") -> DataFrame:
    """Adds ``ids`` (packed) and ``n_tokens``.  ``path`` must be readable on the executors."""

    def per_text():
        encoder = Encoder(load_vocabulary(path))
        return lambda texts: {"ids": encoder(texts)}

    return map_texts(docs, per_text, "ids binary", col, CHUNK_CHARS).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def round_trip(docs: DataFrame, path: str, col: str = "text") -> DataFrame:
    """Adds ``ids`` (packed), ``n_tokens`` and ``decoded``, what the identifiers alone give back, in one pass."""

    def per_text():
        encoder, pieces = Encoder(load_vocabulary(path)), _decoder(path)

        def work(texts: list[str]) -> dict:
            ids = encoder(texts)
            return {"ids": ids, "decoded": decode_packed(pa.array(ids, pa.binary()), pieces)}
        return work

    return map_texts(docs, per_text, "ids binary, decoded string", col, CHUNK_CHARS).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(ids, path: str):
    """Column of the texts that packed identifiers stand for; bytes that are not UTF-8 become replacement signs."""

    @F.arrow_udf(StringType())
    def texts(packed: pa.Array) -> pa.Array:
        return decode_packed(packed, _decoder(path))

    return texts(ids)


def decode_packed(packed: pa.Array, pieces: pa.Array, chunk: int = 2_000_000) -> pa.Array:
    """Texts of packed identifiers: the pieces of a stretch of identifiers are taken from their table at once."""
    held = packed.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1] // 4
    every = np.frombuffer(held.buffers()[2], "<u4", int(offsets[-1])) if offsets[-1] else np.zeros(0, "<u4")
    empty = packed.is_null().to_numpy(zero_copy_only=False)
    out: list[str | None] = []
    at = 0
    while at < len(held):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        ids = every[offsets[at]:offsets[stop]]
        if len(ids) and ids.max() >= len(pieces):
            raise ValueError("an identifier is not in the vocabulary")
        taken = pieces.take(pa.array(ids))
        if taken.null_count:
            raise ValueError("an identifier is not in the vocabulary")
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1] if len(ids) else np.zeros(1, np.int64)
        text = memoryview(taken.buffers()[2] or b"")
        marks = ends[offsets[at:stop + 1] - offsets[at]].tolist()
        out += [None if empty[at + k] else str(text[a:b], "utf-8", "replace") for k, (a, b) in enumerate(zip(marks, marks[1:]))]
        at = stop
    return pa.array(out, pa.string())


_tables: dict[str, pa.Array] = {}


def _decoder(path: str) -> pa.Array:
    """Bytes of each identifier by its number, null where there is none."""
    if path not in _tables:
        table = load_vocabulary(path).id_bytes
        _tables[path] = pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary())
    return _tables[path]
