"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols start as characters.  A heap holds every adjacent pair that the vocabulary can join, by rank and then
by place; the lowest is popped, its two cells of a linked list become one, and the two new neighbours are pushed.  The
count is the initial symbols less the merges; no identifier is made.  A character without a piece of its own counts as
its UTF-8 bytes (byte fallback).

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of any length is counted whole; equal rows give
equal rows; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, whole_text

SPACE = "▁"
CACHE_WORDS = 400_000


@dataclass
class Pieces:
    """Ranks of the joinable pieces of a sentencepiece BPE model (lower joins first)."""

    rank: dict[str, float]
    cut: re.Pattern | None
    prefix: bool


def load_pieces(path: str) -> Pieces:
    """Reads a model; the rules that the merging relies on are checked here."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if train.model_type != 2 or not train.byte_fallback:
        raise ValueError("a BPE model with byte fallback is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("a model that keeps the text as it is is needed")
    if any(p.type in (4, 5) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    rank = {p.piece: -p.score for p in proto.pieces if p.type == 1}
    # a text may be cut where no piece can reach across: before a space sign, and around a line end
    crossing = any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in rank)
    cut = None if crossing else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
    return Pieces(rank, cut, norm.add_dummy_prefix)


def count_merges(word: str, rank: dict[str, float]) -> int:
    """Tokens of one stretch of text."""
    sym: list[str | None] = list(word)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := word[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, piece = heapq.heappop(heap)
        j = after[i] if sym[i] is not None else n
        if j >= n or sym[i] + sym[j] != piece:
            continue  # one of the two has been merged since
        sym[i], sym[j] = piece, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(p := piece + sym[k])) is not None:
                heapq.heappush(heap, (r, i, p))
        h = before[i]
        if h >= 0 and (r := rank.get(p := sym[h] + piece)) is not None:
            heapq.heappush(heap, (r, h, p))
    fallback = sum(len(s.encode()) - 1 for s in sym if s is not None and len(s) == 1 and s not in rank)
    return n - merges + fallback


class Counter(dict):
    """Token counts by stretch, bounded."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = count_merges(word, self.pieces.rank)
        if len(word) <= 64:
            self[word] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        text = (SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE)
        words = self.pieces.cut.findall(text) if self.pieces.cut else [text]
        return sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, col: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.  ``model_path`` must be readable on the executors."""

    def per_text():
        counter = Counter(load_pieces(model_path))
        return lambda texts: {"n_tokens": [counter.of(t) for t in texts]}

    return map_texts(docs, per_text, "n_tokens long", col).withColumns({
        "n_bytes": F.octet_length(whole_text(col)).cast("long"),
        "over_limit": F.col("n_tokens") > limit,
    })
