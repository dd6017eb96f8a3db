"""Benchmark decontamination by latent semantic retrieval.

Items and documents are cut into passages of WIDTH words.  Passage vectors are TF-IDF over the terms of the benchmark, with
document frequencies counted over all documents.  A distributed randomised SVD of all item passages gives the latent space; of
the documents it needs the frequencies alone, so nothing is sampled.  In every document, the passages around which the text has the words and IDF mass
that a leak must have are projected, and item passages by cosine in that space become candidates.  Each place of a candidate
is tried, the most alike first; it is a leak if the longest common
subsequence of the item with the text around it covers ``copy`` of the item, or ``paraphrase`` of it and the item's answer
(its last sentence) stands there too.

The vocabulary, space and item passages of one block of BLOCK_ITEMS items are broadcast; larger benchmarks go block by block
against all documents.  Defined results: null and empty texts or items match nothing; items without MIN_WORDS words must
occur as they are, word for word; equal rows give equal rows; empty tables give an empty result; whole texts are searched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depfleet.staging import passing, stage

from .common import by_chunks, tidy, without_ids

WIDTH, STRIDE, ITEM_STRIDE = 16, 4, 4
BLOCK_ITEMS = 4096        # items searched at once
RANK, OVERSAMPLE = 128, 16
CELLS = 1 << 22           # cosines of document and item passages at once: 16 MB
FLOOR = 1e-5              # least share of the largest squared singular value
COSINE = 0.6
COPY, PARAPHRASE, ANSWER = 0.75, 0.55, 0.6
RARE = 0.8                # times the share of an item's words in place: the share of its squared IDF mass that must be there
MIN_WORDS = 8
EDGES = b".,;:!?\"'()[]{}<>*#$%&-_|/\\~"


def terms_of(text: str) -> list[bytes]:
    """Words in lower case, without punctuation at their edges."""
    return [w.strip(EDGES) for w in text.lower().encode().split()]


def answer_of(text: str) -> list[bytes]:
    """Terms of an item's last sentence."""
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if p.strip()]
    return [t for t in terms_of(parts[-1]) if t] if parts else []


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := places.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Index:
    """What a worker needs for one block of items."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray            # the last entry is for terms outside
    space: np.ndarray          # terms x rank
    passages: np.ndarray       # unit vectors of item passages, rank
    owner: np.ndarray          # item of each passage
    items: list[tuple[int, list[bytes], list[bytes]]]  # id, terms, answer


def windows(n: int, stride: int) -> np.ndarray:
    """Starts of the passages of n words; the last reaches the end."""
    if n <= WIDTH:
        return np.zeros(1 if n else 0, np.int64)
    starts = np.arange(0, n - WIDTH + 1, stride)
    return starts if starts[-1] == n - WIDTH else np.append(starts, n - WIDTH)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term; counted in each task, summed by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, n = vocabulary.keys(), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                counts.update({t.strip(EDGES) for t in set((text or "").lower().encode().split())} & known)
        rows = [(-1, n), *((vocabulary[t], c) for t, c in counts.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    sums = docs.select("text").mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per term
    out = np.zeros(len(vocabulary))
    for term, n in sums:
        if term >= 0:
            out[term] = n
    return next((n for term, n in sums if term == -1), 0), out


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' TF-IDF matrix.

    ``passages`` holds packed term numbers.  The matrix stays distributed by rows; each step adds up one small product
    over its parts: a sketch, one power step, and the final projection.
    """
    n = len(idf)
    width = min(rank + OVERSAMPLE, n)

    def product(right: np.ndarray) -> np.ndarray:
        """A' (A right), summed over the parts."""
        shared = passages.sparkSession.sparkContext.broadcast(right.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(right_shape, np.float32)
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    terms, times = np.unique(np.frombuffer(packed, np.int32), return_counts=True)
                    if len(terms):
                        x = (times * idf[terms]).astype(np.float32)
                        x /= np.sqrt((x * x).sum()) or 1.0
                        total[terms] += np.outer(x, x @ shared.value[terms])
            used = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([total[k].tobytes() for k in used], pa.binary())], names=["term", "row"])

        right_shape = right.shape

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: dict[int, np.ndarray] = {}
            for batch in batches:
                for term, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    row = np.frombuffer(row, np.float32)
                    rows[term] = rows[term] + row if term in rows else row
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], names=["term", "row"])

        out = np.zeros(right.shape)
        summed = passages.mapInArrow(tidy(run), "term int, row binary").repartition(8, "term").mapInArrow(tidy(add), "term int, row binary")
        for term, row in summed.collect():  # terms x width
            out[term] = np.frombuffer(bytes(row), np.float32)
        return out

    sketch = np.linalg.qr(product(np.random.default_rng(5).normal(size=(n, width))))[0]
    sketch = np.linalg.qr(product(sketch))[0]
    small = sketch.T @ product(sketch)  # the matrix's square in the sketched space
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > FLOOR * values.max(initial=0.0)]  # the passages may span fewer directions; others are noise
    return (sketch @ vectors[:, order]).astype(np.float32)


def build_index(docs: DataFrame, items: list[tuple[int, str]]) -> Index:
    """Vocabulary, frequencies, space and item passages of one block of items."""
    held = [(i, [t for t in terms_of(text) if t], answer_of(text)) for i, text in items if text]
    held = [x for x in held if x[1]]
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms, _ in held for t in terms}))}
    n_docs, df = document_frequencies(docs, vocabulary)
    idf = np.append(np.log((n_docs + 1) / (df + 1)) + 1, np.log(n_docs + 1) + 1).astype(np.float32)

    codes = [np.array([vocabulary[t] for t in terms], np.int32) for _, terms, _ in held]
    spans = [(k, c[s : s + WIDTH]) for k, c in enumerate(codes) for s in windows(len(c), ITEM_STRIDE)]

    own = docs.sparkSession.createDataFrame([(c.tobytes(),) for _, c in spans], "terms binary")
    space = randomised_svd(stage(own).df.repartition(4), idf[:-1], min(RANK, len(vocabulary)))
    vectors = np.zeros((len(spans), space.shape[1]), np.float32)
    for row, (_, c) in enumerate(spans):
        vectors[row] = (idf[c][:, None] * space[c]).sum(0)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Index(vocabulary, idf, space, vectors, np.array([k for k, _ in spans], np.int64), held)


class Search:
    """Finds the items that texts hold."""

    def __init__(self, index: Index):
        self.x = index
        self.outside = len(index.vocabulary)
        self.code: dict[bytes, int] = {}
        self.mass = (index.idf.astype(np.float64)) ** 2
        self.projected = np.vstack([index.idf[:-1, None] * index.space, np.zeros((1, index.space.shape[1]), np.float32)])
        self.own = [np.array(sorted({index.vocabulary[t] for t in terms}), np.int64) for _, terms, _ in index.items]
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in self.own])])[:-1]
        self.all_own = np.concatenate(self.own)
        self.size = np.array([len(terms) for _, terms, _ in index.items], np.int64)
        # the mass that ``confirm`` asks of an item at least, with room for rounding; items that have no passages ask too much
        self.need = np.where(self.size < MIN_WORDS, np.inf, np.add.reduceat(self.mass[self.all_own], self.ends) * PARAPHRASE * RARE * 0.999)
        self.least = [(int(n), self.need[self.size == n].min()) for n in np.unique(self.size) if n >= MIN_WORDS]
        self.exact = [k for k, (_, terms, _) in enumerate(index.items) if len(terms) < MIN_WORDS]

    def code_of(self, word: bytes) -> int:
        c = self.code.get(word)
        if c is None:
            bare = word.strip(EDGES)
            c = self.x.vocabulary.get(bare, self.outside) if bare else -1
            if len(self.code) > 500_000:
                self.code.clear()
            if len(word) <= 64:
                self.code[word] = c
        return c

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        get, known = self.code_of, self.code
        out: list[list[dict]] = [[] for _ in texts]
        codes = []
        for text in texts:
            words = text.lower().encode().split()
            c = np.fromiter((known[w] if w in known else get(w) for w in words), np.int32, len(words))
            codes.append(c[c >= 0])
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([*codes, np.zeros(0, np.int32)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        known_mass = np.append(self.mass[:-1], 0.0)
        inside = np.concatenate([[0], np.cumsum(flat < self.outside)])
        weight = np.concatenate([[0.0], np.cumsum(known_mass[flat])])

        def may_hold(at: np.ndarray, doc: np.ndarray, size, need) -> np.ndarray:
            """Whether the text around a place has the number and mass of benchmark terms that ``confirm`` asks of an item."""
            lo, hi = np.maximum(at - size, bounds[doc]), np.minimum(at + WIDTH + size, bounds[doc + 1])
            return (inside[hi] - inside[lo] >= PARAPHRASE * size) & (weight[hi] - weight[lo] >= need)

        # items of whose terms a text, anywhere, has the mass that ``confirm`` asks
        open_items: dict[int, np.ndarray] = {}
        there = np.zeros(self.outside + 1, bool)
        for d in np.flatnonzero(weight[bounds[1:]] - weight[bounds[:-1]] >= self.need.min(initial=np.inf)).tolist():
            there[codes[d]] = True
            held = np.add.reduceat(np.where(there[self.all_own], self.mass[self.all_own], 0.0), self.ends) >= self.need
            there[codes[d]] = False
            if held.any():
                open_items[d] = held
        # all passages of these texts: starts by stride, and one that reaches the end
        starts = [windows(n, STRIDE) + b for d, (n, b) in enumerate(zip(sizes.tolist(), bounds[:-1].tolist(), strict=True)) if d in open_items]
        at = np.concatenate([*starts, np.zeros(0, np.int64)])
        doc = np.repeat(np.array(sorted(open_items), np.int64), [len(s) for s in starts])
        end = np.minimum(at + WIDTH, bounds[doc + 1])
        some = np.zeros(len(at), bool)
        for size, need in self.least:
            some |= may_hold(at, doc, size, need)
        some &= inside[end] > inside[at]  # without a term of the benchmark a passage has no vector
        at, end, doc = at[some], end[some], doc[some]
        hits: list[tuple[np.ndarray, ...]] = []
        step = max(1, CELLS // max(len(self.x.passages), 1))
        for lo in range(0, len(at), step):
            a, e, d = at[lo : lo + step], end[lo : lo + step], doc[lo : lo + step]
            places = a[:, None] + np.arange(WIDTH)
            terms = np.where(places < e[:, None], flat[np.minimum(places, len(flat) - 1)], self.outside)
            vectors = np.zeros((len(a), self.projected.shape[1]), np.float32)
            for k in range(WIDTH):
                vectors += self.projected[terms[:, k]]
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            cosine = vectors @ self.x.passages.T
            r, c = np.nonzero(cosine >= COSINE)
            if not len(r):
                continue
            k = self.x.owner[c]
            fit = may_hold(a[r], d[r], self.size[k], self.need[k])
            turns = np.flatnonzero(np.diff(d[r], prepend=-1)).tolist()  # rows come by text
            for x, y in zip(turns, [*turns[1:], len(r)], strict=True):
                fit[x:y] &= open_items[int(d[r[x]])][k[x:y]]
            hits.append((d[r[fit]], k[fit], -cosine[r[fit], c[fit]], a[r[fit]]))
        # every place of a document and item, the most alike first, until one holds the item
        d, k, far, place = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((place, far, k, d))
        done, last = None, None
        for d, k, far, place in zip(*(x[order].tolist() for x in (d, k, far, place)), strict=True):
            if (d, k) != done and (d, k, far, place) != last:
                last = (d, k, far, place)
                found = self.confirm(codes[d], place - int(bounds[d]), k)
                if found:
                    out[d].append({"item": self.x.items[k][0], "cosine": -far, **found})
                    done = (d, k)
        for k in self.exact:  # too short for passages: word for word
            wanted = np.array([self.x.vocabulary[t] for t in self.x.items[k][1]], np.int32)
            for d, c in enumerate(codes):
                if len(c) >= len(wanted) and not any(h["item"] == self.x.items[k][0] for h in out[d]):
                    first = np.flatnonzero(c[: len(c) - len(wanted) + 1] == wanted[0])
                    for s in first.tolist():
                        if np.array_equal(c[s : s + len(wanted)], wanted):
                            out[d].append({"item": self.x.items[k][0], "cosine": 1.0, "start": s, "end": s + len(wanted), "overlap": 1.0, "answer": True})
                            break
        return out

    def confirm(self, codes: np.ndarray, place: int, k: int) -> dict | None:
        """Whether the text around a candidate holds the item, in its order or with its answer."""
        _, terms, answer = self.x.items[k]
        if len(terms) < MIN_WORDS:
            return None
        item = [self.x.vocabulary[t] for t in terms]
        lo, hi = max(0, place - len(item)), min(len(codes), place + WIDTH + len(item))
        region = codes[lo:hi].tolist()
        there, own = set(region), set(item)
        # words in place are not enough between them: rare words must be among them, not only common ones
        full, held = sum(self.mass[c] for c in own), sum(self.mass[c] for c in own & there)
        if held < PARAPHRASE * RARE * full or sum(c in own for c in region) < PARAPHRASE * len(item):
            return None
        share = common_length(item, region) / len(item)
        if share < PARAPHRASE or held < share * RARE * full:
            return None
        named = [self.x.vocabulary[t] for t in answer if t in self.x.vocabulary]
        mass = sum(self.mass[c] for c in named)
        answered = bool(named) and sum(self.mass[c] for c in named if c in there) >= ANSWER * mass
        if share >= COPY or answered:
            return {"start": lo, "end": hi, "overlap": share, "answer": answered}
        return None


def blocks_of(items: DataFrame, key: str, col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks, by their key."""
    rows = items.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).cast("long"), col).distinct().sort(key, col)
    held: list[tuple[int, str]] = []
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == BLOCK_ITEMS:
            yield held
            held = []
    if held:
        yield held


FIELDS = "array<struct<item:long,cosine:double,start:int,end:int,overlap:double,answer:boolean>>"


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "item_id", col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, start, end, overlap, answer) for every item found in a row of (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    out = None
    for block in blocks_of(items, key, col):
        index = build_index(docs, block)
        if not index.items:
            continue
        shared = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(Index(**shared.value))
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("start", pa.int32()), ("end", pa.int32()),
                                ("overlap", pa.float64()), ("answer", pa.bool_())])
            for batch in batches:
                ids, at = batch.column(0).to_pylist(), 0
                for chunk in by_chunks((t or "" for t in batch.column(1).to_pylist()), 2_000_000):
                    rows = [{"doc_id": ids[at + k], "item_id": h["item"], **{f: h[f] for f in ("cosine", "start", "end", "overlap", "answer")}}
                            for k, found in enumerate(search(chunk)) for h in found]
                    at += len(chunk)
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            tidy(run), "doc_id long, item_id long, cosine double, start int, end int, overlap double, answer boolean")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, cosine double, start int, end int, overlap double, answer boolean")
    return out


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows that hold no item; rows without a key stay, as nothing names them."""
    with passing() as keep:
        leaks = keep(stage(find_leaks(docs, items).where("doc_id IS NOT NULL").select("doc_id").distinct()))
    return without_ids(docs, leaks.df, leaks.rows)
