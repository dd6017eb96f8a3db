"""Ranked lexical search: exact top-k of every query by hybrid TAAT and DAAT.

Documents are turned once into (id, length, terms with frequency) for the terms of the queries; document frequencies,
the number of documents and their total length come from all of them.  Each task then inverts its documents in bounded
chunks and ranks every query against a chunk:

* term at a time: postings of the short lists are summed into one sorted list of accumulators;
* document at a time: the accumulators are one more iterator, bounded by their largest sum, next to the long lists.  With
  iterators in order of their bounds, those whose bounds together stay below the query's k-th best score so far
  cannot bring in a document: candidates come from the others only, window by window, and are looked up in the rest by
  binary search, from the largest bound down, as long as they can still reach that score.

A task keeps k documents a query; the best of all tasks are merged by (query, part) and then by query.  Scores are
integers, so sums have no order.  Queries go in blocks of bounded vocabulary; each block passes over all documents.

Defined results: a null or empty text has no terms and is never found, nor counted among the documents; a null or empty query
finds nothing; each row of the queries is a query of its own, with its item_id, be that null or repeated; rows of documents
are documents of their own; equal scores are ordered by doc_id, null last; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depfleet.staging import stage, union_all

from .common import by_chunks

# fixed values of the score
SCALE, PIVOT, SLOPE, BOOST = 1_000_000_000, 100, 50, 20

TOP = 50
BLOCK_TERMS = 100_000      # terms of the queries that one pass holds, with repeats between queries
CHUNK_POSTINGS = 2_000_000  # postings that a task inverts at once
SHORT_SHARE = 0.05         # a list is short that holds at most this share of a chunk's documents
WINDOW = 1024              # candidates looked up at once
PARTS = 32                 # parts of the first merge of a query

# every byte that is no letter, digit or part of a longer character is a gap; A-Z lower-cased
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Queries:
    """One block: item ids by query number, the distinct terms, and each query's distinct terms by number."""

    items: list
    terms: dict[bytes, int]
    asked: list[list[int]]


def query_blocks(queries: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[Queries]:
    """Queries in blocks of about so many terms, read one partition at a time."""
    block, size = Queries([], {}, []), 0
    for row in queries.select(F.col("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        mine = sorted(set(terms_of(row.text)))
        if size and size + len(mine) > block_terms:
            yield block
            block, size = Queries([], {}, []), 0
        block.items.append(row.item_id)
        block.asked.append([block.terms.setdefault(t, len(block.terms)) for t in mine])
        size += len(mine)
    if size:
        yield block


POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"


def postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with at least one term; ``terms`` only those that queries have."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import numpy as np

        known = held.value
        for batch in batches:
            ids, at = batch.column(0), 0
            for chunk in by_chunks([t or "" for t in batch.column(1).to_pylist()]):
                rows, lengths, counts, found, tfs = [], [], [], [], []
                for i, text in enumerate(chunk):
                    words = terms_of(text)
                    if not words:
                        continue
                    tf = Counter(words)
                    mine = [(known[w], c) for w, c in tf.items() if w in known]
                    rows.append(at + i)
                    lengths.append(len(words))
                    counts.append(len(mine))
                    found += [m[0] for m in mine]
                    tfs += [m[1] for m in mine]
                at += len(chunk)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.array(counts, np.int64)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


class TopK:
    """The best (score, document order) so far, ties by smaller order."""

    def __init__(self, k: int):
        import numpy as np

        self.k, self.scores, self.keys = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self) -> int:
        """A document below this score cannot enter; at it, one with a smaller key can."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores, keys) -> None:
        import numpy as np

        scores, keys = np.concatenate((self.scores, scores)), np.concatenate((self.keys, keys))
        best = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys = scores[best], keys[best]


def rank_chunk(lists: list, order, top: TopK, n_docs: int) -> None:
    """Adds a chunk's best documents of one query to ``top``.

    ``lists``: sorted document places with their scores, one pair for each term of the query.  ``order``: the key of a place.
    """
    import numpy as np

    lists = [x for x in lists if len(x[0])]
    short = [x for x in lists if len(x[0]) <= SHORT_SHARE * n_docs]
    streams = [x for x in lists if len(x[0]) > SHORT_SHARE * n_docs]
    if short:  # term at a time: one list of sums
        places, where = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, where, np.concatenate([x[1] for x in short]))
        streams.append((places, sums))
    bounds = [int(x[1].max()) for x in streams]
    by_bound = sorted(range(len(streams)), key=lambda i: (bounds[i], i))
    streams, bounds = [streams[i] for i in by_bound], [bounds[i] for i in by_bound]
    reach = np.concatenate(([0], np.cumsum(bounds))).tolist()  # most that the first i streams give together
    at = 0
    while at < n_docs:
        bar = top.bar
        free = 0  # streams that cannot bring in a document by themselves
        while free < len(streams) and reach[free + 1] < bar:
            free += 1
        if free == len(streams):
            return
        # the next window of candidates: as many places as one window of the essential streams holds
        begins = [int(np.searchsorted(p, at)) for p, _ in streams[free:]]
        stops = [int(p[b + WINDOW - 1]) + 1 for (p, _), b in zip(streams[free:], begins) if b + WINDOW <= len(p)]
        until = min(stops, default=n_docs)
        parts = [(p[b:e], s[b:e]) for (p, s), b in zip(streams[free:], begins) for e in [int(np.searchsorted(p, until))] if e > b]
        at = until
        if not parts:
            continue
        found, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        score = np.zeros(len(found), np.int64)
        np.add.at(score, where, np.concatenate([s for _, s in parts]))
        for i in range(free - 1, -1, -1):
            able = score + reach[i + 1] >= bar
            found, score = found[able], score[able]
            if not len(found):
                break
            places, gains = streams[i]
            spot = np.minimum(np.searchsorted(places, found), len(places) - 1)
            score = score + np.where(places[spot] == found, gains[spot], 0)
        good = score >= bar
        if good.any():
            top.add(score[good], order[found[good]])


FOUND = "query int, part int, doc_id long, score long"


def _search_block(docs: DataFrame, block: Queries, k: int, short_of: int = CHUNK_POSTINGS) -> DataFrame:
    """(query, doc_id, score, rank) of one block's queries."""
    spark = docs.sparkSession
    # documents without any asked term count for the statistics alone
    held = stage(postings(docs, block.terms), all_terms=F.sum("n"))
    n_docs, n_terms = held.rows, held.facts["all_terms"] or 0
    df = dict(held.df.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())  # at most one row for each term of the block
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(block.terms))]
    shared = spark.sparkContext.broadcast((weight, block.asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        weight, asked = shared.value
        weight = np.array(weight, np.int64)
        tops = [TopK(k) for _ in asked]
        last = np.int64(2**63 - 1)  # stands for a null id, which comes after all others
        nulls_at = []

        def chunks():
            held, size = [], 0
            for batch in batches:
                at = 0
                counts = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                while at < batch.num_rows:
                    more = max(1, int(np.searchsorted(np.cumsum(counts[at:]), short_of - size)))
                    held.append(batch.slice(at, more))
                    size += int(counts[at:at + more].sum())
                    at += more
                    if size >= short_of:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for part in chunks():
            ids = np.concatenate([b.column(0).fill_null(int(last)).to_numpy(zero_copy_only=False).astype(np.int64) for b in part])
            nulls_at.append(sum(b.column(0).null_count for b in part))
            n = np.concatenate([b.column(1).to_numpy() for b in part]).astype(np.int64)
            counts = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in part])
            terms = np.concatenate([b.column(2).flatten().to_numpy() for b in part]).astype(np.int64)
            tfs = np.concatenate([b.column(3).flatten().to_numpy() for b in part]).astype(np.int64)
            m = PIVOT - SLOPE + (SLOPE * n * n_docs) // n_terms
            places = np.repeat(np.arange(len(ids)), counts)
            gain = weight[terms] * ((SCALE * tfs) // (1000 * tfs + BOOST * m[places]))
            inverted = np.argsort(terms, kind="stable")  # places stay in order within a term
            terms, places, gain = terms[inverted], places[inverted], gain[inverted]
            begins = np.searchsorted(terms, np.arange(len(weight) + 1))
            for query, mine in enumerate(asked):
                rank_chunk([(places[begins[t]:begins[t + 1]], gain[begins[t]:begins[t + 1]]) for t in mine], ids, tops[query], len(ids))
        part_no = TaskContext.get().partitionId() % PARTS
        for query, top in enumerate(tops):
            if len(top.scores):
                size = len(top.scores)
                missing = top.keys == last if sum(nulls_at) else np.zeros(size, bool)
                yield pa.RecordBatch.from_arrays([pa.array([query] * size, pa.int32()), pa.array([part_no] * size, pa.int32()),
                                                  pa.array(top.keys, mask=missing), pa.array(top.scores)], names=["query", "part", "doc_id", "score"])

    best = (F.desc("score"), F.asc_nulls_last("doc_id"))
    found = held.df.mapInArrow(run, FOUND)
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*best))).where(F.col("r") <= k).drop("r")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, chunk_postings: int = CHUNK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    kind = queries.schema["item_id"].dataType.simpleString()
    out = []
    for block in query_blocks(queries, block_terms):
        found = _search_block(docs, block, k, chunk_postings)
        names = spark.createDataFrame(list(enumerate(block.items)), f"query int, item_id {kind}")
        out.append(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return union_all(out)


def search_sql(k: int = TOP) -> str:
    """The same rows by scoring every document that has a term of the item."""
    def terms(col: str) -> str:
        return (f"list_filter(regexp_split_to_array(translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                r"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')")

    return f"""
WITH d AS (SELECT doc_id, {terms('text')} AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, unnest({terms('text')}) AS w FROM benchmark),
p AS (SELECT doc_id, n, w, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM i) GROUP BY ALL),
f AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY w, n_docs),
g AS (SELECT p.doc_id, p.w, f.weight * (({SCALE} * tf) // (1000 * tf + {BOOST} * ({PIVOT - SLOPE} + ({SLOPE} * n * n_docs) // n_terms))) AS gain FROM p JOIN f USING (w), s),
r AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM i JOIN g USING (w) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}"""
