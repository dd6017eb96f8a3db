"""N-gram Jaccard join with prefix, length, positional and suffix filters.

1. Every text becomes the set of its word shingles (64-bit hashes); texts of equal sets form one class, keyed by its set.
2. Shingles are ordered rare first by a bounded table of hashed frequencies over all documents.  Any common order is
   exact; the table only makes prefixes selective.
3. Each class posts the shingles of its prefix.  Postings are dealt by shingle and sorted, and streamed: those that stand
   alone are dropped, the others keep the first member of their list (the one with the fewest rarer shingles).
4. Members are compared with that first member, each pair once, by their whole sets.  Links give components.
5. Lists that still join different components are cut into blocks, and pairs of blocks are compared under the length,
   positional and suffix filter (a lower bound of the sets' distance from parity bitmaps).  What passes is verified once
   per pair.  Pairs within one component are left out, as they cannot change the result; no link between components is.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; a text with
fewer words than a shingle has its whole sequence as one; a null key is in no component; equal keys share one component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depfleet.staging import Staged, passing, stage

from . import bloom
from .common import by_chunks, mixed, text_words, tidy, without_ids

SLOT_BITS = 22          # the frequency table: 4 M slots, one byte each once read
SLOT_PARTS = 256
BLOCK_MEMBERS = 1024    # members of one list that meet in one group: twice as many at most
MAX_CANDIDATE_BLOCKS = 1 << 17  # 8 MB


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when 100 * common >= percent * union."""

    words: int = 5
    percent: int = 80

    def __post_init__(self):
        if not (self.words >= 1 and 50 < self.percent <= 100):
            raise ValueError("shingles of one word or more, and a similarity over a half, are needed")

    def prefix(self, n: int) -> int:
        """Shingles to post of a set of n: two linked sets share one of these."""
        return n - ceil(self.percent * n / 100) + 1

    def enough(self, common, a, b):
        return (100 + self.percent) * common >= self.percent * (a + b)


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = text_words(texts)

    def rolled(h: np.ndarray, width: int) -> np.ndarray:
        out = np.full(max(len(h) - width + 1, 0), width, np.uint64)
        for k in range(width if len(out) else 0):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
        return out

    every = rolled(h, size)  # also those across two texts, which no text takes
    for lo, hi in itertools.pairwise(at.tolist()):
        yield np.unique(every[lo : hi - size + 1] if hi - lo >= size else rolled(h[lo:hi], hi - lo) if hi > lo else h[:0])


def set_key(s: np.ndarray) -> int:
    """One 64-bit key for a set."""
    if not len(s):
        return 0
    both = np.array([np.bitwise_xor.reduce(mixed(s + np.uint64(1))), s.sum(), len(s)], np.uint64)
    return int(mixed(mixed(both[:1] + both[1:2]) + both[2:])[0:1].view(np.int64)[0])


def _sets(batch: pa.RecordBatch, at: int, rule: Rule) -> Iterator[np.ndarray]:
    for chunk in by_chunks(t or "" for t in batch.column(at).to_pylist()):
        yield from shingle_sets(chunk, rule.words)


def describe(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, cls, n) of every row, and the frequency level of every slot; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, held, size = np.zeros(1 << SLOT_BITS, np.int64), [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

        def flush():
            nonlocal held, size
            if held:
                slots[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
            held, size = [], 0

        for batch in batches:
            found = []
            for s in _sets(batch, 1, rule):
                found.append((set_key(s), len(s)))
                held.append(s)
                size += len(s)
                if size > 4_000_000:
                    flush()
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([c for c, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        flush()
        import zlib

        for part, counts in enumerate(slots.reshape(SLOT_PARTS, -1)):
            if counts.any():
                packed = zlib.compress(counts.astype("<i8").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                                  pa.array([part], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), "<i8")
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            levels = np.minimum(255, np.round(6 * np.log2(1.0 + counts))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["part", "levels"])

    told = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, cls long, n long, part int, counts binary")).df
    levels = np.zeros((SLOT_PARTS, (1 << SLOT_BITS) // SLOT_PARTS), np.uint8)
    parts = told.where("part IS NOT NULL").select("part", "counts").repartition(32, "part").mapInArrow(tidy(add), "part int, levels binary")
    for part, packed in parts.collect():  # one byte a slot: 4 MB
        levels[part] = np.frombuffer(bytes(packed), np.uint8)
    return told.where("part IS NULL").select("doc_id", "cls", "n"), levels.reshape(-1)


def post(docs: DataFrame, levels: np.ndarray, rule: Rule) -> Staged:
    """Postings (token, cls, n, pos, first, first_n) of lists with two classes or more, ``first`` being the list's first member."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            tokens, classes, sizes, places = [], [], [], []
            for s in _sets(batch, 0, rule):
                n = len(s)
                if not n or (key := set_key(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)  # copies within a task post once; the others meet in the sorted stream
                p = rule.prefix(n)
                rare = np.argsort(order[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")[:p]  # ties by hash, as s is sorted
                tokens.append(s[rare].view(np.int64))
                classes.append(np.full(p, key, np.int64))
                sizes.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, classes, sizes, places)], names=["token", "cls", "n", "pos"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams rows sorted by token and place; a list's first row waits for a second."""
        schema = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("first", pa.int64()), ("first_n", pa.int32())])
        first = last = None   # first row of the current list and whether it is still to be written; last row seen
        waiting = False
        for batch in batches:
            t, c, n, p = (batch.column(i).to_numpy() for i in range(4))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            same = np.zeros(len(t), bool)
            same[1:] = ~new[1:] & (c[1:] == c[:-1])
            if last is not None:
                new[0] = t[0] != last[0]
                same[0] = not new[0] and c[0] == last[1]
            last = (int(t[-1]), int(c[-1]))
            t, c, n, p, new = (x[~same] for x in (t, c, n, p, new))
            if not len(t):
                continue
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1   # -1: goes on with the list of the batch before
            size = np.bincount(group + 1, minlength=len(heads) + 1)
            out = [x[:0] for x in (t, c, n, p, c, n)]
            if size[0] and waiting:
                out = [np.append(x, v).astype(x.dtype) for x, v in zip(out, (first[0], first[1], first[2], first[3], first[1], first[2]), strict=True)]
                waiting = False
            last_open = len(heads) - 1
            many = size[group + 1] > 1
            many |= group == -1
            head = np.where(group >= 0, heads[np.maximum(group, 0)], 0) if len(heads) else np.zeros(len(t), np.int64)
            first_c = np.where(group >= 0, c[head], first[1] if first else 0)
            first_n = np.where(group >= 0, n[head], first[2] if first else 0).astype(np.int32)
            rows = [np.concatenate([a, b[many]]) for a, b in zip(out, (t, c, n, p, first_c, first_n), strict=True)]
            if len(heads):
                h = heads[-1]
                first, waiting = (int(t[h]), int(c[h]), int(n[h]), int(p[h])), not bool(size[last_open + 1] > 1)
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)

    postings = docs.select("text").mapInArrow(tidy(emit), "token long, cls long, n int, pos int")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = postings.repartition(parts, "token").sortWithinPartitions("token", "pos", "n", "cls")
    return stage(dealt.mapInArrow(tidy(keep), "token long, cls long, n int, pos int, first long, first_n int"))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's shingles in a power of two of bits, at least twice the set."""
    bits = 1 << max(6, ceil(log2(2 * max(len(s), 1))))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def read_classes(docs: DataFrame, told: DataFrame, wanted: DataFrame, rule: Rule, what: str) -> DataFrame:
    """(cls, n, what) of the wanted classes, ``what`` being "bits" or "shingles", from one document each.

    Only documents that a bounded Bloom filter of the chosen ids lets pass are read as text again; an exact join by
    class drops what passed by chance.
    """
    chosen = stage(told.join(wanted.select("cls").distinct(), "cls", "left_semi").where("doc_id IS NOT NULL")
                   .groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
    blocks = bloom.block_count(chosen.rows, MAX_CANDIDATE_BLOCKS)
    likely = bloom.may_hold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.col("doc_id"),
                            bloom.build(chosen.df, F.col("doc_id"), blocks), blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), (what, pa.binary())])
        for batch in batches:
            rows = [(set_key(s), len(s), bitmap(s) if what == "bits" else s.tobytes()) for s in _sets(batch, 1, rule)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)

    read = likely.mapInArrow(tidy(run), f"doc_id long, cls long, n int, {what} binary")
    return stage(read.join(chosen.df, ["cls", "doc_id"], "left_semi").dropDuplicates(["cls", "doc_id"]).drop("doc_id")).df


def compared(pairs: DataFrame, classes: DataFrame, what: str, holds) -> DataFrame:
    """Pairs (a, b) for whose ``what`` ``holds`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [bool(holds(*row)) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (classes.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col(what).alias(f"w{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(tidy(run), "a long, b long")


def may_link(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that the suffix filter leaves: the parity bitmaps of linked sets differ in few places."""

    def holds(na: int, nb: int, x: bytes, y: bytes) -> bool:
        x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
        apart = int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())
        return rule.enough((na + nb - apart) // 2, na, nb)

    return compared(pairs, classes, "bits", holds)


def verify(pairs: DataFrame, docs: DataFrame, told: DataFrame, rule: Rule) -> Staged:
    """Pairs (a, b) that link, by the whole sets of the classes in them; each pair once."""
    pairs = stage(pairs).df
    sets = read_classes(docs, told, pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))), rule, "shingles")

    def holds(na: int, nb: int, x: bytes, y: bytes) -> bool:
        return rule.enough(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)), na, nb)

    return stage(compared(pairs, sets, "shingles", holds))


def components(links: DataFrame) -> DataFrame:
    """(cls, label) of every class with a link; ``label`` is the least class it reaches.

    Each round takes the least label around a class and then that label's own, so long chains shorten fast; rounds are
    written tables.
    """
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()).df
    state = stage(both.groupBy(F.col("a").alias("cls")).agg(F.min(F.least("a", "b")).alias("label"))).df
    while True:
        near = (both.join(state, F.col("b") == F.col("cls")).groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near")))
        low = state.join(near, "cls").select("cls", "label", F.least("label", "near").alias("low"))
        jump = state.select(F.col("cls").alias("low"), F.col("label").alias("far"))
        done = stage(low.join(jump, "low", "left").select("cls", F.least("low", F.coalesce("far", F.col("low"))).alias("new"), "label")
                     .withColumn("moved", F.col("new") != F.col("label")), moved=F.count_if("moved"))
        state = done.df.select("cls", F.col("new").alias("label"))
        if not done.facts["moved"]:
            return state


def crossing(posts: DataFrame, labels: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of classes in different components that share a list and pass the filters."""
    named = posts.join(labels, "cls", "left").select("token", "cls", "n", "pos", F.coalesce("label", "cls").alias("label"))
    mixed_lists = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"))
    mixed_lists = mixed_lists.where("lo <> hi AND members > 2")  # the two of a short list have been compared already
    open_rows = named.join(mixed_lists.select("token", "members"), "token")
    parts = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    block = F.pmod(F.xxhash64("cls"), parts).cast("int")
    dealt = (open_rows.withColumn("parts", parts).withColumn("block", block)
             .join(classes.select("cls", "bits"), "cls")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "pos", "label", "bits"))

    def folded(bits: list[bytes], size: int) -> np.ndarray:
        out = np.empty((len(bits), size), np.uint8)
        for k, x in enumerate(bits):
            out[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), 0)
        return out

    def run(table: pa.Table) -> pa.Table:
        """One pair of blocks of one list: two thousand members or so."""
        block, cls, n, pos, label = (table.column(k).to_numpy() for k in ("block", "cls", "n", "pos", "label"))
        bits, both = table.column("bits").to_pylist(), int(table.column("i")[0].as_py()) != int(table.column("j")[0].as_py())
        order = np.argsort(n, kind="stable")
        block, cls, n, pos, label = (x[order] for x in (block, cls, n, pos, label))
        bits = [bits[k] for k in order]
        width = np.array([len(x) for x in bits])
        out_a, out_b = [], []
        for size in np.unique(width).tolist():
            # rows of this width against the same and the next; linked sets differ by less than a factor of two
            rows = np.flatnonzero((width == size) | (width == 2 * size))
            maps = folded([bits[k] for k in rows], size)
            maps = np.ascontiguousarray(maps).view(np.uint64)
            for at, k in enumerate(rows.tolist()):
                if width[k] != size:
                    continue
                others = rows[at + 1 :]
                reach = np.searchsorted(n[others], n[k] * 100 // rule.percent + 1)
                others = others[:reach]
                fit = label[others] != label[k]
                if both:
                    fit &= block[others] != block[k]
                common = np.minimum(pos[others], pos[k]) + 1 + np.minimum(n[others] - pos[others], n[k] - pos[k]) - 1
                fit &= rule.enough(common, n[others], n[k])
                chosen = np.flatnonzero(fit)
                if len(chosen):
                    apart = np.bitwise_count(maps[at + 1 + chosen] ^ maps[at]).sum(1)
                    chosen = chosen[rule.enough((n[others[chosen]] + n[k] - apart.astype(np.int64)) // 2, n[others[chosen]], n[k])]
                    out_a.append(np.minimum(cls[others[chosen]], cls[k]))
                    out_b.append(np.maximum(cls[others[chosen]], cls[k]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("token", "i", "j").applyInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    told, levels = describe(docs, rule)
    posts = post(docs, levels, rule)
    classes = read_classes(docs, told, posts.df, rule, "bits")
    pairs = F.least("cls", "first").alias("a"), F.greatest("cls", "first").alias("b")
    stars = posts.df.where("cls <> first").where(rule.enough(F.least("n", "first_n"), F.col("n"), F.col("first_n"))).select(*pairs).distinct()
    links = verify(may_link(stars, classes, rule), docs, told, rule)
    labels = components(links.df)
    more = verify(crossing(posts.df, labels, classes, rule), docs, told, rule)
    if more.rows:
        labels = components(links.df.unionByName(more.df))
    least = told.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    heads = named.groupBy("label").agg(F.min("least").alias("head"))
    final = named.join(heads, "label").select("cls", "head")
    joined = told.join(final, "cls", "left")
    own = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows of one document of each group, the one with the least doc_id; rows without a key stay."""
    with passing() as keep:
        groups = stage(similar_groups(docs, rule).where("doc_id IS NOT NULL"))
        heads = groups.df.where("doc_id = component_id").select("doc_id")
        repeated = groups.rows > groups.df.select("doc_id").distinct().count()
        others = groups.df.where("doc_id <> component_id").select("doc_id")
        gone = keep(stage(others.distinct().join(heads, "doc_id", "left_anti") if repeated else others))
    kept = without_ids(docs, gone.df, gone.rows)
    if repeated:
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
    return kept
