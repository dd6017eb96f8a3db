"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its hashed words.  Its score is the logistic of a bias, a weight per term, and for each pair of
terms the product of their factor vectors, so that a term can count more beside another.  Weights are learned with a
proximal rule that leaves uninformative terms at zero.  Every term in ``MIN_ROWS`` rows or more of the sample has factors,
with a weight or without; a row moves its own pairs' sum by at most ``REACH`` times its error.

Training takes a bounded sample of labelled rows, ``max_fit`` (documented, chosen by a hash of the key), and learns one table
of weights and factors from it in one task.  The model is bounded by the number of slots.

Defined results: a null or empty text scores the bias alone; unlabelled rows and null labels are not learned from; without
any labelled row every score is 0; a document labelled more than once is learned once, as toxic if any label says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depfleet.staging import stage

from .common import fold, map_texts, whole_text

SLOTS = 1 << 20
FACTORS = 4
MAX_FIT = 24_000
EPOCHS = 10
EDGES = b".,;:!?\"'()[]{}<>*#$%&-_|/\\~"
RATE, SMOOTH, L1, L2 = 4.0, 1.0, 3.0, 0.01
FACTOR_RATE, FACTOR_L2 = 0.02, 0.05
START, REACH = 0.02, 0.5
MIN_ROWS = 5             # rows of the sample a term must stand in to have factors


class Slots(dict):
    """Slot of a word, without punctuation at its edges; -1 if nothing is left.  Kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        bare = word.strip(EDGES)
        slot = xxhash.xxh3_64_intdigest(bare) % SLOTS if bare else -1
        if len(word) <= 64:
            self[word] = slot
        return slot

    def of(self, text: str) -> np.ndarray:
        words = set(text.lower().encode().split())
        found = np.unique(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        return found[1:] if len(found) and found[0] < 0 else found


@dataclass
class Model:
    bias: float
    slots: np.ndarray    # sorted
    weights: np.ndarray
    factors: np.ndarray


EMPTY = Model(-35.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def logistic(x: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-np.clip(x, -35, 35))))


def train(rows: list[tuple[np.ndarray, int]], seed: int = 7) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Bias, and slots with weight and factors, learned from all rows."""
    rng = np.random.default_rng(seed)
    slots, back = np.unique(np.concatenate([s for s, _ in rows] or [np.zeros(0, np.int32)]), return_inverse=True)
    cuts = np.cumsum([len(s) for s, _ in rows])[:-1]
    terms = np.split(back, cuts) if rows else []
    n = len(slots)
    z, g2, w = np.zeros(n), np.zeros(n), np.zeros(n)
    known = np.bincount(back, minlength=n) >= MIN_ROWS
    v = rng.normal(0, START, (n, FACTORS)) * known[:, None]
    v2 = np.zeros((n, FACTORS))
    pairs = [x[known[x]] for x in terms]
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1.0)
    bias, bias_g2 = float(np.log(share / (1 - share))), 1.0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            x, on, y = terms[k], pairs[k], rows[k][1]
            wx, vx = w[x], v[on]
            total = vx.sum(0)
            pair = 0.5 * float((total**2).sum() - (vx**2).sum())
            g = logistic(bias + float(wx.sum()) + pair) - y
            bias_g2 += g * g
            bias -= 0.1 * g / np.sqrt(bias_g2)
            if abs(g) < 1e-4:
                continue
            old = g2[x]
            g2[x] = now = old + g * g
            z[x] = zx = z[x] + g - (np.sqrt(now) - np.sqrt(old)) / RATE * wx
            w[x] = np.where(np.abs(zx) > L1, -(zx - np.sign(zx) * L1) / ((SMOOTH + np.sqrt(now)) / RATE + L2), 0.0)
            if len(on) > 1:
                away = total - vx
                gv = g * away + FACTOR_L2 * abs(g) * vx
                v2[on] += gv * gv
                move = FACTOR_RATE * gv / np.sqrt(1e-2 + v2[on])
                change = abs(float((move * away).sum()))
                v[on] = vx - move * min(1.0, abs(g) * REACH / max(change, 1e-12))
    held = (w != 0) | known
    return bias, slots[held], w[held], v[held]


def fit(labelled: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Learns from rows of (key, text, toxic), at most about ``max_fit`` of them."""
    n = labelled.count()
    if n == 0:
        return EMPTY
    spread = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(spread < min(1.0, max_fit / n)).select("key", "text", "toxic")

    def featured():
        slots = Slots()
        return lambda texts: {"slots": [slots.of(t).tobytes() for t in texts]}

    rows = stage(map_texts(sample, featured, "slots binary").select("key", "slots", "toxic")).df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, s, y) for b in batches for k, s, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))  # MAX_FIT or so
        if rows:
            bias, *arrays = train([(np.frombuffer(s, np.int32), y) for _, s, y in rows])
            packed = [x.astype(t).tobytes() for x, t in zip(arrays, ("<i8", "<f8", "<f8"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([bias], pa.float64()), *(pa.array([x], pa.binary()) for x in packed)],
                                             names=["bias", "slots", "weights", "factors"])

    model = rows.repartition(1).mapInArrow(run, "bias double, slots binary, weights binary, factors binary").collect()  # one row, bounded by SLOTS
    if not model:
        return EMPTY
    bias, slots, weights, factors = model[0]
    return Model(bias, np.frombuffer(bytes(slots), "<i8"), np.frombuffer(bytes(weights), "<f8"), np.frombuffer(bytes(factors), "<f8").reshape(-1, FACTORS))


def score(docs: DataFrame, model: Model, col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def per_text():
        m, slots = Model(**shared.value), Slots()
        place = np.full(SLOTS, -1, np.int32)
        place[m.slots] = np.arange(len(m.slots), dtype=np.int32)

        def one(text: str) -> float:
            at = place[slots.of(text)]
            at = at[at >= 0]
            v = m.factors[at]
            return logistic(m.bias + float(m.weights[at].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum()))

        return lambda texts: {"score": [one(t) for t in texts]}

    return map_texts(docs, per_text, "score double", col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learns from labelled rows of all folds but one and scores every row of (doc_id, text)."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(fold(F.col("doc_id"), folds) != held)
    n = own.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    few = own.where(spread < min(1.0, MAX_FIT / max(n, 1)))  # about MAX_FIT rows: small enough to broadcast
    labelled = docs.join(F.broadcast(few), "doc_id").select(F.col("doc_id").alias("key"), whole_text().alias("text"), "toxic").dropDuplicates(["key"])
    model = fit(stage(labelled).df)
    return score(docs.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "text"), model)
