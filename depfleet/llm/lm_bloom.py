"""Language-model scores from a log-frequency Bloom filter.

Counts of words, and of pairs behind the frequent words, are quantised on a logarithmic scale; a count of level q is held
as q entries (n-gram, 1) to (n-gram, q) of a blocked Bloom filter.  A level is found by probing 1, 2, ... until a probe
fails, so a count is never under-estimated by the filter itself.

The score is a probability.  A word alone has (c + 0.5) / Z, with Z summed over the same quantised counts and one unknown
word.  Behind a context v, a pair of quantised count c has (c - D) / A(v), and the rest, D N(v) / A(v), goes to the words
alone; A(v) is the sum of the quantised counts behind v and N(v) the number of its followers, both taken over all
pairs.  So the sum over the vocabulary is 1 for every context, but for words that the filter lets pass by chance; a
word is a context of the filter only where these take at most ``TOLERANCE`` of its probability, which asks for about one
occurrence for a thousand distinct words.  What follows all other words is scored by the same formula from exact counts
if ``whole`` is asked for (``rare_scores``), else by words alone.

What is counted grows with the corpus and stays distributed.  What is broadcast is bounded: the filter by ``max_blocks``,
and a table of at most ``head_words`` frequent words with their exact counts, A and N.  If more entries are wanted than the
filter has room for, pairs of the lowest levels stay out of it, and before them, if they alone are too many, the
words beyond the table: tokens that ask for either get their counts from the tables of counts by a shuffled join, by the same
formula.  A text that was learned from holds no unseen pair, so it need not ask where only pairs of the first level are out.
The exact base score takes words beyond the table from such a join always, so nothing is cut.

Defined results: a null or empty text is one end token; a null key counts as empty text in its fold and stays null; equal
rows give equal rows; without training rows every count is 0.  Words are told apart by 64-bit hashes, the followers of one
context by 44 bits of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depfleet.staging import shuffles_freed, stage

from .common import WordHashes, by_chunks, fold, mixed, text_words, tidy

END = b" "  # no word holds a space
BASE = 1.5            # ratio of neighbouring levels
BITS_PER_ENTRY = 24
PROBES = 8
FALSE_RATE = 1e-4     # words that pass by chance, at this load
TOLERANCE = 0.05      # share of a context's probability that they may take
DISCOUNT = 0.75       # taken off every pair's count
MAX_BLOCKS = 1 << 20  # of 64 bytes: 64 MB
HEAD_WORDS = 1 << 18
WHOLE_SHARE = 8       # the part of the room that goes to whole contexts, if there is none for all
FOLLOWER_BITS = 44
TASK_TOKENS = 3_000_000


def level(count):
    """Level of a count: 1 for one, one more for each factor BASE."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels):
    """Middle of a level's range; 0 for level 0."""
    return np.where(levels > 0, BASE ** (levels - 0.5), 0.0)


def tokens_of(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text with an end token, and where each text starts."""
    words, at = text_words(texts)
    nth = np.arange(len(texts) + 1)
    tokens = np.full(len(words) + len(texts), hashes.of([END])[0], np.uint64)
    tokens[np.arange(len(words)) + np.repeat(nth[:-1], np.diff(at))] = words
    return tokens, at + nth


def pair_keys(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of (context number, token), spread over all bits; ``context_of`` gets the number back."""
    return mixed((contexts.astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | (tokens >> np.uint64(64 - FOLLOWER_BITS)))


def context_of(keys: np.ndarray) -> np.ndarray:
    """The context numbers of pair keys: the steps of ``mixed`` backwards."""
    x = keys ^ (keys >> np.uint64(31)) ^ (keys >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return (x >> np.uint64(FOLLOWER_BITS)).astype(np.int64)


def numbers_before(tokens: np.ndarray, starts: np.ndarray, end: int, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Context number of the token before each token, -1 where it is no context; before a text's first stands the end token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = end
    at = np.minimum(np.searchsorted(keys, before), len(keys) - 1)
    return np.where(keys[at] == before, numbers[at], -1)


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    """``key`` and ``n`` of what ``keys_of`` (tokens, starts, end) names in the column ``text``; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        end = int(hashes.of([END])[0])

        def out():
            every = np.concatenate(held)
            held.clear()
            every.sort()  # in place: a stretch of tokens is in memory once
            firsts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            ends = np.append(firsts[1:], len(every))
            for at in range(0, len(firsts), 500_000):
                here = firsts[at : at + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(every[here].view(np.int64)), pa.array((ends[at : at + 500_000] - here).astype(np.int32))], names=["key", "n"])

        for batch in batches:
            for chunk in by_chunks(t or "" for t in batch.column(0).to_pylist()):
                tokens, starts = tokens_of(chunk, hashes)
                held.append(keys_of(tokens, starts, end))
                size += len(tokens)
                if size >= TASK_TOKENS:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return texts.select("text").mapInArrow(tidy(run), "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame) -> DataFrame:
    return _counted(texts, lambda tokens, starts, end: tokens.copy())


def count_pairs(texts: DataFrame, keys: np.ndarray, numbers: np.ndarray) -> DataFrame:
    """Pairs behind contexts, whose keys come sorted, with their numbers."""
    shared = texts.sparkSession.sparkContext.broadcast((keys, numbers))

    def of(tokens, starts, end):
        number = numbers_before(tokens, starts, end, *shared.value)
        some = number >= 0
        return pair_keys(number[some], tokens[some])

    return _counted(texts, of)


def followers(pairs: DataFrame, contexts: int) -> DataFrame:
    """Per context number: ``mass``, the sum of its pairs' quantised counts, their number ``n`` and the filter's ``entries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, n, entries = np.zeros(contexts), np.zeros(contexts, np.int64), np.zeros(contexts, np.int64)
        for batch in batches:
            number = context_of(batch.column(0).to_numpy().view(np.uint64))
            q = level(batch.column(1).to_numpy())
            mass += np.bincount(number, count_of(q), contexts)
            n += np.bincount(number, minlength=contexts)
            entries += np.bincount(number, q, contexts).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mass[some]), pa.array(n[some]), pa.array(entries[some])], names=["context", "mass", "n", "entries"])

    return (pairs.select("key", "n").mapInArrow(tidy(run), "context long, mass double, n long, entries long")
            .groupBy("context").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"), F.sum("entries").alias("entries")))


@dataclass
class Model:
    """What workers need: bounded, whatever the corpus."""

    words: np.ndarray      # the filter, eight 64-bit words a block
    apart: bool            # words beyond the head table are not in the filter
    total: int             # training tokens
    distinct: int
    z: float               # sum over all words and an unknown one of what a word alone has
    head_keys: np.ndarray  # sorted
    head_counts: np.ndarray
    context: np.ndarray    # number of a head word as a context whose pairs are all in the filter, or -1
    far: np.ndarray        # number of a head word as a context with pairs that are not, or -1
    least: np.ndarray      # by context number: the lowest level of which pairs are in the filter
    mass: np.ndarray
    kinds: np.ndarray
    rare: bool = False     # what follows known words that are no contexts is scored by ``rare_scores``


PARTS = 64  # ranges of blocks; all entries of a key lie in one of them, each in a block of its own


def entry_at(keys: np.ndarray, j: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of the block of each key's entry j, and two hashes that name its bits."""
    h = mixed(keys + np.uint64((j * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    more = mixed(h ^ np.uint64(0x9E3779B97F4A7C15))
    span = np.uint64(blocks // PARTS)
    block = ((keys >> np.uint64(33)) % np.uint64(PARTS)) * span + (more >> np.uint64(16)) % span
    return block.astype(np.int64) * 8, h, more


def entry_bit(h: np.ndarray, more: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of probe p: nine bits of the hashes."""
    bit = ((h >> np.uint64(9 * p)) if p < 7 else more) & np.uint64(511)
    return (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def probe_levels(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Entries found in a row for each key; a key is asked no further once a probe fails."""
    blocks = len(words) // 8
    found = np.zeros(len(keys), np.int64)
    left, j = np.arange(len(keys)), 0
    while len(left) and j < 200:
        j += 1
        at, h, more = entry_at(keys[left], j, blocks)
        for p in range(PROBES):
            word, mask = entry_bit(h, more, p)
            hit = (words[at + word] & mask) != 0
            left, at, h, more = left[hit], at[hit], h[hit], more[hit]
        found[left] = j
    return found


def build_filter(counts: DataFrame, blocks: int) -> np.ndarray:
    """The filter of (key, q): a key of level q has q entries; each task sets the bits of its own ranges of blocks."""
    span = blocks // PARTS * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, q = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            part = ((keys >> np.uint64(33)) % np.uint64(PARTS)).astype(np.int64)
            for j in range(1, int(q.max(initial=0)) + 1):
                some = q >= j
                at, h, more = entry_at(keys[some], j, blocks)
                of = part[some]
                for one in np.unique(of).tolist():
                    words = parts.setdefault(one, np.zeros(span, np.uint64))
                    mine = of == one
                    for p in range(PROBES):
                        word, mask = entry_bit(h[mine], more[mine], p)
                        np.bitwise_or.at(words, at[mine] - one * span + word, mask)
        for one, words in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["part", "words"])

    # the same arithmetic as in entry_at, on the signed value
    part = F.expr(f"cast(pmod(shiftrightunsigned(key, 33), {PARTS}L) as int)")
    dealt = counts.select("key", F.col("q").cast("int").alias("q")).repartition(PARTS, part)
    ranges = stage(dealt.mapInArrow(tidy(run), "part int, words binary"))
    out = np.zeros(PARTS * span, np.uint64)
    for one, words in ranges.df.toLocalIterator():  # at most max_blocks * 64 bytes, a few ranges at once in the driver beside ``out``
        out[one * span : (one + 1) * span] |= np.frombuffer(words, np.uint64)
    ranges.drop()
    return out


def columns_of(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table without nulls as arrays: eight bytes a value in the driver, and no object a row."""
    return [c.to_numpy() for c in df.toArrow().columns]


def level_column(n):
    return (1 + F.floor(F.log(n.cast("double")) / math.log(BASE) + 1e-9)).cast("int")


@dataclass
class Counts:
    """Tables of exact counts (``key``, ``n``)."""

    words: DataFrame
    pairs: DataFrame | None  # behind all contexts


def learn(texts: DataFrame, max_blocks: int = MAX_BLOCKS, head_words: int = HEAD_WORDS) -> tuple[Model, Counts]:
    """The model, and what it was learned from."""
    counts = stage(count_words(texts)).df
    q = level_column(F.col("n"))
    # a row per level: some tens of rows, whatever the corpus
    levels = counts.groupBy(q.alias("q")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    total, distinct = sum(r["n"] for r in levels), sum(r["types"] for r in levels)
    from_count, held = None, 0
    for r in sorted(levels, key=lambda r: -r["q"]):
        held += r["types"]
        if held > head_words:
            break
        from_count = r["least"]
    head = counts.where(F.col("n") >= from_count) if from_count is not None else counts.limit(0)
    keys, exact = columns_of(head.select("key", "n"))  # at most head_words rows
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    keys, exact = keys[order], exact[order].astype(np.float64)

    # contexts: numbered from the most frequent one
    least = distinct * FALSE_RATE * (float(count_of(np.array(1))) - DISCOUNT) / TOLERANCE
    by_count = np.lexsort((keys, -exact))
    by_count = by_count[exact[by_count] >= least]
    number = np.full(len(keys), -1, np.int64)
    number[by_count] = np.arange(len(by_count))
    some = np.flatnonzero(number >= 0)
    pairs = stage(count_pairs(texts, keys[some], number[some])).df if len(some) else None
    mass, kinds, entries = np.zeros(len(some)), np.zeros(len(some)), np.zeros(len(some), np.int64)
    if pairs is not None:
        at, *figures = columns_of(followers(pairs, len(some)).select("context", "mass", "n", "entries"))  # at most head_words rows
        mass[at], kinds[at], entries[at] = figures
    number[np.isin(number, np.flatnonzero(kinds == 0))] = -1  # never before anything

    # what the filter has room for: all words first, then pairs; the rest is joined
    room = max_blocks * 512 // BITS_PER_ENTRY
    rare = [r for r in levels if from_count is None or r["least"] < from_count]
    of_words = sum(r["types"] * r["q"] for r in rare)
    apart = of_words > room
    if apart:
        of_words = 0
    least_in, of_pairs, kept = np.ones(len(some), np.int16), int(entries.sum()), pairs
    if of_pairs > room - of_words:
        least_in, of_pairs = fitting(pairs, entries, exact[by_count], room - of_words)
        kept = sifted(pairs, lambda of, q: q >= least_in[of])
    whole = np.append(least_in, 1)[number] == 1
    far, number = np.where(whole, -1, number), np.where(whole, number, -1)
    want = -(-(of_words + of_pairs) * BITS_PER_ENTRY // 512)
    blocks = PARTS * max(1, min(max_blocks // PARTS, -(-want // PARTS)))
    rare_words = counts if from_count is None else counts.where(F.col("n") < from_count)
    entries_of = (rare_words.limit(0) if apart else rare_words).select("key", q.alias("q"))
    if of_pairs:
        entries_of = entries_of.unionByName(kept.select("key", q.alias("q")))
    z = exact.sum() + 0.5 * (distinct + 1) + sum(r["types"] * float(count_of(np.array(r["q"]))) for r in rare)
    return Model(build_filter(entries_of, blocks), apart, total, distinct, float(z), keys, exact, number, far, least_in, mass, kinds), Counts(counts, pairs)


def fitting(pairs: DataFrame, entries: np.ndarray, tokens: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """By context number the lowest level of which pairs go into the filter, and the entries that these take.

    A part of the room goes to whole contexts, those with the most tokens for an entry: nothing behind them is asked for.  Behind
    the others levels go in from the highest, as an entry of a frequent pair spares most tokens the join; of the level with
    which the filter is full, the pairs behind the most frequent contexts.
    """
    contexts, order = len(entries), np.argsort(-tokens / np.maximum(entries, 1), kind="stable")
    up_to = np.cumsum(entries[order])
    n_whole = int(np.searchsorted(up_to, room // WHOLE_SHARE, "right"))
    held, whole = int(up_to[n_whole - 1]) if n_whole else 0, np.zeros(contexts, bool)
    whole[order[:n_whole]] = True
    rest = sifted(pairs, lambda of, q: ~whole[of])
    types = rest.groupBy(level_column(F.col("n")).alias("q")).agg(F.count(F.lit(1)).alias("types")).collect()  # some tens of rows
    q = 0
    for q, n in sorted(((r["q"], r["types"]) for r in types), reverse=True):
        if held + q * n > room:
            break
        held += q * n
    own = np.zeros(contexts, np.int64)
    at, figures = columns_of(followers(rest.where(level_column(F.col("n")) == q), contexts).select("context", "entries"))
    own[at] = figures
    up_to = np.cumsum(own)
    n_kept = int(np.searchsorted(up_to, room - held, "right"))
    least = np.where(whole, 1, np.where(np.arange(contexts) < n_kept, q, q + 1)).astype(np.int16)
    return least, held + int(own[:n_kept].sum())


def sifted(pairs: DataFrame, wanted) -> DataFrame:
    """Pairs for whose context numbers and levels ``wanted`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(context_of(batch.column(0).to_numpy().view(np.uint64)), level(batch.column(1).to_numpy()))))

    return pairs.select("key", "n").mapInArrow(tidy(run), "key long, n long")


def looked_up_words(types: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each word in the head table, whether it is there, and the level that the filter has for one that is not."""
    at, in_head = np.zeros(len(types), np.int64), np.zeros(len(types), bool)
    if len(m.head_keys):
        at = np.minimum(np.searchsorted(m.head_keys, types), len(m.head_keys) - 1)
        in_head = m.head_keys[at] == types
    found = np.zeros(len(types), np.int64)
    found[~in_head] = probe_levels(m.words, types[~in_head])
    return at, in_head, found


def words_alone(at: np.ndarray, in_head: np.ndarray, found: np.ndarray, m: Model) -> np.ndarray:
    """Probability without a context of words that were looked up; that of a word apart is not known here."""
    count = count_of(found)
    count[in_head] = m.head_counts[at[in_head]]
    return (count + 0.5) / m.z


def alone(types: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each word in the head table, whether it is there, and its probability without a context."""
    at, in_head, found = looked_up_words(types, m)
    return at, in_head, words_alone(at, in_head, found, m)


def is_rare(number: np.ndarray, in_head: np.ndarray, found: np.ndarray, m: Model) -> np.ndarray:
    """Whether a word is no context of the filter but may have been learned."""
    return (number < 0) & (in_head | (found > 0) | m.apart)


def levels_behind(number: np.ndarray, tokens: np.ndarray, m: Model) -> np.ndarray:
    """Level of each token's pair in the filter, 0 where its context number is -1."""
    found = np.zeros(len(tokens), np.int64)
    some = np.flatnonzero(number >= 0)
    keys, back = np.unique(pair_keys(number[some], tokens[some]), return_inverse=True)  # frequent pairs are probed most often, and once here
    found[some] = probe_levels(m.words, keys)[back]
    return found


def mixed_in(own: np.ndarray, number: np.ndarray, found: np.ndarray, m: Model) -> np.ndarray:
    """Probability of each token behind its context, given the level of their pair, mixed with its own."""
    p = own.copy()
    some = np.flatnonzero(number >= 0)
    of, pair = number[some], found[some]
    told = np.where(pair > 0, count_of(pair) - DISCOUNT, 0.0)
    p[some] = (told + DISCOUNT * m.kinds[of] * own[some]) / m.mass[of]
    return p


def behind(own: np.ndarray, number: np.ndarray, tokens: np.ndarray, m: Model) -> np.ndarray:
    """Probability of each token behind a context of the given number whose pairs are all in the filter."""
    return mixed_in(own, number, levels_behind(number, tokens, m), m)


def lists(bounds: np.ndarray, **columns: pa.Array) -> pa.ListArray:
    """A list of structs for each text: the rows between its bounds."""
    rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows, type=pa.list_(pa.field("element", rows.type)))


def asks(tokens: np.ndarray, starts: np.ndarray, rare: np.ndarray, of: np.ndarray, found: np.ndarray, opens: np.ndarray,
         own: np.ndarray, m: Model) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """For each text (word, weight, pair, known) of the tokens that need a join, the places of these tokens, and the mass behind their contexts.

    Such a token has, times that mass, known + weight * (what ``word`` has alone) + (what ``pair`` gains); a null word or pair adds
    nothing.  ``of``: context number or -1, ``found``: level of the pair in the filter, ``opens``: whether it has to be asked for.
    """
    some = np.flatnonzero(rare | opens)
    rare, of, found, opens, token, own = rare[some], of[some], found[some], opens[some], tokens[some], own[some]
    near = of >= 0
    weight, mass = np.ones(len(some)), np.ones(len(some))
    weight[near], mass[near] = DISCOUNT * m.kinds[of[near]], m.mass[of[near]]
    known = np.where(near & ~opens & (found > 0), count_of(found) - DISCOUNT, 0.0) + np.where(rare, 0.0, weight * own)
    keys = pair_keys(np.maximum(of, 0), token)
    return lists(np.searchsorted(some, starts), word=pa.array(token.view(np.int64), mask=~rare), weight=pa.array(weight, mask=~rare),
                 pair=pa.array(keys.view(np.int64), mask=~opens), known=pa.array(known)), some, mass


def word_before(types: np.ndarray, back: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Place among ``types`` of the word before each token; before a text's first stands the end token."""
    before = np.empty(len(back), np.int64)
    before[1:] = back[:-1]
    before[starts[:-1]] = np.searchsorted(types, np.uint64(end))
    return before


def text_keys(texts: list[str]) -> pa.Array:
    """64-bit hashes of whole texts."""
    import xxhash

    return pa.array(np.fromiter((xxhash.xxh3_64_intdigest(t.encode()) for t in texts), np.uint64, len(texts)).view(np.int64))


def score_chunk(texts: list[str], m: Model, hashes: WordHashes, learned: np.ndarray | None = None) -> dict[str, list]:
    """Figures of some texts; words beyond the head table, and tokens whose counts the filter does not hold, are listed for the joins.

    ``learned``: whether each text is one that the model was learned from.
    """
    tokens, starts = tokens_of(texts, hashes)
    end = int(hashes.of([END])[0])
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    below = m.total + 0.5 * (m.distinct + 1)
    types, back = np.unique(tokens, return_inverse=True)
    at, in_head, levels = looked_up_words(types, m)
    own = words_alone(at, in_head, levels, m)
    # base, as far as the head table knows
    value = np.zeros(len(types))
    value[in_head] = np.log10((m.head_counts[at[in_head]] + 0.5) / below)
    head = in_head[back]
    rest = np.flatnonzero(~head)
    order = rest[np.lexsort((types[back[rest]], doc[rest]))]
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (back[order][1:] != back[order][:-1])
    firsts = np.flatnonzero(new)
    times = np.diff(np.append(firsts, len(order)))
    keys, owners = types[back[order[firsts]]].view(np.int64), doc[order[firsts]]
    bounds = np.searchsorted(owners, np.arange(len(texts) + 1))
    # the model: each token behind the context before it, the first behind the end token
    number = np.full(len(types), -1, np.int64)
    number[in_head] = np.maximum(m.context, m.far)[at[in_head]]
    previous = word_before(types, back, starts, end)
    before = number[previous]
    elsewhere = is_rare(number, in_head, levels, m)[previous] & m.rare
    found = levels_behind(before, tokens, m)
    least = np.append(m.least, 1)[before]
    opens = found < least
    opens[before < 0] = False
    if learned is not None:  # their pairs were seen: what is not in the filter has the first level if all others are
        sure = learned[doc] & (least == 2) & opens
        found[sure], opens[sure] = 1, False
    p = mixed_in(own[back], before, found, m)
    asked = [[]] * len(texts)
    if m.apart or (m.far >= 0).any():
        asked, some, mass = asks(tokens, starts, ~head & m.apart & ~elsewhere, before, found, opens, own[back], m)
        p[some] = 1.0 / mass
    p[elsewhere] = 1.0
    sums = lambda x: np.add.reduceat(x, starts[:-1]) if len(texts) else x
    return {"n_tokens": np.diff(starts).tolist(), "head_known": sums(head.astype(np.int64)).tolist(), "head_score": sums(value[back]).tolist(),
            "score": sums(np.log10(p)).tolist(), "asked": asked, "text_key": text_keys(texts),
            "rest": lists(bounds, key=pa.array(keys), times=pa.array(times.astype(np.int32)))}


def gains(pairs: DataFrame, m: Model) -> DataFrame:
    """(key, n) of the pairs that the filter does not hold."""
    least = m.least
    return sifted(pairs, lambda of, q: q < least[of])


def joined_scores(scored: DataFrame, m: Model, known: Counts) -> DataFrame:
    """(__row, __more): log10 probability of the tokens in ``asked``.  Who asks for nothing joins by its row, so no key is crowded."""

    def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
        found = table.select(F.col("key").alias("__key"), "n")
        if not m.apart:  # every row asks
            return rows.withColumnRenamed(key, "__key").join(found, "__key", "left")
        found = found.withColumn("__asks", F.lit(True))
        return (rows.withColumn("__asks", F.col(key).isNotNull()).withColumn("__key", F.coalesce(F.col(key), F.col("__row"))).drop(key)
                .join(found, ["__key", "__asks"], "left"))

    # only what some token asks for is shuffled
    wanted = ["word", "weight", "pair", "known"] if m.apart else ["pair", "known"]
    rows = scored.select("__row", F.explode("asked").alias("a")).select("__row", *[f"a.{c}" for c in wanted])
    p, rough = F.col("known"), F.pow(F.lit(BASE), level_column(F.col("n")) - 0.5)
    if m.apart:
        rows = looked_up(rows, "word", known.words)
        alone_now = (F.coalesce(rough, F.lit(0.0)) + 0.5) / m.z
        rows = rows.select("__row", "pair", (p + F.coalesce(F.col("weight") * alone_now, F.lit(0.0))).alias("known"))
    if (m.far >= 0).any():
        rows = looked_up(rows, "pair", gains(known.pairs, m))
        p = p + F.coalesce(rough - DISCOUNT, F.lit(0.0))
    return rows.groupBy("__row").agg(F.sum(F.log10(p)).alias("__more"))


RARE_TOKENS = 1_000_000  # about so many learned tokens behind rare words have their hashes in one range
BLOB = "part int, kind int, chunk long, before binary, times binary, head binary, tail binary, level binary, of binary"
LEARNED, ASKED, NAMED = 0, 1, 2  # kinds of blobs, in the order in which a task needs them


def rare_ranges(m: Model) -> int:
    """Ranges of hashes of the words that were learned and are no contexts of the filter; 0 if there are none."""
    return -(-int(m.total - m.head_counts[np.maximum(m.context, m.far) >= 0].sum()) // RARE_TOKENS)


def rare_blobs(docs: DataFrame, m: Model, ranges: int) -> DataFrame:
    """Tokens behind rare words of (text, learned) as columns of bytes, a row per range of the words' hashes and stretch of texts.

    ``before`` are distinct words, ``times`` how many tokens stand behind each, ``head`` their places in the head table or -1, ``tail``
    and ``level`` the words that are not there, ``of`` the numbers of the texts in their stretch.  Tokens of texts that were learned
    have blobs of their own, and the texts of a stretch are named by their hashes in a row of kind ``NAMED``.
    """
    from pyspark import TaskContext

    shared = docs.sparkSession.sparkContext.broadcast(vars(m))
    names = [f.split(" ")[0] for f in BLOB.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = Model(**shared.value), WordHashes()
        end = int(hashes.of([END])[0])
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        named: list[np.ndarray] = []

        def out():
            words, at, tokens, levels, of, learned = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(words, kind="stable")
            for kind, some in ((LEARNED, order[learned[order]]), (ASKED, order[~learned[order]])):
                before = words[some]
                bounds = np.searchsorted(((before >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
                for part in np.flatnonzero(np.diff(bounds)).tolist():
                    here = some[bounds[part] : bounds[part + 1]]
                    own = before[bounds[part] : bounds[part + 1]]
                    firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    rest = here[at[here] < 0]
                    yield row(part, kind, chunk, own[firsts].tobytes(), np.diff(np.append(firsts, len(own))).astype(np.int32).tobytes(), at[here].tobytes(),
                              tokens[rest].tobytes(), levels[rest].tobytes(), of[here].tobytes())
            yield row(0, NAMED, chunk, np.concatenate(named).tobytes(), None, None, None, None, None)

        texts_held = size = 0
        for batch in batches:
            flags, flagged = batch.column(1).to_numpy(zero_copy_only=False), 0
            for some in by_chunks(t or "" for t in batch.column(0).to_pylist()):
                tokens, starts = tokens_of(some, hashes)
                types, back = np.unique(tokens, return_inverse=True)
                at, in_head, found = looked_up_words(types, model)
                number = np.full(len(types), -1, np.int64)
                number[in_head] = np.maximum(model.context, model.far)[at[in_head]]
                before = word_before(types, back, starts, end)
                mine = np.flatnonzero(is_rare(number, in_head, found, model)[before])
                of = np.repeat(np.arange(len(some), dtype=np.int32), np.diff(starts))[mine]
                learned = flags[flagged : flagged + len(some)][of]
                flagged += len(some)
                held.append((types[before[mine]], np.where(in_head, at, -1).astype(np.int32)[back[mine]], tokens[mine], found.astype(np.uint8)[back[mine]],
                             of + np.int32(texts_held), learned))
                named.append(text_keys(some).to_numpy())
                texts_held, size = texts_held + len(some), size + len(tokens)
                if size >= TASK_TOKENS // 3:
                    yield from out()
                    held, named, texts_held, size, chunk = [], [], 0, 0, chunk + 1
        if held:
            yield from out()

    return docs.select("text", "learned").mapInArrow(tidy(run), BLOB)


def rare_scores(docs: DataFrame, m: Model, known: Counts, ranges: int) -> DataFrame:
    """(text_key, __rare): log10 probability of the tokens of each text of (text, learned) that stand behind rare words, by the counts of those learned.

    Tokens meet in ranges of the hashes of the word before: a task holds the learned ones of one range, which are about as many in
    each, and reads the others blob by blob.  A word beyond the head table that is not in the filter gets its count by a join.
    """
    spark = docs.sparkSession
    # no filter: what it has of a word comes with the token
    shared = spark.sparkContext.broadcast((m.head_counts, m.z, m.apart))
    schema = "chunk long, docs binary, sums binary, doc int, word long, known double, weight double"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    read = lambda blob, kind: np.frombuffer(blob, kind)

    def pair_key(words, tokens):
        return mixed(words + mixed(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_counts, z, apart = shared.value
        here, pieces, counts = None, [], None

        def found(sorted_keys, asked):
            if not len(sorted_keys):
                return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
            at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
            return at, sorted_keys[at] == asked

        def result(n, **columns):
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        def scored(chunk, at, tokens, levels, of, c, learned_word, k, learned_pair):
            _, rough, _, mass, kinds = counts
            in_head = at >= 0
            own = count_of(levels)
            own[in_head] = head_counts[at[in_head]]
            own = (own + 0.5) / z
            told, weight = np.zeros(len(at)), np.ones(len(at))
            told[learned_pair] = rough[k[learned_pair]] - DISCOUNT
            c = c[learned_word]
            told[learned_word] /= mass[c]
            weight[learned_word] = DISCOUNT * kinds[c] / mass[c]
            later = ~in_head & apart
            texts, back = np.unique(of, return_inverse=True)
            sums = np.bincount(back[~later], np.log10(told + weight * own)[~later], len(texts))
            yield result(1, chunk=[chunk], docs=[texts.tobytes()], sums=[sums.tobytes()])
            if later.any():
                n = int(later.sum())
                yield result(n, chunk=np.full(n, chunk), doc=of[later], word=tokens[later].view(np.int64), known=told[later], weight=weight[later])

        def counted():
            """Counts of the range's learned tokens, which then are scored."""
            nonlocal counts
            if counts is not None:
                return
            words, tokens = (np.concatenate(x) for x in zip(*((p[1], p[3]) for p in pieces))) if pieces else (np.zeros(0, np.uint64),) * 2
            keys = pair_key(words, tokens)
            order = np.argsort(keys)
            keys = keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            firsts = np.flatnonzero(new)
            pair = np.empty(len(keys), np.int64)
            pair[order] = np.cumsum(new) - 1
            rough = count_of(level(np.diff(np.append(firsts, len(keys)))))
            contexts, of_pair = np.unique(words[order[firsts]], return_inverse=True)
            counts = keys[firsts], rough, contexts, np.bincount(of_pair, rough, len(contexts)), np.bincount(of_pair, minlength=len(contexts))
            del words, tokens, keys, order, new
            start = 0
            for chunk, words, at, tokens, levels, of in pieces:
                k = pair[start : start + len(at)]
                start += len(at)
                sure = np.ones(len(at), bool)
                yield from scored(chunk, at, tokens, levels, of, of_pair[k], sure, k, sure)
            pieces.clear()

        for batch in batches:
            for part, kind, chunk, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if part != here:
                    if here is not None:
                        yield from counted()
                    here, counts = part, None
                if kind == NAMED:
                    yield result(1, chunk=[chunk], docs=[blobs[0]])
                    continue
                words = np.repeat(read(blobs[0], np.uint64), read(blobs[1], np.int32))
                at, of = read(blobs[2], np.int32), read(blobs[5], np.int32)
                tokens, levels = at.astype(np.uint64), np.zeros(len(at), np.int64)
                tokens[at < 0], levels[at < 0] = read(blobs[3], np.uint64), read(blobs[4], np.uint8)
                if kind == LEARNED:
                    pieces.append((chunk, words, at, tokens, levels, of))
                    continue
                yield from counted()
                yield from scored(chunk, at, tokens, levels, of, *found(counts[2], words), *found(counts[0], pair_key(words, tokens)))
        if here is not None:
            yield from counted()

    def summed(blobs: pa.Table) -> pa.Table:
        rows = blobs.to_pylist()
        keys = np.concatenate([read(r["docs"], np.int64) for r in rows if r["sums"] is None])
        more = np.zeros(len(keys))
        for r in rows:
            if r["sums"] is not None:
                more[read(r["docs"], np.int32)] += read(r["sums"], np.float64)
        return pa.table({"chunk": pa.array(np.full(len(keys), rows[0]["chunk"])), "doc": pa.array(np.arange(len(keys), dtype=np.int32)), "text_key": pa.array(keys), "more": pa.array(more)})

    met = stage(rare_blobs(docs, m, ranges).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(tidy(run), schema))
    out = met.df.where("docs IS NOT NULL").groupBy("chunk").applyInArrow(summed, "chunk long, doc int, text_key long, more double")
    if m.apart:
        words = known.words.select(F.col("key").alias("word"), "n")
        rough = F.coalesce(F.pow(F.lit(BASE), level_column(F.col("n")) - 0.5), F.lit(0.0))
        rest = met.df.where("word IS NOT NULL").join(words, "word", "left").groupBy("chunk", "doc").agg(
            F.sum(F.log10(F.col("known") + F.col("weight") * (rough + 0.5) / m.z)).alias("more"))
        out = (out.unionByName(rest, allowMissingColumns=True).groupBy("chunk", "doc")
               .agg(F.max("text_key").alias("text_key"), F.sum("more").alias("more")))
    # equal texts have equal sums, but for the order in which they were added
    once = stage(out.groupBy("text_key").agg(F.max("more").alias("__rare"))).df
    met.drop()
    return once


def score_texts(docs: DataFrame, m: Model, known: Counts, keep: list[str], held: str | None = None, rare: DataFrame | None = None) -> DataFrame:
    """Columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score of ``text``.

    ``held``: one of them, false in the rows that the model was learned from.  ``rare``: what ``rare_scores`` has for these texts.
    """
    from .common import map_texts

    shared = docs.sparkSession.sparkContext.broadcast(vars(m))

    def per_text():
        model, hashes = Model(**shared.value), WordHashes()
        if held is None:
            return lambda texts: score_chunk(texts, model, hashes)
        return lambda texts, flags: score_chunk(texts, model, hashes, ~flags.to_numpy(zero_copy_only=False))

    fields = "n_tokens long, head_known long, head_score double, score double, text_key long, rest array<struct<key:long,times:int>>, "
    fields += "asked array<struct<word:long,weight:double,pair:long,known:double>>"
    scored = map_texts(docs.select(*keep, "text"), per_text, fields, beside=held).drop("text")
    scored = stage(scored.withColumn("__row", F.monotonically_increasing_id())).df  # row numbers are fixed once written
    below = m.total + 0.5 * (m.distinct + 1)
    n = F.coalesce(F.col("n"), F.lit(0))
    rest = scored.select("__row", F.explode("rest").alias("r")).select("__row", "r.key", "r.times")
    sums = (rest.join(known.words, "key", "left").groupBy("__row")
            .agg(F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(below))).alias("__score"), F.sum(F.when(n > 0, F.col("times"))).alias("__known")))
    whole = scored.join(sums, "__row", "left")
    score = F.col("score")
    if m.apart or (m.far >= 0).any():
        whole = whole.join(joined_scores(scored, m, known), "__row", "left")
        score = score + F.coalesce("__more", F.lit(0.0))
    if rare is not None:
        whole = whole.join(rare, "text_key", "left")
        score = score + F.coalesce("__rare", F.lit(0.0))
    return whole.select(
        *keep, "n_tokens", (F.col("head_known") + F.coalesce("__known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(m.total).cast("long").alias("train_tokens"), (F.col("head_score") + F.coalesce("__score", F.lit(0.0))).alias("base_score"), score.alias("score"))


def learn_and_score(docs: DataFrame, folds: int = 5, held: int = 1, whole: bool = False) -> DataFrame:
    """Learns from all folds but one of (doc_id, text) and scores every row.

    ``whole``: pairs behind words that are too rare for the filter count as well.
    """
    held_out = fold(F.col("doc_id"), folds) == held
    with shuffles_freed(docs.sparkSession):
        model, known = learn(docs.where(~held_out).select("text"))
        ranges, rare = rare_ranges(model) if whole else 0, None
        if ranges:
            model.rare = True
            rare = rare_scores(docs.select("text", (~held_out).alias("learned")), model, known, ranges)
        return score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), model, known, ["doc_id", "held_out"], "held_out", rare)
