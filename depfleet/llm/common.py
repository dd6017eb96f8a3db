"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom

# fixed values: the white space of the word rules, and A-Z with their lower case
SPACES = " \t\n\x0b\f\r"
WORD_GAP = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def fold(key: Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for mapInArrow; a worker that waits for its next task then gives the memory of this one back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library keeps it

    return run


def by_chunks(texts: Iterable[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in lists of about so many characters, so that memory follows the chunk and not the batch."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def map_texts(df: DataFrame, per_text: Callable[[], Callable[[list[str]], dict]], fields: str, col: str = "text", chars: int = 4_000_000,
              beside: str | None = None) -> DataFrame:
    """Adds columns computed from whole texts, row for row.

    ``per_text`` is called once a task and gives a function from a list of texts to columns as lists or Arrow arrays.  All other
    columns pass through untouched; a column of ``df`` with the name of a new one is replaced.  The function also gets the values
    of the column ``beside``, if one is named.
    """
    from pyspark.sql.types import _parse_datatype_string

    added = _parse_datatype_string(fields).fields
    names = [f.name for f in added]
    kept = [c for c in df.columns if c not in names]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    carry_text = col in kept
    source = df.select(*[F.col(f"`{c}`") for c in kept], *([] if carry_text else [F.col(f"`{col}`")]))
    for f in added:
        schema = schema.add(f)
    text_at, n_kept = source.columns.index(col), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        work = per_text()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            at = 0
            for chunk in by_chunks(texts, chars):
                part = batch.slice(at, len(chunk))
                out = work(chunk) if beside is None else work(chunk, part.column(kept.index(beside)))
                at += len(chunk)
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(n_kept)]
                cols += [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return source.mapInArrow(tidy(run), schema)


def without_ids(docs: DataFrame, ids: DataFrame, n_ids: int, key: str = "doc_id") -> DataFrame:
    """Rows whose whole-number key is not in ``ids`` (one column, distinct); rows without a key stay.

    A Bloom filter of the ids lets most rows pass where they are: only those it may hold are shuffled for the exact join.
    """
    if not n_ids:
        return docs
    gone = ids.select(F.col(key).cast("long").alias("gone"))
    blocks = bloom.block_count(n_ids, bloom.MAX_BLOCKS * 8)
    rows = bloom.marked(docs, F.col(f"`{key}`").cast("long"), bloom.build(gone, F.col("gone"), blocks), blocks, "may")
    asked = rows.where("may").join(gone, F.col(f"row.`{key}`").cast("long") == F.col("gone"), "left_anti")
    return rows.where("NOT may").select("row.*").unionByName(asked.select("row.*"))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept up to a bound."""

    BOUND = 120_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


# XXH3 of up to 32 bytes, as the xxhash library has it: words of its fixed secret, and primes
_SECRET = bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c")
_GAPS = SPACES.encode()


def _fold128(a, b):
    """Both halves of the 128-bit product, by exclusive or."""
    import numpy as np

    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    ll, hl, lh = (a & low) * (b & low), (a >> half) * (b & low), (a & low) * (b >> half)
    cross = (ll >> half) + (hl & low) + lh
    return ((hl >> half) + (cross >> half) + (a >> half) * (b >> half)) ^ ((cross << half) | (ll & low))


def text_words(texts: list[str]):
    """Hashes of the words of all texts, as ``WordHashes`` gives them, and where each text's words begin, with the end last.

    The words of all texts are hashed together by their length, with no object a word; those over 32 bytes one by one.
    """
    import numpy as np
    import xxhash

    raw = [t.encode() for t in texts]
    data = b" ".join([*raw, b""]).lower()
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    is_gap = np.zeros(256, bool)
    is_gap[list(_GAPS)] = True
    gap = np.concatenate([[True], is_gap[np.frombuffer(data, np.uint8)]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    at, size = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    u, key = np.uint64, lambda k: np.uint64(int.from_bytes(_SECRET[k : k + 8], "little"))
    low = u(0xFFFFFFFF)

    def avalanche(h):
        h = (h ^ (h >> u(37))) * u(0x165667919E3779F9)
        return h ^ (h >> u(32))

    out = np.empty(len(at), np.uint64)
    kind = np.searchsorted([4, 9, 17, 33], size, "right")
    some = np.flatnonzero(kind == 0)
    if len(some):
        n, p = size[some].astype(u), at[some]
        first, mid, last = (eight[k] & u(0xFF) for k in (p, p + (size[some] >> 1), p + size[some] - 1))
        h = ((first << u(16)) | (mid << u(24)) | last | (n << u(8))) ^ ((key(0) & low) ^ (key(0) >> u(32)))
        h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
        out[some] = h ^ (h >> u(32))
    some = np.flatnonzero(kind == 1)
    if len(some):
        n, p = size[some].astype(u), at[some]
        h = (((eight[p] & low) << u(32)) + (eight[p + size[some] - 4] & low)) ^ (key(8) ^ key(16))
        h ^= ((h << u(49)) | (h >> u(15))) ^ ((h << u(24)) | (h >> u(40)))
        h *= u(0x9FB21C651E98DF25)
        h = (h ^ ((h >> u(35)) + n)) * u(0x9FB21C651E98DF25)
        out[some] = h ^ (h >> u(28))
    some = np.flatnonzero(kind == 2)
    if len(some):
        lo, hi = eight[at[some]] ^ (key(24) ^ key(32)), eight[at[some] + size[some] - 8] ^ (key(40) ^ key(48))
        out[some] = avalanche(size[some].astype(u) + lo.byteswap() + hi + _fold128(lo, hi))
    some = np.flatnonzero(kind == 3)
    if len(some):
        p, q = at[some], at[some] + size[some] - 16
        out[some] = avalanche(size[some].astype(u) * u(0x9E3779B185EBCA87) + _fold128(eight[p] ^ key(0), eight[p + 8] ^ key(8))
                              + _fold128(eight[q] ^ key(16), eight[q + 8] ^ key(24)))
    for k in np.flatnonzero(kind == 4).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[at[k] : at[k] + size[k]])
    return out, np.searchsorted(at, np.concatenate([[0], ends]))


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z in lower case (both are what the methods of bytes know)."""
    return text.encode().lower().split()


def mixed(x):
    """Spreads 64-bit values so that every bit depends on all (numpy, in wrapping arithmetic)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
