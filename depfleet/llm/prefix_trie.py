"""The prefix trie of conversations by range minima over sorted common prefixes.

A conversation is its sequence of turn digests.  All conversations are sorted by (sequence, id) and dealt to blocks by
range, so that copies of one conversation spread over as many blocks as they need.  In a block the lengths of the common
prefixes of neighbours (LCP) get a sparse table of minima over spans of 1, 2, 4, ... rows.  The first row with a prefix stands
for its node; each such candidate searches its left and right end by itself, by halving steps over the table: members
lie between the nearest rows whose LCP is below the depth.  There is no stack and no order among candidates.  Sums over a
subtree are differences of running sums, as the candidates of a subtree are neighbours.

A node whose members go on in the next or the former block is found in pieces, at most two for each depth of a block's
first and last row; pieces are put together by the digest of their prefix.  The list of ids that end at such a node is
digested by streaming its pieces in order, so it is never held whole.

Defined results: turns are ordered by (turn, role, digest of role and text), null turns first; a null role or text is empty;
equal rows are turns of their own; a row without conv_id belongs to no conversation; columns beyond the four are ignored; an
empty table has no node, not even a root, as nothing is a member.  What a task gathers by one id is one conversation's
turns at 16 bytes of digest each, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from depfleet.staging import stage

WIDTH = 16             # bytes of a turn's digest
BLOCK_TURNS = 100_000  # turns a block should have
SHARED = 5             # conversations that share the opening of one of them
MOST_SHARED = 9        # openings are shorter than this


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): the turns of each conversation as structs of digest and UTF-8 bytes, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    row = F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("h"), F.octet_length(text).cast("long").alias("b"))
    return (turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("r"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("s"))
            .select("conv_id", F.transform("s", lambda r: F.struct(r["h"].alias("h"), r["b"].alias("b"))).alias("seq")))


def shared_openings(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the conversation whose id is the next lower multiple of five."""
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    opening = convs.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("of"), F.slice("seq", 1, MOST_SHARED - 1).alias("opening"))
    joined = convs.select("conv_id", "seq", base.alias("of"), taken.alias("h")).join(opening, "of", "left")
    first = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.slice("seq", F.lit(1), F.lit(0)))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("seq"))


PIECE = ("block int, key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, "
         "last_bytes long, ends binary, digest string, piece int, parent_piece int, above array<binary>")


def _flat(column: pa.Array, kind: str):
    """Offsets and flat values of a list column, whatever slice it is."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if kind == "b":
        return lengths, values.to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, np.frombuffer(b"".join(values.to_pylist()), dtype=np.dtype(("V", WIDTH)))


def common_prefixes(start, lengths, words):
    """LCP of each row with the one before it; 0 for the first.  ``words``: digests as pairs of 64-bit numbers."""
    import numpy as np

    lcp = np.zeros(len(lengths), np.int64)
    alive = np.arange(1, len(lengths))
    depth = 0
    while len(alive):
        alive = alive[np.minimum(lengths[alive], lengths[alive - 1]) > depth]
        alive = alive[(words[start[alive] + depth] == words[start[alive - 1] + depth]).all(axis=1)]
        depth += 1
        lcp[alive] = depth
    return lcp


def sparse_table(values):
    """Minima over spans of 1, 2, 4, ... values, each from two spans of half the size."""
    import numpy as np

    rows, span = [values], 1
    while 2 * span <= len(values):
        rows.append(np.minimum(rows[-1][: len(rows[-1]) - span], rows[-1][span:]))
        span *= 2
    return rows


def right_ends(table, at, depth):
    """For each (row, depth): the last row j >= row such that all LCPs in (row, j] reach the depth."""
    import numpy as np

    n = len(table[0])
    end = at.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = end + (1 << k) < n
        probe = np.where(fits, end + 1, 0)
        end += np.where(fits & (table[k][np.minimum(probe, len(table[k]) - 1)] >= depth), 1 << k, 0)
    return end


def left_ends(table, at, depth):
    """For each (row, depth): the first row i <= row such that all LCPs in (i, row] reach the depth."""
    import numpy as np

    begin = at.copy()
    for k in range(len(table) - 1, -1, -1):
        probe = begin - (1 << k) + 1
        fits = probe >= 1
        begin -= np.where(fits & (table[k][np.minimum(np.maximum(probe, 0), len(table[k]) - 1)] >= depth), 1 << k, 0)
    return begin


def span_minima(table, left, right):
    """Minimum of the values at left..right, from two spans that may overlap."""
    import numpy as np

    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), np.int64)
    for level in np.unique(k):
        some = k == level
        out[some] = np.minimum(table[level][left[some]], table[level][right[some] - (1 << int(level)) + 1])
    return out


def block_pieces(block: int, ids, lengths, words, raw, sizes, before: int, after: int) -> dict:
    """Nodes and pieces of nodes in one block of the sorted order.

    ``before`` and ``after`` are the LCPs with the neighbouring blocks, -1 at both ends of the order.  A candidate is
    (row, depth) with depth above the row's LCP; the first row has all its depths from 0, the root.
    """
    import numpy as np

    n = len(ids)
    start = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    lcp = common_prefixes(start, lengths, words)
    table = sparse_table(lcp)
    lowest = lcp + 1
    lowest[0] = 0
    made = lengths - lowest + 1                        # candidates of a row; 0 for a copy of the row before
    offset = np.concatenate(([0], np.cumsum(made)))
    at = np.repeat(np.arange(n), made)
    depth = np.arange(len(at)) - offset[at] + lowest[at]
    left, right = left_ends(table, at, depth), right_ends(table, at, depth)
    members = right - left + 1
    conv = span_minima(sparse_table(ids), left, right)

    # copies of a sequence follow each other: the run of equal rows from a candidate's own row on
    copy = made == 0
    copy[0] = False
    runs = np.concatenate((np.flatnonzero(~copy), [n]))
    run_end = np.repeat(runs[1:], np.diff(runs))       # one past the last copy of a row
    ends_here = lengths[at] == depth
    n_ends = np.where(ends_here, run_end[at] - at, 0)

    # a candidate's parent: one less deep on its row, or the node of that depth whose left end is searched
    parent = np.arange(len(at)) - 1
    top = (depth == lowest[at]) & (depth > 0)
    host = left_ends(table, at[top], depth[top] - 1)
    parent[top] = offset[host] + depth[top] - 1 - lowest[host]
    rooted = depth > 0
    from_left = (at == 0) & (depth <= before)
    is_open = from_left | ((right == n - 1) & (depth <= after))
    born = rooted & ~from_left                         # a node from the left was counted as a child where it began
    children = np.bincount(parent[born], minlength=len(at))
    leaf = (children == 0) & ~is_open
    last = np.zeros(len(at), np.int64)
    last[rooted] = sizes[(start[at] + depth - 1)[rooted]] if rooted.any() else 0
    own = np.where(is_open, 0, (members - 1) * last)
    until = offset[right + 1]                          # the subtree's candidates are neighbours
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (leaf.astype(np.int64), own)]
    here = np.arange(len(at))
    n_leaves, saved = (s[until] - s[here] for s in sums)

    texts = list(map(str, ids.tolist()))
    listed = [",".join(texts[a:a + k]).encode() if k else b"" for a, k in zip(at.tolist(), n_ends.tolist())]
    shut = (~is_open).tolist()
    digest = [hashlib.sha256(x).hexdigest() if s else None for x, s in zip(listed, shut)]
    opened = np.flatnonzero(is_open)
    number = np.full(len(at), -1)
    number[opened] = np.arange(len(opened))
    keys: list = [None] * len(at)
    above: list = [None] * len(at)
    for row in np.unique(at[opened]).tolist():
        mine = opened[at[opened] == row]
        deepest, running, chain = int(depth[mine].max()), hashlib.sha256(), []
        for d in range(deepest + 1):
            if d:
                running.update(raw[int(start[row]) + d - 1].tobytes())
            chain.append(running.digest())
        for c in mine.tolist():
            keys[c], above[c] = chain[depth[c]], chain[: depth[c]]
    safe = np.maximum(parent, 0)
    open_parent = rooted & is_open[safe]
    return {
        "block": [block] * len(at), "key": keys, "depth": depth, "conv_id": conv,
        "parent_conv_id": pa.array(conv[safe], mask=~rooted | open_parent), "n_convs": members, "n_children": children, "n_leaves": n_leaves,
        "saved": saved, "last_bytes": last, "ends": [None if s else x for x, s in zip(listed, shut)], "digest": digest,
        "piece": pa.array(number, mask=~is_open), "parent_piece": pa.array(number[safe], mask=~open_parent | is_open), "above": above}


def sorted_blocks(convs: DataFrame, blocks: int) -> DataFrame:
    """All conversations in order, with the number of their block: a range of the order that one file holds."""
    spread = convs.repartitionByRange(blocks, "h", "conv_id").sortWithinPartitions("h", "conv_id")
    return spread.withColumn("block", F.spark_partition_id())


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Batches of a task that are sorted by block, put together per block."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    now = None
    for batch in rows:
        at = 0
        while at < batch.num_rows:
            block = batch.column("block")[at].as_py()
            n = pc.sum(pc.equal(batch.column("block"), block)).as_py()
            if block != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = block
            held.append(batch.slice(at, n))
            at += n
    if held:
        yield now, pa.Table.from_batches(held)


def trie_nodes(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """All nodes of the trie of ``convs`` (conv_id, seq): what the module says, one row per node."""
    spark = convs.sparkSession
    wide = convs.select("conv_id", F.transform("seq", lambda t: t["h"]).alias("h"), F.transform("seq", lambda t: t["b"]).alias("b"))
    given = stage(wide, turns=F.sum(F.size("h")))
    blocks = max(1, -(-(given.rows + (given.facts["turns"] or 0)) // block_turns))
    order = stage(sorted_blocks(given.df, blocks))
    given.drop()

    # the first and last row of each block meet those of the next block that has rows
    edge = F.struct(F.col("h").alias("h"), F.col("conv_id").alias("c"))
    rims = stage(order.df.groupBy("block").agg(F.min(edge).alias("lo"), F.max(edge).alias("hi")))
    line = Window.orderBy("block")  # one row for each block
    near = rims.df.select("block", F.col("lo.h").alias("first"), F.lag("hi.h").over(line).alias("last"))
    length = F.least(F.size("first"), F.size("last"))
    differ = F.array_position(F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(F.col("first"), i) == F.get(F.col("last"), i)), False)
    lcp = F.when(F.col("last").isNull(), F.lit(-1)).when(length == 0, F.lit(0)).when(differ == 0, length).otherwise(differ - 1).cast("int")
    lined = near.select("block", lcp.alias("before"))
    lined = lined.select("block", "before", F.coalesce(F.lead("before").over(line), F.lit(-1)).alias("after"))
    # a block's own rows follow one row with its two outer LCPs: null digests sort first
    head = lined.select("block", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<binary>").alias("h"), F.array("before", "after").cast("array<long>").alias("b"))
    ready = order.df.unionByName(head).repartition(blocks, "block").sortWithinPartitions("block", "h", "conv_id")

    schema = to_arrow_schema(_parse_datatype_string(PIECE))

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for block, part in _blocks(rows):
            before, after = part.column("b")[0].as_py()
            part = part.slice(1)
            lengths, raw = _flat(part.column("h"), "h")
            sizes = _flat(part.column("b"), "b")[1]
            words = np.frombuffer(raw.tobytes(), np.uint64).reshape(-1, WIDTH // 8)
            ids = part.column("conv_id").to_numpy().astype(np.int64)
            out = block_pieces(block, ids, lengths, words, raw, sizes, before, after)
            done = pa.Table.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in schema], schema=schema)
            yield from done.to_batches(max_chunksize=20_000)

    found = stage(ready.mapInArrow(pieces, PIECE)).df
    order.drop()
    rims.drop()
    return _together(found, blocks)


def _stream_digests(ends: DataFrame, blocks: int) -> DataFrame:
    """(key, digest): the digest of each key's pieces, joined by commas in order of block, read one after another."""
    dealt = ends.select("key", "block", "ends").repartition(blocks, "key").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for k, part in zip(batch.column(0), batch.column(2)):
                k = k.as_py()
                if k != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = k, hashlib.sha256(part.as_py())
                else:
                    state.update(b",")
                    state.update(part.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "digest"])

    return dealt.mapInArrow(run, "key binary, digest string")


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _together(found: DataFrame, blocks: int) -> DataFrame:
    """Nodes that lie in one block, and the others from their pieces."""
    open_rows = found.where("piece IS NOT NULL")
    merged = open_rows.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("last_bytes").alias("last_bytes"), F.max("above").alias("above"))
    merged = stage(merged.withColumns({
        "own": (F.col("n_convs") - 1) * F.col("last_bytes"), "leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")})).df
    # what such a node adds to those above it, which are all of this kind
    given = merged.select(F.explode(F.concat("above", F.array("key"))).alias("key"), "own", "leaf").groupBy("key").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    ended = _stream_digests(open_rows.where(F.length("ends") > 0), blocks)
    parents = merged.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    wide = (merged.drop("own", "leaf").join(given, "key").join(ended, "key", "left").withColumn("up", F.try_element_at("above", F.lit(-1)))
            .join(parents, "up", "left"))
    wide = stage(wide.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
                             (F.col("saved") + F.col("own")).alias("saved_tokens"), F.coalesce("digest", F.lit(none)).alias("ends_sha256"))).df

    shut = found.where("piece IS NULL").select(
        "block", "parent_piece", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"))
    inner = shut.where("parent_piece IS NULL")
    # a block's few pieces carry the joined node's id back to the block's own rows
    back = open_rows.select("key", "block", F.col("piece").alias("parent_piece")).join(wide.select("key", F.col("conv_id").alias("up_conv")), "key")
    outer = (shut.where("parent_piece IS NOT NULL").join(back.drop("key").hint("shuffle_hash"), ["block", "parent_piece"])
             .withColumn("parent_conv_id", F.col("up_conv")))
    return inner.select(*NODE).unionByName(outer.select(*NODE)).unionByName(wide.select(*NODE))


def conversation_trie(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of ``turns`` (conv_id, turn, role, text) after shared openings are put in."""
    convs = stage(sequences(turns))
    return trie_nodes(shared_openings(convs.df), block_turns)


def _crc32_sql(number: str) -> str:
    """CRC-32 of a number's decimal text: each byte is mixed in, then eight bits are shifted out."""
    signs = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT)] || [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce([4294967295::BIGINT] || flatten({signs}), lambda a, x: {step}), 4294967295)"


def trie_sql() -> str:
    """The same rows by listing every prefix of every conversation."""
    return f"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, s, conv_id - conv_id % {SHARED} AS base, {_crc32_sql('conv_id')} % {MOST_SHARED} AS h FROM t),
c AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN t b ON b.conv_id = h.base),
p AS (SELECT conv_id, s[1:d] AS k, d, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c)),
g AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM p GROUP BY ALL),
f AS (SELECT a.k, a.depth, a.conv_id, a.n_convs, a.ends, b.conv_id AS parent_conv_id, (SELECT count(*) FROM g x WHERE x.depth = a.depth + 1 AND x.k[1:a.depth] = a.k) AS n_children,
  CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * strlen(a.k[a.depth].t) END AS own
  FROM g a LEFT JOIN g b ON b.depth = a.depth - 1 AND b.k = a.k[1:a.depth - 1]),
z AS (SELECT a.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(x.own) AS saved FROM
  (SELECT k, depth, n_children, own, unnest(range(0, depth + 1)) AS up FROM f) x JOIN g a ON a.depth = x.up AND a.k = x.k[1:x.up] GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, z.n_leaves::BIGINT AS n_leaves,
  z.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256 FROM f JOIN z ON z.k = f.k"""
