"""Licence scan, conversation trie and ranked search: against brute force, and on nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from depfleet.llm import lexical, licenses, prefix_trie  # noqa: E402
from depfleet.llm.queries import ORACLES, QUERIES  # noqa: E402
from tools.check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_prefix_trie", "op13_lexical_search"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


# licences

def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def base_places(text):
    """Places of the base phrases, compared at every word."""
    ws, out = words(text), []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        out += [(i, label) for i in range(len(ws)) if ws[i:i + len(p)] == p]
    return len(ws), sorted(out)


def test_licenses_against_brute_force_and_odd_rows(spark):
    rng = random.Random(5)
    pieces = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by", "nc", "mit", "license", "under the", "é", "ſ", "version 2", "\n", "--"]
    texts = [None, "", " \n", "mit", "MIT-License", "CC BY-NC\x00CC-BY-NC", "under the mit licence", "x " * 30_000 + "under the mit license", "cc by nc " * 3000]
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Licensed under CC BY-NC 4.0.")] * 2 + [(0, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit(7)).withColumn("__w", F.lit("x"))
    got = licenses.scan_licenses(df).drop("places").collect()
    assert len(got) == len(rows)
    for r in got:
        n, places = base_places(texts[r.doc_id] if r.doc_id is not None else "Licensed under CC BY-NC 4.0.")
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_licence_texts_with_changed_words(spark):
    text = {t.label: t.text for t in licenses.TEXTS}
    changed = re.sub(r"\bSoftware\b", "Program", text["zlib"])
    added = text["mit"].replace("to any person", "to any person").replace("The above copyright", "Copyright of Some Body and Friends The above copyright")
    cut = text["mit"].replace("without warranty of any kind".upper(), "")
    cases = [(text["mit"], "mit"), (added, "mit"), (cut, ""), (text["bsd"], "bsd"), (text["bsd-3"], "bsd,bsd-3"), (text["isc"], "isc"), (changed, "zlib"),
             (text["gpl-3"], "gpl-3"), (text["gpl-2"], "gpl-2"), (text["apache-2"], "apache-2"), ("filler " * 500 + text["zlib"] + " filler" * 500, "zlib"),
             ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("the public software license is a general one", ""),
             (" ".join(sorted(set(text["mit"].split()))), "")]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], DOCS)).collect()
    assert [(r.doc_id, r.labels) for r in sorted(got)] == [(i, want) for i, (_, want) in enumerate(cases)]
    assert all((r.score > 0) == bool(r.labels) for r in got)


# the trie

def brute_nodes(rows):
    """One row for each prefix of each conversation, by listing them all."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, text))
    seqs = {c: [(x[2], x[4]) for x in sorted(s)] for c, s in own.items()}
    built = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = seqs.get(c - int(math.fmod(c, 5)), [])[:h] + s[h:]
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    leaf = {k for k in members if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)}
    out = set()
    for k, found in members.items():
        under = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in found if len(built[c]) == len(k))))
        out.add((min(found), len(k), min(members[k[:-1]]) if k else None, len(found), sum(len(x) == len(k) + 1 for x in under), sum(x in leaf for x in under),
                 sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n, most, says, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-n, 3 * n), n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None][:kinds]), rng.choice(says)))
    return rows


@pytest.mark.parametrize("block_turns", [5, 23, 100_000])
def test_trie_against_brute_force(spark, block_turns):
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(4)]
    deep = [(c, t, "user", "on") for c in range(2000, 2006) for t in range(40 + c % 3)]
    rows = conversations(1, 90, 7, ["a", "b", "é€", "", None], 2) + copies + deep + [(None, 1, "user", "x"), (7777, None, None, None), (7777, None, None, None), (7778, 2, "user", "x")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(7).withColumn("block", F.lit(1)), block_turns)
    assert got.columns == list(prefix_trie.NODE)
    found = [tuple(r) for r in got.collect()]
    want = brute_nodes(rows)
    assert len(found) == len(want) and set(found) == want


def test_trie_of_nothing_and_of_one(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    # conversation 3 takes its first turns from 0, which is absent: nothing is left of it, and it ends at the root
    assert zlib.crc32(b"3") % 9 >= 1
    only = prefix_trie.conversation_trie(spark.createDataFrame([(3, 1, "user", "x")], TURNS)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in only] == [(3, 0, 1, 1, hashlib.sha256(b"3").hexdigest())]


def test_range_minimum_searches():
    import numpy as np
    rng = np.random.default_rng(3)
    lcp = rng.integers(0, 4, 200)
    table = prefix_trie.sparse_table(lcp)
    at, depth = np.repeat(np.arange(200), 4), np.tile(np.arange(4), 200)
    right, left = prefix_trie.right_ends(table, at, depth), prefix_trie.left_ends(table, at, depth)
    for i, d, r, l in zip(at, depth, right, left):
        want = next((j for j in range(i + 1, 200) if lcp[j] < d), 200) - 1
        assert r == want
        assert l == next((j for j in range(i, 0, -1) if lcp[j] < d), 0)


# ranked search

def brute_ranks(docs, items, k):
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for _, t in docs]
    terms = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws] for ws in terms]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for ws in terms for w in set(ws))
    out = []
    for item, text in items:
        asked = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")}
        found = []
        for (doc, _), ws in zip(docs, terms):
            tf = Counter(ws)
            score = 0
            for w in asked & set(tf):
                m = 50 + (50 * len(ws) * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 20 * m))
            if score:
                found.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("chunk,block_terms", [(40, 25), (2_000_000, 100_000)])
def test_search_against_brute_force(spark, chunk, block_terms):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "ſ", "A-B", "x_y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))) for i in range(700)]
    docs += [(900 + i, "w0 w1 W2 w3") for i in range(120)] + [(None, "w0 w1 w2 w3"), (None, None), (5, "w50 w51"), (None, ""), (77, "w2 " * 5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)] + [(None, "w0 w1"), (3, "w4"), (3, "w4"), (40, None), (41, ""), (42, "absent")]
    table = spark.createDataFrame(docs, DOCS).repartition(3).withColumn("score", F.lit("x"))
    found = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms, chunk_postings=chunk)
    got = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == sorted(brute_ranks(docs, items, 50), key=repr)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a")], DOCS), items.where("false")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "!")], DOCS), items).count() == 0


def test_accumulators_and_skipping_lose_nothing():
    import numpy as np
    rng = np.random.default_rng(4)
    n = 20_000
    lists = []
    for size in (15_000, 12_000, 6_000, 400, 90, 3, 0):
        places = np.sort(rng.choice(n, size, replace=False)).astype(np.int64)
        lists.append((places, rng.integers(1, 2000 if size > 1000 else 40_000, size)))
    full = np.zeros(n, np.int64)
    for places, gains in lists:
        full[places] += gains
    keys = rng.permutation(n).astype(np.int64)
    top = lexical.TopK(50)
    lexical.rank_chunk(lists, keys, top, n)
    best = np.lexsort((keys, -full))[:50]
    assert (top.scores == full[best]).all() and (top.keys == keys[best]).all()


def test_rows_without_ids(spark):
    """Dropping by ids keeps nulls, repeated rows and odd columns, and reads whole numbers of any width alike."""
    from depfleet.llm.common import without_ids
    docs = spark.createDataFrame([(i % 50 if i else None, "t", i) for i in range(200)], "doc_id int, __block string, __may int")
    ids = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "doc_id long")
    left = without_ids(docs, ids, 17)
    assert left.columns == docs.columns
    assert sorted(r["__may"] for r in left.collect()) == [i for i in range(200) if not i or i % 50 % 3]
    assert without_ids(docs, ids.where("false"), 0).count() == 200


def test_stages_with_odd_columns(spark):
    from depfleet.llm import stages
    text = " ".join(f"alpha{i} beta{i % 17}." for i in range(80))
    docs = spark.createDataFrame([(1, text, 5, "a", "b", "c"), (2, None, None, "a", "b", "c")], "doc_id long, text string, n_chars long, __cleaned string, cleaned string, __doc string")
    for name, apply in stages.STAGES[:1] + stages.STAGES[3:4]:
        out = apply(spark, docs, "")
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1}, name
        assert out.where("doc_id = 1").first()["text"] == text


def test_decoding_in_stretches():
    import pyarrow as pa

    from depfleet.llm import bpe
    pieces = pa.array([b"a", None, b"\xc3", b"\xa9", b"", "日".encode()], pa.large_binary())
    import numpy as np
    rows = [[0, 2, 3, 5], [], None, [2], [4, 4], [5] * 9]
    packed = pa.array([None if r is None else np.array(r, "<u4").tobytes() for r in rows], pa.binary())
    want = ["aé日", "", None, "�", "", "日" * 9]
    for chunk in (1, 3, 1000):
        assert bpe.decode_packed(packed, pieces, chunk).to_pylist() == want
        assert bpe.decode_packed(packed.slice(2), pieces, chunk).to_pylist() == want[2:]
    for wrong in ([1], [6]):
        with pytest.raises(ValueError):
            bpe.decode_packed(pa.array([np.array(wrong, "<u4").tobytes()]), pieces)
