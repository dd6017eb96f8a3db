"""Text operators on small tables: against brute force, and on nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import html as htmllib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from depfleet.llm import (bloom, bpe, common, decontaminate, html_text, jaccard, lm_bloom, quality, secret_scan, stages, token_counts, toxicity,  # noqa: E402
                          url_filter)
from depfleet.llm.common import fold, mixed  # noqa: E402
from depfleet.staging import stage  # noqa: E402

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} of text{i}" for i in range(9000))
PROSE = " ".join(f"alpha{i} beta{i % 17}." for i in range(80))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = [None, "", " ", "\n\n\t", "a", PROSE, PROSE, LONG, "日本語 😀 ▁x▁  two  spaces \x00", "x" * 20000, "<|endoftext|>a <s> </s> <0x0A>"]


def test_token_counts_equal_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, ODD).withColumn("n_bytes", F.lit("clash")), PIECES).collect()}
    for i, t in enumerate(ODD):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts.count_tokens(table(spark, []), PIECES).count() == 0


def test_bpe_equals_library_and_round_trips(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(BYTES)
    rows = bpe.encode(table(spark, ODD).withColumn("ids", F.lit(1)), BYTES).withColumn("back", bpe.decode(F.col("ids"), BYTES)).collect()
    for r in rows:
        ids = lib.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.back == (ODD[r.doc_id] or "")
    both = {r.doc_id: r for r in bpe.round_trip(table(spark, ODD).withColumn("decoded", F.lit(1)), BYTES).collect()}
    assert all(both[r.doc_id].ids == r.ids and both[r.doc_id].decoded == r.back for r in rows)
    assert bpe.encode(table(spark, []), BYTES).count() == 0 and bpe.round_trip(table(spark, []), BYTES).count() == 0
    # bytes that are no UTF-8 become replacement signs
    cut = spark.createDataFrame([(bytearray(np.array([lib.encode("é").ids[0], 160], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r[0] for r in cut.select(bpe.decode(F.col("ids"), BYTES)).collect()][1] is None


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secrets(spark):
    import base64
    key = der(0x30, b"".join(der(2, x) for x in (b"\0", b"\x7f" * 64, b"\x01\0\x01", *[b"\x55" * 32] * 6)))
    packed = base64.b64encode(key).decode()
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{packed[:64]}\n{packed[64:]}\n-----END RSA PRIVATE KEY-----"
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"me","n":1}', b"sig"))
    ssh = base64.b64encode(b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b""))).decode()
    no_key = base64.b64encode(b"just some long harmless sentence, nothing more").decode()
    texts = [f"a {block} b", f"see {token} ok", f"k {packed} z", f"h {key.hex()} z", f"s {ssh} z", f"n {no_key} z", 'PassWord = "abc12"', 'é secret=token:abcdef api-key: "s3cr3t77"',
             "AKIA" + "A" * 16 + " AKIA" + "B" * 15, None, "", "ſecret=abcdefgh", LONG, "token: abcdef0123456789abcdef0123"]
    got = {r.doc_id: r for r in secret_scan.summarise(table(spark, texts).withColumn("spans", F.lit(0))).collect()}
    kinds = lambda i: [s.split(":")[0] for s in got[i].spans.split(",") if s]
    assert "block" in kinds(0) and "token" in kinds(1) and "key" in kinds(2) and "key" in kinds(3) and "key" in kinds(4) and not kinds(5) and not kinds(6)
    assert got[7].spans == "assign:23:41".replace("23", str(texts[7].index("api-key"))) or got[7].n_assign == 0  # api-key is no listed word
    assert got[8].n_access == 1 and got[8].spans == "access:0:20" and not kinds(9) and not kinds(10) and not kinds(11) and not kinds(12)
    assert kinds(13) == ["assign", "hex"]
    for i, t in enumerate(texts):  # the base kinds, as stated
        t, base = t or "", []
        base += [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    hidden = {r.doc_id: r.redacted for r in secret_scan.scan_secrets(table(spark, texts)).collect()}
    assert packed not in hidden[2] and hidden[5] == texts[5] and hidden[13] == "[SECRET]"
    assert secret_scan.summarise(table(spark, [])).count() == 0


def test_secrets_in_other_forms():
    import base64
    numbers = der(0x02, b"\x00") + b"".join(der(0x02, bytes([k + 1]) + bytes((k * j * 7 + 251) % 256 for j in range(64))) for k in range(8))
    raw = der(0x30, numbers)
    key, url = base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode()
    assert {"-", "_"} & set(url) and {"+", "/"} & set(key)
    lines = [key[k : k + 64] for k in range(0, len(key), 64)]
    armour = "-----BEGIN RSA PRIVATE KEY-----{0}{1}{0}-----END RSA PRIVATE KEY-----"

    def kinds(text, kind, span):
        return (kind, text.index(span), text.index(span) + len(span)) in secret_scan.find_spans(text)

    for gap in ("\n", "\r\n", "\\n", "\\r\\n"):
        block = armour.format(gap, gap.join(lines))
        assert kinds(f'"private_key": "{block}{gap}"', "block", block), gap
        assert kinds(f"see {gap.join(lines)} there", "key", gap.join(lines)), gap
        assert not kinds(f"see {gap.join(lines[:-1])} there", "key", gap.join(lines[:-1])), gap
    assert kinds(f"x = {url};", "key", url)
    headed = armour.format("\n", "Proc-Type: 4,CLEAR\nX-Note: a-b\n\n" + "\n".join(lines))
    assert kinds(f"a {headed} b", "block", headed)
    locked = armour.format("\n", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + base64.b64encode(bytes(range(64))).decode())
    assert kinds(f"a {locked} b", "block", locked)
    assert kinds(f"{chr(10).join(lines)}\nplain words follow", "key", "\n".join(lines))


def test_url_filter(spark):
    urls = ["http://A.b.NET/x", "https://example.net/en/1", "http://notnet/x", "x", None, "http://deep.example.com/de/z?q=/en/", "http://a.org/fr", "http://a.org/fr/1#x",
            "http://www.bad.example.org/p.html", "http://bad.example.org/p/", "http://good.example.org/p", "http://a.b.net", "http:///en/"]
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)] + [(0, urls[0], "again")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("bad.example.org/p",), (None,)], "canonical string")
    rows = url_filter.judge_urls(pages, rules, listed).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 1
    assert got[0] == ("a.b.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == (None, "allow")
    assert got[3] == ("", "", None, "allow") == got[4] and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == (None, "allow")
    assert got[7][2:] == ("org/fr/", "allow") and got[8][2:] == (None, "block") == got[9][2:] and got[10][3] == "allow" and got[11][2] is None and got[12][:2] == ("", "/en/")
    assert url_filter.judge_urls(pages.limit(0), rules, listed.limit(0)).count() == 0


def test_bloom_passes_all_members_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = bloom.block_count(5000)
    table_ = bloom.build(keys, F.col("k"), blocks)
    others = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("k"))
    assert bloom.may_hold(keys, F.col("k"), table_, blocks).count() == 5000
    assert bloom.may_hold(others, F.col("k"), table_, blocks).count() < 400


def test_quality_figures_equal_brute_force(spark):
    texts = [*ODD, "a b c a b c a b c", "line one is here.\nline one is here.\n\nx", "home | about | news | help | login\n" + PROSE, "BUY!! NOW!! THIS!! ALL!!\n" * 30 + PROSE,
             PROSE + "\nLicensed under the Apache License, Version 2.0.", "\n".join(["the&&& big*** dog### ran%%% off$$$"] * 3 + [f"the&&& cat*** w{i}###" for i in range(60)])]
    out = quality.judge_quality(table(spark, texts).withColumn("kept", F.lit("clash")))
    got = {r.doc_id: r for r in out.collect()}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for i, t in enumerate(texts):
        t, f = t or "", got[i].figures
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert f.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    n = len(ODD)
    assert got[5].kept and got[7].kept and got[5].cleaned == PROSE
    assert got[n + 2].kept and "login" not in got[n + 2].cleaned and got[n + 4].kept and "Licensed" not in got[n + 4].cleaned and not got[n + 5].kept
    assert quality.judge_quality(table(spark, [])).count() == 0


def brute_groups(texts, size, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(n, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(400)}" for _ in range(120)]
    texts = []
    for _ in range(n):
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 8)):
            words[k] = f"z{rng.integers(1000)}"
        texts.append(" ".join(words))
    for _ in range(n // 2):  # a shared passage in texts of their own
        texts.append(" ".join([f"q{rng.integers(5000)}" for _ in range(40)] + base[:60]))
    return texts


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, size, percent):
    texts = [*near_copies(60), *ODD, "one two", "ONE two", "one two three"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # lists go on from batch to batch
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, texts), jaccard.Rule(size, percent)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_groups(texts, size, percent)


def test_jaccard_blocks_and_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 8)
    texts = near_copies(50, seed=9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, texts), jaccard.Rule(4, 85)).collect()}
    assert got == brute_groups(texts, 4, 85)
    docs = table(spark, [PROSE, PROSE, PROSE, LONG, None, "", PROSE], [5, 5, None, 7, 8, 9, 6])
    rows = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.similar_groups(docs, jaccard.Rule()).collect())
    assert rows == [(-1, -1), (5, 5), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9)]
    kept = jaccard.keep_one(docs.withColumn("cls", F.lit("clash")))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5, 7, 8, 9] and kept.columns == [*docs.columns, "cls"]
    assert jaccard.similar_groups(table(spark, []), jaccard.Rule()).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in jaccard.components(links).collect()} == {0}


ITEMS = ["Which river runs past the old brick mill near Harlow town today? The quiet Wenbourne river runs past it.",
         "A farmer sells thirty seven apples and nineteen pears at market. How much fruit is sold? Fifty six pieces.", "too short item", None, ""]


def test_decontamination(spark):
    filler = " ".join(f"plain{i % 61} filler{i % 47} words{i % 29}" for i in range(200))
    para = "Which stream runs past the old stone mill near Harlow town now? The quiet Wenbourne river runs past it."
    texts = [filler, f"{filler} {ITEMS[0]} {filler}", f"{filler} {ITEMS[1].upper()}", f"{para} {filler}", f"{filler} too short item {filler}",
             "the old mill and the town and the river and how much fruit " * 20, None, "", ITEMS[0], LONG]
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(spark, texts), items).collect()}
    assert got == {(1, 0), (2, 1), (3, 0), (4, 2), (8, 0)}
    kept = decontaminate.drop_leaks(table(spark, texts).withColumn("item_id", F.lit("clash")), items)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5, 6, 7, 9]
    assert decontaminate.find_leaks(table(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(table(spark, []), items).count() == 0


def test_decontamination_tries_every_place(spark):
    item = " ".join(f"stem{i}" for i in range(16)) + ". " + " ".join(f"rest{i}" for i in range(20)) + "."
    changed = " ".join(f"new{k}" if k % 5 == 2 else w for k, w in enumerate(item.split()))
    stem, filler = " ".join(item.split()[:16] + item.split()[:15:-1]), " ".join(f"plain{i % 61} filler{i % 47}" for i in range(200))
    texts = [f"{stem} {filler} {item}", f"{filler} {stem} {filler} {stem} {filler} {changed} {filler}", f"{stem} {filler} {stem}", filler]
    others = [" ".join(np.random.default_rng(k).choice(decontaminate.terms_of(item), 20, False).astype(str)) for k in range(60)]  # terms differ in the space
    got = decontaminate.find_leaks(table(spark, texts), spark.createDataFrame(list(enumerate([item, *others])), "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect() if r.item_id == 0) == [0, 1]


@pytest.mark.parametrize("size", [100, 4000])
def test_decontamination_recall_at_two_sizes(spark, size):
    rng = np.random.default_rng(4)
    words = [f"common{i}" for i in range(120)]
    items = [" ".join(rng.choice(words, 24)) for _ in range(10)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(size)]
    for i, item in enumerate(items):  # every fourth word is another
        changed = [f"other{i}x{k}" if k % 4 == 2 else w for k, w in enumerate(item.split())]
        texts[7 * i] = " ".join([*rng.choice(words, 20), *changed, *rng.choice(words, 20)])
    brute = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if decontaminate.common_length(item.split(), t.split()) >= 0.75 * 24}
    got = decontaminate.find_leaks(table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert len(brute) >= 10 and {(r.doc_id, r.item_id) for r in got.collect()} == brute


def test_decontamination_space_needs_no_sample(spark):
    """Documents with the same words in another order have the same frequencies, so the same space and item vectors."""
    rng = np.random.default_rng(8)
    words = [f"term{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(words, 40))) for i in range(150)]
    texts = [" ".join(rng.choice(words, 50)) for _ in range(300)]
    a, b = (decontaminate.build_index(table(spark, t), items) for t in (texts, [" ".join(sorted(x.split())) for x in texts]))
    assert np.array_equal(a.idf, b.idf) and len(a.passages) > 1000
    assert np.allclose(a.passages @ a.passages.T, b.passages @ b.passages.T, atol=1e-3)


def test_common_length_equals_dynamic_programme():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, 30).tolist(), rng.integers(0, 6, 45).tolist()
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        assert decontaminate.common_length(a, b) == row[-1]


def test_words_of_many_texts_hash_as_one_by_one():
    """All lengths on both sides of each form of the hash, every white space, zero bytes; texts without words between others."""
    rng = np.random.default_rng(11)
    odd = ["", " \t\n\x0b\x0c\r", "\x00 a\x00b\u00a0c", " ".join("Qz\u00e9\u4e2d"[i % 4] * i for i in range(1, 70)), "x" * 300,
           *(" ".join("".join(rng.choice(list("aZ0\u00df\U0001f600"), k)) for k in rng.integers(1, 40, 20)) for _ in range(50)), ""]
    hashes = common.WordHashes()
    for texts in (odd, [], [""], ["end"]):
        want = [hashes.of(common.words_of(t)) for t in texts]
        got, at = common.text_words(texts)
        assert np.array_equal(got, np.concatenate([*want, np.zeros(0, np.uint64)])) and np.diff(at).tolist() == [len(w) for w in want]


def test_decontamination_compares_passages_in_bounded_pieces(spark, monkeypatch):
    """Cosines are held for so many pairs of passages at once, and pieces do not change what is found."""
    rng = np.random.default_rng(9)
    items = [" ".join(f"t{k}" for k in rng.integers(0, 900, 24)) for _ in range(40)]
    docs = [" ".join([items[k % 40], *(f"t{x}" for x in rng.integers(0, 900, 200)), items[(7 * k) % 40]]) for k in range(12)]
    search = decontaminate.Search(decontaminate.build_index(table(spark, docs), list(enumerate(items))))
    whole = search(docs)
    assert sum(map(len, whole)) >= 12
    monkeypatch.setattr(decontaminate, "CELLS", 3 * len(search.x.passages))
    seen = []

    class Watched(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **more):
            out = getattr(ufunc, method)(*(np.asarray(x) for x in inputs), **more)
            seen.append(out.size)
            return out
    search.x.passages = search.x.passages.view(Watched)
    items_of = lambda found: [{h["item"] for h in x} for x in found]
    assert items_of(search(docs)) == items_of(whole) and seen and max(seen) <= decontaminate.CELLS


def test_lm_scores(spark, monkeypatch):
    texts = [f"the cat number {i % 7} sat on the mat and saw dog {i}" for i in range(60)] + [None, "", "unseen words only", "THE cat", LONG]
    tokens = [(t or "").encode().lower().split() + [b" "] for t in texts]
    train = Counter(x for i, w in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    total, distinct = sum(train.values()), len(train)
    for head in (lm_bloom.HEAD_WORDS, 20):  # all words in the head table, and most of them joined
        monkeypatch.setattr(lm_bloom.learn, "__defaults__", (lm_bloom.MAX_BLOCKS, head))
        rows = lm_bloom.learn_and_score(table(spark, texts)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            w = tokens[r.doc_id]
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.train_tokens == total and r.n_tokens == len(w)
            assert r.n_known == sum(train[x] > 0 for x in w)
            assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), rel_tol=1e-9)
        held = [r for r in rows if r.held_out and r.doc_id < 60]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)  # pairs tell more than words
    assert lm_bloom.learn_and_score(table(spark, [])).count() == 0
    with_null = table(spark, ["a b", "a b"], [None, 3])
    assert lm_bloom.learn_and_score(with_null).count() == 2


def test_levels_are_never_under_estimated(spark):
    keys = mixed(np.arange(1, 6001).astype(np.uint64))
    n = [int(1.7 ** (k % 20)) + 1 for k in range(3000)]
    q = lm_bloom.level(np.array(n))
    counts = spark.createDataFrame(list(zip(keys[:3000].view(np.int64).tolist(), q.tolist(), strict=True)), "key long, q int")
    words = lm_bloom.build_filter(counts, lm_bloom.PARTS * -(-int(q.sum()) * lm_bloom.BITS_PER_ENTRY // 512 // lm_bloom.PARTS))
    got = lm_bloom.probe_levels(words, keys[:3000])
    assert (got >= q).all() and (got == q).mean() > 0.99
    others = mixed(np.arange(10_000, 400_000).astype(np.uint64))
    assert (lm_bloom.probe_levels(words, others) > 0).mean() < 2 * lm_bloom.FALSE_RATE


def test_pair_keys_give_their_context_back():
    rng = np.random.default_rng(1)
    number, tokens = rng.integers(0, 1 << 18, 5000), rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    assert (lm_bloom.context_of(lm_bloom.pair_keys(number, tokens)) == number).all()


def lm_texts():
    rng = np.random.default_rng(7)
    weight = 1 / np.arange(1, 3001)
    weight /= weight.sum()
    return [" ".join(f"w{k}" for k in rng.choice(3000, 60, p=weight)) + f" w{i % 5} the cat" for i in range(400)]


@pytest.mark.parametrize("blocks", [lm_bloom.MAX_BLOCKS, 512])
def test_lm_probabilities_sum_to_one(spark, blocks):
    """Over the vocabulary and one unknown word, behind frequent and rare words, with room for all pairs and without."""
    texts = lm_texts()
    m, _ = lm_bloom.learn(table(spark, texts).select("text"), blocks, 500)
    hashes = lm_bloom.WordHashes()
    vocabulary = sorted({w for t in texts for w in t.split()})
    tokens = hashes.of([w.encode() for w in [*vocabulary, "never seen"]] + [lm_bloom.END])
    _, _, own = lm_bloom.alone(tokens, m)
    assert abs(own.sum() - 1) < 2e-3
    numbers = sorted({int(x) for x in m.context if x >= 0})
    assert (m.context >= 0).sum() == len(numbers) and (len(numbers) > 300 if blocks > 512 else 0 < len(numbers) < 300)
    for number in [-1, *numbers[:5], *numbers[-5:]]:
        total = lm_bloom.behind(own, np.full(len(tokens), number), tokens, m).sum()
        assert abs(total - 1) < lm_bloom.TOLERANCE + 2e-3, number


def test_lm_scores_equal_exact_counts(spark):
    """The same formula with a dictionary instead of the filter."""
    texts = [*lm_texts(), "", None, "w1 never w2", "THE Cat the"]
    rows = {r.doc_id: r for r in lm_bloom.learn_and_score(table(spark, texts)).collect()}
    tokens = [(t or "").lower().split() + [" "] for t in texts]
    train = [w for i, w in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1]
    words = Counter(x for w in train for x in w)
    pairs = Counter(p for w in train for p in zip([" ", *w], w))
    rough = lambda n: float(lm_bloom.count_of(lm_bloom.level(np.array([n])))[0])
    least = len(words) * lm_bloom.FALSE_RATE * (rough(1) - lm_bloom.DISCOUNT) / lm_bloom.TOLERANCE
    mass, kinds = Counter(), Counter()
    for (v, _), n in pairs.items():
        mass[v] += rough(n)
        kinds[v] += 1
    z = sum(words.values()) + 0.5 * (len(words) + 1)
    off = 0
    for i, w in enumerate(tokens):
        want = 0.0
        for v, x in zip([" ", *w], w):
            own = (words[x] + 0.5) / z
            told = rough(pairs[v, x]) - lm_bloom.DISCOUNT if (v, x) in pairs else 0.0
            want += math.log10((told + lm_bloom.DISCOUNT * kinds[v] * own) / mass[v] if mass[v] and words[v] >= least else own)
        assert rows[i].score >= want - 1e-6  # a word that passes by chance can only gain
        off += rows[i].score > want + 1e-6
    assert off <= 0.02 * len(texts) + 1


@pytest.mark.parametrize("blocks", [448, 64])
def test_lm_scores_without_room_equal_those_with_room(spark, monkeypatch, blocks):
    """Pairs behind rare contexts that the filter cannot hold, and words, if they alone are too many, come from a join."""
    texts = [*lm_texts(), "", None, "w1 never w2", "THE Cat the"]

    def scores(blocks):
        monkeypatch.setattr(lm_bloom.learn, "__defaults__", (blocks, 500))
        m, _ = lm_bloom.learn(table(spark, texts).select("text"))
        return m, {r.doc_id: r.score for r in lm_bloom.learn_and_score(table(spark, texts)).collect()}
    (roomy, want), (m, got) = scores(lm_bloom.MAX_BLOCKS), scores(blocks)
    assert not roomy.apart and (roomy.far < 0).all() and (m.far >= 0).sum() > 50 and m.apart == (blocks == 64)
    off = [i for i in want if not math.isclose(got[i], want[i], abs_tol=1e-6)]
    assert got.keys() == want.keys() and len(off) <= 0.05 * len(texts)  # where the larger filter lets a word pass by chance


@pytest.mark.parametrize("blocks", [lm_bloom.MAX_BLOCKS, 64])
def test_lm_whole_scores_count_pairs_behind_every_word(spark, monkeypatch, blocks):
    """The formula with dictionaries holds behind words seen once as well, in several ranges and stretches, with words in the filter and apart."""
    texts = [*lm_texts(), "", None, "w1 never w2", "THE Cat the", "w2999 once behind", "w2999 once behind", "W2999  ONCE behind"]
    monkeypatch.setattr(lm_bloom.learn, "__defaults__", (blocks, 500))
    monkeypatch.setattr(lm_bloom, "RARE_TOKENS", 300)
    rows = {r.doc_id: r.score for r in lm_bloom.learn_and_score(table(spark, texts), whole=True).collect()}
    tokens = [(t or "").lower().split() + [" "] for t in texts]
    train = [w for i, w in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1]
    words, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([" ", *w], w))
    rough = lambda n: float(lm_bloom.count_of(lm_bloom.level(np.array([n])))[0])
    head = {w for w in words if sum(n >= words[w] for n in words.values()) <= 500}
    mass, kinds = Counter(), Counter()
    for (v, _), n in pairs.items():
        mass[v] += rough(n)
        kinds[v] += 1
    z = sum(n if w in head else rough(n) for w, n in words.items()) + 0.5 * (len(words) + 1)
    off = 0
    for i, w in enumerate(tokens):
        want = 0.0
        for v, x in zip([" ", *w], w):
            own = ((words[x] if x in head else rough(words[x]) if x in words else 0.0) + 0.5) / z
            told = rough(pairs[v, x]) - lm_bloom.DISCOUNT if (v, x) in pairs else 0.0
            want += math.log10((told + lm_bloom.DISCOUNT * kinds[v] * own) / mass[v] if mass[v] else own)
        off += not math.isclose(rows[i], want, abs_tol=1e-6)
    assert rows.keys() == set(range(len(texts))) and off <= 0.05 * len(texts)  # a word that passes by chance
    assert rows[404] == rows[405]


def test_lm_leaves_no_shuffle_files_of_what_it_staged(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {disk.apply(i).getName() for i in range(disk.size()) if disk.apply(i).getName().startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual, before = spark.conf.get(name, None), files()
    scored = lm_bloom.learn_and_score(table(spark, lm_texts()))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(name, None) == usual
    assert scored.count() == 400


def test_lm_asks_only_for_pairs_where_the_filter_holds_all_words(spark, monkeypatch):
    """The table of words is not joined with every token that asks, and pairs that the filter holds are not shuffled."""
    texts = table(spark, lm_texts()).select("doc_id", "text")
    m, known = lm_bloom.learn(texts.select("text"), 448, 500)
    assert not m.apart and (m.far >= 0).any()
    tables, more = [], lm_bloom.joined_scores
    monkeypatch.setattr(lm_bloom, "joined_scores", lambda scored, m, known: tables.append(scored) or more(scored, m, known))
    lm_bloom.score_texts(texts, m, known, ["doc_id"])
    assert more(tables[0], m, lm_bloom.Counts(None, known.pairs)).count() > 0
    assert 0 < lm_bloom.gains(known.pairs, m).count() < known.pairs.count()


def test_lm_texts_that_were_learned_ask_little(spark):
    """Without room for all pairs the frequent ones stay in the filter behind every context, and what was learned from asks only for those below the second level."""
    texts = table(spark, lm_texts()).select("text")
    m, known = lm_bloom.learn(texts, 560, 500)
    pairs = [(int(lm_bloom.context_of(np.array([r.key]).view(np.uint64))[0]), int(lm_bloom.level(np.array([r.n]))[0]), r.n) for r in known.pairs.collect()]
    kept = sum(q for of, q, _ in pairs if q >= m.least[of])
    assert (m.far >= 0).sum() > 50 and kept <= 560 * 512 // lm_bloom.BITS_PER_ENTRY
    behind_far = {int(x) for x in m.far if x >= 0}
    every = sum(n for of, _, n in pairs if of in behind_far)
    hashes = lm_bloom.WordHashes()
    asked = [sum(len(x) for x in lm_bloom.score_chunk(lm_texts(), m, hashes, learned)["asked"].to_pylist()) for learned in (None, np.ones(400, bool))]
    assert 0 < asked[0] < 0.75 * every and asked[1] < 0.5 * asked[0]
    assert sum(n for of, q, n in pairs if q < m.least[of] and m.least[of] > 2) >= asked[1]


def test_lm_model_reaches_the_driver_as_arrays(spark, monkeypatch):
    """No object a word in the driver, and the filter comes by ranges: only the rows of levels are collected."""
    seen, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    m, _ = lm_bloom.learn(table(spark, lm_texts()).select("text"))
    assert len(m.head_keys) > 2000 and (np.diff(m.head_keys.view(np.uint64).astype(object)) > 0).all() and m.words.any()
    assert sum(len(rows) for rows in seen) < 100 and not any(isinstance(v, (bytes, bytearray)) for rows in seen for r in rows for v in r)


def test_toxicity_learns_held_out(spark):
    rng = np.random.default_rng(2)
    texts, marks = [], []
    for i in range(600):
        words = [f"w{rng.integers(300)}" for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            words[int(rng.integers(40))] = ("Idiot!", "moron,", "scum")[int(rng.integers(3))]
        texts.append(" ".join(words))
        marks.append(int(bad))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(0, 1, 0), (None, 1, 1), (3, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.learn_and_score(docs, labels).collect()}
    assert len(rows) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [r for r in rows.values() if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95 and not rows[600].predicted
    none = toxicity.learn_and_score(docs, labels.limit(0)).collect()
    assert len(none) == 602 and all(r.predicted == 0 for r in none)
    assert toxicity.learn_and_score(table(spark, []), labels).count() == 0


def test_toxicity_learns_pairs_of_words_without_weight(spark):
    rng = np.random.default_rng(3)
    texts, marks = [], []
    for i in range(8500):  # "group" and "insult" alone say nothing: toxic only as both or neither
        words = [f"w{n}" for n in rng.integers(400, size=20)] + ["group"] * (i % 2) + ["insult"] * (i // 2 % 2)
        texts.append(" ".join(words))
        marks.append(int(i % 4 in (0, 3)))
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.learn_and_score(table(spark, texts), labels).collect() if r.held_out]
    assert np.mean([r.predicted == marks[r.doc_id] for r in rows]) > 0.97


PAGE = ("<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a = '<p>no</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div>{}<aside>More</aside><div id=comments><p>nice post</p></div><form>mail <input></form><footer>&copy; me</footer></body></html>")


def test_html_text(spark):
    long_p = "Some words of <b>running</b> text that go on for a while, &eacute;&#233; and&nbsp;so on, line\n  after line."
    plain = htmllib.unescape(re.sub(r"\s+", " ", re.sub("<[^>]*>", "", long_p)))
    plain = re.sub(r"\s+", " ", plain)
    want = f"Head\n\n{plain}\n\n{plain}"
    body = f"<h1>Head</h1><p>{long_p}</p><p>{long_p}</p>"
    pages = [PAGE.format(f"<article>{body}</article>"), PAGE.format(f"<div class=content>{body}</div>"), PAGE.format(f"<article><h1>Head<p>{long_p}<p>{long_p}<div class='ad'>Buy</div>"),
             None, "", "just text", "<p>one<p>two", "<div " * 50, "a < b and c > d", "<ul><li>x<li>y</ul>" * 3000, "<!-- open", "<p>" + "<b>" * 5000 + "deep"]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert [got[i].text for i in range(3)] == [want] * 3
    assert got[3].text == got[4].text == "" and got[5].text == "just text" and got[6].text == "one\n\ntwo" and got[11].text == "deep" and got[9].text.count("\n\n") == 5999
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_text_keeps_articles_in_named_parts_and_formulas():
    body = "<p>" + "Plain words of the article, long enough to count as text. " * 5 + "</p>"
    for name in ("class='layout has-sidebar'", "class=no-ads", "class=with-nav", "id='share-page'", "class='sidebar'"):
        assert "Plain words" in html_text.main_text(f"<body><div {name}><article>{body}</article></div></body>")
        assert "Plain words" in html_text.main_text(f"<body><div {name}>{body}</div><footer>end</footer></body>")
    assert "Plain words" in html_text.main_text(f"<body><form><main>{body}</main></form></body>")
    for name in ("ad-slot", "site-footer", "cookie-notice", "sidebar", "comments"):
        assert "Buy" not in html_text.main_text(f"<body><article>{body}</article><div class='{name}'><p>Buy now</p></div></body>")
        assert "Buy" not in html_text.main_text(f"<body><article>{body}<div class='{name}'><p>Buy now</p></div></article></body>")
    for sign in ("<svg/>", "<svg width='1' />", "<math/>", "<svg><path d='x'>"):
        assert "Plain words" in html_text.main_text(f"<body><article>{sign}{body}</article></body>"), sign
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m</annotation></semantics></math>"
    assert "so E=m holds" in html_text.main_text(f"<body><article>{body}<p>so {formula} holds</p></article></body>")


def test_pipeline_stages(spark):
    near = near_copies(6, seed=4)[:6]
    secret = PROSE.replace("alpha1 ", "qq ") + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    texts = [None, "", *near, LONG, secret, PROSE.replace("alpha", "gamma").replace("beta", "delta") + " " + ITEMS[0], "short"]
    docs = table(spark, texts).withColumn("kept", F.lit("own"))
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    import tempfile
    sf = tempfile.mkdtemp(prefix="depfleet-tests-")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    held = docs
    for _, apply in corpus_pipeline.STAGES[:-1]:
        held = stage(apply(spark, held, sf)).df
        assert held.columns == docs.columns
    kept = {r.doc_id: r.text for r in held.collect()}
    groups = brute_groups([t if 2 <= i < 8 else None for i, t in enumerate(texts)], 5, 80)
    assert set(kept) == {groups[i][1] for i in range(2, 8)} | {8, 9}
    assert "04dbebab" not in kept[9] and kept[8] == LONG
    final = corpus_pipeline.STAGES[-1][1](spark, held, sf).collect()
    assert {r.doc_id for r in final} == set(kept) and all(r.round_trip for r in final)


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect()
    assert all(r.f == (0 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5) for r in rows)


def test_stage_names(spark):
    assert all(callable(f) for _, f in stages.STAGES)
