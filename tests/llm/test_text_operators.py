"""The text operators against plain versions, and the cases every one of them must stand."""

from __future__ import annotations

import hashlib
import random
import struct
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from stemma.llm import chat, common, decontaminate, fingerprint, langid, licenses, packing, sharding, simhash, sketch, tokens, toxicity
from stemma.operators import components

from tests.conftest import DATA

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "a", "That it.", "x  y   z \n\n q \t r", "don't DON'T l'été ÀÉÎ", "<|endoftext|>", "a <|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ Σ", "é   \u0085 \x1c x\x1dy",
    "日本語 テキスト 12345", "a\r\nb", "tail ", " head", "🙂🙂 mixed 🙂", "İstanbul ı", "a" * 5000, "word " * 5000, "12 34\t56", "x" + "\u200b" + "y",
]


def documents(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("score", "fp", "ids", "start", "key", "n", "u", "root", "slot", "_id"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(3, 400))) for _ in range(n)]
    return texts


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = [x or "" for x in ODD] + corpus(30)
    for text, data in zip(texts, tokens.WordIds(WORDS).many(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:50]


def test_pieces_with_signs_equal_the_library(monkeypatch):
    """Random words, signs and white space of all kinds; with room for every piece and for few."""
    from tokenizers import Tokenizer

    ids, counts = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    r = random.Random(11)
    bits = ["word", "Été", "ß", "don", "s", "ll", "VE", "12", "3", "²", "ª", "µ", "é", "ñ", "中", "İ", "ا", "क़", "\u0301", "'", "'s", "'T", "’", *tokens.ENDS, "<|", "|>", "<|endoftext|>", "<|startoftext|>", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "…", "🙂"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(4000)]
    latin = [b for b in bits if max(b) <= "\xff"]
    texts += ["".join(r.choice(latin) for _ in range(r.randrange(1, 14))) for _ in range(4000)]
    for room in (1_000_000, 50):
        monkeypatch.setattr(tokens, "REMEMBERED", room)
        for text, data, n in zip(texts, tokens.WordIds(WORDS).many(texts), tokens.ByteCounts(BYTES).many(texts), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == ids.encode(text, add_special_tokens=False).ids, text
            assert n == len(counts.encode(text, add_special_tokens=False)), text


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    texts = ODD + corpus(20) + ["z" * 3000 + " end", "q w\n" * 900, "\n".join(corpus(3))]
    got = {r["doc_id"]: r for r in tokens.count_tokens(documents(spark, texts, True), BYTES, chunk=700, overlap=32).collect()}
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 1024), (i, (text or "")[:60])


@pytest.mark.parametrize("parts", [1, 40])
def test_packing_loses_nothing(spark, parts):
    texts = ODD + corpus(60) + [None]
    out = packing.pack(documents(spark, texts, True).repartition(parts), WORDS, size=256, windows=3).collect()
    ids = {i: tokens.WordIds(WORDS).many([t or ""])[0] + struct.pack("<I", 2) for i, t in enumerate(texts)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) // 4
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[i][4 * r["start"] : 4 * at])
        assert at == len(ids[i]) // 4
    short = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
        short += at < 256
    assert short <= 3


def brute_simhash(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_brute_force(spark):
    r = random.Random(5)
    texts = ODD + corpus(80)
    for t in corpus(80)[:30]:
        w = t.split()
        for _ in range(3):
            w[r.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += texts[30:40]
    got = {x["doc_id"]: x for x in simhash.near_duplicates(documents(spark, texts, True)).collect()}
    fps = [brute_simhash(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    for i in range(len(texts)):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[i]:016x}", top(i))
    kept = simhash.keep_one(documents(spark, texts, True), width=3, similar=False)
    assert kept.columns == documents(spark, texts, True).columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({top(i) for i in range(len(texts))})


def test_similar_texts_keep_one(spark):
    r = random.Random(12)
    base = [t for t in corpus(60, seed=12) if len(t.split()) > 60]
    texts, near = list(base), {}
    for i, t in enumerate(base):
        w = t.split()
        for _ in range(max(1, len(w) // 90)):  # each edit touches five shingles
            w[r.randrange(len(w))] = "edit" + str(i)
        near[len(texts)] = i
        texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    like = {j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j, i in near.items()}
    kept = {x["doc_id"] for x in simhash.keep_one(documents(spark, texts, True)).collect()}
    assert set(range(len(base))) <= kept
    sure = [j for j, x in like.items() if x >= 0.86]
    assert len(sure) > 10 and not set(sure) & kept
    assert {j for j, x in like.items() if x < 0.65} <= kept


def family(n, seed, low=16, high=42):
    """n base texts of 200 shingles, each with copies that share 200 - a of them, a from low to high: similarities of 0.65 to 0.86."""
    r = random.Random(seed)
    texts = []
    for b in range(n):
        w = [f"w{r.randrange(10**9)}" for _ in range(204)]
        texts.append(" ".join(w))
        for a in range(low, high + 1):
            at = r.randrange(10, 150)
            texts.append(" ".join(w[:at] + [f"x{b}-{a}-{k}" for k in range(a - 4)] + w[at + a - 4 :]))
    return texts


def brute_kept(texts):
    """Smallest positions of the components of pairs at 0.8 (shingle sets) or two bits (fingerprints)."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    fps = [simhash.simhash(t, 5) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) or (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return set(root)


def test_similarity_is_exact_around_the_threshold(spark):
    texts = family(12, 21)
    want = brute_kept(texts)
    assert 12 < len(want) < len(texts) - 12
    assert {x["doc_id"] for x in simhash.keep_one(documents(spark, texts, True)).collect()} == want


@pytest.mark.parametrize(("n", "low", "high", "broadcast"), [(6, 16, 30, True), (6, 36, 50, True), (150, 22, 22, True), (6, 36, 50, False)])
def test_hot_buckets_and_clusters_lose_no_link(spark, monkeypatch, n, low, high, broadcast):
    monkeypatch.setattr(sketch, "HOT_BUCKET", 1)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(sketch, "PART_BYTES", 8_000, raising=False)
    texts = family(n, 22, low, high)
    assert {x["doc_id"] for x in simhash.keep_one(documents(spark, texts, True)).collect()} == brute_kept(texts)


def test_trie_join_equals_all_pairs():
    g = np.random.default_rng(3)
    base = g.integers(0, 2**63, 40, dtype=np.uint64)
    near = (base[:, None] ^ (np.uint64(1) << g.integers(0, 64, (40, 30), dtype=np.uint64))).ravel()
    keys = np.unique(np.r_[base, near, near ^ (np.uint64(1) << np.uint64(7))])
    found = set()
    n = len(keys)
    for i, j in simhash.walk(keys, np.array([[0, n, 0, n, 0]]), 0, 2):
        pairs = set(zip(i.tolist(), j.tolist(), strict=True))
        assert len(pairs) == len(i) and not pairs & found
        found |= pairs
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(keys[i] ^ keys[j]).bit_count() <= 2}
    assert found == want


def test_hot_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BLOCK", 10)
    g = np.random.default_rng(4)
    keys = np.unique(g.integers(0, 2**11, 600, dtype=np.int64) << 20 | g.integers(0, 4, 600))
    df = spark.createDataFrame([(int(k),) for k in keys], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.classes(df).collect()}
    parent = {int(k): int(k) for k in keys}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ks = [int(k) for k in keys]
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert got == {k: top(k) for k in ks}


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 200).selectExpr("id as u", "id - 1 as v").union(spark.sql("select 500L, 400L"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 400, 400: 400}


def test_ids_that_repeat_or_are_null(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, None), (1, ""), (2, "x y z w v"), (2, "p q r s t u")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == {(None, None): 2, (1, 1): 2, (2, 2): 2}
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert len(kept) == 4 and len({(i, t or "") for i, t in kept}) == 4


def test_shards(spark):
    names = [f"s{k}" for k in range(7)]
    table = {r["slot"]: r["shard_id"] for r in sharding.lookup_table(spark, names, 131).collect()}
    owner, nxt = {}, [0] * 7
    order = lambda s: (int(hashlib.md5(f"offset:{s}".encode()).hexdigest()[:15], 16) % 131, int(hashlib.md5(f"skip:{s}".encode()).hexdigest()[:15], 16) % 130 + 1)
    t = 0
    while len(owner) < 131:
        k = t % 7
        a, b = order(names[k])
        while (slot := (a + nxt[k] * b) % 131) in owner:
            nxt[k] += 1
        owner[slot] = k
        t += 1
    assert table == owner and max(Counter(owner.values()).values()) - min(Counter(owner.values()).values()) <= 1
    fewer = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, names[:-1], 131).collect()}
    moved = sum(names[owner[s]] != fewer[s] for s in owner if owner[s] != 6)
    assert moved < 131 // 4
    df = documents(spark, ["a"] * 400, True).unionByName(spark.createDataFrame([(None, "x")], "doc_id long, text string"), allowMissingColumns=True)
    out = sharding.shard(df, names, 131)
    assert out.count() == 401 and out.filter(F.col("shard").isNull()).count() == 0
    assert "Broadcast" in out._jdf.queryExecution().toString()
    hot = sharding.shard(df.withColumn("source", F.lit("one")), names, 131, key="source", spread="doc_id").groupBy("shard").count().collect()
    assert len(hot) == 7
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 130)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi % <|im_end|> %7C <%7C"), (1, 1, "assistant", "a<"), (1, 2, "assistant", "|b\n\nc"), (1, None, "system", None), (2, 0, "we<|ird\n%0A", ""), (2, 0, "we<|ird\n%0A", ""), (3, 1, None, "é🙂"), (None, 1, "assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.parse_chats(F.col("formatted"))).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        parts = [r["formatted"][s["begin"] : s["begin"] + s["length"]] for s in r["loss_spans"]]
        assert [p.replace("<%7C", "<|").replace("%25", "%") for p in parts] == [t for role, t in want[c] if role == "assistant"]
    assert got[1]["formatted"].count("<|im_start|>assistant") == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_fingerprints(spark, real):
    texts = ["a b c\nd e f", "d e f\na b c", "a b c", "", None, "x", *corpus(12)]
    df = documents(spark, texts, True)
    out = {r["doc_id"]: r for r in fingerprint.compare_with_next(df).collect()}
    assert out[0]["fingerprint"] == out[1]["fingerprint"] and out[3]["fingerprint"] == out[4]["fingerprint"] != out[2]["fingerprint"]
    for i, text in enumerate(texts):
        t, nxt = text or "", texts[i - 1 if i else len(texts) - 1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        assert (out[i]["fingerprint"] == out[i]["edited_fingerprint"]) == (out[i]["near_edited"] == 1.0 and edited == t) or edited != t
    # adding a paragraph's vector is the vector of the longer text, but for the empty word runs
    f = {r["t"]: np.array(r["f"], dtype=np.int64) for r in spark.createDataFrame([("p q r",), ("s t",), ("p q r\ns t",)], "t string").withColumn("f", fingerprint.fingerprint(F.col("t"))).collect()}
    with np.errstate(over="ignore"):
        assert (f["p q r"] + f["s t"] == f["p q r\ns t"]).all()
    both = fingerprint.compare_with_next(real).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("double"))).first()[0]
    assert both > 0.95
    one = fingerprint.compare_with_next(documents(spark, ["only one"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.compare_with_next(documents(spark, ["x"]).limit(0)).count() == 0


def test_fingerprints_of_very_long_texts(spark):
    """Lanes and sums wrap around instead of overflowing, and stay homomorphic."""
    long = " ".join(str(k % 977) for k in range(150_000))
    f = [r["f"] for r in spark.createDataFrame([(long,), (long + "\nend",), ("end",)], "t string").withColumn("f", fingerprint.fingerprint(F.col("t"))).collect()]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert [wrap(a + c) for a, c in zip(f[0], f[2], strict=True)] == f[1]
    out = fingerprint.compare_with_next(documents(spark, [long, "x"])).collect()
    assert len(out) == 2 and all(0 <= r["near_edited"] <= 1 for r in out)


def test_likeness_of_very_long_texts_is_that_of_plain_counts(spark):
    r = random.Random(5)
    one = [str(r.randrange(50_000)) for _ in range(200_000)]
    two = [str(r.randrange(50_000)) for _ in range(200_000)]
    texts = [one, two, one[:130_000] + two[:70_000]]
    runs = [(k, a, b, w) for k, t in enumerate(texts) for a, b, w in zip(["", "", *t], ["", *t], t)]
    bits = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))) for k in range(64)]
    import pandas as pd

    counted = spark.createDataFrame(pd.DataFrame(runs, columns=["k", "q", "p", "w"])).withColumn("h", F.xxhash64("q", "p", "w")).groupBy("k").agg(*bits).collect()
    v = {x[0]: 2 * np.array(x[1:], dtype=float) - 200_000 for x in counted}
    plain = lambda a, b: min(1, max(0, 1 - ((v[a] - v[b]) ** 2).sum() / ((v[a] ** 2).sum() + (v[b] ** 2).sum())))
    out = {x["doc_id"]: x["near_next"] for x in fingerprint.compare_with_next(documents(spark, [" ".join(t) for t in texts])).collect()}
    assert plain(0, 1) < 0.4 and plain(0, 2) > 0.4
    for k in range(3):
        assert abs(out[k] - plain(k, (k - 1) % 3)) < 1e-9


def test_fingerprints_order_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, "n"), (5, "five"), (5, "five"), (9, "nine nine")], "doc_id long, text string").repartition(3)
    assert fingerprint.compare_with_next(df).count() == 4


def levenshtein_best(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, q in enumerate(p, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (q != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_equals_brute_force(spark):
    r = random.Random(8)
    items = [(i, t[:200]) for i, t in enumerate(corpus(6, seed=9))] + [(90, None), (91, ""), (92, "?!")]
    texts = list(corpus(10, seed=10)) + [None, ""]
    for i in range(6):
        for edits in (0, 2, 5, 14):
            s = list(items[i][1].upper())
            for _ in range(edits):
                s[r.randrange(len(s))] = r.choice(["", "q", "zz"])
            texts.append(texts[0][:100] + "\n" + "".join(s) + " " + texts[1][:300])
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contaminated(documents(spark, texts, True), bench).collect()
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in out}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            p = decontaminate.plain(item)
            if p and (n := levenshtein_best(p, f" {decontaminate.plain(t)} ")) <= decontaminate.budget(len(p)):
                want[(d, i)] = n
    assert got == want and len(want) > 8
    kept = {x["doc_id"] for x in decontaminate.keep_uncontaminated(documents(spark, texts, True), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, t[:150]) for i, t in enumerate(corpus(8, seed=2))], "item_id long, text string")
    docs = documents(spark, ["x " + t[:150] + " y" for t in corpus(8, seed=2)])
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and len(whole) >= 8


def test_licences(spark):
    s = licenses.SENTENCES
    wrapped = s["mit-grant"][0].replace("to any person", "to any person\n   ")
    mit = "\n".join([wrapped, "", s["mit-notice"][0], s["mit-as-is"][0]])
    texts = ["Words here\nReleased under the MIT License.", "table |\nLicensed under CC BY-NC 4.0.", mit, None, "", "x\n" + s["mpl2"][0] + " " + s["mpl2-copy"][0], s["bsd-grant"][0] + " " + s["bsd-source"][0] + " " + s["bsd-binary"][0] + " Neither the name of the Acme Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "An unlicensed word."]
    got = defaultdict(list)
    for r in licenses.scan(documents(spark, texts, True)).collect():
        got[r["doc_id"]].append(r["license"])
        assert 0 <= r["begin_char"] < r["end_char"] <= len(texts[r["doc_id"]])
    assert got == {0: ["MIT"], 1: ["CC-BY-NC-4.0"], 2: ["MIT"], 5: ["MPL-2.0"], 6: ["BSD-3-Clause"]}


def test_licence_headers_as_published():
    s, wrap = licenses.SENTENCES, lambda t: textwrap.fill(t, 60)
    full = lambda names: "\n\n".join(wrap(s[n][-1]) for n in names)
    mit = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + full(["mit-grant", "mit-notice", "mit-as-is"])
    gpl = "Copyright (C) 2020 Jane Doe\n\n" + full(["gpl-free", "gpl-hope", "gpl-see"])
    apache = "Copyright 2020 Jane Doe\n\n" + full(["apache-short", "apache-copy", "apache-as-is", "apache-see"])
    known = licenses.Recogniser()
    for text, name, n in ((mit, "MIT", 3), (gpl, "GPL-3.0-or-later", 3), (apache, "Apache-2.0", 4)):
        for t in (text, "\n".join("# " + x for x in text.split("\n"))):
            assert [(x[0], x[3]) for x in known.licences(t)] == [(name, n)]


# Licences as they stand in files: the known sentences in order, with what stands between and around them.
FILES = {
    "MIT": "MIT License|Copyright (c) 2020 Jane Doe|mit-grant|mit-notice|mit-as-is mit-no-event",
    "MIT-0": "MIT No Attribution|Copyright 2020 Jane Doe|mit0-grant|mit-as-is mit-no-event",
    "ISC": "ISC License|Copyright (c) 2020, Jane Doe|isc-grant|isc-as-is isc-no-event",
    "0BSD": "BSD Zero Clause License|Copyright (c) 2020 Jane Doe|zero-bsd-grant|isc-as-is isc-no-event",
    "BSD-2-Clause": "BSD 2-Clause License|Copyright (c) 2020, Jane Doe|All rights reserved.|bsd-grant|1. bsd-source|2. bsd-binary|bsd-as-is bsd-no-event",
    "BSD-3-Clause": "BSD 3-Clause License|Copyright (c) 2020, Jane Doe|bsd-grant|* bsd-source|* bsd-binary|* bsd-endorse|bsd-as-is bsd-no-event",
    "Apache-2.0": "apache-title|http://www.apache.org/licenses/|apache-terms|1. Definitions.|apache-definition|2. Grant of Copyright License.|apache-end",
    "GPL-3.0-or-later": "prog.c does things|Copyright (C) 2020 Jane Doe|gpl-free|gpl-hope gpl-see|gpl-received If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-or-later": "Copyright (C) 2020 Jane Doe|gpl2-free|gpl-hope gpl-see|gpl-received",
    "LGPL-2.1-or-later": "Copyright (C) 2020 Jane Doe|lgpl21-free|lgpl-hope lgpl-see",
    "AGPL-3.0-or-later": "Copyright (C) 2020 Jane Doe|agpl-free|gpl-hope agpl-see",
    "GPL-3.0-only": "gpl3-title|Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>|gpl-verbatim|Preamble|gpl3-copyleft",
    "MPL-2.0": "mpl2 mpl2-copy",
    "EPL-2.0": "epl2-title|epl2-under epl-recipient",
    "BSL-1.0": "bsl-title|bsl-grant|The copyright notices in the Software must be included.",
    "Zlib": "Copyright (c) 2020 Jane Doe|zlib-as-is zlib-no-event|zlib-grant|1. zlib-origin|2. zlib-altered|3. zlib-notice",
    "Unlicense": "unlicense|unlicense-anyone",
    "OFL-1.1": "Copyright (c) 2020, Jane Doe|ofl-short|This license is copied below.|ofl-title",
}


def published(name, width=66):
    known = lambda m: licenses.SENTENCES[m[0]][-1].replace("*", "Acme Corp") if m[0] in licenses.SENTENCES else m[0]
    import re

    return "\n\n".join(textwrap.fill(re.sub(r"[a-z0-9]+(?:-[a-z0-9]+)+|unlicense\b|mpl2\b", known, p), width) for p in FILES[name].split("|"))


@pytest.mark.parametrize("name", sorted(FILES))
def test_licence_files(name):
    known = licenses.Recogniser()
    for text in (published(name), published(name, 40), "\n".join(" * " + x for x in published(name).split("\n")), "intro words\n\n" + published(name) + "\n\n" + "x y. " * 3000):
        assert [x[0] for x in known.licences(text)] == [name], text
    assert [x[0] for x in known.licences(f"// SPDX-License-Identifier: {name}\nint main()")] == [name]


def brute_licences(text, sentences, rules):
    """Every form as a pattern over the whole text, every rule at every place."""
    import re

    found, gap = [], r"(?:[\W_]+[^\W_]+){0,%d}" % licenses.GAP
    for name, forms in sentences.items():
        for form in forms:
            parts = [r"[\W_]+".join(map(re.escape, licenses.normal(p).split())) for p in form.split("*")]
            pattern = (gap + r"[\W_]+").join(p for p in parts if p) + (gap if not parts[-1] else "")
            for at in range(len(text)):
                m = re.compile(pattern + r"(?![^\W_])", re.I).match(text, at)
                if m and not re.match(r"[^\W_]", text[at - 1 : at] or " "):
                    before = [0, *(e.end() for e in licenses.END.finditer(text) if e.end() <= at)][-1]
                    end = licenses.END.search(text, m.end())
                    stop = end.start() if end else len(text)
                    if not re.search(r"[^\W_]", text[before:at]) and not re.search(r"[^\W_]", text[m.end() : stop]):
                        found.append((at, -stop, name))
    ids, reach = [], -1
    for at, stop, name in sorted(found):
        if at >= reach:
            ids.append(name)
            reach = -stop
    out, at = [], 0
    while at < len(ids):
        fit = [(len(w), lic) for w, lic in rules if tuple(ids[at : at + len(w)]) == tuple(w)]
        out += [max(fit)[1]] if fit else []
        at += max(fit)[0] if fit else 1
    return out


def test_licences_equal_brute_force():
    sentences = {"a": ["Alpha beta gamma."], "b": ["Alpha beta.", "Delta * omega v. 2."], "c": ["Delta"], "d": ["Beta, alpha: beta!"]}
    rules = ((("a", "b"), "AB"), (("a",), "A"), (("b", "c", "a"), "BCA"), (("d",), "D"), (("c",), "C"))
    known, r = licenses.Recogniser(sentences, rules), random.Random(4)
    some = 0
    for _ in range(400):
        words = [r.choice(["alpha", "Beta", "beta", "gamma", "DELTA", "omega", "v", "2", "x"]) + r.choice([" ", " ", " ", ". ", "\n", "\n\n", ": ", ", ", "\n# "]) for _ in range(r.randrange(1, 25))]
        text = "".join(words)
        want = brute_licences(text, sentences, rules)
        assert [x[0] for x in known.licences(text)] == want, text
        some += len(want)
    assert some > 100
    with pytest.raises(ValueError):
        licenses.Recogniser({"e": ["* alpha"]})


def test_licences_of_very_long_texts():
    known = licenses.Recogniser()
    text = "Some words on a line\n" * 50_000 + published("MIT") + "\n" + "more words. " * 50_000
    assert [x[0] for x in known.licences(text)] == ["MIT"]


def test_licences_of_plain_lines(spark, real):
    want = Counter()
    forms = {licenses.normal(f): n for n, fs in licenses.SENTENCES.items() for f in fs}
    names = {w[0]: lic for w, lic in licenses.RULES if len(w) == 1}
    for r in real.collect():
        for line in r["text"].split("\n"):
            if licenses.normal(line) in forms:
                want[(r["doc_id"], names[forms[licenses.normal(line)]])] += 1
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan(real).collect())
    assert got == want


def test_toxicity_folds_disguises_and_spares_exceptions():
    lex = toxicity.Lexicon({toxicity.fold("idiot"): 4.0, toxicity.fold("trash"): 4.0, " stup": 3.0})
    for text in ("You idiot.", "1d10t", "іdіоt", "IDIOT!", "tra$h", "stupidly", "ｉｄｉｏｔ", "id\u200biot"):
        assert lex.score(text)[1] == 1, text
    for text in ("trash can", "idiotic", "", None, "a 100 $5 bill"):
        assert lex.score(text)[1] == 0, text
    assert lex.score("trash can trash")[1] == 1


def test_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    lex = toxicity.fit(docs, labels, ~toxicity.held_out("i"))
    got = toxicity.score(docs, lex).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    good = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert good > 0.93 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(documents(spark, ODD, True), lex).count() == len(ODD)
    assert toxicity.keep_clean(documents(spark, ODD, True), lex).count() == len(ODD)
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(documents(spark, ODD), empty).filter("score >= 0.5").count() == 0


def test_network_gradients():
    g = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=3)
    x, y, valid = g.integers(0, 256, (5, 3)).astype(np.uint8), np.array([0, 1, 2]), np.ones((5, 3), bool)
    valid[3:, 1] = False
    _, grads = net.gradients(x, y, valid)
    for k, p in net.p.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), p.shape)
        p[at] += 1e-2
        up = net.gradients(x, y, valid)[0]
        p[at] -= 2e-2
        down = net.gradients(x, y, valid)[0]
        p[at] += 1e-2
        assert abs((up - down) / 2e-2 - grads[k][at]) < 2e-3


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs, ~langid.held_out("i"))
    got = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    odd = {r["doc_id"]: r for r in langid.identify(documents(spark, [*ODD, "123 !?"], True), net).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[len(ODD)]["lang_pred"] == "und"
    assert langid.keep_identified(docs, net).count() >= 0.99 * docs.count()
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(documents(spark, ["abc"]), none).collect()} == {"und"}


def test_empty_tables(spark):
    none = documents(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert tokens.count_tokens(none, BYTES).count() == packing.pack(none, WORDS).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == licenses.scan(none).count() == 0
    assert decontaminate.contaminated(none, bench).count() == decontaminate.contaminated(documents(spark, ["a"]), bench).count() == 0
    assert sharding.shard(none, ["a", "b"], 5).count() == 0
