"""Samples, windows and blocks: exact, bounded, and independent of the order of rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from stemma.llm import decontaminate, fingerprint, langid, packing, sample, sharding, simhash, toxicity

from tests.llm.test_text_operators import corpus, documents, levenshtein_best

WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- samples ---------------------------------------------------------------------------------------


def test_samples_are_the_first_by_hash(spark):
    rows = [(y, i) for i in range(3000) for y in ([1] if i % 10 == 0 else [0])] + [(0, 10), (1, 7)] * 5 + [(1, 20)] * 500
    marks = spark.createDataFrame(rows, "y int, i long")
    both = {i for i in range(3000) if {y for y, j in rows if j == i} == {0, 1}}
    assert both == {10, 7}
    place = {r["i"]: r["p"] for r in spark.range(3000).select(F.col("id").alias("i"), F.pmod(F.xxhash64(F.lit("s"), "id"), F.lit(sample.RANGE)).alias("p")).collect()}
    for exclusive in (False, True):
        for df in (marks, marks.repartition(7).orderBy(F.desc("i"))):
            got = {tuple(r) for r in sample.drawn(df, sample.counted(df), {0: 50, 1: 20}, "s", exclusive).collect()}
            want = set()
            for y, k in ((0, 50), (1, 20)):
                ids = {i for x, i in rows if x == y} - (both if exclusive else set())
                want |= {(y, i) for i in sorted(ids, key=lambda i: (place[i], i))[:k]}
            assert got == want


def test_samples_of_one_hot_id(spark):
    """A class nearly all of whose rows have one id still gives all the ids that it has."""
    marks = spark.createDataFrame([(0, 5)] * 4000 + [(0, i) for i in range(30)], "y int, i long")
    assert {r["i"] for r in sample.drawn(marks, sample.counted(marks), {0: 25}, "s").collect()} < set(range(30))
    assert sample.drawn(marks, sample.counted(marks), {0: 25}, "s").count() == 25


def plain_density(lex, text):
    """Every entry searched for at every place of the folded text."""
    folded = toxicity.fold(text or "")
    spared = [(a, a + len(f) - 1) for e in lex.exceptions for f in [toxicity.fold(e)] for a in range(len(folded)) if folded.startswith(f, a)]
    total = hits = 0
    for a in range(len(folded)):
        found = [(x, len(w)) for w, x in lex.weights.items() if folded.startswith(w, a)]
        if found:
            best = max(x for x, _ in found)
            end = a + min(n for x, n in found if x == best) - 1
            if not any(x <= a and min(end, a + 2) <= y for x, y in spared):
                total, hits = total + best, hits + 1
    return total / (1 + math.log1p(folded.count(" ") / 100)), hits


def test_toxicity_equals_a_plain_search():
    lex = toxicity.Lexicon({" idiot ": 4.0, " idi": 2.0, " idio": 4.0, " trash ": 3.0, " stup": 3.0, " scum ": 2.5}, ("trash can", "pond scum", "idiot box"))
    r = random.Random(2)
    for _ in range(500):
        text = " ".join(r.choice(["idiot", "1diot", "idi", "idiom", "trash", "can", "tra$h", "stupidly", "pond", "scum", "box", "fine", "ídiot", "день"]) for _ in range(r.randrange(0, 40)))
        got, want = lex.density(text), plain_density(lex, text)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, text


def test_long_conversations_take_linear_time(spark):
    from stemma.llm import chat

    n = 60_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t%<|"), F.col("id").cast("string")).alias("text"))
    r = chat.format_chats(rows).withColumn("turns", chat.parse_chats(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user" if i % 5 < 2 else "assistant", f"t%<|{i}") for i in range(n)]
    assert len(r["loss_spans"]) == n * 3 // 5
    for s, i in list(zip(r["loss_spans"], [i for i in range(n) if i % 5 > 1], strict=True))[::997]:
        assert r["formatted"][s["begin"] : s["begin"] + s["length"]] == f"t%25<%7C{i}"


def labelled(spark):
    r = random.Random(3)
    plain = corpus(300, seed=4)
    texts = [t + (" " + r.choice(["idjotix", "skumbag", "vileword"]) * (i % 3 == 0)) for i, t in enumerate(plain)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null id " + texts[0]), (4, "another text of four")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (9, 0), (9, 1)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_learns_the_same_from_any_order(spark):
    docs, labels = labelled(spark)
    one = toxicity.fit(docs, labels)
    two = toxicity.fit(docs.repartition(9).orderBy(F.desc("text")), labels.orderBy(F.desc("doc_id")))
    assert one.weights == two.weights and one.slope == pytest.approx(two.slope, rel=1e-12) and one.offset == pytest.approx(two.offset, rel=1e-12)
    assert len(one.weights) > len(toxicity.SEED_WORDS)


def test_toxicity_learns_from_long_texts(spark):
    long = " ".join(corpus(40, seed=8))
    docs = spark.createDataFrame([(i, f"{i} start {long} {'vurmish' * (i % 2)} finish {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert len(long) > 12_000
    assert any(w.strip().startswith("vur") for w in toxicity.fit(docs, labels).weights)


@pytest.mark.parametrize("around", ["", " ключ", " 東京", " x²"])
@pytest.mark.parametrize("word", ["idiot", "ídíot", "ídiot", "1D10T", "ｉｄｉｏｔ", "id­iot", "idi0t", "𝐢𝐝𝐢𝐨𝐭"])
def test_folding_does_not_depend_on_the_rest(word, around):
    assert toxicity.fold(word + around).split()[0] == "idiot"
    assert toxicity.fold("idiot²" + around) == toxicity.fold("idiot " + around)


def test_folding_of_ascii_is_that_of_all_texts():
    r = random.Random(9)
    for _ in range(500):
        t = "".join(chr(r.randrange(32, 127)) for _ in range(40))
        assert toxicity.fold(t).split() == toxicity.fold(t + " 一").split()[:-1]


def test_languages_all_take_part(spark):
    rows = [(i, f"text number {i} of {i % 70}", f"l{i % 70:02d}") for i in range(700)] + [(None, "null id only", "zz"), (701, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, windows, labels = langid.sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert langs == sorted({f"l{k:02d}" for k in range(70)}) and len(windows) == len(labels) >= 700
    again = langid.sample(docs.repartition(5).orderBy(F.desc("text")), F.lit(True), "doc_id", "text", "lang")
    assert again == (langs, windows, labels)
    few = langid.sample(docs.filter("doc_id < 140"), ~langid.held_out("i"), "doc_id", "text", "lang")
    assert len(few[1]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(140))


def test_language_training_reads_whole_texts():
    data = bytes(range(256)) * 100
    w = langid.windows(data)
    assert 1 < len(w) <= langid.WINDOWS_EACH and all(len(x) == langid.TRAIN_WINDOW for x in w) and w == langid.windows(data)
    places = sorted({data.find(x) for x in w})
    assert max(places) > 128 and langid.windows(b"") == [b""] and langid.windows(b"short") == [b"short"]


def plain_network(net, data):
    """Mean probabilities by a loop over single bytes, gates written out."""
    def sig(x):
        return 1 / (1 + np.exp(-x))

    def run(part, d):
        h, out = np.zeros(net.h), {}
        for k in range(len(part)) if d == "f" else range(len(part) - 1, -1, -1):
            x, u, n = net.p["W" + d][part[k]].astype(float), net.p["U" + d].astype(float), net.h
            z, r = sig(x[:n] + h @ u[:, :n]), sig(x[n : 2 * n] + h @ u[:, n : 2 * n])
            c = np.tanh(x[2 * n :] + r * (h @ u[:, 2 * n :]))
            h = c + z * (h - c)
            out[k] = h
        return out

    total, pad = np.zeros(len(net.langs)), b" " * langid.MARGIN
    blocks = -(-len(data) // langid.WINDOW)
    full = pad + data + b" " * (blocks * langid.WINDOW - len(data)) + pad
    for b in range(blocks):
        part = full[b * langid.WINDOW : (b + 1) * langid.WINDOW + 2 * langid.MARGIN]
        f, g = run(part, "f"), run(part, "b")
        for k in range(langid.MARGIN, langid.MARGIN + langid.WINDOW):
            if b * langid.WINDOW + k - langid.MARGIN < len(data):
                y = np.r_[f[k], g[k]] @ net.p["V"].astype(float) + net.p["c"]
                e = np.exp(y - y.max())
                total += e / e.sum()
    return total / len(data)


def test_network_equals_a_plain_loop():
    net = langid.Network(["a", "b", "c"], hidden=3)
    texts = [t.encode()[:n] for t, n in zip(corpus(4, seed=5), (5, 128, 300, 129), strict=True)]
    got = net.documents([*texts, b""])
    for t, p in zip(texts, got, strict=False):
        assert np.abs(plain_network(net, t) - p).max() < 1e-5
    assert np.allclose(got[-1], 1 / 3)


def test_und_is_for_texts_without_a_letter():
    net = langid.Network(["a", "b"])
    for t in ("²", "½ ³", "123", "_", "́", "", None, "①②"):
        assert langid.rated(net, [t]) == [("und", 0.0)], t
    for t in ("a", "é", "日", "ª"):
        assert langid.rated(net, [t])[0][0] != "und", t


# ---- packing ---------------------------------------------------------------------------------------


def brute_place(lengths, size, windows):
    """Lengths of finished sequences and of open windows, by the rule in words."""
    done, open_ = [], []
    for n in lengths:
        while n >= size:
            done.append(size)
            n -= size
        if not n:
            continue
        fits = [w for w in open_ if size - sum(w) >= n]
        if fits:
            w = min(fits, key=lambda w: size - sum(w))
        elif len(open_) < windows:
            w = []
            open_.append(w)
        else:
            fullest = max(open_, key=sum)
            open_.remove(fullest)
            n -= size - sum(fullest)
            done.append(size)
            w = []
            open_.append(w)
        w.append(n)
        if sum(w) == size:
            open_ = [x for x in open_ if x is not w]
            done.append(size)
    return done, sorted(map(sum, open_))


@pytest.mark.parametrize("windows", [1, 2, 5])
def test_packing_places_by_best_fit(windows):
    r = random.Random(windows)
    for _ in range(60):
        lengths = [r.choice([1, 2, 3, 5, 8, 13, 30]) for _ in range(r.randrange(1, 60))]
        p, done = packing.Packer(10, windows, 0), []
        for i, n in enumerate(lengths):
            done += p.place(i, 0, bytes(4 * n), n)
        sizes = Counter()
        for row in done:
            sizes[row[5]] += row[2]
        assert (sorted(sizes.values()), sorted(10 - room for room, _ in p.open)) == tuple(map(sorted, brute_place(lengths, 10, windows)))


@pytest.mark.parametrize(("parts", "n"), [(1, 10), (1, 16), (3, 40), (20, 40)])
def test_packing_leaves_one_short_sequence(spark, parts, n):
    """Windows that all stay open: documents of 3,000 ids do not fit together."""
    docs = documents(spark, ["the " * 2999] * n).repartition(parts)
    sizes = [r["n"] for r in packing.pack(docs, WORDS).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == 3000 * n and sum(x < 4096 for x in sizes) <= 1


def test_packing_of_a_huge_document(spark):
    docs = documents(spark, ["a b c d " * 300_000, "x"])
    rows = packing.pack(docs, WORDS).collect()
    assert sum(r["length"] for r in rows) == 1_200_001 + 2 and len({r["sequence_id"] for r in rows}) == -(-1_200_003 // 4096)


def test_packing_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["length"]) for r in packing.pack(docs, WORDS).collect()) == [(-1, 3), (-1, 3), (3, 2), (3, 4)]


# ---- fingerprints ----------------------------------------------------------------------------------


def true_likeness(a, b):
    """1 - |a - b|^2 / (|a|^2 + |b|^2) over the multisets of three-word runs."""
    x, y = (Counter(zip(["", "", *w], ["", *w], w, strict=False)) for w in (a.split(" "), b.split(" ")))
    gap = sum((x[k] - y[k]) ** 2 for k in x.keys() | y.keys())
    return 1 - gap / (sum(v * v for v in x.values()) + sum(v * v for v in y.values()))


@pytest.mark.parametrize("n", [30, 1000, 30_000, 300_000])
def test_likeness_is_near_the_true_one(spark, n):
    r = random.Random(n)
    words = lambda: [f"w{r.randrange(50_000)}" for _ in range(n)]
    one, two = words(), words()
    texts = [" ".join(one), " ".join(two), " ".join(one[: 2 * n // 3] + two[: n // 3])]
    out = {x["doc_id"]: x["near_next"] for x in fingerprint.compare_with_next(documents(spark, texts)).collect()}
    for k, nxt in ((0, 2), (1, 0), (2, 1)):
        want = true_likeness(texts[k], texts[nxt])
        assert abs(out[k] - max(0, want)) < 0.4, (k, out[k], want)
    assert out[0] > out[1]


@pytest.mark.parametrize("parts", ["1", "3", "13"])
def test_next_documents_of_hot_and_null_ids(spark, parts):
    r = random.Random(7)
    rows = [(7, f"seven {k}") for k in range(40)] + [(None, f"none {k}") for k in range(40)] + [(k, f"t{k}") for k in r.sample(range(1000), 40)] + [(7, "seven 1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint.with_next(df.withColumn("tie", F.xxhash64("text")), "doc_id", ["text"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(((x["doc_id"] is None, -(x["doc_id"] or 0), -x["tie"]), x["text"]) for x in got)
    want = Counter((a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((x["text"], x["next_text"]) for x in got) == want and len(got) == len(rows)


def test_ranges_go_to_a_partition_each(spark):
    keys = fingerprint.partition_keys(spark, 25, 10)
    where = [r["p"] for r in spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(10)).alias("p")).collect()]
    assert where == [k % 10 for k in range(25)] and len(set(keys)) == 25


# ---- decontamination -------------------------------------------------------------------------------


def test_short_items_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "cat"), (2, "Big cat!")], "item_id long, text string")
    docs = documents(spark, ["the category", "a CAT.", "big cat", "bigcat", "cat"])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (4, 1)}


def test_five_blocks_keep_what_brute_force_keeps(spark, monkeypatch):
    texts = corpus(10, seed=2)
    items = [(i, t[:150]) for i, t in enumerate(texts)] + [(1, texts[1][:150]), (None, texts[2][:140])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    others = corpus(10, seed=77)
    docs = documents(spark, [*("x " + t[:150] + " y" for t in texts[:6]), *others, None, "", None], True).withColumn("h", F.lit(1))
    docs = docs.unionByName(docs.filter("doc_id in (0, 7)")).unionByName(docs.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    whole = sorted(decontaminate.contaminated(docs, bench).collect(), key=str)
    kept = sorted(decontaminate.keep_uncontaminated(docs, bench).collect(), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    assert len(list(decontaminate.blocks_of(bench, "item_id", "text"))) >= 5
    assert sorted(decontaminate.contaminated(docs, bench).collect(), key=str) == whole
    again = decontaminate.keep_uncontaminated(docs, bench)
    assert sorted(again.collect(), key=str) == kept and again.columns == docs.columns
    p = [decontaminate.plain(t) for _, t in items]
    clean = [t for t in others if not any(levenshtein_best(x, f" {decontaminate.plain(t)} ") <= decontaminate.budget(len(x)) for x in p)]
    assert Counter(r["text"] for r in kept if r["text"]) == Counter(clean + [t for t in (others[1], others[2]) if t in clean])
    assert sum(r["text"] is None for r in kept) == 2


# ---- trie and shards -------------------------------------------------------------------------------


def test_blocks_of_any_heat_lose_no_link(spark, monkeypatch):
    """One block of thousands of fingerprints is dealt out four, eight and twelve levels down."""
    monkeypatch.setattr(simhash, "HOT_BLOCK", 2)
    g = np.random.default_rng(6)
    base = g.integers(0, 2**40, 300, dtype=np.int64)
    keys = np.unique(np.r_[base, base ^ (1 << g.integers(0, 40, 300)), base[:150] ^ (1 << g.integers(0, 40, 150)) ^ (1 << g.integers(0, 40, 150)), g.integers(0, 2**62, 50)])
    got = {r["fp"]: r["root"] for r in simhash.classes(spark.createDataFrame([(int(k),) for k in keys], "fp long")).collect()}
    root = np.arange(len(keys))
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 2
    for _ in range(len(keys)):
        new = np.where(near, root[None], len(keys)).min(axis=1)
        if (new == root).all():
            break
        root = new
    assert got == {int(k): int(keys[r]) for k, r in zip(keys, root, strict=True)}


def test_a_large_table_of_slots(spark):
    rows = sharding.lookup_table(spark, [f"s{k}" for k in range(5)], 8191).collect()
    assert sorted(r["slot"] for r in rows) == list(range(8191)) and max(Counter(r["shard"] for r in rows).values()) == math.ceil(8191 / 5)
