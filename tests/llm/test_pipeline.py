"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from stemma.llm import decontaminate, langid, simhash, toxicity

from tests.conftest import DATA
from tests.llm.test_text_operators import brute_kept, corpus, documents


def test_stages_decide_as_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    a = stages["language"](spark, docs, DATA)
    net = langid.fit(docs)
    want = {r["doc_id"] for r in langid.identify(docs, net).filter("lang_pred <> 'und' and score >= 0.4").collect()}
    assert {r["doc_id"] for r in a.collect()} == want and a.columns == docs.columns
    b = stages["toxicity"](spark, docs, DATA)
    lex = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in b.collect()} == {i for i, t in texts.items() if lex.score(t)[0] < 0.5} and b.columns == docs.columns
    c = stages["simhash"](spark, docs, DATA)
    order = sorted(texts)
    assert {r["doc_id"] for r in c.collect()} == {order[k] for k in brute_kept([texts[i] or "" for i in order])} and c.columns == docs.columns
    d = stages["decontamination"](spark, docs, DATA)
    m = decontaminate.Matcher([(r["item_id"], r["text"]) for r in bench.collect()])
    assert {r["doc_id"] for r in d.collect()} == {i for i, t in texts.items() if not m.matches(t)} and d.columns == docs.columns
    assert simhash.BITS == 64


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert 0 < len(docs) <= 200 and all(r["n"] == r["m"] for r in docs)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_tables(spark, name):
    """Empty tables give no rows; null ids, nulls, repeated rows and clashing columns neither fail nor get lost but by the stage's own rule."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert stage(spark, docs.limit(0), DATA).count() == 0
    base = corpus(6, seed=31)
    rows = [(None, base[0], None, None), (None, base[0], None, None), (None, base[1], "en", None), (1, base[2], None, "s"), (1, base[3], None, "s"), (1, base[2], None, "s"), (2, None, None, None), (3, "", "en", None), (4, "long " + " ".join(corpus(60, seed=32)), "en", "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("_id", "_fp", "_often", "_c0", "fp", "root", "tid", "h", "n", "ids", "key", "score", "u", "v", "component_id"):
        odd = odd.withColumn(c, F.lit("clash"))
    out = stage(spark, odd, DATA)
    kept = [r["doc_id"] for r in out.collect()]
    if name == "packing":
        assert set(kept) == {None, 1, 2, 3, 4}
        return
    assert out.columns == odd.columns
    # without a label for these languages all texts with a letter are kept; equal rows are one group for the deduplication
    want = {"language": [None] * 3 + [1] * 3 + [4], "simhash": [None] * 2 + [1] * 2 + [2, 4], "toxicity": [None] * 3 + [1] * 3 + [2, 3, 4], "decontamination": [None] * 3 + [1] * 3 + [2, 3, 4]}[name]
    assert sorted(map(str, kept)) == sorted(map(str, want)), kept


def test_language_stage_without_any_label(spark):
    docs = documents(spark, ["one two", "123", None]).withColumn("lang", F.lit(None).cast("string"))
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs, DATA).collect()] == [0]
