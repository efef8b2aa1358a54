import numpy as np
from pyspark.sql import functions as F

from wattline.llm import toxicity
from wattline.llm.common import crc_mod, table


def test_held_out_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    held = labels.filter(crc_mod(F.col("doc_id"), 3) == 1)
    got = toxicity.detect(docs, model).join(held, "doc_id").select("toxic", "predicted", "score").collect()
    hit = sum(r.predicted for r in got if r.toxic == 1)
    assert hit / sum(r.toxic == 1 for r in got) > 0.7
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def made(n=400):
    rng = np.random.default_rng(3)
    vocab = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        sents = [" ".join(rng.choice(vocab, 8)) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            sents[2] += " vileterm"
        rows.append((i, ". ".join(sents) + ".", int(toxic)))
    return rows


def test_locates_the_sentence_and_odd_cases(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10**6, 1), (None, 1), (5, None)], "doc_id long, toxic int").filter("doc_id is null or doc_id <> 5 or toxic is null")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "... !!", "x"), (4, "All fine here. A VILETERM, there! Fine.", "x"), (None, "vileterm", "x"), (5, "word1 word2. " * 5000, "x")], "doc_id long, text string, score string")
    got = toxicity.detect(odd, model).collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1, 1, 0] and [r.score for r in got[:3]] == [0, 0, 0]
    (span,) = got[3].offending
    assert "All fine here. A VILETERM, there! Fine."[span.start : span.end] == " A VILETERM, there"


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.detect(docs, none).collect()] == [0.0, 0.0]
    one = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.detect(docs, one).collect()] == [1.0, 0.0]
    assert toxicity.detect(docs.limit(0), none).count() == 0


def test_scores_equal_a_plain_noisy_or(spark):
    """Sentence by sentence and word by word: 1 - prod(1 - p) with p the logistic of the summed weights."""
    import math
    import re

    rows = made(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = [t for _, t, _ in rows[:60]] + ["Vileterm!", "wörd1 VILETERM\nvileterm? no", "word3 " * 3000 + ". vileterm word1", "é...", None, ""]
    cache = toxicity.WordWeights(model)
    got = toxicity.score(model, texts, cache)
    for text, g in zip(texts, got):
        clean = 1.0
        for sentence in re.split(r"[.!?\r\n]", (text or "").lower()):
            words = re.findall(rb"[a-z0-9\x80-\xff]+", sentence.encode())
            if words:
                z = model.bias + sum(float(model.weights[f]) for w in words for f in toxicity.features(w, model.bits, model.prefixes))
                clean *= 1 - 1 / (1 + math.exp(-max(-700, min(700, z))))
        assert abs(g - (1 - clean)) < 1e-6


def test_several_labels_of_a_document(spark):
    rows = made(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    one = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    more = one.union(one.filter("toxic = 1").select("doc_id", F.lit(0).alias("toxic"))).union(one)
    a, b = toxicity.train(docs, one), toxicity.train(docs, more)
    assert np.array_equal(a.weights, b.weights)
