import numpy as np

from wattline.llm import langid
from wattline.llm.common import crc_mod, table


def test_held_out_accuracy_and_few_rejections(spark):
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    held = langid.identify(docs.filter(crc_mod(F.col("doc_id"), 5) == 0), model).collect()
    right = [r.lang == r.langid.lang for r in held]
    assert np.mean(right) > 0.98
    assert np.mean([r.langid.rejected for r in held]) < 0.02
    assert all(0 <= r.langid.score <= 1 for r in held)


def test_odd_cases_and_clashing_columns(spark):
    texts = ["the quick brown fox jumps over the dog and runs home", "der schnelle braune fuchs springt über den hund und läuft"] * 60
    rows = [(i, t, "en" if i % 2 == 0 else "de", "x") for i, t in enumerate(texts)]
    train = spark.createDataFrame(rows + [(900, None, "en", "x"), (901, "abc", None, "x")], "doc_id long, text string, lang string, langid string")
    model = langid.train(train)
    assert model.langs == ["de", "en"]
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "123 !? 。", "k"), (4, texts[1], "k"), (5, texts[0] * 2000, "k"), (None, texts[0], "k")], "doc_id long, text string, langid string")
    got = langid.identify(odd, model)
    assert got.columns == ["doc_id", "text", "langid", "_langid"]
    found = [(r.doc_id, r._langid.lang, r._langid.rejected) for r in got.collect()]
    assert found == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "de", False), (5, "en", False), (None, "en", False)]
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3


def test_nothing_to_learn_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(none)
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [r.langid.lang for r in langid.identify(one, model).collect()] == ["und"]
    assert langid.identify(one.limit(0), model).count() == 0


def test_scores_equal_a_naive_mean_of_grams():
    """Gram by gram in a loop: mean of the table's rows of all 1- to 4-grams, plus the bias, through the softmax."""
    texts = ["the quick brown fox jumps over the dog", "der schnelle braune fuchs springt über den hund"] * 40
    p = langid.Params(epochs=2, bits=12)
    model = langid.fit(texts, ["en", "de"] * 40, p)
    some = ["The fox, 42 dogs", "über den Hund", "ß", "a", "fox" * 500, "日本 fox", "x-y_z"]
    langs, scores = langid.predict(model, some)
    for text, lang, score in zip(some, langs, scores):
        raw = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in b" " + text.lower().encode() + b"    ")
        rows = []
        for i in range(len(raw)):
            for k in range(1, 5):
                gram = raw[i : i + k]
                if len(gram) < k or set(gram) == {0x20} or 0x20 in gram[1:-1]:
                    continue  # nothing but borders, or a border inside
                h = int.from_bytes(gram, "little") * langid._MULTIPLIERS[k - 1] & 0xFFFFFFFF
                rows.append(model.table[h >> (32 - model.bits)].astype(float))
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        prob = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang == model.langs[int(prob.argmax())] and abs(score - prob.max()) < 1e-5
