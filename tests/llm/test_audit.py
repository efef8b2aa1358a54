"""Filter interaction audit against plain loops, and the document-term matrix against its texts."""

import itertools
import re
from collections import Counter

from wattline.llm import audit

P = audit.Params(few_words=4, shard_bytes=60, buckets=5, salts=3)
SCHEMA = "doc_id long, text string, lang string, source string, PART string"
TEXTS = [
    None, "", " \t\n", "one two three four five", "one two three four five", "a a a a a a", "A B C D e f g", "pay $5 now or never today",
    "# short", "é ü ñ x y z w", "a a a a a a", "AB" * 40 + " b c d e", "x " * 500, "Dup dup DUP dup dup", "tie tie tie tie",
]
DOCS = [(i, t, ("en", "fr", None, "")[i % 4], "s", "x") for i, t in enumerate(TEXTS)]
DOCS += [(None, "a a a a a a", "en", "s", "x"), (None, "a a a a a a", "en", "s", "x"), (3, TEXTS[3], "en", "s", "x"), (3, TEXTS[3], "en", "s", "x"), (100, "a a a a a a", "fr", "s", "x")]
LABELS = [(1, 1, 0), (3, 1, 1), (5, 0, 1), (5, 1, 0), (7, None, 1), (10, 1, 0), (None, 1, 1), (100, 1, 1), (999, 1, 1)]


def fails_of(text, doc_id, ids_of):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    out = "A" if len(w) < P.few_words else ""
    out += "B" if 100 * len(set(w)) < 50 * len(w) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
    out += "D" if re.search("[#$%&*|]", t) else ""
    return out + ("E" if doc_id is not None and any(i is not None and i < doc_id for i in ids_of[t]) else "")


def brute(docs, labels):
    ids_of = {}
    for d in docs:
        ids_of.setdefault(d[1] or "", []).append(d[0])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    out, shap = Counter(), Counter()
    parts = {d[2] or "" for d in docs}
    for d in docs:
        part, f = d[2] or "", fails_of(d[1], d[0], ids_of)
        for o in orders:
            at = next((k for k, x in enumerate(o) if x in f), 5)
            for k, x in enumerate(o):
                key = (part, o, k + 1)
                out[key, "kept"] += at > k
                out[key, "removed"] += at == k
                out[key, "redundant"] += x in f and at < k
                out[key, "unique_fails"] += f == x
                out[key, "good_lost"] += at == k and d[0] in good
                out[key, "toxic_lost"] += at == k and d[0] in toxic
            if at < 5:
                shap[part, o[at]] += 1
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, k + 1): (*[out[(p, o, k + 1), n] for n in names], shap[p, x]) for p in parts for o in orders for k, x in enumerate(o)}


def result(spark, docs, labels):
    d = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), P).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got}


def test_equals_loops_with_nulls_ties_and_repeated_rows(spark):
    assert result(spark, DOCS, LABELS) == brute(DOCS, LABELS)


def test_empty_tables(spark):
    assert result(spark, [], LABELS) == {}
    assert result(spark, DOCS[3:6], []) == brute(DOCS[3:6], [])


def test_matrix_holds_the_words_of_the_texts(spark):
    docs = [(i, f"w{i % 7} w{i % 3} w{i % 7} x{i}", "en", "s", "x") for i in range(200)] + [(900, None, None, None, None)]
    matrix, words = audit.term_matrix(spark.createDataFrame(docs, SCHEMA).repartition(5), P)
    name = {r["id"]: r["word"] for r in words.collect()}
    assert sorted(name) == list(range(len(name))) and len(set(name.values())) == len(name)
    got = {}
    for r in matrix.collect():
        for k, i in enumerate(r["doc_id"]):
            lo, hi = r["indptr"][k], r["indptr"][k + 1]
            got[i] = Counter({name[c]: n for c, n in zip(r["indices"][lo:hi], r["counts"][lo:hi])})
    assert got == {d[0]: Counter((d[1] or "").split()) for d in docs}
    assert matrix.count() > 5
