"""Runs of words against plain loops over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wattline.llm import periodic
from wattline.llm.common import segment_starts

SCHEMA = "doc_id long, text string, RUNS string, n_words string"


def brute_runs(w, least=6, times=4):
    """Every maximal stretch with period q, for all q; of equal stretches that with the smallest period."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j
    return sorted((s, n_, q) for (s, n_), q in out.items())


def brute(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    if doc_id is not None and w:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return (
        len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def found(texts):
    return [(n, runs, collapsed) for n, runs, _, collapsed in periodic.collapse([t.encode() for t in texts], list(range(len(texts))))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=0, max_size=12), st.integers(1, 9)), max_size=8))
def test_repeated_blocks(blocks):
    w = [x for block, times in blocks for x in block * times]
    (n, runs, _), = found([" ".join(w)])
    assert n == len(w)
    assert runs == brute_runs(w)


def test_many_texts_at_once():
    rnd = random.Random(5)
    texts = []
    for k in range(120):
        w: list[str] = []
        while len(w) < rnd.choice((0, 5, 8, 60, 300)):
            block = [rnd.choice("abcdefgh"[: rnd.choice((1, 2, 8))]) for _ in range(rnd.randint(1, 30))]
            w += block * rnd.choice((1, 1, 1, 4, 6)) + block[: rnd.randint(0, len(block))]
        texts.append(" ".join(w))
    texts += texts[:10]
    for t, (n, runs, _) in zip(texts, found(texts)):
        assert runs == brute_runs(t.split())
    small = periodic.Params(probes=7)  # the grid in many pieces
    assert [r[1] for r in periodic.collapse([t.encode() for t in texts], [0] * len(texts), small)] == [r[1] for r in found(texts)]


def test_common_extensions():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 40, 200, 700])
    begin = segment_starts(size + periodic.MODULUS + 1)
    x = np.zeros(int(begin[-1] + size[-1]) + periodic.MODULUS + 1, np.int64)
    for b, n in zip(begin, size):
        x[b : b + n] = np.tile(rng.integers(1, 4, 50), 20)[:n] if n > 100 else rng.integers(1, 3, n)
    lce = periodic.Lce(x, begin, size)
    for b, n in zip(begin[2:], size[2:]):
        i, j = np.triu_indices(int(n), 1)
        keep = rng.random(len(i)) < 4000 / len(i)
        i, j = i[keep] + b, j[keep] + b
        for a, c, got in zip(i, j, lce(i, j)):
            k = 0
            while c + k < b + n and x[a + k] == x[c + k]:
                k += 1
            assert got == k


def test_one_word_over_and_over():
    n, runs, collapsed = found(["la " * 5000])[0]
    assert (runs, collapsed) == ([(0, 5000, 1)], b"la")
    assert found(["x x x x x"])[0][1] == []
    assert found(["a b a b a b a"])[0][1] == []
    assert found(["a b a b a b a b"])[0][1] == [(0, 8, 2)]


def test_documents(spark):
    rnd = random.Random(11)
    docs = [(None, "a b " * 9, None, None), (0, None, "x", "y"), (1, "", "x", "y"), (2, " \t\r\n", None, None), (7, "é ü é ü é ü é ü", "x", "y")]
    docs += [(k, " ".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(1, 90))), None, None) for k in range(20, 160)]
    docs += [(7, "é ü é ü é ü é ü", "x", "y"), (500, " ".join(f"w{i % 1000}" for i in range(20_000)), None, None)]
    assert sum(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in docs if d[0]) > 5
    got = periodic.digests(periodic.collapse_runs(spark.createDataFrame(docs, SCHEMA).repartition(3), edit=periodic.repeated_tail)).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    short = [d for d in docs if d[0] != 500]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], *[r[c] for c in names]) for r in got if r["doc_id"] != 500), key=key) == sorted(((d[0], *brute(d[0], d[1])) for d in short), key=key)
    long, = [r for r in got if r["doc_id"] == 500]
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 20_000, 1000, 20_000)
    assert periodic.collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
