import hashlib

import numpy as np

from wattline.llm import lcp


def random_text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def names_at(text, level):
    x, n = np.frombuffer(text.encode(), np.uint8), np.array([len(text.encode())])
    for _ in range(level):
        x, n = lcp.parse_level(x, n)
    return x


def test_equal_substrings_share_interior_names():
    shared = random_text(300, 1)
    for before in ("", "x", "other words ", random_text(20, 2)):
        a, b = names_at(shared, 3), names_at(before + shared + " tail", 3)
        assert len(set(a) & set(b)) >= len(set(a)) - 8


def test_likeness_of_fingerprints():
    t = random_text(400, 3)
    cut = t[: len(t) * 3 // 4] + random_text(400, 4)[: len(t) // 4]
    rows = lcp.fingerprints([t, t, cut, random_text(400, 5), "", ""])
    near = lcp.likeness(rows[[0, 0, 0, 4, 0]], rows[[1, 2, 3, 5, 4]])
    assert near[0] == 1 and 0.4 < near[1] < 0.8 and near[2] < 0.1 and near[3] == 1 and near[4] == 0
    repeats = lcp.fingerprints(["na " * 2000, "na " * 1500 + random_text(250, 6)])
    assert lcp.likeness(repeats[:1], repeats[1:])[0] > 0.2


def test_successors_and_odd_cases(spark):
    rows = [(i * 7, random_text(3 + i % 9, i)) for i in range(60)] + [(-5, None), (1000, ""), (1001, "é" * 4000), (14, "again"), (None, "no id"), (None, "second"), (None, None), (None, None)]
    rows += [(None, f"no id either, number {i}") for i in range(40)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string").repartition(4)
    for blocks in (1, 7):
        got = lcp.fingerprint_with_edits(df, blocks=blocks).collect()
        order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest() if r[0] is None else "", r[1]))
        want = {}
        for k, (d, t) in enumerate(order):
            q = len(t) // 4
            e = t[: len(t) - q] + order[(k + 1) % len(order)][1][:q]
            want.setdefault(d, []).append((len(t), hashlib.sha256(e.encode()).hexdigest()))
        have = {}
        for r in got:
            have.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
        assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_one_document_and_none(spark):
    one = lcp.fingerprint_with_edits(spark.createDataFrame([(1, "only this text")], "doc_id long, text string"), blocks=4).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"only this tonl").hexdigest())]
    assert lcp.fingerprint_with_edits(spark.createDataFrame([], "doc_id long, text string"), blocks=4).count() == 0
