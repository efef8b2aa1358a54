import numpy as np
from pyspark.sql import Row

from wattline.llm.common import WordHashes, table
from wattline.llm.setsketch import Params, components, estimate, merge, near_duplicates, registers, shingle_sets

SCHEMA = "doc_id long, text string, n_shingles string, ck string"  # two clashing extra columns


def brute(rows, percent):
    """component_id by all pairs."""
    sets = shingle_sets([t for _, t in rows], 5, WordHashes())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)] if len(sets[i]) else d) for i, (d, _) in enumerate(rows) if d is not None}


def test_against_brute_force_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(200)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, Params(percent=85)).collect()}
    assert got == brute(rows, 85)


def test_groups_chains_and_odd_cases(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(40):  # near copies with more and more edits: some linked only over others
        words = list(base)
        for k in rng.integers(0, 120, i // 8):
            words[k] = f"e{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "two one"), (7, "x " * 30000), (8, "x " * 30000), (None, "one two"), (4, "One two")]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA)
    got = near_duplicates(df, Params(percent=85, block=8)).collect()
    want = brute(rows, 85)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [4]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert want[1] == (0, 1) and want[5] == (1, 4) and want[6] == (1, 6) and want[8][1] == 7


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    p = Params(m=1024)
    a, b = (np.unique(rng.integers(0, 2**62, 3000).astype(np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([a[:2500], b]))
    ra, rb, rab = registers([a, both, np.unique(np.concatenate([a, both]))], p)
    assert (merge(ra, rb) == rab).all()
    true = len(np.intersect1d(a, both)) / len(np.union1d(a, both))
    est = estimate(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(both))]), p.b)[0]
    assert abs(est - true) < 0.06


def test_components_of_a_path(spark):
    n = 40
    links = spark.createDataFrame([Row(a=bytes([i]), b=bytes([i + 1])) for i in range(n)] + [Row(a=b"\xf0", b=b"\xf1")])
    got = {bytes(r.ck): bytes(r.root) for r in components(links).collect()}
    assert got == {**{bytes([i]): b"\x00" for i in range(n + 1)}, b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_links_at_the_thresholds_in_use_are_missed_as_rarely_as_stated():
    for percent, chance in ((80, 2e-6), (85, 1e-8)):
        p = Params(percent=percent)
        assert p.m % p.rows == 0 and (1 - p.threshold**p.rows) ** (p.m // p.rows) < chance
