import re

import pytest

from wattline.llm import mixing


def fill(sizes, weights, budget, epochs):
    """Targets by sharing the excess out step by step."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    full = {}
    left = budget * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > epochs * sizes[s]]
        if not over:
            return {**full, **{s: level * w[s] for s in rest}}
        for s in over:
            full[s] = epochs * sizes[s]
            left -= full[s]


ROWS = [(i, None if i % 11 == 0 else " ".join(["w"] * (i % 37)), [None, "a", "b", "Z", "é"][min(4, i % 9)], "x") for i in range(300)]
ROWS += [(500, "big " * 3000, "a", "x"), (500, "big " * 3000, "a", "x"), (None, "no id", "b", "x"), (501, "", "empty", "x")]
SCHEMA = "doc_id long, text string, source string, size string"


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = mixing.mix(docs, mixing.Params(block_rows=20)).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, t, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes, (3, 1, 2), 1.5, 2)
    source = {r[0]: r[2] for r in ROWS}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(want[s] - 1 < taken[s] <= want[s] + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(5), mixing.Params(block_rows=7)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_documents_of_the_mix(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mix.collect())
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "", "a", "x"), (2, None, None, "x")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_no_shuffle_of_documents_by_source_alone(spark):
    """Without broadcasts too, documents meet by (source, block); blocks and sources alone go by source."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = mixing.sized(spark.createDataFrame(ROWS, SCHEMA))
        plan = mixing.placed(rows, mixing.Params(block_rows=20))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    tree = plan.split("== Initial Plan ==")[-1]
    wide = [line for line in tree.splitlines() if "hashpartitioning(skey" in line and ", block" in line.split("hashpartitioning(")[1].split(")")[0]]
    assert wide, plan
    scan = [i for i, line in enumerate(tree.splitlines()) if "place#" in line and "FileScan" in line]
    lines = tree.splitlines()
    for i in scan:  # the first exchange above the documents' scan
        above = next(line for line in reversed(lines[:i]) if "Exchange" in line)
        assert "hashpartitioning(skey" in above and "block" in above, plan


def test_null_ids_are_placed_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"word {i}" + " x" * i, "a", "x") for i in range(50)], SCHEMA)
    places = {r["place"] for r in mixing.sized(docs).collect()}
    assert len(places) == 50
