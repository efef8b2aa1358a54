"""Segmented scans equal the single-level windows, including a hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.operators import scans


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}"
        ts = base + dt.timedelta(seconds=rnd.randint(0, 6 * 3600))
        v = None if rnd.random() < 0.05 else rnd.randint(-50, 100)
        out.append((i, key, ts, v))
    return spark.createDataFrame(out, "id long, k string, ts timestamp, v long")


def test_running_sum_max_lag_rownumber(spark):
    df = _data(spark)
    blk = F.date_trunc("minute", "ts")          # many small blocks
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = df.select(
        "id",
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"),
        F.lag("v").over(w).alias("p"),
        F.row_number().over(w).alias("rn"),
    )
    got = scans.running_sum(df, ["k"], ["ts", "id"], F.col("v"), "s", blk)
    got = scans.running_max(got, ["k"], ["ts", "id"], F.col("v"), "m", blk)
    got = scans.previous_value(got, ["k"], ["ts", "id"], F.col("v"), "p", blk)
    got = scans.row_index(got, ["k"], ["ts", "id"], "rn", blk)
    a = {r["id"]: (r["s"], r["m"], r["p"], r["rn"]) for r in ref.collect()}
    b = {r["id"]: (r["s"], r["m"], r["p"], r["rn"]) for r in got.select("id", "s", "m", "p", "rn").collect()}
    assert a == b


def test_rolling_rows_across_blocks(spark):
    df = _data(spark, n=800, seed=3).fillna(0, ["v"])
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-4, 0)
    ref = {r["id"]: (r["s"], r["n"]) for r in df.select("id", F.sum("v").over(w).alias("s"),
                                                        F.count(F.lit(1)).over(w).alias("n")).collect()}
    got = scans.rolling_rows(df, ["k"], ["ts", "id"], {"s": F.col("v")}, 5, F.date_trunc("minute", "ts"), block_rows=7)
    assert {r["id"]: (r["s"], r["_rr_n"]) for r in got.collect()} == ref


def test_time_window_reaches_the_scan(spark):
    from tests.conftest import SF_SMALL
    from wattline.sources import tables

    r = tables.readings(spark, SF_SMALL, with_counter=False, since=dt.datetime(2024, 1, 20), until=dt.datetime(2024, 1, 21))
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
    assert r.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 20))).count() == 0


def test_segmented_sessions_equal_plain_windows(spark):
    df = _data(spark, n=1500, seed=5).withColumn("t", F.unix_seconds("ts"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    for strict in (False, True):
        prev = F.lag("t").over(w)
        ref = df.withColumn("p", prev).withColumn(
            "new", (F.col("p").isNull() | ((F.col("t") - F.col("p") > 120) if strict else (F.col("t") - F.col("p") >= 120))).cast("int"))
        ref = ref.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        got = scans.segmented_sessions(df, ["k"], ["ts", "id"], F.col("t"), 120, F.date_trunc("minute", "ts"), strict=strict)
        a = {r["id"]: (r["p"], r["g"]) for r in ref.collect()}
        b = {r["id"]: (r["prev_t"], r["group_no"]) for r in got.collect()}
        assert a == b


@pytest.mark.parametrize("name,most", [
    ("occupancy_edges", 4), ("detection_changes", 6), ("occupancy_sessions", 4), ("last_seen_asof", 4), ("light_decision", 6),
    ("light_commands", 9), ("hourly_rollup", 4), ("day_summary", 4), ("latest_reading", 4), ("rolling_last_60", 4), ("downsample_status", 3)])
def test_scans_read_their_input_once(spark, name, most):
    """No broadcasts: one scan of the log, and both levels of each segmented scan read one shuffle of the rows."""
    from tests.conftest import SF_SMALL
    from wattline.plans.catalog import QUERIES

    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert plan.count("FileScan") == 1, plan
    assert plan.count("- Exchange") <= most, plan
    assert plan.count("ReusedExchange") == (2 if name == "light_commands" else 1), plan


def test_last_seen_in_frames_equals_the_union_of_ticks_and_detections(spark):
    from tests.conftest import SF_SMALL
    from wattline.operators import occupancy
    from wattline.sources import tables

    det = tables.detections(spark, SF_SMALL)
    a = occupancy.last_seen_in_frames(occupancy.frames_with_last_person(det))
    b = occupancy.last_seen(occupancy.frame_occupancy(det), occupancy.detection_filter(det)).select(*a.columns)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
