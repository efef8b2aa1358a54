"""Occupancy, controller and timetable semantics on hand-made rows."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline import fixed
from wattline.operators import occupancy, schedule

T0 = dt.datetime(2024, 3, 4, 6, 0, 0)   # Monday 06:00


def _det(spark, secs, room="705", conf=0.9):
    rows = [(i, room, T0 + dt.timedelta(seconds=s), 0, conf) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "det_id long, room string, ts timestamp, class_id int, confidence double")
    return df.withColumn("frame_ts", F.date_trunc("minute", "ts"))


def test_throttle_is_greedy_from_last_emitted(spark):
    secs = [0, 1, 2, 2.5, 3, 4.2, 4.9, 10, 12, 12.0001]
    got = [r["notified_at"] for r in occupancy.notification_throttle(_det(spark, secs)).orderBy("notified_at").collect()]
    want, last = [], None
    for s in secs:
        if last is None or s - last > 2:
            want.append(T0 + dt.timedelta(seconds=s))
            last = s
    assert got == want


def test_sessions_break_at_exactly_300s(spark):
    secs = [0, 299, 599, 898.9, 1300]
    s = occupancy.occupancy_sessions(_det(spark, secs)).orderBy("session_start").collect()
    assert [r["n_detections"] for r in s] == [2, 2, 1]   # 299->599 is 300 s: new session


def test_threshold_and_frames(spark):
    df = spark.createDataFrame([
        (1, "705", T0, 0, 0.70), (2, "705", T0 + dt.timedelta(seconds=1), 0, 0.69),
        (3, "705", T0 + dt.timedelta(seconds=2), 2, 0.99), (4, "705", T0 + dt.timedelta(seconds=3), 0, 0.85),
        (5, "705", T0 + dt.timedelta(minutes=1), 1, 0.99),
    ], "det_id long, room string, ts timestamp, class_id int, confidence double").withColumn(
        "frame_ts", F.date_trunc("minute", "ts"))
    f = occupancy.frame_occupancy(df).orderBy("frame_ts").collect()
    assert [(r["persons"], r["avg_confidence"], r["status"]) for r in f] == [(2, 77, "OCCUPIED"), (0, 0, "VACANT")]
    assert occupancy.clamp_threshold(5) == 0.99 and occupancy.clamp_threshold(0) == 0.10


def test_light_decision_priorities(spark):
    ticks = spark.createDataFrame([
        ("705", T0, 1, None, False, None),
        ("705", T0 + dt.timedelta(seconds=100), 0, T0, False, None),
        ("705", T0 + dt.timedelta(seconds=300), 0, T0, False, None),
        ("705", T0 + dt.timedelta(seconds=310), 0, T0, True, "GEC"),
    ], "room string, tick_ts timestamp, persons int, last_seen timestamp, in_class boolean, class_event string")
    ticks = ticks.withColumn("last_seen", F.coalesce("last_seen", F.when(F.col("persons") > 0, F.col("tick_ts"))))
    d = occupancy.light_decision(ticks).orderBy("tick_ts").collect()
    assert [(r["mode"], r["countdown"]) for r in d] == [("PERSON", 0), ("PERSON", 200), ("OFF", 0), ("SCHEDULE", 0)]
    assert d[1]["event"] == "Person left — OFF in 200s" and d[3]["event"] == "Class: GEC"
    cmds = occupancy.light_commands(occupancy.light_decision(ticks)).orderBy("tick_ts").collect()
    assert [r["command"] for r in cmds] == ["ON", "OFF", "ON"]


def test_schedule_half_open_and_first_wins(spark):
    tt = schedule.timetable(spark, [
        ("705", "Monday", "07:30", "08:30", "A"),
        ("705", "monday ", "08:00", "09:00", "B"),     # overlaps A: A wins where both apply
        ("705", "Monday", "", "10:00", "broken"),
    ])
    ticks = spark.createDataFrame([(i, "705", T0.replace(hour=h, minute=m)) for i, (h, m) in
                                   enumerate([(7, 29), (7, 30), (8, 15), (8, 30), (8, 59), (9, 0)])],
                                  "id long, room string, ts timestamp")
    got = [r["class_event"] for r in schedule.schedule_at(ticks, tt).orderBy("id").collect()]
    assert got == [None, "A", "A", "B", "B", None]
    days = spark.createDataFrame([("705", T0.date())], "room string, date date")
    conf = schedule.schedule_conflicts(schedule.schedule_for_day(days, tt)).collect()
    assert [(r["event_name"], r["overlaps_event"]) for r in conf] == [("B", "A")]


def test_gaps(spark):
    days = spark.createDataFrame([("705", dt.date(2024, 3, 5))], "room string, date date")   # Tuesday
    rows = [("705", "Tuesday", "09:00", "10:30", "A"), ("705", "Tuesday", "12:00", "13:30", "B"), ("705", "Tuesday", "13:35", "15:00", "C"),
            ("705", "Tuesday", "", "16:00", "no start")]
    gaps = schedule.schedule_gaps(schedule.schedule_for_day(days, schedule.timetable(spark, rows))).orderBy("gap_start").collect()
    assert [(r["gap_start"], r["gap_end"], r["gap_minutes"]) for r in gaps] == [("10:30", "12:00", 90)]


def test_throttle_exact_across_blocks(spark):
    import random

    rnd = random.Random(4)
    secs, t = [], 0.0
    for _ in range(400):                       # a dense burst that never pauses 2 s
        t += rnd.choice([0.05, 0.3, 0.7, 1.1, 1.9, 2.0, 2.05])
        secs.append(round(t, 2))
    got = [r["notified_at"] for r in occupancy.notification_throttle(_det(spark, secs), block_seconds=7)
           .orderBy("notified_at").collect()]
    want, last = [], None
    for s in secs:
        if last is None or s - last > 2:
            want.append(T0 + dt.timedelta(seconds=s))
            last = s
    assert got == want


def _loop(rows, cooldown):
    out, last = [], {}
    for room, us in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if room not in last or us - last[room] > cooldown * 1_000_000:
            out.append((room, us))
            last[room] = us
    return sorted(out, key=str)


def _throttled(spark, rows, **kw):
    df = spark.createDataFrame(rows, "room string, us long").select("room", F.timestamp_micros("us").alias("ts"))
    return sorted(((r["room"], r["us"]) for r in occupancy.notification_throttle(df, **kw).select("room", F.unix_micros("notified_at").alias("us")).collect()), key=str)


@pytest.mark.parametrize("cooldown,block,fan_in", [(2, 600, 4096), (5, 5, 16), (60, 10, 6), (300, 600, 40)])
def test_throttle_composed_over_levels_equals_the_loop(spark, cooldown, block, fan_in):
    """Bursts, gaps around the cooldown, ties, times before 1970, a room without a name."""
    rnd = random.Random(cooldown)
    rows = []
    for room in ("705", None, "x"):
        t = -40_000_000
        for _ in range(700):
            t += rnd.choice([0, 1, 400_000, 900_000, cooldown * 1_000_000 - 1, cooldown * 1_000_000, cooldown * 1_000_000 + 1, 40_000_000])
            rows.append((room, t))
    assert _throttled(spark, rows, cooldown_seconds=cooldown, block_seconds=block, fan_in=fan_in) == _loop(rows, cooldown)


def test_throttle_of_one_room_over_a_year(spark):
    """One room, a detection every 100 s of a year: several levels, and no task holds the room."""
    rows = [("hot", i * 100_000_000 + (i * 7919) % 50_000_000) for i in range(365 * 864)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["room", "us"])).select("room", F.timestamp_micros("us").alias("ts"))
    got = occupancy.notification_throttle(df, 120, block_seconds=3600, fan_in=64)
    assert sorted(r["us"] for r in got.select(F.unix_micros("notified_at").alias("us")).collect()) == sorted(us for _, us in _loop(rows, 120))
    assert occupancy.notification_throttle(df.limit(0)).count() == 0
