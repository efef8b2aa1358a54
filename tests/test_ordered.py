"""Ordered state machines on live, disordered feeds: files in any order, one per micro-batch."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from wattline.operators import occupancy
from wattline.streaming import ordered, streams

T0 = dt.datetime(2024, 3, 4, 6, 0)
DELAY = "10 minutes"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def land(spark, rows, schema, slices, seed):
    """Rows in files of one time slice each, landed slice by slice out of order but never later than the delay:
    neighbouring slices change places, and the rows inside a file are shuffled."""
    rnd = random.Random(seed)
    folder = tempfile.mkdtemp(prefix="feed-")
    order = list(range(len(slices)))
    for i in range(0, len(order) - 1, 2):
        order[i], order[i + 1] = order[i + 1], order[i]
    for nr, k in enumerate(order):
        part = [r for r in rows if slices[k][0] <= r[-1] < slices[k][1]]
        rnd.shuffle(part)
        before = set(os.listdir(folder))
        spark.createDataFrame([(*r[:-1], at(r[-1])) for r in part], schema).coalesce(1).write.mode("append").parquet(folder)
        for f in set(os.listdir(folder)) - before:            # the feed's order is that of the files' times
            os.utime(os.path.join(folder, f), (1_700_000_000 + nr, 1_700_000_000 + nr))
    return folder


def feed_of(spark, folder, schema):
    return streams.file_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def same(a, b):
    b = b.select(*a.columns)
    return a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


SLICES = [(k * 240, k * 240 + 240) for k in range(12)]       # 4 minutes each, swapped in pairs: at most 8 minutes late
LAST = 12 * 240 - 1
CUT = at(LAST - 600)


def detections():
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["705", "hot", "hot", "hot", None]), 0, 0.9, rnd.randint(0, LAST * 4) / 4) for i in range(1500)]
    return [*rows, (9000, "705", 0, 0.9, LAST)]


DET = "det_id long, room string, class_id int, confidence double, ts timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_throttle_on_a_disordered_feed(spark, seed):
    """Everything up to the watermark equals the batch form, rooms without a name included."""
    rows = detections()
    got = streams.run_until_caught_up(streams.stream_throttle(feed_of(spark, land(spark, rows, DET, SLICES, seed), DET), 30, DELAY), "th")
    df = spark.createDataFrame([(*r[:-1], at(r[-1])) for r in rows], DET)
    want = occupancy.notification_throttle(df, 30).where(F.col("notified_at") <= F.lit(CUT))
    assert same(got, want)
    assert got.where("room IS NULL").count() > 0


def test_status_numbers_on_a_disordered_feed(spark):
    schema = "id long, room string, wifi_status string, cloud_status string, sd_card_status string, ts timestamp"
    rows = [(i, ("a", "b")[i % 3 == 0], "w", None, "s", (i * 7919) % LAST) for i in range(900)] + [(5000 + k, "a", "w", "c", "s", 77) for k in range(30)]
    rows.append((9999, "a", "w", "c", "s", LAST))
    got = streams.run_until_caught_up(streams.stream_status_downsample(feed_of(spark, land(spark, rows, schema, SLICES, 3), schema), 10, DELAY), "st")
    want = set()
    for room in "ab":
        mine = sorted((r[-1], r[0]) for r in rows if r[1] == room)
        want |= {(room, i, n + 1) for n, (s, i) in enumerate(mine) if (n + 1) % 10 == 0 and at(s) <= CUT}
    assert {(r["room"], r["id"], r["poll_no"]) for r in got.collect()} == want


def test_controller_on_a_disordered_feed(spark):
    schema = "room string, frame_ts timestamp, persons int, in_class boolean, class_event string, tick_ts timestamp"
    rnd = random.Random(8)
    rows = [(room, at(s // 60 * 60), rnd.choice([0, 0, 0, 2]) if rnd.random() < 0.3 else 0, 900 < s < 1200, "Physics" if 900 < s < 1200 else None, s)
            for room in ("x", "y", None) for s in range(5, LAST, 20)] + [("x", at(LAST), 0, False, None, LAST)]
    got = streams.run_until_caught_up(streams.stream_light_decision(feed_of(spark, land(spark, rows, schema, SLICES, 5), schema), DELAY), "li")
    want, gone = {}, 300
    for room in ("x", "y", None):
        last, on = None, False
        for _, _, persons, in_class, event, s in sorted((r for r in rows if r[0] == room), key=lambda r: r[-1]):
            last = s if persons else last
            left = gone - (s - last) if last is not None else 0
            mode = "SCHEDULE" if in_class else "PERSON" if persons or left > 0 else "OFF"
            text = f"Class: {event}" if in_class else "Person detected" if persons else f"Person left — OFF in {left}s" if left > 0 else "No class, no person"
            now = mode != "OFF"
            want[room, at(s)] = (mode, text, None if now == on else "ON" if now else "OFF")
            on = now
    want = {k: v for k, v in want.items() if k[1] <= CUT}
    assert {(r["room"], r["tick_ts"]): (r["mode"], r["event"], r["command"]) for r in got.collect()} == want


def test_late_rows_change_nothing_and_idle_state_goes(spark, tmp_path):
    """A row behind the watermark is dropped; waiting rows are bounded by the delay; a room that falls silent leaves no state."""
    folder = tempfile.mkdtemp(prefix="feed-")
    files = [[("a", s) for s in range(k * 300, k * 300 + 300, 10)] for k in range(8)]
    files[5].append(("a", 3))                                 # far behind: its time is decided
    files.append([("b", 8 * 3600)])                           # hours later, another room
    files.append([("b", 8 * 3600 + 1300)])
    for nr, part in enumerate(files):
        before = set(os.listdir(folder))
        spark.createDataFrame([(r, at(s)) for r, s in part], "room string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        for f in set(os.listdir(folder)) - before:
            os.utime(os.path.join(folder, f), (1_700_000_000 + nr, 1_700_000_000 + nr))
    feed = feed_of(spark, folder, "room string, ts timestamp")
    seen = []

    def note(batch, batch_id):
        seen.extend((r["room"], r["notified_at"]) for r in batch.collect())

    keep = {k: spark.conf.get(k, None) for k in ordered.STATE_STORE}
    for k, v in ordered.STATE_STORE.items():
        spark.conf.set(k, v)
    q = streams.stream_throttle(feed, 100, DELAY).writeStream.foreachBatch(note).outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
    for k, v in keep.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    assert sorted(seen) == [("a", at(s)) for s in range(0, 2400, 110)] + [("b", at(8 * 3600))]
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(totals) < 40                                   # chunks, not rows, and none for long
    assert totals[-1] <= 10                                   # room a is forgotten, b's last row waits
