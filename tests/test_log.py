"""The stored log: unique append, stream sink, retention over three tables, export of days."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wattline.sources import log, sinks

DAY = dt.datetime(2024, 1, 1)
COLS = "ts timestamp, room string, voltage double, current double, power double, energy_kwh double, light_state string, nr int"


def reading(day, seconds, room="705", power=1.0, nr=0, energy=0.5):
    return (DAY + dt.timedelta(days=day, seconds=seconds), room, 220.0, 0.1, power, energy, "OFF", nr)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def stored(spark, path):
    return sorted((r["ts"], r["room"], r["power"]) for r in spark.read.parquet(path).collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "log")


def test_a_file_appended_twice_is_there_once(spark, path):
    rows = [reading(d, s, room, nr=i) for i, (d, s, room) in enumerate((d, s, room) for d in range(3) for s in range(5) for room in ("705", "706"))]
    for _ in range(2):
        log.append_unique(frame(spark, rows), path, ["nr"])
    assert stored(spark, path) == sorted((r[0], r[1], r[4]) for r in rows)
    assert log.stored_days(spark, path) == [dt.date(2024, 1, d) for d in (1, 2, 3)]


def test_first_of_a_second_counts_and_nulls(spark, path):
    """Parts of a second, repeats in a batch, repeats of stored rows, a missing room (the table's default), no time."""
    half = dt.timedelta(microseconds=500_000)
    a = [reading(0, 5, power=2.0, nr=2), (DAY + dt.timedelta(seconds=5) + half, "705", 220.0, 0.1, 1.0, 0.5, "OFF", 1), (None, "705", 1.0, 1.0, 1.0, 1.0, "ON", 3),
         (DAY, None, None, None, None, None, None, 4)]
    log.append_unique(frame(spark, a), path, ["nr"])
    assert stored(spark, path) == [(DAY, "705", 0.0), (DAY + dt.timedelta(seconds=5) + half, "705", 1.0)]
    log.append_unique(frame(spark, [reading(0, 5, power=9.0), reading(0, 0, power=9.0), reading(0, 6, power=3.0), reading(0, 5, "706", power=4.0)]), path, ["nr"])
    assert [r[2] for r in stored(spark, path)] == [0.0, 1.0, 4.0, 3.0] or sorted(r[2] for r in stored(spark, path)) == [0.0, 1.0, 3.0, 4.0]
    log.append_unique(frame(spark, []), path)
    log.append_unique(spark.read.parquet(path), path, ["nr"])          # its own rows, with their day column
    assert spark.read.parquet(path).count() == 4


def test_a_committed_batch_is_not_read_again(spark, path):
    log.append_unique(frame(spark, [reading(0, 1)]), path, batch="q-0")
    log.append_unique(frame(spark, [reading(0, 2)]), path, batch="q-0")        # the same batch replayed
    log.append_unique(frame(spark, [reading(0, 2)]), path, batch="q-1")
    assert len(stored(spark, path)) == 2


def test_only_the_batchs_days_are_read(spark, path):
    log.append_unique(frame(spark, [reading(d, 1) for d in range(5)]), path)
    part = log.read_days(spark, path, [dt.date(2024, 1, 2), dt.date(2030, 1, 1)])
    assert {f.split("date=")[1][:10] for f in part.inputFiles()} == {"2024-01-02"}
    assert log.read_days(spark, path, [dt.date(2030, 1, 1)]) is None


def test_stream_sink_appends_once(spark, path, tmp_path):
    """One file per micro-batch, the same file landed twice, a batch that failed after its rows were written,
    and a second query over the same folder: one row per (ts, room)."""
    folder = tempfile.mkdtemp(prefix="feed-")
    rows = [reading(0, s, room, nr=s) for s in range(6) for room in ("705", "706")]
    for k in (0, 1, 0):
        frame(spark, rows[6 * k : 6 * k + 6]).coalesce(1).write.mode("append").parquet(folder)
    feed = lambda: spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = lambda chk: log.sink_readings(feed(), path, str(tmp_path / chk), ["nr"]).trigger(availableNow=True).start().awaitTermination()
    run("a")
    want = sorted((r[0], r[1], r[4]) for r in rows)
    assert stored(spark, path) == want
    marks = sorted(os.listdir(f"{path}/{log.COMMITS}"))
    marks = [m for m in marks if not m.startswith(".")]
    assert len(marks) == 3
    os.remove(f"{path}/{log.COMMITS}/{marks[-1]}")              # as if the batch broke off before its mark
    last = sorted(os.listdir(tmp_path / "a" / "commits"))
    for f in [f for f in last if f.strip(".").startswith("2")]:
        os.remove(tmp_path / "a" / "commits" / f)               # and Spark had not committed it: it is replayed
    run("a")
    assert stored(spark, path) == want
    run("b")
    assert stored(spark, path) == want


def test_retention_over_three_tables(spark, tmp_path):
    """Whole days go as partitions, the cutoff's day is rewritten, the other partitions keep their files."""
    paths = {n: str(tmp_path / n) for n in ("energy_log", "device_status", "person_events")}
    for k, p in enumerate(paths.values()):
        rows = [(10 * d + h, DAY + dt.timedelta(days=d, hours=h)) for d in range(6) for h in (1, 12, 23) if k != 1 or d != 3]
        df = spark.createDataFrame(rows, "id long, ts timestamp")
        df.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(p)
    files = lambda p, d: sorted(f for f in os.listdir(f"{p}/date={d}") if f.endswith(".parquet"))
    before = {n: files(p, "2024-01-06") for n, p in paths.items()}
    as_of = dt.datetime(2024, 1, 6, 12, 0)
    got = log.retain(spark, list(paths.values()), as_of, keep_days=2)
    cutoff = dt.datetime(2024, 1, 4, 12, 0)
    assert got[paths["energy_log"]] == [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
    for n, p in paths.items():
        left = sorted(r["ts"] for r in spark.read.parquet(p).collect())
        assert left and min(left) >= cutoff
        assert len(left) == sum(DAY + dt.timedelta(days=d, hours=h) >= cutoff for d in range(6) for h in (1, 12, 23) if n != "device_status" or d != 3)
        assert files(p, "2024-01-06") == before[n]
    again = log.retain(spark, list(paths.values()), as_of, keep_days=2)
    assert all(v == [] for v in again.values())
    want = [r["id"] for r in sinks.retain_since(spark.read.parquet(paths["energy_log"]), 2, F.lit(as_of).cast("timestamp")).collect()]
    assert sorted(want) == sorted(r["id"] for r in spark.read.parquet(paths["energy_log"]).collect())
    with pytest.raises(TypeError):
        log.retain(spark, list(paths.values()))               # "now" is never taken from a clock


def test_retention_can_empty_the_cutoff_day(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(1, DAY)], "id long, ts timestamp").withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(p)
    log.retain(spark, [p], DAY + dt.timedelta(hours=5), keep_days=0)
    assert log.stored_days(spark, p) == []
    assert log.retain(spark, [str(tmp_path / "none")], DAY, 0) == {str(tmp_path / "none"): []}


def test_export_reads_only_its_days_and_carries_the_counter(spark, path, tmp_path):
    carry, out = str(tmp_path / "carry"), str(tmp_path / "out")
    rows = [reading(d, 3600 * h, room, energy=0.25 + d) for d in range(10) for h in (1, 9, 20) for room in ("705", "706")]
    log.append_unique(frame(spark, rows[:30]), path)
    log.refresh_carry(spark, path, carry)
    log.append_unique(frame(spark, rows[30:]), path)
    log.refresh_carry(spark, path, carry, {r[0].date() for r in rows[30:]})
    as_of = DAY + dt.timedelta(days=9, hours=9)
    df = log.export_days(spark, path, carry, as_of, days=2, room="705")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") >= 2
    total, want = 0.0, []
    for r in sorted(r for r in rows if r[1] == "705"):
        total += r[5]
        if r[0] >= as_of - dt.timedelta(days=2):
            want.append((r[0], total))
    assert [(r["ts"], r["energy_kwh"]) for r in df.orderBy("ts").collect()] == want
    assert log.export_to(df, out) == out and os.path.isdir(out)
    none = log.export_days(spark, path, carry, as_of, days=2, room="999")
    assert log.export_to(none, str(tmp_path / "empty")) is None and not os.path.exists(tmp_path / "empty")
    lines = []
    for f in sorted(f for f in os.listdir(out) if f.endswith(".csv")):
        text = open(os.path.join(out, f)).read().splitlines()
        assert text[0] == "timestamp,room,voltage,current,power,energy_kwh,light_state"
        lines += text[1:]
    assert len(lines) == len(want) and lines == sorted(lines)          # K6: one room in time order over all files
    both = str(tmp_path / "both")
    log.export_to(log.export_days(spark, path, carry, as_of, days=3), both)
    seen = []
    for f in sorted(f for f in os.listdir(both) if f.endswith(".csv")):
        seen += [tuple(x.split(",")[:2][::-1]) for x in open(os.path.join(both, f)).read().splitlines()[1:]]
    assert seen == sorted(seen) and len({r for r, _ in seen}) == 2
