"""Streaming forms equal their batch forms (availableNow over the events file)."""

from tests.conftest import SF_SMALL
from wattline.plans.catalog import QUERIES


def _with_beat(schema):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField("beat", T.BooleanType(), True)])


def _beat(spark, folder, schema, at, ts="ts"):
    """A file with one heartbeat in a landed feed."""
    row = [at if f.name == ts else True if f.name == "beat" else None for f in _with_beat(schema).fields]
    spark.createDataFrame([tuple(row)], _with_beat(schema)).coalesce(1).write.mode("append").parquet(folder)


def _closed(spark, feed, at, ts="ts"):
    import tempfile

    from wattline.streaming import ordered, streams

    folder = tempfile.mkdtemp(prefix="beats-")
    spark.createDataFrame([(at,)], "at timestamp").write.mode("append").parquet(folder)
    return ordered.closing_beat(feed, streams.file_stream(spark, folder, "at timestamp", files_per_batch=None), ts)


def _same(spark, a, b):
    x = QUERIES[a](spark, SF_SMALL)
    y = QUERIES[b](spark, SF_SMALL).select(*x.columns)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_stream_throttle_equals_batch(spark):
    _same(spark, "stream_throttle", "notification_throttle")


def test_stream_status_equals_batch(spark):
    _same(spark, "stream_status_downsample", "downsample_status")


def test_stream_light_equals_batch(spark):
    x = QUERIES["stream_light_decision"](spark, SF_SMALL).drop("command")
    y = QUERIES["light_decision"](spark, SF_SMALL).select(*x.columns)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_stream_readings_parses_everything(spark):
    r = QUERIES["stream_readings"](spark, SF_SMALL)
    assert r.count() > 0 and r.where("ts IS NULL").count() == 0


def test_stream_sessions_equal_batch(spark):
    x = QUERIES["stream_sessions"](spark, SF_SMALL)
    y = QUERIES["occupancy_sessions"](spark, SF_SMALL).select(*x.columns)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_stream_hourly_equals_batch(spark):
    from pyspark.sql import functions as F

    from wattline.functions import exact
    from wattline.plans.present import present
    from wattline.sources import tables

    x = QUERIES["stream_hourly"](spark, SF_SMALL)
    r = tables.readings(spark, SF_SMALL, with_counter=False)
    x = x.select("room", "window_start", "avg_power", "n_readings")
    y = present(r.groupBy("room", F.date_trunc("hour", "ts").alias("window_start")).agg(
        exact.avg_rounded("power", exact.POWER, 2).alias("avg_power"), F.count("power").alias("n_readings"))).select(*x.columns)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_controller_state_machine_unsorted_chunks(spark):
    """Rows of a room may arrive in any order within a micro-batch."""
    import datetime as dt

    from wattline.streaming import streams

    t0 = dt.datetime(2024, 3, 4, 6, 0)
    rows = [("705", t0 + dt.timedelta(minutes=m), t0 + dt.timedelta(minutes=m, seconds=5), p, False, None)
            for m, p in [(3, 0), (0, 1), (2, 0), (1, 0), (9, 0)]]
    schema = "room string, frame_ts timestamp, tick_ts timestamp, persons int, in_class boolean, class_event string"
    ticks = spark.createDataFrame(rows, schema)
    import tempfile

    path = tempfile.mkdtemp(prefix="ticks-")
    ticks.repartition(3).write.mode("overwrite").parquet(path)
    feed = _closed(spark, streams.file_stream(spark, path, ticks.schema, files_per_batch=None), t0 + dt.timedelta(hours=1), "tick_ts")
    got = streams.run_until_caught_up(streams.stream_light_decision(feed), "t")
    got = {r["frame_ts"]: (r["mode"], r["countdown"]) for r in got.collect()}
    assert got[t0] == ("PERSON", 0)
    assert got[t0 + dt.timedelta(minutes=1)] == ("PERSON", 240)
    assert got[t0 + dt.timedelta(minutes=3)] == ("PERSON", 120)
    assert got[t0 + dt.timedelta(minutes=9)] == ("OFF", 0)


def test_state_carries_across_micro_batches(spark, tmp_path):
    """Two time-ordered landings, one file per micro-batch: sessions and the
    throttle continue from the state of the previous batch."""
    import datetime as dt
    import time

    from pyspark.sql import functions as F

    from wattline.operators import occupancy
    from wattline.streaming import streams

    t0 = dt.datetime(2024, 3, 4, 6, 0)
    secs = [0, 1, 1.5, 3.6, 100, 250, 260, 599, 600.5, 1000, 1001, 1003.5]
    rows = [(i, "705", t0 + dt.timedelta(seconds=s), 0, 0.9) for i, s in enumerate(secs)]
    schema = "det_id long, room string, ts timestamp, class_id int, confidence double"
    df = spark.createDataFrame(rows, schema)
    land = str(tmp_path / "det")
    df.where(F.col("det_id") < 6).coalesce(1).write.mode("append").parquet(land)
    time.sleep(1.1)
    df.where(F.col("det_id") >= 6).coalesce(1).write.mode("append").parquet(land)
    feed = lambda: streams.file_stream(spark, land, df.schema, files_per_batch=1)

    s = streams.run_until_caught_up(streams.stream_sessions(feed()), "s", output_mode="complete")
    b = occupancy.occupancy_sessions(df.withColumn("frame_ts", F.date_trunc("minute", "ts"))).drop("session_no")
    assert s.exceptAll(b.select(*s.columns)).count() == 0 and b.select(*s.columns).exceptAll(s).count() == 0

    time.sleep(1.1)                       # the closing beat lands last
    _beat(spark, land, df.schema, t0 + dt.timedelta(hours=1))
    th = streams.run_until_caught_up(streams.stream_throttle(streams.file_stream(spark, land, _with_beat(df.schema), files_per_batch=1)), "th")
    tb = occupancy.notification_throttle(df)
    assert th.exceptAll(tb).count() == 0 and tb.exceptAll(th).count() == 0


def test_folder_tables_and_files_out_of_order(spark, tmp_path):
    """A table of many files, landed in any order: the streams give what the batch forms give."""
    from pyspark.sql import functions as F

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for part in (3, 0, 2, 1):
        ev.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    for live, batch in (("stream_sessions", "occupancy_sessions"), ("stream_latest", None), ("stream_hourly", None)):
        got = QUERIES[live](spark, folder)
        want = QUERIES[batch or live](spark, SF_SMALL).select(*got.columns)
        assert got.count() > 0
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_empty_feed_gives_an_empty_result(spark, tmp_path):
    from wattline.streaming import streams

    schema = "room string, ts timestamp"
    (tmp_path / "in").mkdir()
    feed = streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    assert streams.run_until_caught_up(streams.stream_sessions(feed), "none", output_mode="complete").count() == 0


def _differs(x, y):
    x, y = x.cache(), y.select(*x.columns).cache()
    return x.count() == 0 or x.exceptAll(y).count() > 0 or y.exceptAll(x).count() > 0


def test_more_files_than_micro_batches_of_a_live_feed(spark, tmp_path):
    """A table of more than twice FILES_PER_BATCH files, the newest rows landed first: a replay loses no row."""
    from pyspark.sql import functions as F

    from wattline.streaming import streams

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    newest = ev.where(F.col("ts") > ev.select(F.expr("percentile(unix_micros(cast(ts as timestamp)), 0.6)").cast("long").alias("x")).select(F.timestamp_micros("x")).scalar())
    land = str(tmp_path / "events.parquet")
    newest.repartition(2 * streams.FILES_PER_BATCH).write.mode("append").parquet(land)
    ev.join(newest, "event_id", "left_anti").select(*ev.columns).repartition(8).write.mode("append").parquet(land)
    assert len(spark.read.parquet(land).inputFiles()) > 2 * streams.FILES_PER_BATCH
    live = ("stream_hourly", "stream_throttle", "stream_status_downsample")
    assert [q for q in live if _differs(QUERIES[q](spark, str(tmp_path)), QUERIES[q](spark, SF_SMALL))] == []


def test_more_payload_files_than_micro_batches_of_a_live_feed(spark, monkeypatch):
    from wattline.plans import catalog
    from wattline.streaming import streams

    want = QUERIES["stream_readings"](spark, SF_SMALL)
    landed = catalog._landed
    monkeypatch.setattr(catalog, "_landed", lambda df, *a: landed(df.repartition(2 * streams.FILES_PER_BATCH + 20), *a))
    assert not _differs(QUERIES["stream_readings"](spark, SF_SMALL), want)
