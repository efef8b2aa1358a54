"""Driver tables and the reading-domain views built on them (FIXTURES.md §2).

All views are lazy projections/aggregations of the parquet scans, so filters and
column pruning still reach the files.  The one ordered quantity, the cumulative
meter counter, is a segmented scan (``operators.scans``) — no task ever holds a
whole room.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import scans

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def room_from_id(c: Column) -> Column:
    """Room label from an integer id: floors 1-7, rooms x01-x11."""
    return (F.lit(100) * (F.lit(1) + c % 7) + F.lit(1) + c % 11).cast("string")


def props_k(props: Column) -> Column:
    return F.regexp_extract(props, r'"k"\s*:\s*(-?[0-9]+)', 1).try_cast("int")


def hour_block(ts: Column) -> Column:
    """Scan block of a reading: its hour (a hot room splits into many blocks)."""
    return F.date_trunc("hour", ts)


def readings_from_events(events: DataFrame, with_counter: bool = True, block=hour_block,
                         columns: Sequence[str] | None = None) -> DataFrame:
    """The reading log view (FIXTURES.md §2.1).

    Columns: id, ts, room, voltage, current, power, energy_kwh (increment),
    energy_counter_kwh (cumulative meter), light_state, event_type.  ``columns``: those of the
    values that the caller goes on to use; the counter's scan then shuffles no others.
    """
    k = props_k(F.col("props"))
    voltage = F.lit(220) + (k - F.lit(50)) / F.lit(10) + (F.col("event_id") % 9) * F.lit(0.0111)
    power = F.col("value") / F.lit(3)          # more decimals than the log stores
    base = events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        room_from_id(F.col("user_id")).alias("room"),
        voltage.alias("voltage"),
        (power / voltage).alias("current"),
        power.alias("power"),
        (F.col("value") / F.lit(3000)).alias("energy_kwh"),
        F.when(F.col("event_type").isin("click", "purchase"), F.lit("ON")).otherwise(F.lit("OFF")).alias("light_state"),
        F.col("event_type"),
    )
    if columns is not None:
        base = base.select(*[c for c in base.columns if c in ("id", "ts", "room", "energy_kwh", *columns)])
    if not with_counter:
        return base
    # ``block``: the counter's scan block (an hour by default; finer for denser feeds)
    with_counter = scans.running_sum(
        base, ["room"], ["ts", "id"], F.col("energy_kwh"), "energy_counter_kwh", block(F.col("ts"))
    )
    order = ["id", "ts", "room", "voltage", "current", "power", "energy_kwh", "energy_counter_kwh", "light_state", "event_type"]
    return with_counter.withColumn("energy_counter_kwh", F.round("energy_counter_kwh", 8)).select(
        *[c for c in order if c in with_counter.columns])


def readings(spark: SparkSession, sf_dir: str, with_counter: bool = True,
             since: _dt.datetime | None = None, until: _dt.datetime | None = None,
             columns: Sequence[str] | None = None) -> DataFrame:
    """The reading log (``columns`` as in ``readings_from_events``); ``since`` / ``until`` (wall-clock literals, half-open) are
    applied to the raw timestamp column before the view, so they reach the
    parquet scan as pushed filters (row-group skipping).

    The derived meter counter is cumulative from the first reading, so with
    ``with_counter`` the window is applied after the counter instead."""
    ev = table(spark, sf_dir, "events")
    if with_counter:
        r = readings_from_events(ev, True, columns=columns)
        if since is not None:
            r = r.where(F.col("ts") >= F.lit(since).cast("timestamp"))
        if until is not None:
            r = r.where(F.col("ts") < F.lit(until).cast("timestamp"))
        return r
    if since is not None:
        ev = ev.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        ev = ev.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return readings_from_events(ev, False, columns=columns)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_from_events(table(spark, sf_dir, "events"))


def detections_from_events(ev: DataFrame) -> DataFrame:
    """Detector output stand-in: one box per event; ``view`` events are persons (class 0).

    frame = (room, minute of the event); confidence = (k % 100) / 101.37 (raw floats).
    """
    k = props_k(F.col("props"))
    return ev.select(
        F.col("event_id").alias("det_id"),
        room_from_id(F.col("user_id")).alias("room"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("frame_ts"),
        F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.lit(1)).alias("class_id"),
        ((k % 100) / F.lit(101.37)).alias("confidence"),
    )


def training_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training input at volume from ``lineitem`` (FIXTURES.md §2.2).

    room from l_suppkey, date l_shipdate, energy l_quantity, room type from
    l_returnflag (A lab, N lecture, R office); voltage/current derived from
    tax/discount so the optional columns exist.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        room_from_id(F.col("l_suppkey")).alias("room"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_quantity") / F.lit(3)).alias("energy_kwh"),
        F.when(F.col("l_returnflag") == "A", F.lit("lab"))
        .when(F.col("l_returnflag") == "N", F.lit("lecture"))
        .otherwise(F.lit("office")).alias("room_type"),
        (F.lit(216) + F.col("l_tax") * F.lit(100)).alias("voltage"),
        (F.col("l_discount") * F.lit(100)).alias("current"),
    )


def tariff_series(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Many monthly tariff series from ``orders`` (FIXTURES.md §2.2).

    series = o_orderpriority, month = first day of the order month,
    rate = round(avg(o_totalprice) / 10000, 4) (exact); every month counts.  One pass over ``orders``; the
    result (series x months) is small and feeds several lookups, so it is
    checkpointed once into the shared checkpoint folder."""
    from ..session import cut_lineage

    o = table(spark, sf_dir, "orders")
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    g = o.groupBy(F.col("o_orderpriority").alias("series"), month.alias("month")).agg(
        (exact.avg_rounded("o_totalprice", 2, 0) / F.lit(10000.0)).alias("rate")
    )
    return cut_lineage(g) if materialize else g


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table (a folder of files, or one file) as a file stream.

    A replay of landed history: its files are in no time order, so all of them are
    one micro-batch.  Cut by files, the first batch would move the watermark past
    older rows of later files, and the per-room states would see time run backwards."""
    where = f"{sf_dir.rstrip('/')}/events.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    feed = spark.readStream.format("parquet").schema(table(spark, sf_dir, "events").schema)
    if fs.getFileStatus(path).isDirectory():
        return feed.load(where)
    return feed.option("pathGlobFilter", "events.parquet").load(sf_dir.rstrip("/"))     # a stream reads folders


def as_of(df: DataFrame, col: str = "ts") -> Column:
    """The explicit "now" of a table: its max timestamp, as a scalar subquery."""
    return df.select(F.max(col)).scalar()


def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training CSV stand-in as text columns with the reference's kind of
    headers ('Date', 'Hour', 'Energy (kWh)', 'Room', 'Room_Type', 'Voltage',
    'Current'), from ``lineitem``: every 97th order has a broken date, every 83rd a
    broken time, every 89th an energy that is not a number, some rooms carry blanks."""
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("l_orderkey")
    room = room_from_id(F.col("l_suppkey"))
    return li.select(
        F.when(ok % 97 == 0, F.lit("bad-date")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Date"),
        F.when(ok % 83 == 0, F.lit("late")).otherwise(F.format_string("%02d:00", F.col("l_linenumber") + 6)).alias("Hour"),
        F.when(ok % 89 == 0, F.lit("n/a")).otherwise(F.format_string("%.1f", F.col("l_quantity"))).alias("Energy (kWh)"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" "), room, F.lit(" "))).otherwise(room).alias("Room"),
        F.when(F.col("l_returnflag") == "A", F.lit("lab"))
        .when(F.col("l_returnflag") == "N", F.lit("lecture")).otherwise(F.lit("office")).alias("Room_Type"),
        F.format_string("%.2f", F.lit(216) + F.col("l_tax") * F.lit(100)).alias("Voltage"),
        F.format_string("%.2f", F.col("l_discount") * F.lit(100)).alias("Current"),
    )
