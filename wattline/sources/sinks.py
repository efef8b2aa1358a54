"""Log sinks and time-range access.

The log lives as parquet partitioned by ``date``; time filters are written on
the raw timestamp column so they reach the scan as ``PushedFilters`` and, on
the partitioned log, prune whole partitions.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

# Table definitions (column defaults are applied with ``with_defaults``).
ENERGY_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("room", T.StringType(), True),
    T.StructField("voltage", T.DoubleType(), True),
    T.StructField("current", T.DoubleType(), True),
    T.StructField("power", T.DoubleType(), True),
    T.StructField("energy_kwh", T.DoubleType(), True),
    T.StructField("light_state", T.StringType(), True),
])
DEVICE_STATUS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("wifi_status", T.StringType(), True),
    T.StructField("cloud_status", T.StringType(), True),
    T.StructField("sd_card_status", T.StringType(), True),
])
PERSON_EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("event", T.StringType(), True),
])
DEFAULTS = {
    "room": "705", "voltage": 0.0, "current": 0.0, "power": 0.0, "energy_kwh": 0.0, "light_state": "OFF",
    "wifi_status": "Unknown", "cloud_status": "Unknown", "sd_card_status": "Unknown",
}
EXPORT_COLUMNS = ["ts", "room", "voltage", "current", "power", "energy_kwh", "light_state"]


def with_defaults(df: DataFrame) -> DataFrame:
    """The DDL defaults as ``coalesce`` on the columns present."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def time_range(df: DataFrame, start: Column | _dt.datetime | str, end: Column | _dt.datetime | str | None = None,
               ts: str = "ts") -> DataFrame:
    """``start <= ts < end`` (half-open; whole days use the next midnight)."""
    s = start if isinstance(start, Column) else F.lit(start).cast("timestamp")
    out = df.where(F.col(ts) >= s)
    if end is not None:
        e = end if isinstance(end, Column) else F.lit(end).cast("timestamp")
        out = out.where(F.col(ts) < e)
    return out


def day_range(df: DataFrame, day: Column, ts: str = "ts") -> DataFrame:
    """P0a for one calendar day: [day 00:00, next day 00:00)."""
    start = F.to_timestamp(day)
    return time_range(df, start, F.to_timestamp(F.date_add(day, 1)), ts)


def export_range(readings: DataFrame, days: int = 7, as_of: Column | None = None, room: str | None = None) -> DataFrame:
    """The last ``days`` days of readings (one room or all), seven export columns."""
    now = as_of if as_of is not None else readings.select(F.max("ts")).scalar()
    r = readings if room is None else readings.where(F.col("room") == room)
    r = r.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))
    cols = [F.col(c) for c in EXPORT_COLUMNS if c != "energy_kwh"]
    energy = F.col("energy_counter_kwh") if "energy_counter_kwh" in readings.columns else F.col("energy_kwh")
    return r.select(*cols[:5], energy.alias("energy_kwh"), F.col("light_state"))


def write_export(df: DataFrame, path: str) -> None:
    """S7 files: CSV with the header timestamp, room, voltage, current, power, energy_kwh,
    light_state; rows in order of room and time over all files (a range sort, so a hot
    room spreads over several).
    """
    out = df.withColumnRenamed("ts", "timestamp")
    columns = ["timestamp", *[c for c in EXPORT_COLUMNS if c not in ("ts", "timestamp")]]
    (out.select(*columns).repartitionByRange("room", "timestamp").sortWithinPartitions("room", "timestamp")
        .write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def retain_since(df: DataFrame, keep_days: int = fixed.RETENTION_DAYS, as_of: Column | _dt.datetime | None = None,
                 ts: str = "ts") -> DataFrame:
    """Rows not older than ``keep_days`` before ``as_of`` (a literal prunes the scan; default: the newest row)."""
    if isinstance(as_of, _dt.datetime):
        return df.where(F.col(ts) >= F.lit(as_of - _dt.timedelta(days=keep_days)))
    now = as_of if as_of is not None else df.select(F.max(ts)).scalar()
    return df.where(F.col(ts) >= now - F.make_dt_interval(days=F.lit(keep_days)))


def prune_log(spark, path: str, as_of: _dt.date, keep_days: int = fixed.RETENTION_DAYS) -> list[str]:
    """S8 on the stored log by whole days: drop the ``date=`` partitions older than the cutoff
    (``log.retain`` keeps the cutoff's own day to the second).

    A metadata operation on the (shared) file system — no data is read or
    rewritten; returns the dropped partition names.
    """
    cutoff = (as_of - _dt.timedelta(days=keep_days)).isoformat()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("date=") and name[5:] < cutoff:
            fs.delete(st.getPath(), True)
            dropped.append(name)
    return dropped


def downsample_status(status: DataFrame, every: int = fixed.STATUS_EVERY_N_POLLS, keys=("room",)) -> DataFrame:
    """Keep every ``every``-th poll per device (poll numbers 10, 20, ...).

    Poll numbers come from a segmented running count (``scans.row_index``), so
    a busy device is numbered across many tasks.
    """
    from ..operators import scans

    numbered = scans.row_index(status, list(keys), ["ts", "id"], "poll_no", F.date_trunc("hour", "ts"))
    return numbered.where(F.col("poll_no") % every == 0)
