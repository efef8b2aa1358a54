"""The stored log: unique append, stream sink, retention and export of days.

Tables are parquet folders partitioned by ``date``; every operation touches only the
days it is about, named as literals, so the other partitions are neither read nor listed.

* ``append_unique``: the log's key is (whole second, room).  Of a batch's rows with the
  same key the first by ``order`` counts, and rows whose key the log already has are
  ignored: the batch is anti-joined with the keys of its own days.  Appending a file
  twice, or a batch again after a failure halfway, adds nothing.
* ``sink_readings``: the same as a streaming sink.  A batch that was committed is known
  by the query's id and its number and not even read again; one that broke off before
  its commit mark is caught by the anti-join.
* ``retain``: rows older than the cutoff go, in any number of tables: whole days as
  partitions, the cutoff's own day by rewriting that partition alone.
* ``refresh_carry`` / ``export_days``: the meter counter is cumulative over the whole log;
  a small table of each day's energy per room carries it, so an export of N days reads
  those days only.

One writer at a time per table (as the reference's file database enforces): two appends
of the same new key at the same moment would both find it missing.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from .. import fixed
from ..functions import exact
from ..operators import scans
from ..session import written
from . import sinks

COMMITS = "_commits"        # hidden from readers of the table


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _has(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_days(spark: SparkSession, path: str, days: Iterable[_dt.date], schema=None) -> DataFrame | None:
    """The stored rows of some days (None: the table has none of them); no other partition is listed."""
    there = [f"{path}/date={d.isoformat()}" for d in sorted(set(days)) if _has(spark, f"{path}/date={d.isoformat()}")]
    if not there:
        return None
    r = spark.read.option("basePath", path)
    return (r.schema(schema) if schema is not None else r).parquet(*there)


def _key(df: DataFrame) -> list[Column]:
    """(day, whole second, room) of a row; without nulls in the room, so plain equality joins."""
    room = F.coalesce(F.concat(F.lit("="), F.col("room").cast("string")), F.lit(""))
    return [F.to_date("ts").alias("_day"), F.date_trunc("second", "ts").alias("_sec"), room.alias("_room")]


def append_unique(df: DataFrame, path: str, order: Sequence[str | Column] = ("ts",), batch: str | None = None) -> None:
    """Add the rows of ``df`` whose (second, room) the log at ``path`` does not have yet.

    ``order``: which of a batch's rows with the same key comes first.  ``batch``: a name that is
    committed once; a committed batch is skipped.  Rows without a time do not enter, missing values get
    the table's defaults (S10)."""
    spark = df.sparkSession
    if batch is not None and _has(spark, f"{path}/{COMMITS}/{batch}"):
        return
    rows = sinks.with_defaults(df.where(F.col("ts").isNotNull()).drop("date"))
    first = rows.select(*_key(rows), F.struct(*order).alias("_order"), F.struct(*rows.columns).alias("_row"))
    new = written(first.groupBy("_day", "_sec", "_room").agg(F.min_by("_row", "_order").alias("_row")), "append")
    days = [r[0] for r in new.select("_day").distinct().collect()]        # a row for each day of the batch
    log = read_days(spark, path, days)
    if log is not None:
        new = new.join(log.select(*_key(log)), ["_day", "_sec", "_room"], "left_anti")
    if days:
        out = new.select("_row.*", F.col("_day").alias("date"))
        out.repartition("date", F.pmod(F.hash("room", "ts"), F.lit(8))).write.mode("append").partitionBy("date").parquet(path)
    if batch is not None:
        fs, p = _fs(spark, f"{path}/{COMMITS}/{batch}")
        fs.create(p, True).close()


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps in its checkpoint folder."""
    return spark.read.json(f"{checkpoint}/metadata").select("id").first()[0]


def sink_readings(readings: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ("ts",)) -> DataStreamWriter:
    """S5 as a stream: each micro-batch is appended once (see ``append_unique``); start it as usual."""
    def put(batch: DataFrame, batch_id: int) -> None:
        append_unique(batch, path, order, f"{_query_id(batch.sparkSession, checkpoint)}-{batch_id}")

    return readings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def stored_days(spark: SparkSession, path: str) -> list[_dt.date]:
    """The days a table has partitions for."""
    fs, p = _fs(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()] if fs.exists(p) else []
    return sorted(_dt.date.fromisoformat(n[5:]) for n in names if n.startswith("date="))


def retain(spark: SparkSession, paths: Sequence[str], as_of: _dt.datetime, keep_days: int = fixed.RETENTION_DAYS) -> dict[str, list[_dt.date]]:
    """Drop the rows of each table older than ``keep_days`` before ``as_of``; the days touched, by table.

    Whole days are dropped as partitions (nothing is read); the cutoff's day keeps the rows from the
    cutoff on and is the only partition rewritten."""
    cutoff = as_of - _dt.timedelta(days=keep_days)
    out: dict[str, list[_dt.date]] = {}
    for path in paths:
        out[path] = []
        for day in stored_days(spark, path):
            if day > cutoff.date() or (day == cutoff.date() and cutoff.time() == _dt.time(0)):
                continue
            if day == cutoff.date():
                old = read_days(spark, path, [day])
                late = F.col("ts") < F.lit(cutoff).cast("timestamp")
                if old is None or old.where(late).isEmpty():
                    continue
                kept = written(old.where(~late), "retain")
                if not kept.isEmpty():
                    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
                    out[path].append(day)
                    continue
            fs, p = _fs(spark, f"{path}/date={day.isoformat()}")
            fs.delete(p, True)
            out[path].append(day)
    return out


# --- export of days: the counter carried per day -----------------------------------------

def refresh_carry(spark: SparkSession, path: str, carry: str, days: Iterable[_dt.date] | None = None) -> None:
    """Energy per room and day (whole units of the log's last decimal) of ``days`` (default: all), each day a
    partition that is replaced: run it for the days an append or a retention touched."""
    log = spark.read.parquet(path) if days is None else read_days(spark, path, days)
    if log is None:
        return
    sums = log.groupBy("date", "room").agg(exact.total(exact.units("energy_kwh", exact.ENERGY)).alias("units"))
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(carry)


def export_days(spark: SparkSession, path: str, carry: str, as_of: _dt.datetime, days: int = 7, room: str | None = None) -> DataFrame:
    """The last ``days`` days before ``as_of`` (one room or all) with the cumulative counter.

    Only the partitions from the first day on are read; what was metered before is the carry table's sum."""
    since = as_of - _dt.timedelta(days=days)
    first = F.lit(since.date())
    log, before = spark.read.parquet(path).where(F.col("date") >= first), spark.read.parquet(carry).where(F.col("date") < first)
    if room is not None:
        log, before = log.where(F.col("room") == room), before.where(F.col("room") == room)
    run = scans.running_sum(log, ["room"], ["ts"], exact.units("energy_kwh", exact.ENERGY).cast("decimal(20,0)"), "_run", F.date_trunc("hour", "ts"))
    start = before.groupBy(F.col("room").alias("_room")).agg(F.sum("units").alias("_start"))
    rows = run.where(F.col("ts") >= F.lit(since).cast("timestamp")).join(start, F.col("room").eqNullSafe(F.col("_room")), "left")
    counter = (F.coalesce(F.col("_start"), F.lit(0)) + F.col("_run")).cast("double") / F.lit(10.0 ** exact.ENERGY)
    return rows.select(*[counter.alias(c) if c == "energy_kwh" else F.col(c) for c in sinks.EXPORT_COLUMNS])


def export_to(df: DataFrame, path: str) -> str | None:
    """S7 file(s) of ``df`` in order of room and time, or None and no file where it has no row."""
    if df.isEmpty():
        return None
    sinks.write_export(df, path)
    return path


def rows_by_table(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table, id, ts) of several stored tables."""
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).select(F.lit(name).alias("table"), "id", "ts")
        out = one if out is None else out.unionByName(one)
    return out
