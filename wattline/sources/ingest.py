"""Meter import: text rows -> the reading log.

``import_text`` renders the driver's ``events`` table as the import file the
reference reads (FIXTURES.md §2.2): 12 h times for even ids and 24 h for odd
ones, every 50th row broken, every 20th row repeated later in the file with
another power value, every 7th power text not a number.

``ingest`` is the insert-or-ignore import: parse (F1/F2), keep the first row
of the file per (timestamp, room) — ``min_by`` over the file order, a partial
aggregate keyed by the second, so no key is ever hot — then ``left_anti``
against the existing log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.scalars import parse_reading_ts, safe_float
from . import csv, tables

IMPORT_COLUMNS = ["Date", "Time", "Voltage(V)", "Current(A)", "Power(W)", "Energy(kWh)"]

def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV files, all columns text, taken by header name file by file (missing columns
    are null), plus the order (``line_no``) that first-wins de-duplication needs: file, place in it, line."""
    df = csv.read_text_columns(spark, path, IMPORT_COLUMNS, required=False)
    return df.select(*[F.col(f"`{c}`") for c in IMPORT_COLUMNS], F.struct(F.col("_file").alias("file"), F.col("_at").alias("at"), F.col("_line").alias("line")).alias("line_no"))


def import_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import file stand-in from ``events`` (one line per event, plus repeats)."""
    ev = tables.table(spark, sf_dir, "events")
    k = tables.props_k(F.col("props"))
    voltage = F.lit(220) + (k - F.lit(50)) / F.lit(10)
    ts = F.col("ts").cast("timestamp")
    i = F.col("event_id")

    def line(power, line_no):
        return ev.select(
            F.when(i % 100 == 50, F.lit("not-a-date")).otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("Date"),
            F.when(i % 100 == 0, F.lit(""))
            .when(i % 2 == 0, F.date_format(ts, "hh:mm:ss a"))
            .otherwise(F.date_format(ts, "HH:mm:ss")).alias("Time"),
            F.format_string("%.1f", voltage).alias("Voltage(V)"),
            exact.fixed_text(exact.current_e6(F.col("value"), voltage), 6).alias("Current(A)"),
            F.when(i % 7 == 3, F.lit("n/a")).otherwise(F.format_string("%.2f", power)).alias("Power(W)"),
            F.format_string("%.5f", F.col("value") / F.lit(1000)).alias("Energy(kWh)"),
            line_no.alias("line_no"),
        )

    first = line(F.col("value"), i * 2)
    repeats = line(F.col("value") + F.lit(1), i * 2 + 1).where(i % 20 == 0)
    return first.unionByName(repeats)


def parse_import(raw: DataFrame, room: str = "705") -> DataFrame:
    """typed rows with the reference's rounding (4/6/4/8 places); ``ts`` null = skipped."""
    return raw.select(
        "line_no",
        parse_reading_ts(F.col("Date"), F.col("Time")).alias("ts"),
        F.lit(room).alias("room"),
        F.round(safe_float(F.col("Voltage(V)")), 4).alias("voltage"),
        F.round(safe_float(F.col("Current(A)")), 6).alias("current"),
        F.round(safe_float(F.col("Power(W)")), 4).alias("power"),
        F.round(safe_float(F.col("Energy(kWh)")), 8).alias("energy_kwh"),
        F.lit("OFF").alias("light_state"),
    )


def first_per_key(parsed: DataFrame) -> DataFrame:
    """Keep the first row in file order per (ts, room): insert-or-ignore within the file.

    Lines whose timestamp did not parse form the null-ts group, dropped after the
    aggregate by its count of valid timestamps: a filter before the aggregate
    would be pushed below the parsing projection and parse every line twice.
    The partial aggregate keeps that group one row per task."""
    cols = [c for c in parsed.columns if c not in ("ts", "room")]
    g = parsed.groupBy("ts", "room").agg(
        F.min_by(F.struct(*cols), F.col("line_no")).alias("r"), F.count("ts").alias("_n_valid"))
    return g.where(F.col("_n_valid") > 0).select("ts", "room", *[F.col(f"r.{c}").alias(c) for c in cols])


def ingest(raw: DataFrame, existing_log: DataFrame, room: str = "705") -> DataFrame:
    """The rows the import adds to ``existing_log`` (keyed by whole-second ts and room)."""
    fresh = first_per_key(parse_import(raw, room)).withColumn("_date", F.to_date("ts"))
    # The day is part of the key: on a log partitioned by date, dynamic partition
    # pruning limits the scan of the existing log to the days being imported.
    log_date = F.col("date") if "date" in existing_log.columns else F.to_date("ts")
    keys = existing_log.select(log_date.alias("_date"), F.date_trunc("second", "ts").alias("ts"), "room")
    return fresh.join(keys, ["_date", "ts", "room"], "left_anti").drop("line_no", "_date")


def ingest_counts(raw: DataFrame, existing_log: DataFrame, room: str = "705") -> DataFrame:
    """S4 counters in one pass over the import: processed (valid ts), skipped
    (bad ts, the null-key group), unique in file, added (not in the log)."""
    parsed = parse_import(raw, room)
    groups = parsed.groupBy("ts", "room").agg(F.count(F.lit(1)).alias("_n")).withColumn("_date", F.to_date("ts"))
    log_date = F.col("date") if "date" in existing_log.columns else F.to_date("ts")
    keys = existing_log.select(log_date.alias("_date"), F.date_trunc("second", "ts").alias("ts"), "room") \
        .distinct().withColumn("_present", F.lit(True))
    flagged = groups.join(keys, ["_date", "ts", "room"], "left")
    valid = F.col("ts").isNotNull()
    return flagged.agg(
        F.coalesce(F.sum(F.when(valid, F.col("_n"))), F.lit(0)).cast("long").alias("processed"),
        F.coalesce(F.sum(F.when(~valid, F.col("_n"))), F.lit(0)).cast("long").alias("skipped"),
        F.count_if(valid).alias("unique_in_file"),
        F.count_if(valid & F.col("_present").isNull()).alias("added"),
    )


def append(df: DataFrame, path: str, partition_by: str = "date") -> None:
    """Append to the parquet log, partitioned by day (S4/S5 sink)."""
    df.withColumn(partition_by, F.to_date("ts")).write.mode("append").partitionBy(partition_by).parquet(path)
