"""Headered CSV sources, columns by name.

A column is found by its header, wherever it stands: a byte-order mark and blanks
around names do not count, nor does case.  The files of a folder may order their
columns differently; files with the same header are read together.  A missing
required column is an error that names it.  Small configuration tables
(rules, timetable) stay DataFrames; operators size-check them before use.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
RATES_SCHEMA = "year int, month int, rate_per_kWh double"
RULES_SCHEMA = "threshold_type string, threshold_value double, recommendation string"
TIMETABLE_SCHEMA = "room string, day string, start_time string, end_time string, event_name string"
ALERTS_SCHEMA = "notification_type string, trigger_condition string, message string, priority string, is_active int"


def header_groups(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` (a file, folder or pattern) by their header line; empty files have none.

    The driver reads the first line of each file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(conf).globStatus(where)
    if not found:
        raise FileNotFoundError(path)
    out: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(f for st in found for f in spark.read.text(st.getPath().toString()).inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(p.getFileSystem(conf).open(p), "UTF-8"))
        line = reader.readLine()
        reader.close()
        if line:
            out.setdefault(tuple(next(csv.reader([line.removeprefix(BOM)]))), []).append(p.toString())
    return out


def read_text_columns(spark: SparkSession, path: str, columns: Sequence[str], required: bool = True) -> DataFrame:
    """``columns`` (as text) of headered CSV files, with the place of each line: ``_file``, ``_at``, ``_line``.

    Missing columns: an error if ``required``, else null."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line")]
    out = None
    for header, files in header_groups(spark, path).items():
        by_name = {name.strip().lower(): i for i, name in reversed(list(enumerate(header)))}
        missing = [c for c in columns if c.lower() not in by_name]
        if missing and required:
            raise ValueError(f"{files[0]}: no column {', '.join(missing)} among {', '.join(header)}")
        schema = ", ".join(f"c{i} string" for i in range(len(header)))
        df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(files)
        text = [F.col(f"c{by_name[c.lower()]}") if c.lower() in by_name else F.lit(None).cast("string") for c in columns]
        one = df.select(*[t.alias(c) for t, c in zip(text, columns)], *place)
        out = one if out is None else out.unionByName(one)
    if out is None:
        fields = ", ".join([*[f"`{c}` string" for c in columns], "_file string", "_at long", "_line long"])
        return spark.createDataFrame([], fields)
    return out


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` by header name, in file order, values that do not parse as null."""
    fields = [f.split(" ") for f in schema.split(", ")]
    raw = read_text_columns(spark, path, [n for n, _ in fields])
    cols = [F.col(n) if t == "string" else F.trim(F.col(n)).try_cast(t) for n, t in fields]
    return raw.select(*[c.alias(n) for c, (n, _) in zip(cols, fields)])


def with_file_order(df: DataFrame, col: str = "rule_order") -> DataFrame:
    """File order of a small, single-file table (rules keep the order they are listed in)."""
    return df.withColumn(col, F.monotonically_increasing_id())


def load_rates(spark: SparkSession, path: str, series: str = "default") -> DataFrame:
    """Tariff history as the long series table ``(series, month, rate)``."""
    df = read_csv(spark, path, RATES_SCHEMA)
    return df.select(F.lit(series).alias("series"), F.make_date("year", "month", F.lit(1)).alias("month"),
                     F.col("rate_per_kWh").alias("rate"))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return with_file_order(read_csv(spark, path, RULES_SCHEMA))


def load_timetable(spark: SparkSession, path: str) -> DataFrame:
    """Weekly timetable with file order, trimmed keys and minutes of day."""
    from ..functions.scalars import minutes_of_day

    df = with_file_order(read_csv(spark, path, TIMETABLE_SCHEMA))
    return df.select(
        F.trim("room").alias("room"), F.lower(F.trim("day")).alias("day"),
        F.trim("start_time").alias("start_time"), F.trim("end_time").alias("end_time"),
        F.trim("event_name").alias("event_name"), F.col("rule_order").cast("int").alias("rule_order"),
        minutes_of_day(F.trim("start_time")).alias("start_min"), minutes_of_day(F.trim("end_time")).alias("end_min"),
    )


def load_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert rules; ``trigger_condition`` '>15' becomes op '>' and threshold 15 (others stay null)."""
    df = with_file_order(read_csv(spark, path, ALERTS_SCHEMA))
    return df.select(
        "notification_type",
        F.regexp_extract("trigger_condition", r"^([<>]=?)", 1).alias("op"),
        F.regexp_extract("trigger_condition", r"^[<>]=?\s*([0-9.]+)$", 1).try_cast("double").alias("threshold"),
        "message", "priority", "is_active", F.col("rule_order").cast("int").alias("rule_order"),
    )
