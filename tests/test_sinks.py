"""Sinks: partitioned log append, partition-drop retention, CSV export, and
dynamic partition pruning of the import's anti-join."""

import datetime as dt
import os

from pyspark.sql import functions as F

from wattline.sources import ingest, sinks


def _log(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 3, 8, i % 3), "705", 220.0, 0.1, 22.0, 0.01 * i, "OFF") for i in range(12)]
    return spark.createDataFrame(rows, sinks.ENERGY_LOG)


def test_append_prune_and_export(spark, tmp_path):
    path = str(tmp_path / "log")
    ingest.append(_log(spark), path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("date="))
    assert parts == ["date=2024-01-01", "date=2024-01-02", "date=2024-01-03", "date=2024-01-04"]
    dropped = sinks.prune_log(spark, path, dt.date(2024, 1, 4), keep_days=2)
    assert dropped == ["date=2024-01-01"]
    assert spark.read.parquet(path).count() == 9

    out = str(tmp_path / "export")
    sinks.write_export(sinks.export_range(spark.read.parquet(path).drop("date"), days=1), out)
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(out) for f in fs if f.endswith(".csv")]
    lines = [ln for f in files for ln in open(f).read().splitlines()]
    header = "timestamp,room,voltage,current,power,energy_kwh,light_state"
    body = [ln for ln in lines if ln != header]
    assert lines[0] == header and len(body) == 4          # the last day before 2024-01-04 08:02
    assert sorted(body)[0].startswith("2024-01-03 08:02:00,705,")


def test_import_anti_join_prunes_log_partitions(spark, tmp_path):
    path = str(tmp_path / "log")
    ingest.append(_log(spark), path)
    log = spark.read.parquet(path)
    raw = spark.createDataFrame([("2024-01-03", "08:00:00", "220", "0.1", "5", "0.1", 0)],
                                "Date string, Time string, `Voltage(V)` string, `Current(A)` string, "
                                "`Power(W)` string, `Energy(kWh)` string, line_no long")
    new = ingest.ingest(raw, log)
    assert new.count() == 0                                  # 2024-01-03 08:00:00 is already in the log
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(date" in plan


def test_a_literal_now_prunes(spark, tmp_path):
    """retain_since with a literal as_of is pushed down to the scan."""
    path = str(tmp_path / "log")
    _log(spark).write.parquet(path)
    df = sinks.retain_since(spark.read.parquet(path), 2, dt.datetime(2024, 1, 4, 8, 2))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 7
