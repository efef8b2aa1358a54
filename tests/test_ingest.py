"""Import: first row in file order wins, existing rows are kept, counters add up."""

import datetime as dt

from wattline.sources import ingest


def test_first_wins_and_anti_join(spark):
    raw = spark.createDataFrame([
        ("2024-01-05", "01:00:00 PM", "220.1", "0.5", "110", "0.1", 0),
        ("2024-01-05", "13:00:00", "220.1", "0.5", "999", "0.1", 1),      # same second: ignored
        ("2024-01-05", "13:00:01", "x", "0.5", "n/a", "0.2", 2),
        ("bad", "13:00:02", "220", "0.5", "1", "0.3", 3),
        ("2024-01-05", "13:00:03", "220", "0.5", "1", "0.3", 4),
    ], "Date string, Time string, `Voltage(V)` string, `Current(A)` string, `Power(W)` string, `Energy(kWh)` string, line_no long")
    log = spark.createDataFrame([("705", dt.datetime(2024, 1, 5, 13, 0, 3, 500))], "room string, ts timestamp")
    new = {r["ts"]: r for r in ingest.ingest(raw, log).collect()}
    assert set(new) == {dt.datetime(2024, 1, 5, 13, 0, 0), dt.datetime(2024, 1, 5, 13, 0, 1)}
    assert new[dt.datetime(2024, 1, 5, 13, 0, 0)]["power"] == 110.0
    assert new[dt.datetime(2024, 1, 5, 13, 0, 1)]["voltage"] == 0.0 and new[dt.datetime(2024, 1, 5, 13, 0, 1)]["power"] == 0.0
    c = ingest.ingest_counts(raw, log).first()
    assert (c["processed"], c["skipped"], c["unique_in_file"], c["added"]) == (4, 1, 3, 2)


def test_import_files_with_different_headers(spark, tmp_path):
    """Two files that order their columns differently, a BOM, blanks, a missing column: each by its own header."""
    (tmp_path / "1.csv").write_text("\ufeff Date ,Time,Voltage(V),Current(A),Power(W),Energy(kWh)\n2024-01-05,01:00:00 PM,220.1,0.5,110,0.1\n2024-01-05,13:00:00,220,0.5,999,0.1\n", encoding="utf-8")
    (tmp_path / "2.csv").write_text("Power(W),Energy(kWh),Time,Date,Room\n50,0.2,13:00:00,2024-01-05,x\n60,0.3,13:00:05,2024-01-05,x\n", encoding="utf-8")
    raw = ingest.read_import_csv(spark, str(tmp_path))
    log = spark.createDataFrame([], "room string, ts timestamp")
    new = {r["ts"].second: (r["voltage"], r["power"]) for r in ingest.ingest(raw, log).collect()}
    assert new == {0: (220.1, 110.0), 5: (0.0, 60.0)}           # the first file's first line wins
