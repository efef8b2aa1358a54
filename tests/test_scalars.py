"""Scalar functions on hand-made edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from wattline.functions import scalars


def _one(spark, expr, *vals, schema="a string, b string"):
    df = spark.createDataFrame([vals], schema)
    return df.select(expr.alias("x")).first()["x"]


def test_parse_reading_ts(spark):
    p = lambda d, t: _one(spark, scalars.parse_reading_ts(F.col("a"), F.col("b")), d, t)
    assert p("2024-01-05", "03:04:05 PM") == dt.datetime(2024, 1, 5, 15, 4, 5)
    assert p("2024-01-05", "12:00:01 am") == dt.datetime(2024, 1, 5, 0, 0, 1)
    assert p("2024-01-05", "15:04:05") == dt.datetime(2024, 1, 5, 15, 4, 5)
    assert p(" 2024-1-5 ", " 3:4:5 ") == dt.datetime(2024, 1, 5, 3, 4, 5)
    assert p("2024-01-05", "") is None
    assert p("", "10:00:00") is None
    assert p("not-a-date", "10:00:00") is None
    assert p("2019-12-31", "10:00:00") is None        # year outside 2020..2030
    assert p("2031-01-01", "10:00:00 AM") is None


def test_safe_float(spark):
    f = lambda v: _one(spark, scalars.safe_float(F.col("a")), v, None)
    assert f("1.5") == 1.5
    assert f(" 2 ") == 2.0
    assert f("1e3") == 1000.0
    assert f("1d") == 0.0          # Spark's cast would take it; Python's float() does not
    assert f("n/a") == 0.0
    assert f(None) == 0.0
    assert f("nan") is None        # NaN is stored as NULL
    assert f("-.5") == -0.5


def test_floor_and_room_type(spark):
    df = spark.createDataFrame([(" 705",), ("101",), ("A12",), ("",)], "room string")
    got = [r[0] for r in df.select(scalars.floor_of_room(F.col("room"))).collect()]
    assert got == [7, 1, 0, 0]
    t = [r[0] for r in df.select(scalars.room_type_from_prefix(F.trim("room"))).collect()]
    assert t == ["lab", "office", "office", "office"]


def test_payload_parse(spark):
    text = "voltage: 221.5 V\nPower: 12.00 W\nUptime: 42 seconds\nLight: ON\nWiFi: Connected\nSD Card: Failed\nTime: 01/02/2024 03:04:05"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(
        scalars.payload_number(F.col("t"), "voltage").alias("v"),
        scalars.payload_number(F.col("t"), "current").alias("c"),
        scalars.payload_number(F.col("t"), "uptime").alias("u"),
        *[c.alias(k) for k, c in scalars.payload_status(F.col("t")).items()],
        scalars.device_event_time(F.col("t"), F.lit(None).cast("timestamp")).alias("ts"),
    ).first()
    assert (r["v"], r["c"], r["u"]) == (221.5, None, 42.0)
    assert (r["light_state"], r["wifi"], r["cloud"], r["sd_card"]) == ("ON", "Connected", "Disconnected", "Failed")
    assert r["ts"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_factors_and_minutes(spark):
    df = spark.createDataFrame([(d, m) for d, m in [(1, 1), (8, 5), (15, 11), (22, 3)]], "d int, m int")
    got = df.select(scalars.week_of_month_factor(F.col("d"), fallback=True).alias("w"),
                    scalars.season_factor(F.col("m")).alias("s")).collect()
    assert [(r["w"], r["s"]) for r in got] == [(0.95, 0.8), (1.0, 1.2), (1.05, 0.8), (0.9, 1.0)]
    m = spark.createDataFrame([("07:30",), ("16:05",)], "t string").select(
        scalars.minutes_of_day(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in m] == [450, 965]
    s = spark.createDataFrame([("Connected",), ("Failed",), ("Unknown",)], "s string").select(
        scalars.status_class(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in s] == ["ok", "err", "warn"]


def test_coerce_ts_shapes(spark):
    rows = [("2024-01-05", "13:04:05"), ("2024-1-5", "7:04"), ("2024-01-05", "01:04:05 PM"), ("1/5/2024", "13:04:05"),
            ("2024-01-05", "garbage"), ("bad", "13:00"), ("2024-01-05 13:04:05", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(scalars.coerce_ts(F.col("a"), F.col("b"))).collect()]
    assert got == [dt.datetime(2024, 1, 5, 13, 4, 5), dt.datetime(2024, 1, 5, 7, 4), dt.datetime(2024, 1, 5, 13, 4, 5),
                   dt.datetime(2024, 1, 5, 13, 4, 5), None, None, dt.datetime(2024, 1, 5, 13, 4, 5)]
    only = [r[0] for r in df.select(scalars.coerce_ts(F.col("a"))).collect()]
    assert only[0] == dt.datetime(2024, 1, 5) and only[3] == dt.datetime(2024, 1, 5) and only[5] is None
