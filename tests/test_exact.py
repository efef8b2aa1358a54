"""Arithmetic at storage precision: only results are rounded."""

import datetime as dt

from pyspark.sql import functions as F

from wattline.functions import exact
from wattline.operators import features, occupancy, profile, rollups

T0 = dt.datetime(2024, 1, 1)      # a Monday


def test_daily_energy_of_small_increments(spark):
    r = spark.range(3600).select(F.lit("705").alias("room"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
                                 F.lit(0.1 / 3600).alias("energy_kwh"))
    assert round(features.daily_totals(r).first()["energy_kwh"], 3) == 0.1


def test_zero_day_and_means_keep_the_stored_decimals(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "705", 229.9649, 4.9962 / 229.9649, 4.9962, 0.0, 0.0, "ON") for i in range(100)]
    r = spark.createDataFrame(rows, "id long, ts timestamp, room string, voltage double, current double, power double, energy_kwh double, "
                                    "energy_counter_kwh double, light_state string")
    assert rollups.hourly_rollup(r).first()["avg_voltage"] == 229.9649
    day = [x for x in profile.zero_days(r).collect() if x["weekday"] == 0][0]
    assert day["is_zero_day"] and day["dow_avg_power"] == 5.0
    buffer = rollups.rolling_last_n(r, 60).orderBy(F.col("id").desc()).first()
    assert (buffer["avg_power"], buffer["avg_current"]) == (5.0, 0.021726)


def test_nulls_in_the_buffer_do_not_count(spark):
    rows = [(1, T0, "705", 220.0, 1.0, 10.0), (2, T0 + dt.timedelta(seconds=1), "705", 221.0, 1.0, None)]
    r = spark.createDataFrame(rows, "id long, ts timestamp, room string, voltage double, current double, power double")
    assert [x["avg_power"] for x in rollups.rolling_last_n(r, 60).orderBy("id").collect()] == [10.0, 10.0]


def test_confidence_is_truncated_not_rounded(spark):
    rows = [(i, "705", T0, T0, 0, 0.745) for i in range(2)]
    det = spark.createDataFrame(rows, "det_id long, room string, ts timestamp, frame_ts timestamp, class_id int, confidence double")
    assert occupancy.frame_occupancy(det).first()["avg_confidence"] == 74


def test_large_sums_and_quotients_are_exact(spark):
    df = spark.createDataFrame([(900000000000000003,), (900000000000000003,), (7,)], "u long")
    got = df.agg(exact.total("u").alias("s")).select("s", exact.ratio_units(F.col("s"), F.lit(3), 2, 4).alias("r")).first()
    assert int(got["s"]) == 1800000000000000013 and int(got["r"]) == 60000000000000000433
    one = spark.createDataFrame([(27021597764222980,)], "u long").select(exact.idiv(F.col("u"), 3)).first()[0]
    assert one == 27021597764222980 // 3
