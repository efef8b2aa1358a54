"""Deterministic predictions: SURVEY §5 hand-derived goldens and rule order."""

import datetime as dt

from pyspark.sql import functions as F

from wattline import fixed
from wattline.operators import predict, rules


def _grid(spark, rows):
    return spark.createDataFrame(rows, "room string, date date, rate double")


def test_goldens(spark):
    rate = 6.9671                      # tariff of 2024-12
    g = _grid(spark, [
        ("101", dt.date(2024, 12, 2), rate),   # Monday
        ("705", dt.date(2024, 12, 3), rate),   # Tuesday
        ("101", dt.date(2024, 12, 7), rate),   # Saturday
        ("705", dt.date(2024, 12, 7), rate),
        ("101", dt.date(2024, 12, 1), rate),   # Sunday
    ])
    out = {(r["room"], r["date"].isoformat()): r for r in predict.predict_days(g, rules.rules_table(spark)).collect()}
    mon = out[("101", "2024-12-02")]
    assert (mon["total_daily_kwh"], mon["total_cost_php"], mon["avg_hourly_kwh"], mon["avg_hourly_cost_php"]) == (11.4, 79.42, 0.475, 3.31)
    assert list(mon["recommendations"]) == [fixed.RECOMMENDATION_RULES[0][2], fixed.RECOMMENDATION_RULES[1][2],
                                            fixed.RECOMMENDATION_RULES[3][2]]
    tue = out[("705", "2024-12-03")]
    assert (tue["total_daily_kwh"], tue["total_cost_php"], tue["avg_hourly_kwh"], tue["avg_hourly_cost_php"]) == (19.0, 132.37, 0.792, 5.52)
    s1 = out[("101", "2024-12-07")]
    assert (s1["total_daily_kwh"], s1["total_cost_php"], s1["avg_hourly_kwh"], s1["avg_hourly_cost_php"]) == (1.0, 6.97, 0.042, 0.29)
    s7 = out[("705", "2024-12-07")]
    assert (s7["total_daily_kwh"], s7["total_cost_php"], s7["avg_hourly_cost_php"]) == (1.5, 10.45, 0.44)
    assert s7["avg_hourly_kwh"] in (0.062, 0.063)           # exact tie .0625 (F23)
    sun = out[("101", "2024-12-01")]
    assert (sun["total_daily_kwh"], sun["total_cost_php"]) == (0.0, 0.0) and sum(sun["hourly_breakdown"]) == 0
    assert sun["predicted_rate"] == 6.97


def test_recommend_edges(spark):
    df = spark.createDataFrame([(5.0, 49.99), (0.5, 0.0), (0.0, 0.0), (60.0, 900.0)], "k double, c double")
    got = [list(r[0]) for r in df.withColumn("r", rules.rules_array(fixed.RECOMMENDATION_RULES)).select(rules.recommend(F.col("k"), F.col("c"), F.col("r"))).collect()]
    assert got[0] == [fixed.RECOMMENDATION_RULES[0][2]]            # threshold <= value
    assert got[1] == [fixed.ADVICE_LOW_KWH]
    assert got[2] == [fixed.ADVICE_DEFAULT]
    assert got[3][-2:] == [fixed.ADVICE_HIGH_KWH, fixed.ADVICE_HIGH_COST] and len(got[3]) == 8


def test_hourly_pattern_sums(spark):
    # the shares do not add up to one: .917 lab, .861 office
    assert round(sum(fixed.HOURLY_PATTERN_LAB), 3) == 0.917
    assert round(sum(fixed.HOURLY_PATTERN_OFFICE), 3) == 0.861
