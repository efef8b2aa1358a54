"""Profile forecast (P1) against a direct transcription of the stated algorithm
on hand-made readings: weekday zero test, weight-2 hours, empty hours, peak."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from wattline.operators import profile


def _spec(rows, target):
    """The forecast as stated in SURVEY P1 (one room), with exact half-up rounding."""
    from decimal import ROUND_HALF_UP, Decimal

    def r(x, n):
        return float(Decimal(str(x)).quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP))

    wd = target.weekday()
    same = [p for ts, p in rows if ts.weekday() == wd]
    dow = sum(Decimal(str(p)) for p in same) / len(same) if same else Decimal(0)
    if dow < 5:
        return {"zero": True, "total": 0.0, "hourly": [0.0] * 24}
    buckets = defaultdict(list)
    for ts, p in rows:
        for _ in range(2 if ts.weekday() == wd else 1):
            buckets[ts.hour].append(Decimal(str(p)))
    hourly = [r(sum(buckets[h]) / len(buckets[h]) if buckets[h] else dow, 2) for h in range(24)]
    kwh = [r(Decimal(str(w)) / 1000, 4) for w in hourly]
    total = r(sum(Decimal(str(k)) for k in kwh), 4)
    return {"zero": False, "total": total, "hourly": hourly,
            "peak": hourly.index(max(hourly)), "conf": min(95, 60 + len(same) // 10)}


def test_profile_matches_spec(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 3, 4)   # a Monday
    rows = []
    for i in range(900):
        ts = base + dt.timedelta(minutes=rnd.randint(0, 13 * 24 * 60))
        if ts.weekday() == 6:
            p = round(rnd.uniform(0, 3), 2)                   # Sundays ~ idle -> zero day
        elif ts.hour in (3, 4):
            continue                                         # hours without data
        else:
            p = round(rnd.uniform(0, 900), 2)
        rows.append((ts, p))
    df = spark.createDataFrame([(i, "705", ts, p) for i, (ts, p) in enumerate(rows)], "id long, room string, ts timestamp, power double")
    targets = spark.createDataFrame([("705", base.date() + dt.timedelta(days=k)) for k in range(14, 21)], "room string, date date")
    got = {r["date"]: r for r in profile.predict_profile(df, targets).collect()}
    for d, r in got.items():
        s = _spec(rows, d)
        assert r["is_zero_day"] == s["zero"], d
        assert r["total_daily_kwh"] == s["total"], d
        assert list(r["hourly_power_w"]) == s["hourly"], d
        if not s["zero"]:
            assert r["peak_hour"] == s["peak"] and r["confidence"] == s["conf"], d
    assert any(r["is_zero_day"] for r in got.values())
    assert any(not r["is_zero_day"] for r in got.values())


def test_zero_day_threshold_is_strict(spark):
    t0 = dt.datetime(2024, 3, 4, 10)          # Monday
    df = spark.createDataFrame([(1, "101", t0, 5.0), (2, "101", t0 + dt.timedelta(days=7), 5.0)],
                               "id long, room string, ts timestamp, power double")
    z = profile.zero_days(df).where(F.col("weekday") == 0).first()
    assert z["dow_avg_power"] == 5.0 and z["is_zero_day"] is False   # 5.0 is not < 5.0
