"""Tariff: Holt-Winters fold against a plain loop; lookup fallbacks; extrapolation."""

import datetime as dt
import math


from wattline.operators import tariff


def _series(spark, n=40):
    rows = []
    for i in range(n):
        y, m = 2021 + i // 12, i % 12 + 1
        rate = 7 + 0.02 * i + 0.5 * math.sin(2 * math.pi * m / 12) + (0.1 if i % 5 == 0 else 0)
        rows.append(("s1", dt.date(y, m, 1), round(rate, 4)))
    return spark.createDataFrame(rows, "series string, month date, rate double"), [r[2] for r in rows]


def _hw(y, a, b, g):
    l = sum(y[:12]) / 12
    t = (sum(y[12:24]) / 12 - l) / 12
    s = [v - l for v in y[:12]]
    sse = 0.0
    for i, v in enumerate(y):
        k = i % 12
        yhat = l + t + s[k]
        sse += (v - yhat) ** 2
        l2 = a * (v - s[k]) + (1 - a) * (l + t)
        t = b * (l2 - l) + (1 - b) * t
        s[k] = g * (v - l2) + (1 - g) * s[k]
        l = l2
    return l, t, s, sse


def test_holt_winters_matches_loop(spark):
    df, y = _series(spark)
    grid = {"alpha": [0.2, 0.5], "beta": [0.0, 0.1], "gamma": [0.1, 0.3]}
    fit = tariff.holt_winters_fit(df, grid).first()
    best = min(((_hw(y, a, b, g)[3], a, b, g) for a in grid["alpha"] for b in grid["beta"] for g in grid["gamma"]))
    assert (fit["alpha"], fit["beta"], fit["gamma"]) == best[1:]
    l, t, s, sse = _hw(y, *best[1:])
    assert abs(fit["sse"] - sse) < 1e-9 and abs(fit["level"] - l) < 1e-9 and abs(fit["trend"] - t) < 1e-9
    fc = tariff.forecast_rates(tariff.holt_winters_fit(df, grid), 3).orderBy("horizon").collect()
    for r in fc:
        h = r["horizon"]
        assert abs(r["rate"] - (l + h * t + s[(len(y) + h - 1) % 12])) < 1e-9


def test_rate_for_date_fallbacks(spark):
    rates = spark.createDataFrame([("s", dt.date(2024, 1, 1), 6.0), ("s", dt.date(2024, 3, 1), 7.0)],
                                  "series string, month date, rate double")
    dates = spark.createDataFrame([("s", dt.date(2024, 1, 20)), ("s", dt.date(2024, 2, 5)), ("s", dt.date(2023, 5, 1)),
                                   ("s", dt.date(2025, 1, 1)), ("t", dt.date(2024, 1, 1))], "series string, date date")
    got = {(r["series"], r["date"].isoformat()): r["rate"] for r in tariff.rate_for_date(dates, rates).collect()}
    assert got[("s", "2024-01-20")] == 6.0       # exact month
    assert got[("s", "2024-02-05")] == 7.0       # gap -> last known rate
    assert got[("s", "2023-05-01")] == 7.0       # before history -> last known
    assert got[("s", "2025-01-01")] == 7.0       # after, no model -> last known
    assert got[("t", "2024-01-01")] == 11.0      # no history at all


def test_extrapolate_clamps(spark):
    rates = spark.createDataFrame([("s", dt.date(2024, m, 1), 14.0 + 0.5 * m) for m in range(1, 13)],
                                  "series string, month date, rate double")
    summ = tariff.series_summary(rates)
    dates = spark.createDataFrame([("s", dt.date(2025, 6, 1))], "series string, date date")
    assert tariff.extrapolate_rate(dates, summ).first()["rate"] == 15.0
    assert abs(summ.first()["trend"] - 0.5) < 1e-12


def test_month_grid_and_default(spark):
    rates = spark.createDataFrame([("s", dt.date(2024, 1, 1), 1.0), ("s", dt.date(2024, 4, 1), 2.0)],
                                  "series string, month date, rate double")
    g = tariff.fill_month_grid(rates).orderBy("month").collect()
    assert [r["rate"] for r in g] == [1.0, None, None, 2.0]
    d = tariff.default_rate_series(spark).orderBy("month").collect()
    assert len(d) == 60 and d[0]["rate"] == 11.0 and abs(d[-1]["rate"] - (11.0 + 0.08 * 59)) < 1e-12


def test_estimated_parameters_are_not_above_the_grid(spark):
    """A series made by the model itself fits without error; noise fits no worse than the grid; a gap, a short series."""
    import numpy as np

    rng = np.random.default_rng(2)
    season = [float(x) for x in rng.normal(size=12)]
    rows = []
    for m in range(60):
        month = dt.date(2019 + m // 12, m % 12 + 1, 1)
        rows.append(("clean", month, 10 + 0.1 * m + season[m % 12]))
        rows.append(("noisy", month, 10 + 0.05 * m + 0.5 * season[m % 12] + float(rng.normal())))
        if m % 7 != 5:
            rows.append(("gaps", month, 8 + 0.2 * m + float(rng.normal())))
        if m < 20:
            rows.append(("short", month, 5.0))
    rates = spark.createDataFrame(rows, "series string, month date, rate double")
    grid = {r["series"]: r for r in tariff.holt_winters_fit(rates).collect()}
    est = {r["series"]: r for r in tariff.holt_winters_estimate(rates).collect()}
    assert set(est) == set(grid) and est["short"]["alpha"] is None
    assert est["clean"]["sse"] < 1e-18
    for s in ("noisy", "gaps"):
        assert est[s]["sse"] < 0.9 * grid[s]["sse"] and all(0 <= est[s][p] <= 1 for p in ("alpha", "beta", "gamma"))
        assert est[s]["n_obs"] == grid[s]["n_obs"] and est[s]["aic"] < grid[s]["aic"]
    # no triple of a fine random sample does better, each with its own best first state
    y = np.array([r[2] for r in rows if r[0] == "noisy"])
    best = tariff._best_states(y, rng.random((2000, 3)))[0].min()
    assert est["noisy"]["sse"] <= best * (1 + 1e-3)
    # the linear form is the fold: errors from a first state taken directly
    x = rng.normal(size=14)
    e = tariff._linear_errors(y, *np.array([[0.3], [0.1], [0.2]]))[0]
    assert abs(((e[:, 0] + e[:, 1:] @ x) ** 2).sum() - tariff._fold(y, 0.3, 0.1, 0.2, x)[0]) < 1e-9
    ahead = {r["month"]: r["rate"] for r in tariff.forecast_rates(tariff.holt_winters_estimate(rates).where("series = 'clean'"), 12).collect()}
    assert all(abs(v - (10 + 0.1 * (60 + k) + season[(60 + k) % 12])) < 1e-6 for k, (_, v) in enumerate(sorted(ahead.items())))
