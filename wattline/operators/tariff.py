"""Tariff series: month grid, lookup, trend, extrapolation and many-series
Holt-Winters (SURVEY J2, W7, M7-M11, F19).

Input is a long table ``(series, month DATE, rate DOUBLE)`` — any number of
series.  Per-series work is bounded by the calendar (one row per month), so the
one place a series is gathered into an array — the Holt-Winters fold — holds
at most a few hundred numbers regardless of data volume.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.scalars import clamp, months_between_index

SEASON = 12


def fill_month_grid(rates: DataFrame) -> DataFrame:
    """M10 (asfreq('MS')): every month between a series' first and last, missing -> null rate."""
    bounds = rates.groupBy("series").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = bounds.select(
        "series", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month")
    )
    return grid.join(rates, ["series", "month"], "left").select("series", "month", "rate")


def default_rate_series(spark, start: str = "2021-01-01", months: int = 60, base: float = 11.0, step: float = 0.08) -> DataFrame:
    """Deterministic trainer default, ``base + step * i`` for ``months`` months."""
    return spark.range(months).select(
        F.lit("default").alias("series"),
        F.add_months(F.to_date(F.lit(start)), F.col("id").cast("int")).alias("month"),
        (F.lit(base) + F.col("id") * F.lit(step)).alias("rate"),
    )


def series_summary(rates: DataFrame, tail: int = 12) -> DataFrame:
    """Per series: last month, last rate, row count and W7's recent trend.

    W7: over the last ``tail`` rows, (last - first) / (n - 1).  The window is
    per series over monthly rows (bounded by the calendar).
    """
    w = Window.partitionBy("series").orderBy(F.col("month").desc())
    recent = rates.where(F.col("rate").isNotNull()).withColumn("rn", F.row_number().over(w))
    return recent.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("month").alias("last_month"),
        F.max_by("rate", "month").alias("last_rate"),
        F.count_if(F.col("rn") <= tail).alias("n_recent"),
        F.min_by(F.when(F.col("rn") <= tail, F.col("rate")), F.when(F.col("rn") <= tail, F.col("month"))).alias("first_recent"),
    ).withColumn(
        "trend",
        F.when(F.col("n_recent") >= 2, (F.col("last_rate") - F.col("first_recent")) / (F.col("n_recent") - 1)),
    )


def extrapolate_rate(dates: DataFrame, summary: DataFrame) -> DataFrame:
    """M9: last + trend * n_months + 0.3 * sin(2*pi*month/12), clamped to 10..15.

    ``dates(series, date)``; fewer than two history rows -> 11.0; fewer than
    two recent rows -> the last rate.
    """
    d = dates.join(summary, "series", "left")
    n = months_between_index(F.col("date"), F.col("last_month"))
    seasonal = F.sin(F.lit(2 * math.pi) * F.month("date") / F.lit(12.0)) * F.lit(0.3)
    lo, hi = fixed.RATE_CLAMP
    value = (
        F.when(F.coalesce(F.col("n_rows"), F.lit(0)) < 2, F.lit(fixed.DEFAULT_RATE))
        .when(F.col("n_recent") < 2, F.col("last_rate"))
        .otherwise(clamp(F.col("last_rate") + F.col("trend") * n + seasonal, lo, hi))
    )
    return d.select(*dates.columns, value.alias("rate"))


def rate_for_date(dates: DataFrame, rates: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Exact month in the history, else the model forecast for months after
    the history (``forecast(series, month, rate)``), else the series' last known
    rate (also for dates before or inside gaps of the history), else 11.0.

    History and forecasts are per-month tables (one row per series-month);
    joined on (series, month) — broadcast by AQE when they are small.
    """
    d = dates.withColumn("_m", F.trunc("date", "MM"))
    hist = rates.where(F.col("rate").isNotNull()).select("series", F.col("month").alias("_m"), F.col("rate").alias("_hist"))
    summ = series_summary(rates).select("series", "last_month", "last_rate")
    out = d.join(hist, ["series", "_m"], "left").join(summ, "series", "left")
    fc = F.lit(None).cast("double")
    if forecast is not None:
        f = forecast.select("series", F.col("month").alias("_m"), F.col("rate").alias("_fc"))
        out = out.join(f, ["series", "_m"], "left")
        fc = F.when(months_between_index(F.col("date"), F.col("last_month")) > 0, F.col("_fc"))
    rate = F.coalesce(F.col("_hist"), fc, F.col("last_rate"), F.lit(fixed.DEFAULT_RATE))
    return out.select(*dates.columns, rate.alias("rate"))


# --- M7 / M8: Holt-Winters, additive trend and season, many series ----------

DEFAULT_GRID = {
    "alpha": [0.05 + 0.1 * i for i in range(10)],
    "beta": [0.0, 0.05, 0.1, 0.15, 0.2, 0.3],
    "gamma": [0.0 + 0.05 * i for i in range(9)],
}


FIT = ("series string, last_month date, alpha double, beta double, gamma double, sse double, n_obs int, n_steps int, "
       "level double, trend double, season array<double>, aic double, bic double")


def _fit_series(grid: dict, min_points: int):
    """Fit of one series (its months in order, gaps null): all parameter triples as vectors, one pass over the months.

    Initial state from the first two seasons: level = mean(season 1), trend =
    (mean(season 2) - mean(season 1)) / 12, seasonal terms = value - level."""
    alpha, beta, gamma = (x.ravel() for x in np.meshgrid(grid["alpha"], grid["beta"], grid["gamma"], indexing="ij"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        y = pdf["rate"].to_numpy(np.float64)
        row = {"series": pdf["series"].iloc[0], "last_month": pdf["month"].iloc[-1], "n_steps": len(y), "n_obs": int(np.isfinite(y).sum())}
        if len(y) < min_points:          # too short to fit: reported without parameters
            return pd.DataFrame([row | dict.fromkeys(("alpha", "beta", "gamma", "sse", "level", "trend", "season", "aic", "bic"))])

        def mean(x):
            seen = x[np.isfinite(x)]
            total = 0.0
            for v in seen:
                total += v
            return total / max(1, len(seen))

        m1, m2 = mean(y[:SEASON]), mean(y[SEASON:2 * SEASON])
        level, trend = np.full(len(alpha), m1), np.full(len(alpha), (m2 - m1) / float(SEASON))
        season = np.repeat((np.where(np.isfinite(y[:SEASON]), y[:SEASON], m1) - m1)[None], len(alpha), axis=0)
        sse = np.zeros(len(alpha))
        for i, v in enumerate(y):
            k, ahead = i % SEASON, level + trend
            if not np.isfinite(v):
                level = ahead
                continue
            s = season[:, k].copy()
            new = alpha * (v - s) + (1.0 - alpha) * ahead
            err = v - (ahead + s)
            sse += err * err
            trend = beta * (new - level) + (1.0 - beta) * trend
            season[:, k] = gamma * (v - new) + (1.0 - gamma) * s
            level = new
        best = int(np.lexsort((gamma, beta, alpha, sse))[0])
        n, params = row["n_obs"], 3 + 2 + SEASON
        base = n * np.log(max(sse[best], 1e-300) / n)
        return pd.DataFrame([row | {"alpha": alpha[best], "beta": beta[best], "gamma": gamma[best], "sse": sse[best], "level": level[best], "trend": trend[best],
                                    "season": season[best].tolist(), "aic": base + 2 * params, "bic": base + params * np.log(float(n))}])

    return fit


def holt_winters_fit(rates: DataFrame, grid: dict | None = None, min_points: int = 2 * SEASON) -> DataFrame:
    """M7: grid-search additive Holt-Winters for every series at once.

    One group per series (its months: bounded by the calendar), in which the
    triples (alpha, beta, gamma) are one vector; the best triple is the minimum
    SSE (ties to the smaller parameters).  Output per series: alpha, beta, gamma,
    sse, n, final level/trend/season, last month and AIC/BIC (k = 3 smoothing +
    2 initial + 12 seasonal).  Series with fewer than ``min_points`` months come
    out with null parameters, so their forecasts are null and callers fall back.
    """
    months = fill_month_grid(rates).select("series", "month", "rate")
    return months.groupBy("series").applyInPandas(_fit_series(grid or DEFAULT_GRID, min_points), FIT)


# The one-step errors of the fold are linear in its first state (level, trend, 12 seasonal terms), so for given
# (alpha, beta, gamma) the best first state is a least-squares solution and only the three remain to be searched.

def _linear_errors(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Errors of the observed months for each triple: (triple, month, 1 + 14); the error for a first state x is
    column 0 plus the other columns times x."""
    a, b, g = (v[:, None] for v in (alpha, beta, gamma))
    n, width = len(alpha), 3 + SEASON
    level, trend, season = np.zeros((n, width)), np.zeros((n, width)), np.zeros((n, width, SEASON))
    level[:, 1] = trend[:, 2] = 1.0
    season[:, np.arange(3, width), np.arange(SEASON)] = 1.0
    seen = np.zeros(width)
    out = []
    for i, v in enumerate(y):
        k, ahead = i % SEASON, level + trend
        if not np.isfinite(v):
            level = ahead
            continue
        seen[0] = v
        s = season[:, :, k].copy()
        new = a * (seen - s) + (1.0 - a) * ahead
        out.append(seen - (ahead + s))
        trend = b * (new - level) + (1.0 - b) * trend
        season[:, :, k] = g * (seen - new) + (1.0 - g) * s
        level = new
    return np.stack(out, axis=1)


def _best_states(y: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SSE and first state of each (alpha, beta, gamma) row."""
    e = _linear_errors(y, *triples.T)
    x = -(np.linalg.pinv(e[:, :, 1:]) @ e[:, :, :1])
    return ((e[:, :, :1] + e[:, :, 1:] @ x) ** 2).sum((1, 2)), x[:, :, 0]


def _fold(y: np.ndarray, alpha: float, beta: float, gamma: float, first: np.ndarray) -> tuple[float, float, float, list[float]]:
    """SSE and last state of the fold from a first state."""
    level, trend, season, sse = float(first[0]), float(first[1]), [float(v) for v in first[2:]], 0.0
    for i, v in enumerate(y):
        k, ahead = i % SEASON, level + trend
        if not np.isfinite(v):
            level = ahead
            continue
        new = alpha * (v - season[k]) + (1.0 - alpha) * ahead
        sse += (v - ahead - season[k]) ** 2
        trend = beta * (new - level) + (1.0 - beta) * trend
        season[k] = gamma * (v - new) + (1.0 - gamma) * season[k]
        level = new
    return sse, level, trend, season


def _estimated(smallest: float):
    moves = np.array(np.meshgrid(*[[-1.0, 0.0, 1.0]] * 3, indexing="ij")).reshape(3, -1).T

    def fit(key: tuple, months: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(start) or not len(months) or pd.isna(start["alpha"].iloc[0]):
            return start
        y = months.sort_values("month")["rate"].to_numpy(np.float64)
        here, step = start[["alpha", "beta", "gamma"]].iloc[0].to_numpy(np.float64), 0.1
        best = _best_states(y, here[None])[0][0]
        while step >= smallest:                    # a pattern search in the unit cube: 27 triples in one pass
            around = np.unique(np.clip(here + step * moves, 0.0, 1.0), axis=0)
            sse, _ = _best_states(y, around)
            k = int(np.argmin(sse))
            if sse[k] < best * (1 - 1e-9):
                best, here = sse[k], around[k]
            else:
                step /= 2
        first = _best_states(y, here[None])[1][0]
        sse, level, trend, season = _fold(y, *here, first)
        n, params = int(np.isfinite(y).sum()), 3 + 2 + SEASON
        base = n * np.log(max(sse, 1e-300) / n)
        return start.assign(alpha=here[0], beta=here[1], gamma=here[2], sse=sse, level=level, trend=trend, season=[season],
                            aic=base + 2 * params, bic=base + params * np.log(float(n)))

    return fit


def holt_winters_estimate(rates: DataFrame, fit: DataFrame | None = None, smallest: float = 1e-4) -> DataFrame:
    """M7 with estimated parameters and first states, started at the best of the grid (``fit``).

    For each series (alpha, beta, gamma) are searched in the unit cube down to steps of ``smallest``; the first
    state of every triple is its least-squares optimum.  The SSE is never above the grid's, whose first state is one
    of those.  Same columns as ``holt_winters_fit``; series too short to fit stay without parameters."""
    months = fill_month_grid(rates).select("series", "month", "rate")
    start = fit if fit is not None else holt_winters_fit(rates)
    return months.groupBy("series").cogroup(start.groupBy("series")).applyInPandas(_estimated(smallest), FIT)


def forecast_rates(fit: DataFrame, horizon: int = 12) -> DataFrame:
    """M8: h-step forecasts level + h*trend + season[(n_steps + h - 1) mod 12], h = 1..horizon."""
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    f = fit.select("series", "last_month", "level", "trend", "season", "n_steps", h)
    idx = (F.col("n_steps") + F.col("h") - 1) % SEASON
    return f.select(
        "series",
        F.add_months("last_month", F.col("h")).alias("month"),
        F.col("h").alias("horizon"),
        (F.col("level") + F.col("h") * F.col("trend") + F.element_at("season", idx + 1)).alias("rate"),
    )


def forecast_at(fit: DataFrame, dates: DataFrame) -> DataFrame:
    """Forecast for arbitrary dates ``(series, date)`` after each series' history (any horizon)."""
    d = dates.join(fit, "series")
    h = months_between_index(F.col("date"), F.col("last_month"))
    idx = (F.col("n_steps") + h - 1) % SEASON
    return d.where(h > 0).select(
        "series",
        F.trunc("date", "MM").alias("month"),
        (F.col("level") + h * F.col("trend") + F.element_at("season", idx + 1)).alias("rate"),
    ).distinct()
