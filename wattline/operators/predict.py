"""Deterministic daily predictions for every (room, date) at once (SURVEY P2-P7,
F16-F22, M6/J8, J7).

All quantities are integers in fixed units until the very end — kWh in 1e-4,
rates in 1e-4 Php, costs in centavos, hourly kWh in 1e-3 — so every rounding
(2 places for totals, 3 for hourly values) is exact half-up and identical in
any engine (F23: Python's binary half-even differs only on exact ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import exact
from ..functions.exact import idiv
from ..functions.scalars import day_name, prediction_id, room_type_from_prefix, room_type_label, weekday_mon0
from .rules import recommend, rules_array

PATTERN_E3 = {
    "lab": [int(round(p * 1000)) for p in fixed.HOURLY_PATTERN_LAB],
    "office": [int(round(p * 1000)) for p in fixed.HOURLY_PATTERN_OFFICE],
}


def _season100(month: Column) -> Column:
    """F17 in hundredths."""
    return F.when(month.isin(5, 6, 7, 8), 120).when(month.isin(11, 12, 1, 2), 80).otherwise(100)


def _week100(day: Column, fallback: bool) -> Column:
    """F16 in hundredths."""
    a, b, c, d = (95, 100, 105, 90) if fallback else (98, 100, 102, 97)
    return F.when(day <= 7, a).when(day <= 14, b).when(day <= 21, c).otherwise(d)


def fallback_kwh_e4(room_type: Column, d: Column) -> Column:
    """Base 25 (lab) / 15 kWh x season x week-of-month, at least 0.5 kWh; 1e-4 kWh."""
    base = F.when(room_type == "lab", 25).otherwise(15)
    kwh = base * _season100(F.month(d)) * _week100(F.dayofmonth(d), fallback=True)
    return F.greatest(kwh.cast("long"), F.lit(5000).cast("long"))


def _pattern(room_type: Column) -> Column:
    lab = F.array(*[F.lit(x) for x in PATTERN_E3["lab"]])
    office = F.array(*[F.lit(x) for x in PATTERN_E3["office"]])
    return F.when(room_type == "office", office).otherwise(lab)   # unknown type -> lab


def hourly_e3(kwh_e4: Column, room_type: Column, flat_e3: Column | None = None) -> Column:
    """24 hourly kWh in 1e-3 units: round(kwh * share, 3)."""
    if flat_e3 is not None:
        return F.array_repeat(flat_e3, 24)
    return F.transform(_pattern(room_type), lambda p: idiv(kwh_e4 * p + 5000, 10000))


def _cost_c(kwh_e4: Column, rate_e4: Column) -> Column:
    """round(kwh * rate, 2) in centavos."""
    return idiv(kwh_e4 * rate_e4 * 2 + 1_000_000, 2_000_000)


def predict_days(grid: DataFrame, rules, weekday_kwh_e4: Column | None = None) -> DataFrame:
    """P2 for weekends; weekdays from ``weekday_kwh_e4`` (a model's kWh in
    1e-4 units) or, without a model, the P3 formula.

    ``grid(room, date, rate)`` — ``rate`` from J2 (``tariff.rate_for_date``).
    Output: one result record per row, hourly values as an array.
    """
    room, d = F.col("room"), F.col("date")
    rt = room_type_from_prefix(room)
    wd = weekday_mon0(d)
    lab = rt == "lab"
    kwh_e4 = (
        F.when(wd == 6, F.lit(0).cast("long"))
        .when(wd == 5, F.when(lab, 15000).otherwise(10000).cast("long"))
        .otherwise(weekday_kwh_e4 if weekday_kwh_e4 is not None else fallback_kwh_e4(rt, d))
    )
    rate_e4 = exact.units(F.col("rate"), 4)
    g = grid.select("*", rt.alias("_rt"), wd.alias("_wd"), kwh_e4.alias("_k"), rate_e4.alias("_r"), rules_array(rules).alias("_rules"))
    k, r, wdc, rtc = F.col("_k"), F.col("_r"), F.col("_wd"), F.col("_rt")
    c = F.when(wdc == 6, F.lit(0).cast("long")).otherwise(_cost_c(k, r))
    g = g.withColumn("_c", c)
    c = F.col("_c")
    sat_flat = idiv(k * 40 + 5000, 10000)
    hourly = (
        F.when(wdc == 6, F.array_repeat(F.lit(0).cast("long"), 24))
        .when(wdc == 5, F.array_repeat(sat_flat, 24))
        .otherwise(hourly_e3(k, rtc))
    )
    advice = (
        F.when(wdc == 6, F.array(F.lit(fixed.ADVICE_SUNDAY)))
        .when(wdc == 5, F.array(F.lit(fixed.ADVICE_SATURDAY)))
        .otherwise(recommend(k / F.lit(10000.0), c / F.lit(100.0), F.col("_rules")))
    )
    weekend = wdc >= 5
    return g.select(
        *grid.columns,
        day_name(d).alias("day_name"),
        room_type_label(rtc).alias("room_type"),
        weekend.alias("is_weekend"),
        (idiv(k + 50, 100) / F.lit(100.0)).alias("total_daily_kwh"),
        (idiv(k * 2 + 240, 480) / F.lit(1000.0)).alias("avg_hourly_kwh"),
        (idiv(r + 50, 100) / F.lit(100.0)).alias("predicted_rate"),
        (c / F.lit(100.0)).alias("total_cost_php"),
        (idiv(c * 2 + 24, 48) / F.lit(100.0)).alias("avg_hourly_cost_php"),
        F.transform(hourly, lambda x: x / F.lit(1000.0)).alias("hourly_breakdown"),
        advice.alias("recommendations"),
        F.dayofmonth(d).alias("day_of_month"),
        F.when(~weekend, prediction_id(room, d)).alias("prediction_id"),
    )


def predict_weekend(grid: DataFrame) -> DataFrame:
    """P2 alone: weekend rows of ``grid(room, date, rate)``."""
    from .rules import rules_table

    return predict_days(grid.where(weekday_mon0(F.col("date")) >= 5), rules_table(grid.sparkSession))


def predict_last_resort(grid: DataFrame) -> DataFrame:
    """Weekdays base x season only, rate 11.0, fixed advice, date text without
    zero padding; weekends as P2."""
    d = F.col("date")
    rt = room_type_from_prefix(F.col("room"))
    base = F.when(rt == "lab", 25).otherwise(15)
    k = (base * _season100(F.month(d)) * 100).cast("long")
    rate_e4 = int(fixed.DEFAULT_RATE * 10000)
    c = _cost_c(k, F.lit(rate_e4).cast("long"))
    return grid.where(weekday_mon0(d) < 5).select(
        *grid.columns,
        day_name(d).alias("day_name"),
        room_type_label(rt).alias("room_type"),
        F.lit(False).alias("is_weekend"),
        (idiv(k + 50, 100) / F.lit(100.0)).alias("total_daily_kwh"),
        (idiv(k * 2 + 240, 480) / F.lit(1000.0)).alias("avg_hourly_kwh"),
        F.lit(fixed.DEFAULT_RATE).alias("predicted_rate"),
        (c / F.lit(100.0)).alias("total_cost_php"),
        (idiv(c * 2 + 24, 48) / F.lit(100.0)).alias("avg_hourly_cost_php"),
        F.transform(hourly_e3(k, rt), lambda x: x / F.lit(1000.0)).alias("hourly_breakdown"),
        F.array(F.lit(fixed.ADVICE_FALLBACK_MODE)).alias("recommendations"),
        F.format_string("%d-%d-%d", F.year(d), F.month(d), F.dayofmonth(d)).alias("date_text"),
    )


def client_fallback(grid: DataFrame) -> DataFrame:
    """P7 (browser fallback): base 25/15, weekend x0.3, rate 11, flat hourly, confidence 65."""
    d = F.col("date")
    rt = room_type_from_prefix(F.col("room"))
    weekend = weekday_mon0(d) >= 5
    t2 = (F.when(rt == "lab", 25).otherwise(15) * F.when(weekend, 30).otherwise(100)).cast("long")  # 1e-2 kWh
    c = t2 * 11                                                                                        # centavos
    avg3 = idiv(t2 * 20 + 24, 48)                                                                     # 1e-3 kWh
    return grid.select(
        *grid.columns,
        room_type_label(rt).alias("room_type"),
        (t2 / F.lit(100.0)).alias("total_kwh"),
        F.lit(fixed.DEFAULT_RATE).alias("rate"),
        (c / F.lit(100.0)).alias("total_cost"),
        (avg3 / F.lit(1000.0)).alias("avg_hourly_kwh"),
        (idiv(c * 2 + 24, 48) / F.lit(100.0)).alias("avg_hourly_cost"),
        F.array_repeat(avg3 / F.lit(1000.0), 24).alias("hourly_breakdown"),
        F.array(F.lit("Using fallback prediction model"), F.lit("Check API connection")).alias("recommendations"),
        F.lit(65).alias("confidence"),
    )


def date_grid(rooms: DataFrame, start, end) -> DataFrame:
    """Every room x every day in [start, end] (dates or date Columns; an
    explode per room, no join)."""
    s = start if isinstance(start, Column) else F.lit(start).cast("date")
    e = end if isinstance(end, Column) else F.lit(end).cast("date")
    return rooms.select("room", F.explode(F.sequence(s, e)).alias("date"))
