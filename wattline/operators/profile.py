"""Day-of-week profile forecast from the reading log.

For a target (room, date) the reference scans the room's whole log, tests the
target weekday's mean power against 5 W, and otherwise averages power per hour
of day with weight 2 for rows of the target weekday.  Here the whole log is
reduced once to ``(room, weekday, hour) -> (count, sum)`` (a partial hash
aggregate: map-side combine, so a hot room never lands in one task), and every
target of every room is answered from that 168-row-per-room summary.

Sums are kept in integer units of the stored precision (1e-4 W) and every
rounding (W to 2 places, kWh to 4, cost to centavos) is exact half-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import exact
from ..functions.exact import idiv
from ..functions.scalars import day_name, room_type_from_prefix, room_type_label, weekday_mon0
from ..session import cut_lineage


def weekday_hour_stats(readings: DataFrame, materialize: bool = True) -> DataFrame:
    """(room, wd, h) -> n (non-null power rows), s (sum of power in 1e-4 W),
    n_rows, last_ts — the one pass over the log.

    The summary (at most 168 rows per room) feeds several small consumers; it is
    checkpointed into the shared checkpoint folder so the log is read once
    instead of once per consumer (their column needs differ, so Spark would not
    reuse the exchange)."""
    st = readings.groupBy(
        "room", weekday_mon0(F.col("ts")).alias("wd"), F.hour("ts").alias("h")
    ).agg(F.count("power").alias("n"), exact.total(exact.units(F.col("power"), exact.POWER)).alias("s"),
          F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("last_ts"))
    return cut_lineage(st) if materialize else st


def _weekday_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("room", "wd").agg(F.sum("n").alias("n_same"), F.sum("s").alias("s_same"))


def zero_days(readings: DataFrame) -> DataFrame:
    """P0h for every room and all seven weekdays: mean power of that weekday and
    whether it is below 5 W (no rows of that weekday counts as zero)."""
    stats = weekday_hour_stats(readings)
    rooms = stats.select("room").distinct()
    grid = rooms.select("room", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("wd"))
    tot = _weekday_totals(stats)
    g = grid.join(tot, ["room", "wd"], "left").fillna(0, ["n_same", "s_same"])
    limit = int(fixed.ZERO_DAY_WATTS * 10 ** exact.POWER)
    return g.select(
        "room",
        F.col("wd").alias("weekday"),
        F.coalesce(exact.ratio_rounded(F.col("s_same"), F.col("n_same"), exact.POWER, 2), F.lit(0.0)).alias("dow_avg_power"),
        F.col("n_same").alias("n_rows"),
        ((F.col("n_same") == 0) | (F.col("s_same") < F.col("n_same") * limit)).alias("is_zero_day"),
    )


def hourly_profile(readings: DataFrame, targets: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row per (room, date, hour) of ``targets(room, date)``.

    cw = weighted mean power in centiwatts (half-up), the target weekday's mean
    for hours without rows; plus the weekday totals used by P0h/P1.
    """
    stats = stats if stats is not None else weekday_hour_stats(readings)
    stats = stats.select("room", "wd", "h", "n", "s")
    per_hour = stats.groupBy("room", "h").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    tot = _weekday_totals(stats)
    t = targets.select("room", "date", weekday_mon0(F.col("date")).alias("wd"))
    grid = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    g = (
        grid.join(tot, ["room", "wd"], "left")
        .join(per_hour, ["room", "h"], "left")
        .join(stats, ["room", "wd", "h"], "left")
        .fillna(0, ["n_same", "s_same", "n_all", "s_all", "n", "s"])
    )
    nu = F.col("s_all") + F.col("s")          # weight 2 for the target weekday
    de = F.col("n_all") + F.col("n")
    dow_cw = F.when(F.col("n_same") > 0, exact.ratio_units(F.col("s_same"), F.col("n_same"), exact.POWER, 2)).otherwise(0)
    cw = F.when(de > 0, exact.ratio_units(nu, de, exact.POWER, 2)).otherwise(dow_cw)
    limit = int(fixed.ZERO_DAY_WATTS * 10 ** exact.POWER)
    zero = (F.col("n_same") == 0) | (F.col("s_same") < F.col("n_same") * limit)
    return g.select(
        "room", "date", "wd", "h", "n_same",
        zero.alias("is_zero_day"),
        cw.cast("long").alias("cw_weighted"),
        F.when(zero, F.lit(0)).otherwise(cw).cast("long").alias("cw"),
    ).withColumn("kwh_e4", idiv(F.col("cw") + 5, F.lit(10)))


def weighted_hour_profile(readings: DataFrame) -> DataFrame:
    """A14 registered form: every room x target weekday x hour, weighted mean W (2 places).

    The target dates are the seven days after the last reading (one per weekday).
    """
    stats = weekday_hour_stats(readings)
    hp = hourly_profile(readings, next_week_targets(stats), stats)
    return hp.select(
        "room",
        F.col("wd").cast("long").alias("weekday"),
        F.col("h").cast("long").alias("hour"),
        (F.col("cw_weighted") / F.lit(100.0)).alias("avg_w"),
        "is_zero_day",
    )


def predict_profile(readings: DataFrame, targets: DataFrame | None = None, rate: float = fixed.DEFAULT_RATE) -> DataFrame:
    """Profile forecast for every (room, date) target in one job.

    Returns totals, cost at the fixed dashboard rate, confidence, peak hour,
    advice (array) and the 24 hourly values (arrays, W and kWh).
    """
    stats = weekday_hour_stats(readings)           # the only pass over the log
    targets = targets if targets is not None else next_week_targets(stats)
    hp = hourly_profile(readings, targets, stats)
    rows_used = stats.groupBy("room").agg(F.sum("n_rows").alias("historical_rows_used"))
    rate_c = int(round(rate * 100))  # rate in centavos per kWh
    per_day = hp.groupBy("room", "date").agg(
        F.first("is_zero_day").alias("is_zero_day"),
        F.first("n_same").alias("n_same"),
        F.sum("kwh_e4").alias("u"),
        F.max("cw").alias("peak_cw"),
        F.min_by("h", F.struct((-F.col("cw")).alias("k"), F.col("h"))).alias("peak_hour"),
        F.sort_array(F.collect_list(F.struct("h", "cw", "kwh_e4"))).alias("hours"),
    )
    u = F.col("u")
    c = idiv(u * (2 * rate_c) + 10000, F.lit(20000))     # cost in centavos, half-up
    total = u / F.lit(10000.0)
    q, r = idiv(F.col("peak_cw"), F.lit(100)), F.col("peak_cw") % 100
    peak_w = q + F.when((r > 50) | ((r == 50) & (q % 2 == 1)), 1).otherwise(0)   # like Python's :.0f
    dname = day_name(F.col("date"))
    advice_regular = F.filter(
        F.array(
            F.when(
                F.col("peak_cw") > 50000,
                F.format_string(fixed.PROFILE_PEAK_TEXT.replace("{hour}", "%02d").replace("{watts}", "%d"), F.col("peak_hour"), peak_w),
            ),
            F.when(u > 50000, F.concat(F.lit(fixed.PROFILE_HIGH_TEXT.split("{kwh}")[0]), total.cast("string"), F.lit(fixed.PROFILE_HIGH_TEXT.split("{kwh}")[1]))),
            F.when(u <= 10000, F.lit(fixed.PROFILE_LOW_TEXT)),
        ),
        lambda x: x.isNotNull(),
    )
    advice_regular = F.when(F.size(advice_regular) > 0, advice_regular).otherwise(
        F.array(F.concat(F.lit("Normal "), dname, F.lit(" usage projected.")))
    )
    advice_zero = F.array(*[F.replace(F.lit(t), F.lit("{day}"), dname) for t in fixed.PROFILE_ZERO_DAY_TEXTS])
    zero = F.col("is_zero_day")
    out = per_day.join(rows_used, "room", "left").select(
        "room",
        "date",
        dname.alias("day_of_week"),
        room_type_label(room_type_from_prefix(F.col("room")), web=True).alias("room_type"),
        zero.alias("is_zero_day"),
        total.alias("total_daily_kwh"),
        F.lit(float(rate)).alias("predicted_rate"),
        (c / F.lit(100.0)).alias("total_cost_php"),
        (idiv(u * 2 + 24, F.lit(48)) / F.lit(10000.0)).alias("avg_hourly_kwh"),
        (idiv(c * 2 + 24, F.lit(48)) / F.lit(100.0)).alias("avg_hourly_cost_php"),
        F.when(zero, F.lit(95)).otherwise(F.least(F.lit(95), F.lit(60) + idiv(F.col("n_same"), F.lit(10)))).cast("long").alias("confidence"),
        F.col("peak_hour").cast("long").alias("peak_hour"),
        (F.col("peak_cw") / F.lit(100.0)).alias("peak_power_w"),
        F.when(zero, advice_zero).otherwise(advice_regular).alias("recommendations"),
        F.transform("hours", lambda x: x["cw"] / F.lit(100.0)).alias("hourly_power_w"),
        F.transform("hours", lambda x: x["kwh_e4"] / F.lit(10000.0)).alias("hourly_breakdown"),
        F.coalesce("historical_rows_used", F.lit(0)).alias("historical_rows_used"),
    )
    return out


def next_week_targets(stats: DataFrame) -> DataFrame:
    """Targets: every room with data x the seven days after the last reading
    (from the weekday/hour summary, or from readings)."""
    col = "last_ts" if "last_ts" in stats.columns else "ts"
    last = stats.select(F.to_date(F.max(col))).scalar()
    rooms = stats.select("room").distinct()
    return rooms.select("room", F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, 7))).alias("date"))
