"""Time-bucketed rollups and lookups over the reading log.

All of them are hash aggregates with a partial (map-side) phase, so a hot room
is pre-aggregated in every task before the shuffle; none sorts a whole room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.scalars import quarter_hour_label, weekday_mon0


def _since(df: DataFrame, as_of: Column | None, seconds: int | None) -> DataFrame:
    if seconds is None:
        return df
    now = as_of if as_of is not None else df.select(F.max("ts")).scalar()
    return df.where(F.col("ts") >= now - F.make_dt_interval(secs=F.lit(seconds)))


def hourly_rollup(readings: DataFrame, hours: int | None = None, as_of: Column | None = None) -> DataFrame:
    """A3: per room and clock hour — mean voltage/current/power, counter MAX-MIN, rows.

    ``hours`` keeps only the last N hours before ``as_of`` (default: max ts).
    """
    r = _since(readings, as_of, None if hours is None else hours * 3600)
    return r.groupBy("room", F.date_trunc("hour", "ts").alias("hour")).agg(
        exact.avg_rounded("voltage", exact.VOLTAGE, 4).alias("avg_voltage"),
        exact.avg_rounded("current", exact.CURRENT, 6).alias("avg_current"),
        exact.avg_rounded("power", exact.POWER, 4).alias("avg_power"),
        exact.spread_rounded("energy_counter_kwh", exact.ENERGY, 8).alias("energy_consumed"),
        F.count(F.lit(1)).alias("n_readings"),
    )


def power_15min(readings: DataFrame) -> DataFrame:
    """A4: per room and day, mean power per 15-minute slot label ``HH:MM`` (round 2)."""
    return readings.groupBy(
        "room", F.to_date("ts").alias("date"), quarter_hour_label(F.col("ts")).alias("slot")
    ).agg(exact.avg_rounded("power", exact.POWER, 2).alias("avg_power"), F.count(F.lit(1)).alias("n_readings"))


def day_summary(readings: DataFrame) -> DataFrame:
    """A5: per room and day — avg/max power, avg voltage/current, counter MAX-MIN, rows."""
    return readings.groupBy("room", F.to_date("ts").alias("date")).agg(
        exact.avg_rounded("power", exact.POWER, 2).alias("avg_power"),
        exact.units_rounded(F.max(exact.units("power", exact.POWER)), exact.POWER, 2).alias("max_power"),
        exact.avg_rounded("voltage", exact.VOLTAGE, 2).alias("avg_voltage"),
        exact.avg_rounded("current", exact.CURRENT, 6).alias("avg_current"),
        exact.spread_rounded("energy_counter_kwh", exact.ENERGY, 4).alias("total_energy"),
        F.count(F.lit(1)).alias("data_points"),
    )


def available_dates(readings: DataFrame) -> DataFrame:
    """Distinct (room, date) with data."""
    return readings.select("room", F.to_date("ts").alias("date")).distinct()


def rooms_with_data(readings: DataFrame, default_room: str = "705") -> DataFrame:
    """Distinct rooms; the default room alone when the log is empty."""
    from pyspark.sql import Window

    rooms = readings.select("room").where(F.col("room").isNotNull()).distinct().withColumn("_real", F.lit(1))
    fallback = readings.sparkSession.range(1).select(F.lit(default_room).alias("room"), F.lit(0).alias("_real"))
    u = rooms.unionByName(fallback).withColumn("_any", F.max("_real").over(Window.partitionBy()))  # distinct rooms only
    return u.where((F.col("_real") == 1) | (F.col("_any") == 0)).select("room")


def room_counts(readings: DataFrame) -> DataFrame:
    """Rows per room."""
    return readings.groupBy("room").agg(F.count(F.lit(1)).alias("n_rows"))


def weekday_power(readings: DataFrame) -> DataFrame:
    """Per room and weekday (Mon=0) — mean power and rows."""
    return readings.groupBy("room", weekday_mon0(F.col("ts")).alias("weekday")).agg(
        exact.avg_rounded("power", exact.POWER, 2).alias("avg_power"), F.count(F.lit(1)).alias("n_rows")
    )


def latest_reading(readings: DataFrame) -> DataFrame:
    """The latest reading of every room (ties on ts broken by the larger id).

    ``max_by`` is an aggregate with a partial phase: no per-room sort.
    Rounded as the dashboard shows it (2/6/2/3 places).
    """
    last = readings.groupBy("room").agg(
        F.max_by(
            F.struct("ts", "voltage", "current", "power", "energy_counter_kwh", "light_state"),
            F.struct("ts", "id"),
        ).alias("r")
    )
    return last.select(
        "room",
        F.col("r.ts").alias("ts"),
        exact.units_rounded(exact.units(F.col("r.voltage"), exact.VOLTAGE), exact.VOLTAGE, 2).alias("voltage"),
        F.round("r.current", 6).alias("current"),
        exact.units_rounded(exact.units(F.col("r.power"), exact.POWER), exact.POWER, 2).alias("power"),
        exact.units_rounded(exact.units(F.col("r.energy_counter_kwh"), exact.ENERGY), exact.ENERGY, 3).alias("energy_kwh"),
        F.col("r.light_state").alias("light_state"),
    )


def nearest_available_date(available: DataFrame, requests: DataFrame) -> DataFrame:
    """K4: for each (room, requested date) the greatest available date <= it, else the earliest.

    As-of lookup without pairs: union requests with available dates per room and
    carry the running max of available dates; per room this is one row per date,
    so the window is bounded by the calendar, not by the data volume.
    """
    from pyspark.sql import Window

    a = available.select("room", F.col("date").alias("d"), F.lit(0).alias("kind"), F.col("date").alias("avail"))
    q = requests.select("room", F.col("date").alias("d"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("avail"))
    w = Window.partitionBy("room").orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(q).withColumn("prior", F.max("avail").over(w)).withColumn(
        "earliest", F.min("avail").over(Window.partitionBy("room")))
    return u.where(F.col("kind") == 1).select(
        "room", F.col("d").alias("requested"), F.coalesce("prior", "earliest").alias("resolved"))


def peak_hour(profile: DataFrame, keys: list[str], hour: str = "hour", value: str = "avg_w") -> DataFrame:
    """K5: first hour with the maximal value per key (smallest hour on ties)."""
    return profile.groupBy(*keys).agg(
        F.min_by(F.col(hour), F.struct((-F.col(value)).alias("neg"), F.col(hour))).alias("peak_hour"),
        F.max(value).alias("peak_value"),
    )


#: What the live buffer holds, with its stored decimals.
_BUFFERED = {"power": exact.POWER, "voltage": exact.VOLTAGE, "current": exact.CURRENT}


def rolling_last_n(readings: DataFrame, n: int = 60, block_rows: int = 100_000) -> DataFrame:
    """Mean power, voltage and current over each room's last ``n`` readings (the
    live buffer), exact in integer units; ``n_window`` = readings in the buffer.
    A null value counts in neither sum nor divisor of its mean."""
    from . import scans

    vals = {}
    for c, d in _BUFFERED.items():
        vals[f"_s_{c}"] = exact.units(F.col(c), d)
        vals[f"_n_{c}"] = F.col(c).isNotNull().cast("long")
    used = readings.select("id", "room", "ts", *_BUFFERED)
    r = scans.rolling_rows(used, ["room"], ["ts", "id"], vals, n, F.date_trunc("hour", "ts"), block_rows)
    return r.select(
        "id", "room", "ts",
        F.col("_rr_n").alias("n_window"),
        *[exact.ratio_rounded(F.col(f"_s_{c}"), F.col(f"_n_{c}"), d, 6 if c == "current" else 2).alias(f"avg_{c}")
          for c, d in _BUFFERED.items()],
    )
