"""Weekly timetable: lookups, in-class test, gaps, conflicts (SURVEY J4, J6, P0f,
W3, N3, F20).

The timetable is a table like any other: whether a join broadcasts it is left to
Spark's own size statistics.  Overlapping bookings are resolved on the timetable itself
(first row in file order wins) before it meets the readings, so each reading
matches at most one booking and readings are never regrouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.scalars import minutes_of_day, hhmm

def timetable(spark: SparkSession, rows=fixed.TIMETABLE) -> DataFrame:
    """Timetable with file order and minutes of day (F20); keys trimmed / lower-cased (P0f)."""
    df = spark.createDataFrame(
        [(r, d, s, e, n, i) for i, (r, d, s, e, n) in enumerate(rows)],
        "room string, day string, start_time string, end_time string, event_name string, rule_order int",
    )
    return df.select(
        F.trim("room").alias("room"),
        F.lower(F.trim("day")).alias("day"),
        F.trim("start_time").alias("start_time"),
        F.trim("end_time").alias("end_time"),
        F.trim("event_name").alias("event_name"),
        "rule_order",
        minutes_of_day(F.trim("start_time")).alias("start_min"),
        minutes_of_day(F.trim("end_time")).alias("end_min"),
    )


def effective_timetable(tt: DataFrame) -> DataFrame:
    """Non-overlapping segments per (room, day): at every minute the booking that
    comes first in the file wins (the reference scans rows in order and stops at
    the first hit).  Computed per (room, day) with array functions over that
    day's bookings — a handful of rows — so nothing is paired up as rows."""
    valid = tt.where((F.length("start_time") > 0) & (F.length("end_time") > 0) & (F.col("start_time") < F.col("end_time")))
    g = valid.groupBy("room", "day").agg(
        F.collect_list(F.struct("start_time", "end_time", "rule_order", "event_name")).alias("ev")
    )
    bounds = F.array_sort(F.array_distinct(F.flatten(F.transform("ev", lambda e: F.array(e["start_time"], e["end_time"])))))
    g = g.withColumn("b", bounds)
    segs = F.transform(
        F.sequence(F.lit(1), F.size("b") - 1),
        lambda i: F.struct(
            F.element_at("b", i).alias("seg_start"),
            F.element_at("b", i + 1).alias("seg_end"),
            F.array_min(F.transform(
                F.filter(
                    F.col("ev"),
                    lambda e: (e["start_time"] <= F.element_at("b", i)) & (e["end_time"] >= F.element_at("b", i + 1)),
                ),
                lambda e: F.struct(e["rule_order"].alias("rule_order"), e["event_name"].alias("event_name")),
            )).alias("win"),
        ),
    )
    return (
        g.select("room", "day", F.explode(F.when(F.size("b") >= 2, segs).otherwise(F.array())).alias("s"))
        .where(F.col("s.win").isNotNull())
        .select(
            "room", "day",
            F.col("s.seg_start").alias("seg_start"), F.col("s.seg_end").alias("seg_end"),
            F.col("s.win.event_name").alias("event_name"), F.col("s.win.rule_order").alias("rule_order"),
        )
    )


def schedule_at(ticks: DataFrame, tt: DataFrame, ts: str = "ts") -> DataFrame:
    """For each tick (room, ts): in_class and the booking, with
    ``start <= HH:MM < end`` on the tick's weekday (half-open)."""
    eff = (
        effective_timetable(tt).withColumnRenamed("room", "_tt_room").withColumnRenamed("day", "_tt_day")
    )
    t = ticks.withColumn("_day", F.lower(F.date_format(ts, "EEEE"))).withColumn("_hm", F.date_format(ts, "HH:mm"))
    cond = (
        (F.trim(t["room"]) == eff["_tt_room"]) & (t["_day"] == eff["_tt_day"])
        & (eff["seg_start"] <= t["_hm"]) & (t["_hm"] < eff["seg_end"])
    )
    j = t.join(eff, cond, "left")
    return j.select(
        *[t[c] for c in ticks.columns],
        F.col("event_name").isNotNull().alias("in_class"),
        F.col("event_name").alias("class_event"),
    )


def schedule_for_day(room_days: DataFrame, tt: DataFrame) -> DataFrame:
    """Bookings of each (room, date)'s weekday, with start/end (sort on read by start)."""
    r = room_days.withColumn("_day", F.lower(F.date_format("date", "EEEE")))
    t = tt.withColumnRenamed("room", "_tt_room")
    j = r.join(t, (F.trim(r["room"]) == F.col("_tt_room")) & (r["_day"] == F.col("day")))
    return j.select("room", "date", "start_time", "end_time", "event_name", "start_min", "rule_order")


def schedule_gaps(day_schedule: DataFrame, min_gap: int = 10) -> DataFrame:
    """Free time between consecutive bookings of a day (sorted by start):
    from the previous booking's end to the next start, kept if >= ``min_gap`` min.

    The window is per (room, date) over that day's bookings (a handful)."""
    w = Window.partitionBy("room", "date").orderBy("start_min", "rule_order")
    d = day_schedule.withColumn("_end_min", minutes_of_day(F.col("end_time")))
    d = d.where(F.col("start_min").isNotNull() & F.col("_end_min").isNotNull())
    d = d.withColumn("prev_end", F.lag("_end_min").over(w))
    gap = F.col("start_min") - F.col("prev_end")
    return d.where(F.col("prev_end").isNotNull() & (gap > 0) & (gap >= min_gap)).select(
        "room", "date",
        hhmm(F.col("prev_end")).alias("gap_start"),
        F.col("start_time").alias("gap_end"),
        gap.alias("gap_minutes"),
        F.col("event_name").alias("next_event"),
    )


def schedule_conflicts(day_schedule: DataFrame) -> DataFrame:
    """Bookings that start before an earlier-starting booking of the same
    room and day has ended.  A running maximum of end times (no pairs): each
    conflicting booking is reported once, with the booking that holds the room."""
    d = day_schedule.withColumn("_end_min", minutes_of_day(F.col("end_time")))
    d = d.where(F.col("start_min").isNotNull() & F.col("_end_min").isNotNull())   # empty bounds never book
    key = F.struct(F.col("_end_min"), (-F.col("rule_order")).alias("o"))
    w = Window.partitionBy("room", "date").orderBy("start_min", "rule_order").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_holder", F.max(F.struct(key.alias("k"), F.col("event_name").alias("n"), F.col("end_time").alias("e"))).over(w))
    conflict = F.col("_holder").isNotNull() & (F.col("start_min") < F.col("_holder.k._end_min"))
    msg = F.replace(F.replace(F.replace(F.lit(fixed.CONFLICT_TEXT), F.lit("{room}"), F.col("room")),
                              F.lit("{date}"), F.date_format("date", "yyyy-MM-dd")),
                    F.lit("{time}"), F.concat(F.col("start_time"), F.lit("-"), F.col("_holder.e")))
    return d.where(conflict).select(
        "room", "date", "event_name", "start_time", "end_time",
        F.col("_holder.n").alias("overlaps_event"), msg.alias("message"),
    )
