"""Occupancy from person detections, and the light controller's decisions
(SURVEY P0g, A16, J5, T4, T5, W4, W5, W6, W8).

Detections are ``(det_id, room, ts, frame_ts, class_id, confidence)``; a
frame is ``(room, frame_ts)``.  Everything ordered per room goes through the
segmented scans (``operators.scans``), so a camera that never stops seeing
people is still split over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import exact
from ..session import written
from . import scans

GONE_US = fixed.PERSON_GONE_SECONDS * 1_000_000
COOLDOWN_US = fixed.NOTIFY_COOLDOWN_SECONDS * 1_000_000


def clamp_threshold(t: float) -> float:
    """The settable confidence threshold, clamped to 0.10..0.99."""
    return max(fixed.CONFIDENCE_MIN, min(fixed.CONFIDENCE_MAX, float(t)))


def _hour(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


def is_person(conf_threshold: float) -> Column:
    return (F.col("class_id") == 0) & (F.col("confidence") >= F.lit(clamp_threshold(conf_threshold)))


def detection_filter(det: DataFrame, conf_threshold: float = fixed.CONFIDENCE_DEFAULT) -> DataFrame:
    """P0g: person boxes (class 0) at or above the (clamped) confidence threshold."""
    return det.where(is_person(conf_threshold))


def frame_occupancy(det: DataFrame, conf_threshold: float = fixed.CONFIDENCE_DEFAULT) -> DataFrame:
    """Per frame — persons, int(mean confidence x 100) (0 if none),
    OCCUPIED/VACANT; every frame is kept (conditional aggregation).

    ``tick_ts`` is the frame's last detection time (the controller's "now").
    Confidences are raw floats: plain mean, truncated."""
    return frames_with_last_person(det, conf_threshold).drop("last_person")


def frames_with_last_person(det: DataFrame, conf_threshold: float = fixed.CONFIDENCE_DEFAULT) -> DataFrame:
    """``frame_occupancy`` with the time of the frame's last person (``last_person``, null if none)."""
    p = is_person(conf_threshold)
    g = det.groupBy("room", "frame_ts").agg(
        F.count_if(p).alias("persons"),
        F.avg(F.when(p, F.col("confidence"))).alias("_avg"),
        F.max("ts").alias("tick_ts"),
        F.max(F.when(p, F.col("ts"))).alias("last_person"),
    )
    avg = (F.col("_avg") * 100).cast("long")
    return g.select(
        "room", "frame_ts", "tick_ts", "persons",
        F.coalesce(avg, F.lit(0).cast("long")).alias("avg_confidence"),
        F.when(F.col("persons") > 0, F.lit("OCCUPIED")).otherwise(F.lit("VACANT")).alias("status"),
        "last_person",
    )


def occupancy_edges(frames: DataFrame) -> DataFrame:
    """W4: 'appeared' / 'left' where presence changes from the previous frame (start: absent)."""
    now = F.col("persons") > 0
    f = scans.previous_value(frames.select("room", "frame_ts", "persons"), ["room"], ["frame_ts"], now, "_prev", _hour("frame_ts"))
    prev = F.coalesce(F.col("_prev"), F.lit(False))
    edge = F.when(now & ~prev, F.lit("appeared")).when(~now & prev, F.lit("left"))
    return f.where(edge.isNotNull()).select("room", "frame_ts", "persons", edge.alias("edge"))


def detection_changes(frames: DataFrame, keep: int = 15) -> DataFrame:
    """Log a frame when it has persons and the count differs from the
    previous frame (start: 0); keep the latest ``keep`` entries per room."""
    used = frames.select("room", "frame_ts", "persons", "avg_confidence")
    f = scans.previous_value(used, ["room"], ["frame_ts"], F.col("persons"), "_prev", _hour("frame_ts"))
    logged = f.where((F.col("persons") > 0) & (F.col("persons") != F.coalesce(F.col("_prev"), F.lit(0))))
    top = scans.top_k_per_key(logged, ["room"], [F.col("frame_ts").desc()], keep, F.to_date("frame_ts"))
    return top.select("room", "frame_ts", "persons", "avg_confidence")


def occupancy_sessions(person_det: DataFrame, gap_seconds: int = fixed.PERSON_GONE_SECONDS) -> DataFrame:
    """T4 (batch): presence continues while detections are less than ``gap_seconds``
    apart; a gap of ``gap_seconds`` or more starts a new session."""
    d = scans.segmented_sessions(person_det.select("room", "ts", "det_id"), ["room"], ["ts", "det_id"], F.unix_micros("ts"),
                                 gap_seconds * 1_000_000, _hour(), strict=False, group_out="session_no")
    return d.groupBy("room", "session_no").agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        F.count(F.lit(1)).alias("n_detections"),
    )


def last_seen(frames: DataFrame, person_det: DataFrame) -> DataFrame:
    """For each frame tick, the last person time at or before it (the tick
    itself when the frame has persons); as-of by a running max over the union of
    ticks and detections per room (segmented), no pairs.  Frame columns travel
    through the union, so frames are produced once."""
    cols = [c for c in frames.columns if c != "room"]
    t = frames.select("room", F.col("tick_ts").alias("_t"), F.lit(1).alias("_kind"),
                      F.lit(None).cast("timestamp").alias("_p"), *cols)
    p = person_det.select("room", F.col("ts").alias("_t"), F.lit(0).alias("_kind"), F.col("ts").alias("_p"),
                          *[F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in cols])
    u = scans.running_max(t.unionByName(p), ["room"], ["_t", "_kind"], F.col("_p"), "_last", _hour("_t"))
    out = u.where(F.col("_kind") == 1).select("room", *cols, F.col("_last").alias("_asof"))
    return out.withColumn("last_seen", F.when(F.col("persons") > 0, F.col("tick_ts")).otherwise(F.col("_asof"))).drop("_asof")


def last_seen_in_frames(frames: DataFrame) -> DataFrame:
    """J5 from the frames alone (``frames_with_last_person``), which hold every person: a running
    maximum over a room's ticks, so the detections are read once.

    For frames that follow one another in time, as a camera's do; where a frame's detections reach
    into the next one's time, ``last_seen`` compares every detection."""
    cols = [c for c in frames.columns if c not in ("room", "last_person")]
    u = scans.running_max(frames, ["room"], ["tick_ts", "frame_ts"], F.col("last_person"), "_asof", _hour("tick_ts"))
    seen = F.when(F.col("persons") > 0, F.col("tick_ts")).otherwise(F.col("_asof"))
    return u.select("room", *cols, seen.alias("last_seen"))


def light_decision(ticks: DataFrame) -> DataFrame:
    """T5: per tick, SCHEDULE (a class is on) > PERSON (present, or seen less than
    300 s ago) > OFF, with the status text and the countdown in whole seconds.

    ``ticks`` has room, tick_ts, persons, last_seen, in_class, class_event."""
    now = F.col("persons") > 0
    gap_us = F.unix_micros("tick_ts") - F.unix_micros("last_seen")
    seen = F.col("last_seen").isNotNull()
    recent = seen & (gap_us < GONE_US)
    left_us = F.lit(GONE_US) - gap_us
    countdown = F.when(~now & seen & (left_us > 0), exact.idiv(left_us, 1_000_000)).otherwise(
        F.lit(0).cast("long"))
    mode = F.when(F.col("in_class"), F.lit("SCHEDULE")).when(recent | now, F.lit("PERSON")).otherwise(F.lit("OFF"))
    event = (
        F.when(F.col("in_class"), F.concat(F.lit("Class: "), F.col("class_event")))
        .when(now, F.lit("Person detected"))
        .when(recent, F.format_string("Person left — OFF in %ds", countdown))
        .otherwise(F.lit("No class, no person"))
    )
    return ticks.select(
        *ticks.columns, mode.alias("mode"), event.alias("event"),
        F.when(F.col("in_class"), F.lit(0).cast("long")).when(recent | now, countdown).otherwise(F.lit(0).cast("long")).alias("countdown"),
    )


def light_commands(decisions: DataFrame) -> DataFrame:
    """ON/OFF commands only where the commanded state changes (initially OFF)."""
    on = F.col("mode") != "OFF"
    d = scans.previous_value(decisions.select("room", "tick_ts", "mode"), ["room"], ["tick_ts"], on, "_prev_on", _hour("tick_ts"))
    change = on != F.coalesce(F.col("_prev_on"), F.lit(False))
    return d.where(change).select("room", "tick_ts", F.when(on, F.lit("ON")).otherwise(F.lit("OFF")).alias("command"), "mode")


def _greedy(xs: Column, start: Column, cd: int) -> Column:
    """Greedy emission over the sorted long array ``xs`` from 1-based index
    ``start`` (which is emitted): state (last emitted, emitted times)."""
    init = F.struct(F.element_at(xs, start).alias("last"), F.array(F.element_at(xs, start)).alias("out"))
    rest = F.slice(xs, start + 1, F.greatest(F.size(xs) - start, F.lit(0)))
    return F.aggregate(
        rest, init,
        lambda acc, x: F.when(x - acc["last"] > cd, F.struct(x.alias("last"), F.concat(acc["out"], F.array(x)).alias("out")))
        .otherwise(acc),
    )


# A block's (or a stretch of blocks') effect on the throttle, as a function of the last emission
# before it: ``head`` holds the detections that can be its first emission, ``outs`` the last emission
# after it for each of these; with no such detection the last emission stays.

def _after(last, head: np.ndarray, outs: np.ndarray, cd: int):
    """The function's value; ``last`` None: nothing emitted yet."""
    j = 0 if last is None else int(np.searchsorted(head, last + cd, side="right"))
    return int(outs[j]) if j < len(head) else last


def _composed(cd: int, width: int):
    """Functions of consecutive blocks (``width`` microseconds each) of one stretch -> the stretch's."""
    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        heads, outs = [np.asarray(x) for x in pdf["head"]], [np.asarray(x) for x in pdf["outs"]]
        head, at = heads[0], outs[0].astype(np.int64)
        if len(heads) > 1 and head[-1] < int(pdf["blk"].iloc[0]) * width + cd:
            # all of the first block may lie within the cooldown; then the second block's first one is emitted
            head, at = np.append(head, heads[1][0]), np.append(at, np.iinfo(np.int64).min // 2)
        for h, o in zip(heads[1:], outs[1:]):
            j = np.searchsorted(h, at + cd, side="right")
            at = np.where(j < len(h), o[np.minimum(j, len(h) - 1)], at)
        return pd.DataFrame({"k": [key[0]], "blk": [key[1]], "head": [head.tolist()], "outs": [at.tolist()]})
    return fn


def _starts(cd: int):
    """For consecutive blocks: the last emission before each, from that before the first (``given``)."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        last = pdf["given"].iloc[0]
        last, before = None if pd.isna(last) else int(last), []
        for head, outs in zip(pdf["head"], pdf["outs"]):
            before.append(last)
            last = _after(last, np.asarray(head), np.asarray(outs), cd)
        return pd.DataFrame({"k": pdf["k"], "blk": pdf["blk"], "given": pd.array(before, dtype="Int64")})
    return fn


def notification_throttle(person_det: DataFrame, cooldown_seconds: int = fixed.NOTIFY_COOLDOWN_SECONDS,
                          block_seconds: int = 600, fan_in: int = 4096) -> DataFrame:
    """At most one notification per ``cooldown`` while persons are seen —
    greedy, measured from the last *emitted* time, strictly greater.

    Exact and bounded for any detection rate and any time span.  Detections are
    grouped per (room, block of ``block_seconds``, at least the cooldown).  The
    previous emission lies before the block, so the block's first emission is one
    of its first detections (those less than the cooldown after the block start, plus
    one): for each such candidate the block's greedy outcome (its last emission) is
    computed.  That makes a block a small function of the last emission before it,
    and functions of consecutive blocks compose to one of the same size: ``fan_in``
    blocks at a time are composed, level by level, until a room has no more than
    that; then the last emission before each stretch is handed down the same way,
    and a per-block fold emits.  No task ever holds more than ``fan_in`` small
    records of a room.  A null room is a room of its own."""
    cd = cooldown_seconds * 1_000_000
    bl = max(block_seconds, cooldown_seconds) * 1_000_000
    key = F.coalesce(F.concat(F.lit("="), F.col("room").cast("string")), F.lit(""))
    d = person_det.where("ts IS NOT NULL").select(key.alias("k"), F.unix_micros("ts").alias("us"))
    d = d.withColumn("blk", ((F.col("us") - F.pmod("us", F.lit(bl))) / bl).cast("long"))
    blocks = d.groupBy("k", "blk").agg(F.sort_array(F.collect_list("us")).alias("xs"))
    n_head = F.least(F.size("xs"), F.size(F.filter("xs", lambda x: x < F.col("blk") * bl + cd)) + 1)
    leaves = written(blocks.select(
        "k", "blk", "xs", F.slice("xs", 1, n_head).alias("head"),
        F.transform(F.sequence(F.lit(1), n_head), lambda j: _greedy(F.col("xs"), j, cd)["last"]).alias("outs"),
    ), "throttle-blocks")
    levels, width = [leaves.select("k", "blk", "head", "outs")], bl
    up = ((F.col("blk") - F.pmod("blk", F.lit(fan_in))) / fan_in).cast("long")
    while (levels[-1].groupBy("k").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        group = levels[-1].withColumn("up", up).groupBy("k", "up")
        levels.append(written(group.applyInPandas(_composed(cd, width), "k string, blk long, head array<long>, outs array<long>"), "throttle-level"))
        width *= fan_in
    given = levels.pop().withColumn("given", F.lit(None).cast("long")).groupBy("k").applyInPandas(_starts(cd), "k string, blk long, given long")
    while levels:
        lower = levels.pop().withColumn("up", up).join(given.withColumnRenamed("blk", "up"), ["k", "up"])
        given = lower.groupBy("k", "up").applyInPandas(_starts(cd), "k string, blk long, given long")
    first = F.size(F.filter("head", lambda x: x <= F.col("given") + cd)) + 1
    j = F.when(F.col("given").isNull(), F.lit(1)).otherwise(first)
    emits = leaves.join(given, ["k", "blk"]).withColumn("j", j).where(F.col("j") <= F.size("head"))
    times = emits.select("k", F.explode(_greedy(F.col("xs"), F.col("j"), cd)["out"]).alias("us"))
    room = F.when(F.col("k") != "", F.substring("k", 2, 1 << 30))
    return times.select(room.alias("room"), F.timestamp_micros("us").alias("notified_at"))
