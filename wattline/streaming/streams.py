"""Structured Streaming forms of the live operators.

The reference polls one device per second in a thread and keeps shared
variables; here the same work is a streaming query per operator:

* T1  payload files -> parsed readings, device event time, watermark,
      ``dropDuplicatesWithinWatermark`` on (room, device time), parquet sink;
* T2  tumbling 15-minute / hourly rollups (watermarked windows);
* T3  latest reading per room (``max_by`` state, one row per room);
* T4  presence sessions with ``session_window`` (gap just under 300 s, so a
      detection exactly 300 s later starts a new session, as in the batch form);
* T5  the light controller, T6 the notification throttle, T7 every-10th
      status poll: per-room state machines over events in time order
      (``streaming.ordered``), whatever order the feed delivers them in.

``run_until_caught_up`` drives any of them with ``trigger(availableNow=True)``
into parquet under the session's shared checkpoint folder and hands the result
back as a batch DataFrame (tests and registered queries compare it with the
batch operators).  Aggregations run in update mode; each micro-batch is
appended with its batch id and the latest row per key wins, so the result is
final even for windows still open when the input ends.
"""

from __future__ import annotations

import uuid
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import exact
from ..session import checkpoint_dir
from ..sources.payload import parse_payload
from .ordered import STATE_STORE, Machine, run_in_order

WATERMARK = "10 minutes"


def run_until_caught_up(sdf: DataFrame, name: str, keys: list[str] | None = None,
                        output_mode: str = "append") -> DataFrame:
    """Process everything available, then return the sink as a batch DataFrame.

    The query keeps its state in RocksDB (the ordered state machines need it), in no more
    partitions than the cluster has cores: each costs a store and a worker in every micro-batch.

    ``keys``: update mode, the latest row per key wins.  ``output_mode``
    "complete": each micro-batch holds the whole result, the last one counts."""
    spark = sdf.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    data, chk = f"{base}/data", f"{base}/chk"
    numbered = keys is not None or output_mode == "complete"
    parts = "spark.sql.shuffle.partitions"
    own = {**STATE_STORE, parts: str(min(int(spark.conf.get(parts)), max(1, spark.sparkContext.defaultParallelism)))}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    if not numbered:
        q = (sdf.writeStream.format("parquet").option("path", data).option("checkpointLocation", chk)
             .outputMode(output_mode).trigger(availableNow=True).start())
    else:
        def upsert(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(data)

        q = (sdf.writeStream.foreachBatch(upsert).option("checkpointLocation", chk)
             .outputMode("complete" if output_mode == "complete" else "update").trigger(availableNow=True).start())
    for k, v in before.items():            # the started query has its own copy of the settings
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    if not _exists(spark, data):           # the input had nothing: no micro-batch ran
        out = spark.createDataFrame([], _sink_schema(sdf, numbered))
    else:
        out = spark.read.schema(_sink_schema(sdf, numbered)).parquet(data)
    if not numbered:
        return out
    if keys is None:
        return out.where(F.col("_batch") == out.select(F.max("_batch")).scalar()).drop("_batch")
    rest = [c for c in out.columns if c not in keys and c != "_batch"]
    latest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _sink_schema(sdf: DataFrame, numbered: bool):
    from pyspark.sql import types as T

    fields = list(sdf.schema.fields)
    if numbered:
        fields.append(T.StructField("_batch", T.LongType(), True))
    return T.StructType(fields)


# --- T1: payload stream ----------------------------------------------------------

PAYLOAD_SCHEMA = "room string, received_at timestamp, text string"
FILES_PER_BATCH = 100   # bounds a micro-batch, hence what one room's state function sees at once


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """Landed device payloads, one JSON object per line (room, received_at, text).

    ``files_per_batch`` as in ``file_stream``: ``None`` for a replay of files that are in no time order."""
    return file_stream(spark, folder, PAYLOAD_SCHEMA, "json", files_per_batch)


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet",
                files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """A landed feed as a stream, ``files_per_batch`` files per micro-batch
    (``None``: everything landed so far in one micro-batch).

    The watermarked aggregations (T1, T2) and the ordered state machines (T5-T7)
    take rows in any order that is no later than the watermark, as a live device or
    camera feed delivers them.  Files written in parallel over a long history have
    no order at all, so a replay of them is read as one micro-batch."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(folder)


def stream_readings(payloads: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Parse, stamp with the device clock (fallback: arrival time), and keep
    the first payload to arrive for each (room, device second) — the log's
    insert-or-ignore — as a watermarked aggregation (state per key lives until
    the watermark passes it).  Run in update mode (``run_until_caught_up`` with
    keys room, ts) or append mode for closed seconds only."""
    p = parse_payload(payloads, ingest_ts=F.col("received_at"))
    rows = p.select("room", F.col("device_ts").alias("ts"), "received_at", "text",
                    F.round("voltage", 4).alias("voltage"), F.round("current", 6).alias("current"),   # S5 storage
                    F.round("power", 4).alias("power"), F.round("energy_kwh", 8).alias("energy_kwh"),  # rounding
                    "light_state", "wifi", "cloud", "sd_card")
    keep = ["voltage", "current", "power", "energy_kwh", "light_state", "wifi", "cloud", "sd_card"]
    g = rows.withWatermark("ts", watermark).groupBy("room", "ts").agg(
        F.min_by(F.struct(*keep), F.struct("received_at", "text")).alias("r"))
    return g.select("room", "ts", *[F.col(f"r.{c}").alias(c) for c in keep])


# --- T2 / T3 / T4: aggregations ------------------------------------------------------

def stream_window_rollup(readings: DataFrame, window: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Tumbling window per room: mean power, voltage and current, maximum power and
    the energy metered in the window (exact), rows.

    Readings that carry the meter's counter (``energy_counter_kwh``) give its MAX - MIN, as the batch
    rollups do; else the increments are added up."""
    counter = "energy_counter_kwh" in readings.columns
    energy = F.max(exact.units("energy_counter_kwh", exact.ENERGY)) - F.min(exact.units("energy_counter_kwh", exact.ENERGY)) \
        if counter else exact.total(exact.units("energy_kwh", exact.ENERGY))

    def u(c, d):
        return exact.total(exact.units(F.col(c), d))

    g = readings.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "room").agg(
        u("power", exact.POWER).alias("_p"), F.count("power").alias("n_readings"),
        u("voltage", exact.VOLTAGE).alias("_v"), F.count("voltage").alias("_nv"),
        u("current", exact.CURRENT).alias("_c"), F.count("current").alias("_nc"),
        F.max(exact.units(F.col("power"), exact.POWER)).alias("_mp"), energy.alias("_e"),
    )
    return g.select(
        "room", F.col("w.start").alias("window_start"),
        exact.ratio_rounded(F.col("_p"), F.col("n_readings"), exact.POWER, 2).alias("avg_power"),
        exact.ratio_rounded(F.col("_v"), F.col("_nv"), exact.VOLTAGE, 4).alias("avg_voltage"),
        exact.ratio_rounded(F.col("_c"), F.col("_nc"), exact.CURRENT, 6).alias("avg_current"),
        exact.units_rounded(F.col("_mp"), exact.POWER, 2).alias("max_power"),
        exact.units_rounded(F.col("_e"), exact.ENERGY, 8).alias("energy_kwh"), "n_readings",
    )


#: What the latest-reading stream carries, where the readings have it.
LATEST = ("ts", "voltage", "current", "power", "energy_kwh", "light_state", "wifi", "cloud", "sd_card")


def stream_latest(readings: DataFrame) -> DataFrame:
    """Latest reading per room with all its values and statuses (state is one row per room)."""
    cols = [c for c in LATEST if c in readings.columns]
    order = ["ts", "id"] if "id" in readings.columns else ["ts"]
    g = readings.groupBy("room").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return g.select("room", *[F.col(f"r.{c}").alias(c) for c in cols])


# A detection exactly 300 s after the previous one starts a new session (gap < 300 s
# continues), while session_window merges events whose gap equals the window gap.
SESSION_GAP = "299 seconds 999999 microseconds"


def stream_sessions(persons: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """T4: presence sessions per room (event-time session windows, merged by Spark
    whatever order detections arrive in).

    Append mode emits a session once the watermark has passed its end and drops
    rows that arrive later than that; complete mode keeps all sessions, open ones
    included, for a replay."""
    g = persons.withWatermark("ts", watermark).groupBy("room", F.session_window("ts", SESSION_GAP).alias("s")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n_detections")
    )
    return g.select("room", "session_start", "session_end", "n_detections")


# --- T5 / T6 / T7: per-room state machines, in event-time order -----------------------

class Throttle(Machine):
    """state = last emitted time, forgotten once the cooldown is over."""

    output = "room string, notified_us long"

    def __init__(self, cooldown_us: int):
        self.cooldown_us = cooldown_us

    def start(self) -> dict[str, Any]:
        return {"last": None}

    def step(self, room, state, rows):
        xs, last = rows["us"].to_numpy(np.int64), state["last"]
        out = []
        i = 0 if last is None else int(np.searchsorted(xs, last + self.cooldown_us, side="right"))
        while i < len(xs):                 # a step per emission: the next detection after the cooldown
            out.append(int(xs[i]))
            i = int(np.searchsorted(xs, out[-1] + self.cooldown_us, side="right"))
        if out:
            state["last"] = out[-1]
        return pd.DataFrame({"room": pd.Series([room] * len(out), dtype=object), "notified_us": pd.Series(out, dtype="int64")})

    def expires(self, state):
        return 0 if state["last"] is None else state["last"] + self.cooldown_us


def stream_throttle(persons: DataFrame, cooldown_seconds: int = fixed.NOTIFY_COOLDOWN_SECONDS,
                    watermark: str = WATERMARK) -> DataFrame:
    """At most one notification per cooldown per room, over ``persons`` (room, ts) in time order."""
    out = run_in_order(persons, Throttle(cooldown_seconds * 1_000_000), "ts", watermark)
    return out.select("room", F.timestamp_micros("notified_us").alias("notified_at"))


class EveryNth(Machine):
    """state = polls seen (kept as long as the stream runs: the numbering goes on)."""

    columns = ("id", "wifi_status", "cloud_status", "sd_card_status")
    ties = ("id",)
    output = "room string, id long, us long, wifi_status string, cloud_status string, sd_card_status string, poll_no long"

    def __init__(self, every: int):
        self.every = every

    def start(self) -> dict[str, Any]:
        return {"seen": 0}

    def step(self, room, state, rows):
        poll_no = state["seen"] + np.arange(1, len(rows) + 1, dtype="int64")
        state["seen"] += len(rows)
        keep = rows.assign(room=pd.Series([room] * len(rows), dtype=object), poll_no=poll_no)[poll_no % self.every == 0]
        return keep[["room", "id", "us", "wifi_status", "cloud_status", "sd_card_status", "poll_no"]]


def stream_status_downsample(status: DataFrame, every: int = fixed.STATUS_EVERY_N_POLLS,
                             watermark: str = WATERMARK) -> DataFrame:
    """Keep every ``every``-th status poll per device, polls in order of (ts, id)."""
    out = run_in_order(status, EveryNth(every), "ts", watermark)
    return out.select("room", "id", F.timestamp_micros("us").alias("ts"), "wifi_status", "cloud_status",
                      "sd_card_status", "poll_no")


_NEVER = np.iinfo(np.int64).min // 4


class Controller(Machine):
    """T5: state = last time a person was seen, and whether the light is on; forgotten when
    the light is off and nobody was seen for the person-gone time."""

    columns = ("frame_ts", "persons", "in_class", "class_event")
    ties = ("frame_ts",)
    output = ("room string, frame_ts timestamp, us long, in_class boolean, mode string, event string, "
              "countdown long, command string")

    def __init__(self, gone_us: int):
        self.gone_us = gone_us

    def start(self) -> dict[str, Any]:
        return {"last": None, "on": False}

    def step(self, room, state, rows):
        last = state["last"]
        t, now, in_class = rows["us"].to_numpy(np.int64), rows["persons"].to_numpy() > 0, rows["in_class"].to_numpy(bool)
        seen = np.maximum.accumulate(np.maximum(np.where(now, t, _NEVER), _NEVER if last is None else last))
        left = self.gone_us - (t - seen)
        waits = ~now & (seen > _NEVER) & (left > 0)
        cd = np.where(waits, left // 1_000_000, 0)
        person = now | waits
        mode = np.where(in_class, "SCHEDULE", np.where(person, "PERSON", "OFF")).astype(object)
        text = np.where(now, "Person detected", np.where(waits, ["Person left — OFF in %ds" % c for c in cd], "No class, no person")).astype(object)
        event = np.where(in_class, "Class: " + rows["class_event"].fillna("").astype(object), text)
        want = in_class | person
        changed = want != np.r_[state["on"], want[:-1]]
        command = np.where(changed, np.where(want, "ON", "OFF"), None)
        state["last"], state["on"] = None if seen[-1] == _NEVER else int(seen[-1]), bool(want[-1])
        return rows.assign(room=pd.Series([room] * len(rows), dtype=object), mode=mode, event=event,
                           countdown=np.where(person & ~in_class, cd, 0).astype(np.int64), command=command)[
            ["room", "frame_ts", "us", "in_class", "mode", "event", "countdown", "command"]]

    def expires(self, state):
        if state["on"]:
            return None
        return 0 if state["last"] is None else state["last"] + self.gone_us


def stream_light_decision(ticks: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """T5: SCHEDULE > PERSON > OFF per tick, ticks in time order, with the last-seen time and
    the light state carried in per-room state; ``command`` is set where W5 emits.

    ``ticks``: room, frame_ts, tick_ts, persons, in_class, class_event."""
    out = run_in_order(ticks, Controller(fixed.PERSON_GONE_SECONDS * 1_000_000), "tick_ts", watermark)
    return out.select("room", "frame_ts", F.timestamp_micros("us").alias("tick_ts"), "in_class", "mode",
                      "event", "countdown", "command")
