"""State machines over a room's events in event-time order, on live feeds that
deliver them in any order (SURVEY T5-T7).

A live feed's files, partitions and devices are in no common order.  An ordered
machine therefore holds a room's rows back until the watermark has passed them,
then takes them in time order, whatever micro-batch brought them:

* rows wait in a map state, cut by time (``bucket_seconds``, a day), so a task reads
  one bucket of one room at a time (a live feed's rows wait for minutes only);
* an event-time timer per room names its earliest waiting row; when the watermark
  passes it, everything that is due is taken, in order, and the next timer set;
* the machine's own state is a few numbers per room; it is dropped as soon as time
  has made it equal to a new room's (``expires``), so idle rooms cost nothing.

So the result on any arrival order equals the batch form up to the watermark, and
what waits is bounded by the watermark delay.  Rows at or before the watermark are
late: their time is decided, they change nothing.  A row whose ``beat`` is true only
moves time on (``closing_beat``): the end of a replay, or a feed's heartbeat.

Arbitrary state needs the RocksDB state store (``STATE_STORE``); ``run_until_caught_up``
sets it for its own query, a session that starts the streams itself sets it as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
BEAT = "beat"


class Machine:
    """What happens to a room's events in order.  State is a dict of plain values."""

    columns: Sequence[str] = ()      # columns of the feed it reads, besides the room and the time
    ties: Sequence[str] = ()         # order of rows of the same time
    output = ""                      # DDL of what it emits, the room first

    def start(self) -> dict[str, Any]:
        return {}

    def step(self, room, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        """The output for ``rows`` (sorted, ``us`` their time); changes ``state``."""
        raise NotImplementedError

    def expires(self, state: dict[str, Any]) -> int | None:
        """The time (microseconds) from which the state is as good as none; None: never."""
        return None


def _pack(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


class InOrder(StatefulProcessor):
    """Runs a Machine: map state of waiting chunks, one timer, value state of the machine."""

    def __init__(self, machine: Machine, bucket_us: int):
        self.machine, self.bucket_us = machine, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, first long, nr long", "rows binary")
        self.meta = handle.getValueState("meta", "nr long, timer long, waits boolean, machine string")

    def _load(self) -> tuple[int, int | None, bool, dict[str, Any] | None]:
        """Number of the next chunk, the timer, whether it is for a waiting row, the machine's state."""
        if not self.meta.exists():
            return 0, None, False, None
        nr, timer, waits, text = self.meta.get()
        return int(nr), None if timer is None or pd.isna(timer) else int(timer), bool(waits), json.loads(text) if text else None

    def _save(self, nr: int, timer: int | None, waits: bool, state: dict[str, Any] | None) -> None:
        self.meta.update((nr, timer, waits, None if state is None else json.dumps(state)))

    def _hold(self, pdf: pd.DataFrame, nr: int) -> int:
        """Rows into the waiting chunks, one chunk for each bucket."""
        for bucket, rows in pdf.groupby(pdf["us"] // self.bucket_us, sort=True):
            self.waiting.updateValue((int(bucket), int(rows["us"].min()), nr), (_pack(rows),))
            nr += 1
        return nr

    def _settle(self, nr: int, timer: int | None, state: dict[str, Any] | None, firsts: Sequence[int]) -> None:
        """One timer: at the earliest waiting row, else where the state expires; without either no state stays."""
        if firsts:
            due = -(-min(firsts) // 1000)
        else:
            end = self.machine.expires(state) if state is not None else 0
            if state is None or end == 0:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.meta.clear()
                return
            due = None if end is None else -(-end // 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self._save(nr, due, bool(firsts), state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        nr, timer, waits, state = self._load()
        first = None
        for pdf in rows:
            pdf = pdf[~pdf[BEAT].astype(bool) & ((pdf["us"] > closed) | (closed <= 0))].drop(columns=[BEAT, "at_ts"])
            if len(pdf):
                nr = self._hold(pdf, nr)
                first = min(int(pdf["us"].min()), first if first is not None else np.iinfo(np.int64).max)
        if first is not None:
            if waits and timer is not None and timer <= -(-first // 1000):
                self._save(nr, timer, waits, state)
            else:                       # none yet, a later one, or one for the state's end
                self._settle(nr, timer, state, [first])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        nr, _, _, state = self._load()
        chunks: dict[int, list[tuple]] = {}
        for k in list(self.waiting.keys()):
            chunks.setdefault(int(k[0]), []).append(tuple(int(x) for x in k))
        firsts = [k[1] for ks in chunks.values() for k in ks if k[1] > closed]
        for bucket in sorted(chunks):
            keys = [k for k in chunks[bucket] if k[1] <= closed]
            if not keys:
                continue
            pdf = pd.concat([_unpack(self.waiting.getValue(k)[0]) for k in keys], ignore_index=True)
            for k in keys:
                self.waiting.removeKey(k)
            later = pdf[pdf["us"] > closed]
            if len(later):
                nr = self._hold(later, nr)
                firsts.append(int(later["us"].min()))
            due = pdf[pdf["us"] <= closed].sort_values(["us", *self.machine.ties], kind="stable").reset_index(drop=True)
            state = self.machine.start() if state is None else state
            yield self.machine.step(key[0], state, due)
        if state is not None and not firsts:
            end = self.machine.expires(state)
            if end is not None and end <= closed:
                state = None
        self._settle(nr, None, state, firsts)      # the timer that fired is gone

    def close(self) -> None:
        pass


def run_in_order(feed: DataFrame, machine: Machine, ts: str, watermark: str, bucket_seconds: int = 86_400) -> DataFrame:
    """``machine`` over each room's rows of ``feed`` (room, ``ts``, the machine's columns, optionally ``beat``)."""
    beat = F.coalesce(F.col(BEAT), F.lit(False)) if BEAT in feed.columns else F.lit(False)
    rows = feed.withWatermark(ts, watermark).select(
        "room", F.col(ts).alias("at_ts"), F.unix_micros(ts).alias("us"), beat.alias(BEAT), *machine.columns)
    return rows.groupBy("room").transformWithStateInPandas(
        InOrder(machine, bucket_seconds * 1_000_000), machine.output, "append", "EventTime")


def closing_beat(feed: DataFrame, beats: DataFrame, ts: str) -> DataFrame:
    """``feed`` with the rows of ``beats`` (a stream of ``at`` timestamps) as beats: each moves time on to ``at``.

    A replay reads its closing beat with the feed's one micro-batch, so every row comes due."""
    marks = beats.select(F.col("at").alias(ts), F.lit(True).alias(BEAT))
    return feed.withColumn(BEAT, F.lit(False)).unionByName(marks, allowMissingColumns=True)
