"""Runs of periodically repeated words (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of at least max(`least_words`, `least_periods` * q) words, that no
neighbouring word extends keeping period q.  Loops of a generator, repeated
boilerplate and stuck text are such runs; the collapsed text keeps the first q
words of each.

Longest common extensions.  LCE(i, j) is the number of words for which the texts
behind places i and j agree.  Places whose number modulo 13 lies in the difference
cover {0, 1, 3, 9} are sampled: for any i and j there is a shift below 13 that
brings both to sampled places.  Only the sampled suffixes are sorted, first by 13
words, then by doubling, where only suffixes that are still tied are sorted again;
ranks of each doubling step give the common prefix of neighbours in the order, and
a sparse table the minimum of any stretch of them.  A query compares the few words
up to the shift and reads the rest from the table.

Enumeration.  For each period p the multiples of p are probed: a run of period p
covers at least `least_periods` - 1 of them, and at the first of these, i, LCE(i, i + p) spans
nearly all of it.  The run begins less than p words before i; that place is found by
halving, as "LCE(i - t, i - t + p) >= t" holds up to it.  Over all p these are n ln n
probes, few of which agree in a word at all.  A stretch reported for several periods
has the smallest as its period (the others are multiples of it).

Texts are cut into batches of about `batch_bytes`; a batch's texts stand one behind
the other, 13 zeros between them, and go through numpy together.  Nothing is
shuffled; memory is that of a batch, or of the longest text, times log n.

Cases: null text, empty text, no words: no runs, collapsed to the empty text.  Null
doc_id: kept as null (and never rewritten by `repeated_tail`).  Repeated rows: each
by itself.  Very long texts: whole, a batch of their own.  Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import segment_starts, spans

#: A perfect difference cover: every remainder modulo 13 is a difference of two of these.
MODULUS, COVER = 13, (0, 1, 3, 9)
_IN = np.isin(np.arange(MODULUS), COVER)
#: The least shift that brings places of the two remainders into the cover.
_SHIFT = np.array([[next(d for d in range(MODULUS) if _IN[(a + d) % MODULUS] and _IN[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)], np.int64)


@dataclass(frozen=True)
class Params:
    least_words: int = 6
    least_periods: int = 4  # 3 at least
    batch_bytes: int = 2_000_000
    probes: int = 2_000_000  # grid places looked at in one go


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


class Lce:
    """Longest common extensions in texts that stand one behind the other.

    x: word numbers from 1, each text followed by MODULUS zeros at least; begin and size of each text."""

    def __init__(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.x = x
        real = x > 0
        at = np.flatnonzero(real & _IN[np.arange(len(x)) % MODULUS])
        text = np.searchsorted(begin, at, side="right") - 1
        end = (begin + size)[text]
        self.place = np.full(len(x) + MODULUS, -1, np.int64)
        self.place[at] = np.arange(len(at))
        levels = self._ranks(at, text, end)
        self.rank = levels[-1]
        self.table = self._table(self._neighbours(levels, at, text))

    def _ranks(self, at: np.ndarray, text: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ranks by text and the first 13, 26, 52, ... words; ties have the place of their first in the order."""
        bits = int(self.x.max(initial=1)).bit_length()
        key, t = text.astype(np.int64), 0
        while t < MODULUS:
            room = max(1, (62 - int(key.max(initial=0)).bit_length()) // bits)
            for t in range(t, min(t + room, MODULUS)):
                key = (key << bits) | self.x[at + t]
            t += 1
            key = _dense(key)
        n = np.bincount(key)
        rank = (np.cumsum(n) - n)[key] if len(key) else key
        tied = np.flatnonzero(n[key] > 1) if len(key) else np.zeros(0, np.int64)
        levels, h = [rank], MODULUS
        while len(tied):
            to = at[tied] + h
            inside = to < end[tied]
            nxt = np.full(len(tied), -1, np.int64)
            nxt[inside] = rank[self.place[to[inside]]]
            k = rank[tied] * np.int64(len(at) + 1) + nxt + 1
            order = np.argsort(k, kind="stable")
            tied, k = tied[order], k[order]
            r = rank[tied]
            index = np.arange(len(tied))
            new_group, new = np.r_[True, r[1:] != r[:-1]], np.r_[True, k[1:] != k[:-1]]
            first = np.maximum.accumulate(np.where(new_group, index, 0))
            mine = np.maximum.accumulate(np.where(new, index, 0))
            rank = rank.copy()
            rank[tied] = r + mine - first
            levels.append(rank)
            head = np.flatnonzero(new)
            tied = tied[np.repeat(np.diff(np.r_[head, len(tied)]), np.diff(np.r_[head, len(tied)])) > 1]
            h *= 2
        return levels

    def _neighbours(self, levels: list[np.ndarray], at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Common prefix of each sampled suffix with the one before it in the order; 0 between texts."""
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        out = np.zeros(len(at), np.int64)
        pair = np.flatnonzero(text[order[1:]] == text[order[:-1]]) + 1
        a, b = at[order[pair - 1]], at[order[pair]]
        off = np.zeros(len(pair), np.int64)
        for level in range(len(levels) - 2, -1, -1):
            i, j = self.place[a + off], self.place[b + off]
            same = (i >= 0) & (j >= 0) & (levels[level][i] == levels[level][j])
            off[same] += MODULUS << level
        live = np.arange(len(pair))
        while len(live):
            live = live[self.x[a[live] + off[live]] == self.x[b[live] + off[live]]]
            off[live] += 1
        out[pair] = off
        return out

    @staticmethod
    def _table(lcp: np.ndarray) -> list[np.ndarray]:
        """Minima of stretches of 1, 2, 4, ... neighbours, as far as any is above 0."""
        table, w = [lcp.astype(np.int32)], 1
        while 2 * w <= len(lcp) and table[-1].any():
            t = table[-1]
            table.append(np.minimum(t[:-w], t[w:]))
            w *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCE of places i < j of the same text."""
        d = _SHIFT[i % MODULUS, j % MODULUS]
        out = d.copy()
        live = np.arange(len(i))
        agreed = np.ones(len(i), bool)
        for t in range(int(d.max(initial=0))):
            live = live[d[live] > t]
            same = self.x[i[live] + t] == self.x[j[live] + t]
            out[live[~same]] = t
            agreed[live[~same]] = False
            live = live[same]
        live = np.flatnonzero(agreed)
        a, b = self.place[i[live] + d[live]], self.place[j[live] + d[live]]
        live, a, b = live[b >= 0], a[b >= 0], b[b >= 0]  # else the text ends there
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        for level in np.unique(k):
            m = k == level
            if level < len(self.table):
                t = self.table[level]
                out[live[m]] += np.minimum(t[lo[m]], t[hi[m] - (1 << level) + 1])
        return out


def _grid(begin: np.ndarray, size: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, begin of its text) of the harmonic grids, some at a time."""
    periods = np.where(size >= p.least_words, size // p.least_periods, 0)
    text = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(text)) - np.repeat(segment_starts(periods), periods) + 1
    inner = p.least_periods - 1
    places = (size[text] - inner * q) // q + 1
    for lo, hi in spans(places.tolist(), p.probes):
        n = places[lo:hi]
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        step, at = np.repeat(q[lo:hi], n), np.repeat(begin[text[lo:hi]], n)
        yield at + off * step, step, at


def runs_of(x: np.ndarray, begin: np.ndarray, size: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts laid out as for Lce: start (place in x), length, period; by start, then period."""
    found = []
    lce = None
    for i, q, first in _grid(begin, size, p):
        hit = np.flatnonzero(x[i] == x[i + q])
        hit = hit[x[i[hit] + 1] == x[i[hit] + q[hit] + 1]]
        if not len(hit):
            continue
        lce = lce or Lce(x, begin, size)
        i, q, first = i[hit], q[hit], first[hit]
        right = lce(i, i + q)
        # a run agrees with itself q words on for inner * q words, of which less than q lie before its first grid place
        inner = (p.least_periods - 1) * q
        m = right >= np.maximum(inner - q + 1, 1)
        i, q, first, right = i[m], q[m], first[m], right[m]
        most = np.minimum(q, i - first)
        before = np.flatnonzero(most == q)
        before = before[lce(i[before] - q[before], i[before]) >= q[before]]
        m = np.ones(len(i), bool)
        m[before] = False  # not the first grid place of its run
        i, q, right, most = i[m], q[m], right[m], np.minimum(most[m], q[m] - 1)
        low = np.zeros(len(i), np.int64)
        while (live := np.flatnonzero(low < most)).size:
            mid = (low[live] + most[live] + 1) // 2
            at = i[live] - mid
            ok = lce(at, at + q[live]) >= mid
            low[live] = np.where(ok, mid, low[live])
            most[live] = np.where(ok, most[live], mid - 1)
        length = right + low + q
        m = length >= np.maximum(p.least_words, p.least_periods * q)
        found.append(np.stack([i[m] - low[m], length[m], q[m]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    m = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, q = start[m], length[m], q[m]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def _strongest(start: np.ndarray, length: np.ndarray, q: np.ndarray) -> int:
    """Number of the run of greatest exact length / period, of equals that with the least start, then period."""
    top = 0
    for k in range(1, len(start)):
        a, b = int(length[k]) * int(q[top]), int(length[top]) * int(q[k])
        if a > b or (a == b and (start[k], q[k]) < (start[top], q[top])):
            top = k
    return top


Edit = Callable[[int | None, int], np.ndarray | None]


def collapse(texts: list[bytes], ids: list[int | None], p: Params = Params(), edit: Edit | None = None) -> Iterator[tuple[int, list[tuple[int, int, int]], int | None, bytes]]:
    """For each text: number of words, runs (start, length, period), number of the strongest, collapsed text."""
    numbers = _Numbers()
    words = [t.split() for t in texts]
    for k, w in enumerate(words):
        take = edit(ids[k], len(w)) if edit and w else None
        if take is not None:
            words[k] = [w[i] for i in take.tolist()]
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = segment_starts(size + MODULUS + 1) if len(size) else size
    x = np.zeros(int(size.sum()) + (MODULUS + 1) * len(size), np.int64)
    for k, w in enumerate(words):
        x[begin[k] : begin[k] + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    start, length, q = runs_of(x, begin, size, p)
    lo = np.searchsorted(start, begin)
    hi = np.searchsorted(start, begin + size)
    for k, w in enumerate(words):
        if lo[k] == hi[k]:
            yield len(w), [], None, b" ".join(w)
            continue
        mine = slice(lo[k], hi[k])
        s, n, r = start[mine] - begin[k], length[mine], q[mine]
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, s + r, 1)
        np.add.at(cover, s + n, -1)
        keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        yield len(w), list(zip(s.tolist(), n.tolist(), r.tolist())), _strongest(s, n, r), b" ".join([w[i] for i in keep.tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, p: Params = Params(), edit: Edit | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, runs (by start, then period), strongest (a run or null), collapsed.

    `edit(doc_id, number of words)` may name the words (by number) to be read in place of the text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            ids = b.column(0).to_pylist()
            for lo, hi in spans([len(t) for t in texts], p.batch_bytes):
                rows = list(collapse(texts[lo:hi], ids[lo:hi], p, edit))
                as_run = lambda r: dict(zip(("start", "length", "period"), r))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[as_run(x) for x in r[1]] for r in rows], pa.list_(_RUN)),
                    pa.array([None if r[2] is None else as_run(r[1][r[2]]) for r in rows], _RUN),
                    pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    one = "struct<start:long,length:long,period:long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{one}>, strongest {one}, collapsed string")


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The edit of the registered query: every tenth document (by its id's checksum) repeats a stretch from some word on."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % period, i)


def digests(found: DataFrame) -> DataFrame:
    """collapse_runs() -> a narrow row for each document: the strongest run, and digests of all runs and of the collapsed text."""
    line: Callable[[Column], Column] = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    s = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), s["start"].alias("start"), s["length"].alias("length"), s["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
