"""Document fingerprints by locally consistent parsing (operator 10).

A text's UTF-8 bytes are parsed into phrases, the phrases into phrases of
phrases, and so on.  At each level deterministic coin tossing gives every symbol
a small label from the lowest bit in which it differs from its left neighbour
(repeated until the labels are below 6), and a phrase begins at each local
maximum of the labels; long runs of one symbol are cut every four symbols.  A
phrase's name is a hash of its symbols' names.  Where a phrase ends depends on a
few symbols around it only, so equal substrings get the same names inside,
whatever stands before them.

The fingerprint holds, for each of the levels in `levels` (a phrase of level n
has about 2.5^n bytes), `registers` 16-bit minima of hashes of the names, repeats
counted.  The likeness of two fingerprints is the mean share of equal registers,
weighted by level (`weights`): about the share of common phrases.

The next document (for edited texts) is found without ordering everything in
one task: documents fall into blocks by quantiles of doc_id, the first document
of each block (a row for each block) is added behind the block before it, and
each block is read in order as a stream.

Cases: null text: as the empty text, whose fingerprint is all zeros; it is like
the empty text alone.  Null doc_id: after all others, by the MD5 of their texts, in
up to 256 blocks of their own.  Rows with equal doc_id: ordered by text; each has a
successor.  One document: its own successor.
Very long texts: whole.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import materialize, mix64, segment_starts, spans

_U = np.uint64
#: Lowest set bit of a byte; equal neighbours (0) count as differing in the highest.
_CTZ8 = np.array([7] + [(b & -b).bit_length() - 1 for b in range(1, 256)], np.uint8)
_BYTE_NAMES = mix64(np.arange(1, 257, dtype=_U))
_BASE = 0x9E3779B97F4A7C15
#: Runs of at least so many equal symbols are phrases by themselves, so many symbols each.
_RUN = 4


@dataclass(frozen=True)
class Params:
    levels: tuple[int, ...] = (1, 3, 4, 5)
    weights: tuple[float, ...] = (0.5, 3.0, 2.0, 1.0)
    registers: int = 16
    seed: int = 17


def _toss8(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing on small labels; `first` are the first symbols of texts."""
    d = np.empty_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=d[1:])
    d[first] = x[first] ^ np.uint8(0xFF)
    k = _CTZ8[d]
    x = (x >> k) & np.uint8(1)
    return (k << np.uint8(1)) | x


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels that differ between unequal neighbours: below 6, but beside runs and at text starts."""
    if x.dtype != np.uint8:
        d = np.empty_like(x)
        np.bitwise_xor(x[1:], x[:-1], out=d[1:])
        d[first] = ~x[first]
        low = d & (~d + _U(1))
        k = np.minimum(np.bitwise_count(low - _U(1)), 63).astype(np.uint8)
        x = (k << np.uint8(1)) | ((x >> k.astype(_U)).astype(np.uint8) & np.uint8(1))
    for _ in range(3):
        x = _toss8(x, first)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1 modulo 2^64, and their inverses; tables grow as needed."""
    have = _TABLES[0]
    if len(have) < n:
        size = max(n, 2 * len(have))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            t = np.full(size, base, _U)
            t[0] = 1
            _TABLES[k] = np.multiply.accumulate(t)
    return _TABLES[0][:n], _TABLES[1][:n]


_TABLES = [np.ones(1, _U), np.ones(1, _U)]


def parse_level(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols of non-empty texts one behind the other (bytes, or names) -> names of their
    phrases, and the texts' new lengths."""
    first = segment_starts(lengths)
    l = _labels(x, first)
    start = np.zeros(len(x), bool)
    if len(x) > 2:
        start[1:-1] = (l[1:-1] > l[:-2]) & (l[1:-1] > l[2:])
    # neither a text's second symbol nor its last begins a phrase
    start[np.r_[first[1:], len(x)] - 1] = False
    start[np.minimum(first + 1, len(x) - 1)] = False
    start[first] = True
    same = x[1:] == x[:-1]
    same[first[1:] - 1] = False
    if len(same) >= 3 and (same[2:] & same[1:-1] & same[:-2]).any():  # long runs are cut from their beginning
        head = np.flatnonzero(np.r_[True, ~same])
        run = np.diff(np.r_[head, len(x)])
        head, run = head[run >= _RUN], run[run >= _RUN]
        inside = np.repeat(head, run) + (off := np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run))
        start[inside] = off % _RUN == 0
        after = head + run
        start[after[after < len(x)]] = True
    s = np.flatnonzero(start)
    up, down = _powers(len(x))
    total = np.empty(len(x) + 1, _U)
    total[0] = 0
    np.cumsum((_BYTE_NAMES[x] if x.dtype == np.uint8 else x) * up, out=total[1:])
    end = np.r_[s[1:], len(x)]
    names = mix64((total[end] - total[s]) * down[s] + (end - s).astype(_U))
    return names, np.add.reduceat(start.astype(np.int64), first)


def _numbered(names: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names with their occurrence number in the text: repeats count as so many elements."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    key = names + text.astype(_U) * _U(_BASE)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(new)
    out = np.empty_like(names)
    nth = np.arange(len(k)) - np.repeat(at, np.diff(np.r_[at, len(k)]))
    out[order] = nth
    again = out > 0
    return np.where(again, mix64(names + out), names)


def fingerprints(texts: list[str], p: Params = Params()) -> np.ndarray:
    """A row of len(levels) * registers 16-bit values for each text; zeros for the empty text."""
    rng = np.random.default_rng(p.seed)
    odd = rng.integers(0, 2**63, p.registers, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    out = np.zeros((len(texts), len(p.levels) * p.registers), np.uint16)
    raw = [t.encode("utf-8", "replace") for t in texts]
    full = [i for i, b in enumerate(raw) if b]
    for lo, hi in spans([len(raw[i]) for i in full], 400_000):
        ids = full[lo:hi]
        x: np.ndarray = np.frombuffer(b"".join(raw[i] for i in ids), np.uint8)
        lengths = np.array([len(raw[i]) for i in ids], np.int64)
        for level in range(1, max(p.levels) + 1):
            x, lengths = parse_level(x, lengths)
            if level in p.levels:
                k = p.levels.index(level) * p.registers
                e = _numbered(x, lengths) if level > 1 else x
                starts = segment_starts(lengths)
                for r in range(p.registers):
                    least = np.minimum.reduceat((e ^ odd[r]) * odd[r], starts)
                    out[ids, k + r] = (mix64(least) >> _U(48)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray, p: Params = Params()) -> np.ndarray:
    """Likeness (0 to 1) of fingerprint rows."""
    same = (a == b).reshape(len(a), len(p.levels), p.registers).mean(2)
    w = np.array(p.weights) / sum(p.weights)
    return np.where((a == b).all(1), 1.0, np.minimum(same @ w, 1.0))


def as_text(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


# ---------------------------------------------------------------- documents with their successors


def in_order(docs: DataFrame, blocks: int) -> DataFrame:
    """docs (doc_id, text) -> (block, extra, doc_id, text), sorted within partitions; each block of
    consecutive documents stands in one partition and ends with an extra row, the next block's first document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    probs = [i / blocks for i in range(1, blocks)]
    cuts = docs.agg(F.percentile_approx("doc_id", probs, 10 * blocks)).first()[0] if probs else None
    splits = [float("-inf"), *(sorted({float(c) for c in cuts or []}) or [0.0]), float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="id_double", outputCol="block", handleInvalid="keep")
    mark = F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary"))).otherwise(F.lit(""))  # places rows without an id
    spread = F.lit(len(splits)) + F.conv(F.substring("mark", 1, 2), 16, 10).cast("int")
    rows = bucket.transform(docs.withColumn("id_double", F.col("doc_id").cast("double")).withColumn("mark", mark))
    rows = rows.select(F.when(F.col("doc_id").isNull(), spread).otherwise(F.col("block").cast("int")).alias("block"), F.lit(0).alias("extra"), "doc_id", "mark", "text")
    firsts = rows.groupBy("block").agg(F.min("doc_id").alias("first_id"))
    order = Window.orderBy("block")  # a row for each block
    before = F.coalesce(F.lag("block").over(order), F.last("block").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = materialize(firsts.select("block", "first_id", before.alias("before")), "lcp-blocks")
    f = firsts.select(F.col("block").alias("b"), "first_id", "before")
    heads = rows.join(f, (F.col("block") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("before", "first_id").agg(F.min(F.struct("mark", "text")).alias("x"))
    heads = heads.select(F.col("before").alias("block"), F.lit(1).alias("extra"), F.col("first_id").alias("doc_id"), "x.mark", "x.text")
    return rows.union(heads).repartition("block").sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_last(), "mark", "text").drop("mark")


def _fingerprinted(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait = None  # the last row seen, with its fingerprint
        for pdf in batches:
            block, extra, ids, texts = (list(pdf[c]) for c in ("block", "extra", "doc_id", "text"))
            for lo, hi in spans([len(t) for t in texts], 400_000):
                prints = fingerprints(texts[lo:hi], p)
                rows = list(zip(block[lo:hi], extra[lo:hi], ids[lo:hi], texts[lo:hi], prints))
                if wait is not None:
                    rows.insert(0, wait)
                done, edited = [], []
                for a, b in zip(rows, rows[1:]):
                    if not a[1]:  # the row behind it is of the same block
                        k = len(a[3]) // 4
                        edited.append(a[3][: len(a[3]) - k] + b[3][:k])
                        done.append((a, b))
                wait = rows[-1]
                if not done:
                    continue
                own, nxt, new = np.array([a[4] for a, _ in done]), np.array([b[4] for _, b in done]), fingerprints(edited, p)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(a[2]) else int(a[2]) for a, _ in done], "Int64"), "n_chars": [len(a[3]) for a, _ in done],
                    "edited_sha256": [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
                    "fingerprint": as_text(own), "edited_fingerprint": as_text(new),
                    "near_edited": likeness(own, new, p), "near_next": likeness(own, nxt, p)})

    return run


def fingerprint_with_edits(docs: DataFrame, p: Params = Params(), blocks: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, that of its edited text (the last quarter
    replaced by as much of the next document's beginning), and the likenesses."""
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, blocks).mapInPandas(_fingerprinted(p), schema)


def fingerprint(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": as_text(fingerprints([t or "" for t in pdf["text"]], p))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fingerprint string")
