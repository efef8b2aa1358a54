"""Filter interaction audit over a sparse document-term matrix (operator 11).

Five filters judge every whole text, alone and in each of the 120 orders:

    A  under `few_words` words
    B  distinct words under `distinct_percent` percent of the words
    C  `[A-Z]` over `caps_percent` percent of the code points
    D  holds any of `# $ % & * |`
    E  identical to the text of a smaller doc_id, anywhere in the table

The matrix.  One pass over the texts cuts each partition into shards of about
`shard_bytes` bytes (at least one text).  A shard is a CSR block whose columns are
numbered by the shard's own vocabulary; it goes to a written table together with
that vocabulary, which is dealt to `buckets` by a checksum of the word and numbered
bucket by bucket.  Only the vocabularies - a word at most once a shard, not once a
document - are shuffled, a bucket's words of a shard as one text.  Each bucket is
read as a stream that numbers its words in order of first sight: the global
dictionary, whose buckets begin where the ones before end, so it has no gaps.  The
numbers go back to the shards, which are renumbered.  Row sums of the matrix are
the words of a text, the non-zeros of a row its distinct words: these decide A and
B.  C, D and the text's SHA-256 come from the same pass over the bytes.  No word is
hot: it counts once a shard, however often it stands there.  A task holds the words
of one bucket; more buckets hold less each.

The rest is narrow.  E compares a document with the least doc_id of its digest;
copies may hold any share of the table, so a digest's rows are first reduced by
(digest, salt) and the answer goes back to the salts present (`common.with_group`).
The documents are then counted by (part, failing filters, labels): at most 128 rows
a part, which are spread over the 600 places of the 120 orders.

Cases: null text: the empty text (A fails: no words; B and C do not).  Null lang:
the part of the empty string, with texts whose lang is that.  Null doc_id: neither
has a smaller id nor is one, and has no label.  Repeated doc_id: each row is a
document; equal rows have no smaller id.  Several labels of a doc_id: 1 if any is.
Very long texts: a shard of their own.  Empty table: no part, no row.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import materialize, segment_starts, spans, with_group

FILTERS = "ABCDE"
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Characters of filter D.
_MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))


@dataclass(frozen=True)
class Params:
    few_words: int = 200
    distinct_percent: int = 50
    caps_percent: int = 3
    shard_bytes: int = 8_000_000
    buckets: int | None = None  # of the dictionary; else four for each shuffle partition
    salts: int = 64


class _Numbers(dict):
    """Words in order of first sight -> 0, 1, ..."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def local_csr(texts: list[bytes], buckets: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as a CSR block: vocabulary by bucket (numbered through), row pointers, columns, counts."""
    numbers, split = _Numbers(), [t.split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(lengths.sum()))
    words = list(numbers)
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    by_bucket = [words[i] for i in order.tolist()]
    cells, counts = np.unique((np.repeat(np.arange(len(texts)), lengths) << 32) | place[codes], return_counts=True)
    indptr = np.searchsorted(cells, np.arange(len(texts) + 1) << 32)
    return [by_bucket[lo:hi] for lo, hi in zip(ends, ends[1:])], indptr, cells & 0xFFFFFFFF, counts


def packed(a: np.ndarray) -> bytes:
    """Numbers below 2^32 as four byte planes, the high ones nearly all zeros, which compress to nothing."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def byte_fails(texts: list[bytes], p: Params = Params()) -> np.ndarray:
    """Bits of the filters C and D for each text."""
    out = np.zeros(len(texts), np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    full = np.flatnonzero(lengths)
    if len(full):
        raw: np.ndarray = np.frombuffer(b"".join(texts), np.uint8)
        at = segment_starts(lengths[full])
        total = lambda hit: np.add.reduceat(hit, at, dtype=np.int64)
        caps, chars = total((raw >= 65) & (raw <= 90)), total((raw & 0xC0) != 0x80)
        out[full] = np.where(100 * caps > p.caps_percent * chars, _BIT["C"], 0) | np.where(total(_MARKS[raw]) > 0, _BIT["D"], 0)
    return out


_SHARD = "shard long, vocabulary array<string>, indptr binary, indices binary, counts binary, doc_id array<long>, part array<string>, fails array<int>, digest array<binary>"


def _list(values, kind: pa.DataType) -> pa.Array:
    """One list as an array of one row."""
    v = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)


def _cut(p: Params, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            for lo, hi in spans([len(t) for t in texts], p.shard_bytes):
                some = texts[lo:hi]
                vocabulary, indptr, indices, counts = local_csr(some, buckets)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int64()), _list(pa.array([b" ".join(w) for w in vocabulary], pa.binary()).cast(pa.string()), pa.string()),
                    *[pa.array([packed(x)], pa.binary()) for x in (indptr, indices, counts)],
                    _list(b.column(0).slice(lo, hi - lo).to_pylist(), pa.int64()), _list(b.column(1).slice(lo, hi - lo).to_pylist(), pa.string()),
                    _list(byte_fails(some, p).astype(np.int32), pa.int32()), _list([hashlib.sha256(t).digest() for t in some], pa.binary())],
                    names=[c.split()[0] for c in _SHARD.split(", ")])
                shard += 1

    return run


def shards(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs (doc_id, lang, text) -> written CSR shards with their own vocabularies."""
    buckets = p.buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_cut(p, buckets), _SHARD), "audit-shards")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, shard, words), bucket by bucket -> with the words' numbers in their bucket, and those seen first here."""
    numbers, now = _Numbers(), None
    for b in batches:
        out: list[tuple] = []
        for bucket, shard, text in zip(*[b.column(c).to_pylist() for c in ("bucket", "shard", "words")]):
            if bucket != now:
                numbers, now = _Numbers(), bucket
            words, known = text.split(" "), len(numbers)
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            out.append((bucket, shard, packed(ids), known, len(numbers), " ".join([w for w, i in zip(words, ids.tolist()) if i >= known])))
        names = ("bucket", "shard", "ids", "known", "top", "new")
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def dictionary(cut: DataFrame, keep: bool = False) -> DataFrame:
    """shards() -> written rows bucket, shard, ids (in the bucket), start (the bucket's first number in the
    dictionary), and with `keep` the words seen first in this row (`new`, from number start + `known` on)."""
    own = cut.select("shard", F.posexplode("vocabulary").alias("bucket", "words")).filter("words != ''")
    rows = own.repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket").select("bucket", "shard", "words")
    found = rows.mapInArrow(_numbered, "bucket int, shard long, ids binary, known long, top long, new string")
    found = materialize(found if keep else found.drop("new", "known"), "audit-dictionary")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    starts = found.groupBy("bucket").agg(F.max("top").alias("size")).select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return found.join(starts, "bucket")


def renumbered(cut: DataFrame, found: DataFrame) -> DataFrame:
    """shards() with `slices`: by bucket, the dictionary's numbers of the shard's vocabulary (bounded by the shard)."""
    slices = found.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "start", "ids"))).alias("slices"))
    return cut.drop("vocabulary").join(slices, "shard", "left")


def _matrix(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row i of renumbered() as CSR: row pointers, dictionary numbers, counts."""
    indptr, local, counts = (unpacked(b.column(c)[i].as_py()) for c in ("indptr", "indices", "counts"))
    slices = b.column("slices")[i].as_py() or []
    ids = np.concatenate([unpacked(s["ids"]) + s["start"] for s in slices]) if slices else np.zeros(0, np.int64)
    return indptr, ids[local], counts


def term_matrix(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix in CSR shards (shard, doc_id, indptr, indices, counts) and its dictionary (word, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                indptr, indices, counts = _matrix(b, i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("shard").slice(i, 1), b.column("doc_id").slice(i, 1), _list(indptr.astype(np.int32), pa.int32()), _list(indices, pa.int64()), _list(counts.astype(np.int32), pa.int32())],
                    names=["shard", "doc_id", "indptr", "indices", "counts"])

    cut = shards(docs, p)
    found = dictionary(cut, keep=True)
    new = found.filter("new != ''").select((F.col("start") + F.col("known")).alias("first"), F.posexplode(F.split("new", " ")).alias("at", "word"))
    matrix = renumbered(cut, found).mapInArrow(run, "shard long, doc_id array<long>, indptr array<int>, indices array<long>, counts array<int>")
    return matrix, new.select("word", (F.col("first") + F.col("at")).alias("id"))


def _judged(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                indptr, indices, counts = _matrix(b, i)
                upto = np.r_[0, np.cumsum(counts)]
                words, distinct = upto[indptr[1:]] - upto[indptr[:-1]], np.diff(indptr)
                fails = b.column("fails")[i].values.to_numpy() | np.where(words < p.few_words, _BIT["A"], 0) | np.where(100 * distinct < p.distinct_percent * words, _BIT["B"], 0)
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[i].values, b.column("part")[i].values, pa.array(fails.astype(np.int32)), b.column("digest")[i].values, pa.array(np.arange(n) % p.salts, pa.int32())],
                    names=["doc_id", "part", "fails", "digest", "salt"])

    return run


def failing(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """For each document: doc_id, part, fails (bits of the filters A to E that it fails), salt."""
    cut = shards(docs, p)
    rows = renumbered(cut, dictionary(cut)).select("doc_id", "part", "fails", "digest", "indptr", "indices", "counts", "slices")
    flags = materialize(rows.mapInArrow(_judged(p), "doc_id long, part string, fails int, digest binary, salt int"), "audit-flags")
    known = with_group(flags, "digest", "salt", [F.min("doc_id").alias("least")], [F.min("least").alias("least")])
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return known.select("doc_id", "part", F.when(copy, F.col("fails").bitwiseOR(F.lit(_BIT["E"]))).otherwise(F.col("fails")).alias("fails"), "salt")


def _places():
    """The 600 places of the 120 orders: filter_order, step, before (bits of the filters before), bit."""
    out = []
    for order in itertools.permutations(FILTERS):
        for i, f in enumerate(order):
            out.append({"filter_order": "".join(order), "step": i + 1, "before": sum(_BIT[x] for x in order[:i]), "bit": _BIT[f]})
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")


def interactions(counts: DataFrame) -> DataFrame:
    """counts (part, fails, good, toxic, n): documents by failing filters -> a row for each part and place of an order."""
    x = counts.select("part", "fails", "good", "toxic", "n", F.explode(_places()).alias("o")).select("part", "fails", "good", "toxic", "n", "o.*")
    has = lambda bits: F.col("fails").bitwiseAND(bits) != 0
    mine, earlier = has(F.col("bit")), has(F.col("before"))
    removed = mine & ~earlier
    total = lambda cond, n=F.col("n"): F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    # of the orders of its failing filters, each comes first in an equal share of the 120
    first_in = F.col("n") * F.expr("120 div bit_count(fails)")
    return x.groupBy("part", "filter_order", "step").agg(
        total(~mine & ~earlier).alias("kept"), total(removed).alias("removed"), total(mine & earlier).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"), total(removed & (F.col("good") == 1)).alias("good_lost"),
        total(removed & (F.col("toxic") == 1)).alias("toxic_lost"), total(mine, first_in).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """docs (doc_id, lang, text) and labels (doc_id, quality, toxic) -> for each part, order of the filters and
    step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(one("quality"), one("toxic")).filter("l_id is not null")
    # rows that repeat an id are one row here; rows without id are spread by their salt, as they meet no label
    spread = F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(F.lit(-1)).alias("spread")
    rows = failing(docs, p).groupBy("doc_id", spread, "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    marks = marks.withColumn("l_spread", F.lit(-1))
    both = rows.join(marks, (F.col("doc_id") == F.col("l_id")) & (F.col("spread") == F.col("l_spread")), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = both.select("part", "fails", flag("quality"), flag("toxic"), "n").groupBy("part", "fails", F.col("quality").alias("good"), "toxic").agg(F.sum("n").alias("n"))
    return interactions(counts)
