"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Unset in a local session (tests): a folder of its own.  Unset on a cluster: an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wattline-shared-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors.

    Some of these tables hold texts and stay until the job's folder goes, so they are packed well (zstd)."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_group(rows: DataFrame, key: str, salt: str, first: list[Column], then: list[Column]) -> DataFrame:
    """rows with aggregates of all rows of their key, whatever share of the rows a key holds.

    `first` aggregates the rows of a (key, salt), `then` the partial results of a key, at most one for each salt
    value; the answer goes back to the (key, salt) present, so no key's rows meet in one task.  Key and salt are
    not null.  rows is read twice: written before.  Aggregates are named unlike the columns of rows."""
    part = materialize(rows.groupBy(key, salt).agg(*first), "group")
    return give_back(rows, key, salt, part.groupBy(key).agg(*then), part.select(key, salt))


def give_back(rows: DataFrame, key: str, salt: str, known: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """rows with the columns of known (a row for each key), whatever share of the rows a key holds: known is first
    joined with the (key, salt) present, then rows by both.  Rows of unknown keys go.  Key and salt are not null."""
    names = [c for c in known.columns if c != key]
    where = (rows.select(key, salt).distinct() if present is None else present).select(F.col(key).alias("p_key"), F.col(salt).alias("p_salt"))
    back = where.join(known, F.col("p_key") == known[key]).select("p_key", "p_salt", *names)
    same = (F.col(key) == F.col("p_key")) & (F.col(salt) == F.col("p_salt"))
    return rows.join(back, same).select(*[F.col(f"`{c}`") for c in rows.columns], *names)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set by its path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (multiply and xor-shift), vectorised."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


class WordHashes(dict):
    """Cache of 64-bit word hashes; emptied when it holds `limit` words, so memory is bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() splits at exactly the six ASCII white spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def segment_starts(lengths: np.ndarray) -> np.ndarray:
    """Start offset of each segment of the given lengths."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def spans(total_rows: list[int], most: int):
    """Runs of consecutive rows whose sizes sum to at most `most` (single rows may exceed it)."""
    lo, acc = 0, 0
    for i, n in enumerate(total_rows):
        if acc and acc + n > most:
            yield lo, i
            lo, acc = i, 0
        acc += n
    if lo < len(total_rows):
        yield lo, len(total_rows)
