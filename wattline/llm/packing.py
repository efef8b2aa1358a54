"""Packing of tokenized documents into training sequences (operator 7): vector bin packing.

Every sequence has limits in several dimensions: tokens, segments (pieces) and
loss-bearing tokens.  A document is tokenized and cut: whole stretches that
fill a sequence by themselves go out at once, what is left waits in a bounded
pool.  A sequence is filled from the pool by the dot-product heuristic: of the
pieces that fit, the one whose demands have the largest dot product with what
is left of the limits comes next.  When none fits, one is cut to fill the rest
exactly.  A sequence that cannot be filled (end of a partition, segment limit)
is trimmed to a power of two, a length that needs no padding, and the rest
goes back to the pool; so at most a few short sequences arise per partition.

All happens in one pass over the partitions of the input, nothing is shuffled;
memory holds the pool (`pool` pieces shorter than a sequence).  sequence_id = partition number * 2^40 + number in the partition; a
retried task packs its partition the same way again.

Cases: null or empty text: the end id alone, one token.  Null doc_id: kept
null.  Repeated rows: each is packed.  Very long texts: many whole sequences.
Empty table: empty result.  Extra columns are ignored.  Loss flags that are
null or missing: every token bears loss.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, loss_tokens long")


@dataclass(frozen=True)
class Params:
    """Limits of a sequence.  tokenizer: installed tokenizer file, or a path; ranks: the same vocabulary as
    ranks (None: there are none); checked: texts of each partition held against the tokenizer; special: a special
    token that a text spells out gets its own id, as the tokenizer's file has it (else it is text like any other)."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    end_id: int = 1
    tokenizer: str = "byte_bpe_50k.json"
    ranks: str | None = "byte_bpe_50k.tiktoken"
    checked: int = 32
    special: bool = False
    pool: int = 512


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit).

    The ids are those of the tokenizer's file, special tokens as `special` has it.  Where its vocabulary is also
    given as ranks, the faster library that reads these does the work, and the
    first texts of each partition (those with special tokens before others) are
    held against the tokenizer itself."""

    def __init__(self, p: Params):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(self._path(p.tokenizer))
        self.tok.encode_special_tokens = not p.special
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()} if p.special else {}
        self.fast, self.to_check = None, p.checked
        if p.ranks:
            import public_tokenizers
            import tiktoken

            with open(self._path(p.ranks), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(p.ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.end = self._bytes([p.end_id])

    @staticmethod
    def _path(name: str) -> str:
        if "/" in name:
            return name
        import public_tokenizers

        return str(public_tokenizers.path(name))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the end id behind."""
        if self.fast is None:
            return [self._bytes(e.ids) + self.end for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        marked = [any(s in t for s in self.special) for t in texts]
        out = [self.fast.encode(t, allowed_special="all") if m else self.fast.encode_ordinary(t) for t, m in zip(texts, marked)]
        if self.to_check > 0:
            few = sorted(range(len(texts)), key=lambda i: (not marked[i], len(texts[i])))[: self.to_check]
            self.to_check = 0
            for i in few:
                if self.tok.encode(texts[i], add_special_tokens=False).ids != out[i]:
                    raise ValueError("the ranks give other ids than the tokenizer")
        return [self._bytes(ids) + self.end for ids in out]


class Packer:
    """Sequences of one partition; emitted pieces gather in `out`."""

    def __init__(self, p: Params, first_id: int):
        self.p, self.next_id = p, first_id
        self.limits = np.array([p.tokens, p.segments, p.loss_tokens], np.float64)
        self.pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens, loss flags or None)
        self.need = np.empty((0, 3))
        self.out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}

    @staticmethod
    def _loss(ids: bytes, flags: bytes | None) -> int:
        return len(ids) // 4 if flags is None else flags.count(1)

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total, flags in pieces:
            n = len(ids) // 4
            row = (doc_id, start, n, zlib.crc32(ids), total, self.next_id, at, self._loss(ids, flags))
            for col, v in zip(self.out.values(), row):
                col.append(v)
            at += n
        self.next_id += 1

    @staticmethod
    def _cut(item: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total, flags = item
        return ((doc_id, start, ids[: 4 * n], total, flags and flags[:n]), (doc_id, start + n, ids[4 * n :], total, flags and flags[n:]))

    def _fitting(self, item: tuple, tokens: int, loss: int) -> int:
        """Most leading tokens of a piece within both limits."""
        n = min(tokens, len(item[2]) // 4)
        if item[4] is None:
            return min(n, loss)
        flags = np.frombuffer(item[4], np.uint8)[:n]
        return int(np.searchsorted(np.cumsum(flags), loss, side="right"))

    def add(self, doc_id: int | None, ids: bytes, flags: bytes | None = None) -> None:
        item = (doc_id, 0, ids, len(ids) // 4, flags)
        while len(item[2]) // 4 >= self.p.tokens:
            n = self._fitting(item, self.p.tokens, self.p.loss_tokens)
            if n < self.p.tokens:
                break
            head, item = self._cut(item, n)
            self._emit([head])
        while len(item[2]) // 4 > self.p.tokens:  # loss-bearing tokens are denser than a sequence may hold
            head, item = self._cut(item, max(1, self._fitting(item, self.p.tokens, self.p.loss_tokens)))
            self._put(head)
        if item[2]:
            self._put(item)
        while len(self.pool) >= self.p.pool:
            self._fill()

    def _put(self, item: tuple) -> None:
        self.pool.append(item)
        if len(self.need) < len(self.pool):
            self.need = np.vstack([self.need, np.zeros((max(64, len(self.pool)), 3))])
        self.need[len(self.pool) - 1] = (len(item[2]) // 4, 1, self._loss(item[2], item[4]))

    def _take(self, i: int) -> tuple:
        item, last = self.pool[i], len(self.pool) - 1
        self.pool[i] = self.pool[last]
        self.need[i] = self.need[last]
        self.pool.pop()
        return item

    def _fill(self) -> None:
        """One sequence from the pool."""
        left, pieces = self.limits.copy(), []
        while self.pool and left[0] >= 1 and left[1] >= 1:
            need = self.need[: len(self.pool)]
            fit = (need <= left).all(1)
            score = np.where(fit, (need / self.limits) @ (left / self.limits), -1.0)
            i = int(score.argmax())
            if fit[i]:
                item = self._take(i)
            else:  # none fits whole: cut the longest
                i = int(need[:, 0].argmax())
                n = self._fitting(self.pool[i], int(left[0]), int(left[2]))
                if n < 1:
                    break
                item, rest = self._cut(self._take(i), n)
                self._put(rest)
            pieces.append(item)
            left -= (len(item[2]) // 4, 1, self._loss(item[2], item[4]))
        total = sum(len(x[2]) // 4 for x in pieces)
        if total < self.p.tokens:  # not to be filled: a power of two, the rest goes back
            excess = total - (1 << (total.bit_length() - 1))
            while excess:
                item = pieces.pop()
                n = len(item[2]) // 4
                if n > excess:
                    item, rest = self._cut(item, n - excess)
                    pieces.append(item)
                    item, n = rest, excess
                self._put(item)
                excess -= n
        self._emit(pieces)

    def finish(self) -> None:
        while self.pool:
            self._fill()


def _packed(p: Params, with_flags: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(p)
        packer = Packer(p, TaskContext.get().partitionId() << 40)
        schema = pa.schema([(k, pa.int64()) for k in packer.out])

        def rows() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pydict(packer.out, schema=schema)
            for col in packer.out.values():
                col.clear()
            return got

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flags = batch.column(2).to_pylist() if with_flags else None
            for lo in range(0, len(texts), 256):
                coded = enc.encode([t or "" for t in texts[lo : lo + 256]])
                for k, (doc_id, x) in enumerate(zip(ids[lo : lo + 256], coded)):
                    loss = flags[lo + k] if flags else None
                    bits = None if loss is None else bytes([bool(loss)]) * (len(x) // 4)
                    packer.add(doc_id, x, bits)
                if len(packer.out["doc_id"]) >= 4096:
                    yield rows()
        packer.finish()
        yield rows()

    return run


def pack(docs: DataFrame, p: Params = Params(), loss: str | None = None) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens.  loss: boolean column, whether the row's tokens bear loss."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if loss:
        cols.append(F.col(loss).cast("boolean").alias("loss"))
    return docs.select(*cols).mapInArrow(_packed(p, bool(loss)), PIECES)
