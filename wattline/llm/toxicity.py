"""Toxicity by multiple-instance learning (operator 1).

A document is a bag of sentences (runs without . ! ? or line end).  A sentence
scores by a logistic model of its words (each word: itself and its leading
bytes, hashed); a document's score is the noisy-or of its sentences,
1 - prod(1 - p).  Only document labels are learned from: the gradient reaches
the sentences through the noisy-or, so blame settles on the sentences that
explain the label, and the trained model then locates them.  A sentence without
learned words scores `leak` (in logits), next to nothing, so that length alone
makes no document toxic.  Only features that
occur in more toxic documents than chance explains (G test of at least
`evidence`) are learned, so that rare words are not learned by heart.

Training: adaptive gradient steps in numpy on a bounded sample of labelled
documents, chosen by hash: at most about `positives` toxic and `negatives`
other ones of at most `most_words` words.  Sample weights keep the natural share of
toxic documents.  Every whole text is scored, in Arrow batches, without a shuffle.

Cases: null, empty or wordless text: no sentences, score 0.  Labels that are
null or not 0/1, and labels of unknown documents, are not learned; a document with
several labels is toxic if one says so.  No label to
learn from, or one class only: the share of toxic labels is the score of every
text with words.  Repeated rows are scored alike.  Very long texts: whole.
Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import segment_starts, spans

_ENDS = b".!?\r\n"
#: Bytes to bytes: sentence ends to line feeds, other ASCII but letters and digits to spaces.
_TABLE = bytes(10 if b in _ENDS else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
_SENTENCE = re.compile(r"[^.!?\r\n]+")


@dataclass(frozen=True)
class Params:
    positives: int = 3000
    negatives: int = 5000
    most_words: int = 4000
    evidence: float = 15.0
    bits: int = 18
    prefixes: tuple[int, ...] = (5, 6, 7)
    epochs: int = 12
    rate: float = 1.0
    leak: float = -12.0
    batch: int = 32
    l2: float = 2e-4
    seed: int = 3
    threshold: float = 0.7


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int
    prefixes: tuple[int, ...]
    constant: float | None = None


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has any."""
    if not text:
        return []
    return [w for s in text.lower().encode("utf-8", "replace").translate(_TABLE).split(b"\n") if (w := s.split())]


def features(word: bytes, bits: int, prefixes: tuple[int, ...]) -> list[int]:
    """Buckets of a word: itself, and its leading bytes where it is longer."""
    mask = (1 << bits) - 1
    return [xxhash.xxh3_64_intdigest(word, 1) & mask] + [xxhash.xxh3_64_intdigest(word[:k], 2) & mask for k in prefixes if len(word) > k]


class WordWeights(dict):
    """Cache of the summed weight of each word; emptied at `limit` words."""

    def __init__(self, model: Model, limit: int = 800_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        m = self.model
        w = self[word] = float(sum(m.weights[f] for f in features(word, m.bits, m.prefixes)))
        return w


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0, z)


def evident(docs: list[tuple[int, float, np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """G statistic of each bucket's document counts against the labels; 0 where it occurs in fewer toxic ones than expected."""
    seen = np.zeros((2, size))
    for y, _, ids, _ in docs:
        seen[y, np.unique(ids)] += 1
    n = np.array([sum(d[0] == y for d in docs) for y in (0, 1)], np.float64)
    both, share = seen.sum(0), n / n.sum()
    g = np.zeros(size)
    for y in (0, 1):
        for have, all_ in ((seen[y], both), (n[y] - seen[y], n.sum() - both)):
            expected = all_ * share[y]
            g += 2 * np.where(have > 0, have * np.log(np.maximum(have, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return np.where(seen[1] > both * share[1], g, 0.0)


def fit(docs: list[tuple[int, float, np.ndarray, np.ndarray]], p: Params = Params(), share: float | None = None) -> Model:
    """docs: (label, weight, buckets, sentence number of each bucket)."""
    labels = np.array([d[0] for d in docs])
    if not len(docs) or labels.min() == labels.max():
        constant = float(labels.mean()) if len(docs) else 0.0
        return Model(np.zeros(1 << p.bits, np.float32), 0.0, p.bits, p.prefixes, constant if share is None else share)
    rng = np.random.default_rng(p.seed)
    kept = evident(docs, 1 << p.bits) >= p.evidence
    bags = []
    for y, weight, ids, sent in docs:
        ok = kept[ids]
        n = int(sent[-1]) + 1 if len(sent) else 0
        bags.append((y, weight, ids[ok], sent[ok], n))
    w = np.zeros(1 << p.bits)
    squares = np.full(1 << p.bits, 1e-3)
    for _ in range(p.epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), p.batch):
            pick = [bags[i] for i in order[lo : lo + p.batch]]
            counts = np.array([b[4] for b in pick])
            first = segment_starts(counts)
            total = int(counts.sum())
            if not total:
                continue
            ids = np.concatenate([b[2] for b in pick])
            at = np.concatenate([b[3] + f for b, f in zip(pick, first)])
            z = p.leak + np.bincount(at, w[ids], total)
            prob = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            doc_of = np.repeat(np.arange(len(pick)), counts)
            clean = np.exp(np.bincount(doc_of, _log_clean(z), len(pick)))
            toxic = np.maximum(1 - clean, 1e-9)
            y, weight = np.array([b[0] for b in pick]), np.array([b[1] for b in pick])
            push = weight * np.where(y == 1, -clean / toxic, 1.0)
            gz = prob * push[doc_of]
            touched, inverse = np.unique(ids, return_inverse=True)
            g = np.bincount(inverse, gz[at], len(touched)) + p.l2 * w[touched]
            squares[touched] += g * g
            w[touched] -= p.rate * g / np.sqrt(squares[touched])
    return Model(w.astype(np.float32), p.leak, p.bits, p.prefixes)


def score(model: Model, texts: list[str | None], cache: WordWeights) -> np.ndarray:
    """Noisy-or score of each whole text."""
    out = np.zeros(len(texts))
    for lo, hi in spans([len(t or "") for t in texts], 2_000_000):
        bags = [sentences(t) for t in texts[lo:hi]]
        if model.constant is not None:
            out[lo:hi] = [model.constant if b else 0.0 for b in bags]
            continue
        sizes = np.array([len(s) for b in bags for s in b], np.int64)
        if not len(sizes):
            continue
        flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(chain.from_iterable(bags))), np.float64, int(sizes.sum()))
        logc = _log_clean(model.bias + np.add.reduceat(flat, segment_starts(sizes)))
        doc_of = np.repeat(np.arange(hi - lo), [len(b) for b in bags])
        out[lo:hi] = -np.expm1(np.bincount(doc_of, logc, hi - lo))
    return np.clip(out, 0.0, 1.0)


def offending(model: Model, text: str, cache: WordWeights, least: float = 0.5) -> list[tuple[int, int, float]]:
    """Sentences (first and last+1 code point, score) that score at least `least`."""
    found = []
    for m in _SENTENCE.finditer(text):
        words = [w for s in sentences(m.group()) for w in s]
        if words:
            z = model.bias + sum(cache[w] for w in words)
            s = 1 / (1 + np.exp(-max(-40.0, min(40.0, z))))
            if s >= least:
                found.append((m.start(), m.end(), float(s)))
    return found


def _bags(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, y in zip(pdf["text"], pdf["toxic"]):
                bag = sentences(text)
                if 0 < sum(map(len, bag)) <= p.most_words:
                    ids, at = [], []
                    for k, s in enumerate(bag):
                        for word in set(s):
                            f = features(word, p.bits, p.prefixes)
                            ids += f
                            at += [k] * len(f)
                    rows.append((int(y), np.array(ids, np.int32).tobytes(), np.array(at, np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["y", "ids", "at"])

    return run


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic): a bounded sample comes to the driver."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {1: p.positives, 0: p.negatives}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, want[1] / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, want[0] / max(1, n.get(0, 0)))))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * (p.positives + p.negatives))
    # the sample's size is bounded by the limit, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    got = rows.select("text", "toxic").mapInPandas(_bags(p), "y int, ids binary, at binary").toPandas().sort_values(["y", "ids", "at"], kind="stable")
    have = got["y"].value_counts().to_dict()
    natural = {y: n.get(y, 0) / max(1, have.get(y, 0)) for y in (0, 1)}
    scale = len(got) / max(1e-9, sum(natural[y] * have.get(y, 0) for y in (0, 1)))
    bags = [(int(y), natural[int(y)] * scale, np.frombuffer(i, np.int32), np.frombuffer(a, np.int32)) for y, i, a in zip(got["y"], got["ids"], got["at"])]
    return fit(bags, p, share=n.get(1, 0) / max(1, sum(n.values())))


def _scored(model: Model, p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordWeights(model)
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            s = score(model, texts, cache)
            where = [offending(model, t, cache) if v >= p.threshold and t and model.constant is None else [] for t, v in zip(texts, s)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= p.threshold).astype(np.int32),
                                "offending": [[{"start": a, "end": b, "score": c} for a, b, c in x] for x in where]})

    return run


def detect(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, score, predicted, offending (spans of sentences, for predicted ones)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_scored(model, p), "doc_id long, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")
