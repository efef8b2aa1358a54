"""Language identification by averaged hashed subword embeddings (operator 9).

A text is lower-cased and read as UTF-8; bytes that are neither ASCII letters
nor part of a non-ASCII character are word borders.  Its features are the
byte 1- to 4-grams inside words (borders included as marks), hashed to
`buckets`; its vector is the mean of their embeddings, and a linear softmax
gives the languages.  Embeddings and softmax are trained together by mini-batch
stochastic gradient descent in numpy, on a bounded sample: at most about
`per_lang` documents of each language, `windows` stretches of `window` bytes of
each, chosen by hash.  A tenth of the sample calibrates: a temperature by
likelihood, then the rejection threshold, the `keep` quantile of the scores of
rightly labelled stretches (never above `most_reject`).

Every whole text is scored, in Arrow batches; nothing is shuffled.

Cases: null text, empty text or text without a letter: lang 'und', score 0,
rejected.  No labelled row to learn from: all 'und'.  Null languages are not
learned.  Repeated rows are scored alike.  Very long texts: whole.  Empty table:
empty result.  Extra columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import fresh, segment_starts, spans

_U32 = np.uint32
UND = "und"
#: Byte to byte: ASCII letters and bytes of non-ASCII characters stay, all else is a border (space).
_KEEP = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


@dataclass(frozen=True)
class Params:
    """Bounds of the training sample, and the model's size."""

    per_lang: int = 1500
    windows: int = 4
    window: int = 300
    bits: int = 16
    dim: int = 12
    epochs: int = 6
    rate: float = 1.0
    batch: int = 32
    seed: int = 5
    keep: float = 0.001
    most_reject: float = 0.5


@dataclass
class Model:
    """langs in order; table: one row of logits per bucket (embedding times softmax weights)."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int


def ngrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 1- to 4-grams as 4 rows; texts lie one behind the other.  Bucket 2^bits: no feature.
    Also each text's first position and length."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b"    " for t in texts]
    raw = _KEEP[np.frombuffer(b"".join(parts), np.uint8)]
    lengths = np.array([len(p) for p in parts], np.int64)
    n = len(raw)
    none = _U32(1 << bits)
    out = np.full((4, n), none, _U32)
    space = raw == 0x20
    value = raw.astype(_U32)
    inner = ~space  # bytes between the first and the last of the n-gram are not borders
    out[0] = np.where(space, none, (value * _U32(_MULTIPLIERS[0])) >> _U32(32 - bits))
    for k in (1, 2, 3):
        m = n - k
        value = value[:m] | (raw[k:].astype(_U32) << _U32(8 * k))
        if k == 1:
            ok = inner[:m] | inner[1:]
        elif k == 2:
            ok = inner[1 : m + 1]
        else:
            ok = inner[1 : m + 1] & inner[2 : m + 2]
        out[k, :m] = np.where(ok, (value * _U32(_MULTIPLIERS[k])) >> _U32(32 - bits), none)
    return out, segment_starts(lengths), lengths


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], p: Params = Params()) -> Model:
    """Train on stretches of text with their languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 1.0, p.bits)
    rng = np.random.default_rng(p.seed)
    y = np.searchsorted(names, langs)
    grams, starts, lengths = ngrams(texts, p.bits)
    rows = []
    for s, n in zip(starts, lengths):
        ids = grams[:, s : s + n].ravel()
        rows.append(ids[ids < (1 << p.bits)].astype(np.int64))
    ok = np.array([len(r) > 0 for r in rows])
    order = rng.permutation(np.flatnonzero(ok))
    held, train = order[: len(order) // 10], order[len(order) // 10 :]
    emb = rng.normal(0, 0.1, (1 << p.bits, p.dim)).astype(np.float32)
    w = np.zeros((p.dim, len(names)), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, done = p.epochs * max(1, -(-len(train) // p.batch)), 0
    for _ in range(p.epochs):
        for lo in range(0, len(train), p.batch):
            pick = train[lo : lo + p.batch] if lo else rng.permutation(train)[: p.batch]
            flat = np.concatenate([rows[i] for i in pick])
            sizes = np.array([len(rows[i]) for i in pick])
            h = np.add.reduceat(emb[flat], segment_starts(sizes), axis=0) / sizes[:, None]
            g = _softmax(h @ w + bias)
            g[np.arange(len(pick)), y[pick]] -= 1
            rate = p.rate * (1 - done / steps)
            back = (g @ w.T).astype(np.float32)
            w -= rate * (h.T @ g).astype(np.float32) / len(pick) * 10
            bias -= rate * g.mean(0).astype(np.float32)
            # embeddings: each feature moves by its share in the mean
            step = np.repeat(back * (rate * 10 / sizes[:, None]), sizes, axis=0)
            np.add.at(emb, flat, -step.astype(np.float32))
            done += 1
        train = rng.permutation(train)
    table = np.vstack([emb @ w, np.zeros((1, len(names)), np.float32)]).astype(np.float32)
    model = Model(names, table, bias, 1.0, 0.0, p.bits)
    check = held if len(held) >= 20 else order
    logits = _logits(model, [texts[i] for i in check])[0]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))]) if len(check) else 1.0
    prob = _softmax(logits / model.temperature)
    right = prob.max(1)[prob.argmax(1) == y[check]]
    model.threshold = float(min(p.most_reject, np.quantile(right, p.keep))) if len(right) else p.most_reject
    return model


def _logits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    grams, starts, _ = ngrams(texts, model.bits)
    total = np.zeros((len(texts), len(model.langs)), np.float64)
    count = np.zeros(len(texts), np.int64)
    for row in grams:
        count += np.add.reduceat((row < (1 << model.bits)).astype(np.int64), starts)
        for j in range(total.shape[1]):  # one contiguous column at a time
            total[:, j] += np.add.reduceat(np.take(model.table[:, j], row), starts)
    return total / np.maximum(count, 1)[:, None] + model.bias, count


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated score of each whole text."""
    langs, score = [UND] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return langs, score
    has = [i for i, t in enumerate(texts) if isinstance(t, str) and regex.search(r"\p{L}", t)]
    for lo, hi in spans([len(texts[i]) for i in has], 300_000):
        ids = has[lo:hi]
        prob = _softmax(_logits(model, [texts[i] for i in ids])[0] / model.temperature)
        for i, row in zip(ids, prob):
            k = int(row.argmax())
            langs[i], score[i] = model.langs[k], float(min(1.0, row[k]))
    return langs, score


def _stretches(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, lang, h in zip(pdf["text"], pdf["lang"], pdf["h"]):
                rng = np.random.default_rng(abs(int(h)))
                for lo in {int(x) for x in rng.integers(0, max(1, len(text) - p.window + 1), p.windows)}:
                    out.append((text[lo : lo + int(rng.integers(20, p.window + 1))], lang))
            yield pd.DataFrame(out, columns=["text", "lang"])

    return run


def train(labelled: DataFrame, p: Params = Params()) -> Model:
    """Fit on labelled rows (doc_id, text, lang): a bounded sample is brought to the driver.

    Counts by language come first; each language keeps the share of its
    documents, chosen by hash, that gives about per_lang of them."""
    rows = labelled.filter("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(p.seed)).alias("h"))
    # a row for each language that the model will hold
    counts = labelled.filter("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return fit([], [], p)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, p.per_lang / r["n"]))])
    picked = rows.filter(F.pmod("h", F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20)).select("text", "lang", "h")
    got = picked.mapInPandas(_stretches(p), "text string, lang string").toPandas().sort_values(["lang", "text"], kind="stable")
    return fit(list(got["text"]), list(got["lang"]), p)


def _scored(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            langs, score = predict(model, list(s))
            yield pd.DataFrame({"lang": langs, "score": score})

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a struct column `langid` (lang, score, rejected); its name avoids those that docs has."""
    scored = F.pandas_udf(_scored_typed(model), "lang string, score double")
    name, raw = fresh(docs, "langid"), fresh(docs, "langid_raw")
    out = docs.withColumn(raw, scored(F.col(text).cast("string")))
    rejected = (F.col(raw)["lang"] == UND) | (F.col(raw)["score"] < F.lit(model.threshold))
    return out.withColumn(name, F.struct(F.col(raw)["lang"].alias("lang"), F.col(raw)["score"].alias("score"), rejected.alias("rejected"))).drop(raw)


def _scored_typed(model: Model):
    run = _scored(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(batches)

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return scored


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of docs whose language is not rejected; all columns stay."""
    scored = identify(docs, model, text)
    name = scored.columns[-1]
    return scored.filter(~F.col(name)["rejected"]).drop(name)
