"""Near-duplicate documents by SetSketch registers (operator 6).

A document's set is its distinct five-word shingles (words: runs of non-white
space, A-Z lower-cased; fewer than five words: the whole sequence as one
shingle).  Each set gets `m` registers: register i is the least of the
elements' exponential variables, on an exponential scale of base `b`, cut to
16 bits.  Registers are mergeable (element-wise maximum) and equal with a
probability that follows the Jaccard similarity.

1. Equal sets are one class (128-bit digest of the sorted set); only classes
   are compared, copies never expand into pairs.
2. Bands of `rows` registers make buckets.  In each bucket the two end members
   (least and greatest class key) are compared with all others: linear in the
   bucket, however large it is.
3. Candidates pass when the maximum-likelihood estimate of the joint register
   distribution reaches `floor` (about five standard errors below the
   threshold), and are then verified on the full sets.
4. Connected components of the verified links; what still lies in different
   components within one bucket is compared exhaustively, in blocks of bounded
   size, again by estimate first and full sets after.

A pair at the threshold t shares no band with probability (1 - t^rows)^(m / rows):
1.9e-6 at 0.80, 9.7e-9 at 0.85; links are lost only with that chance.

Cases: null or empty text and text without words: empty set, linked with
nothing, component_id = own doc_id.  Null doc_id: kept null; it is a member of
its class, but never the least id.  Repeated rows: one result row for each
input row; equal texts share a class.  Very long texts: whole.  Empty table:
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import WordHashes, materialize, mix64, segment_starts, spans, words_of

_U = np.uint64


@dataclass(frozen=True)
class Params:
    """threshold: link when 100 * |A and B| >= percent * |A or B|; m registers in bands of `rows`."""

    percent: int = 80
    shingle: int = 5
    m: int = 100
    rows: int = 4
    b: float = 1.001
    a: float = 20.0
    seed: int = 11
    block: int = 1024
    block_elements: int = 1_000_000

    @property
    def threshold(self) -> float:
        return self.percent / 100

    @property
    def floor(self) -> float:
        t = self.threshold
        return max(0.05, t - 5 * (t * (1 - t) / self.m) ** 0.5)


# ---------------------------------------------------------------- sets and registers


def shingle_sets(texts: list[str | None], size: int, cache: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [words_of(t) for t in texts]
    out: list[np.ndarray] = []
    odd = mix64(np.arange(1, size + 1, dtype=_U)) | _U(1)
    for ws in words:
        n = len(ws)
        if n == 0:
            out.append(np.empty(0, _U))
        elif n < size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\x00short\x00" + b" ".join(ws))], _U))
        else:
            h = cache.of(ws)
            s = np.zeros(n - size + 1, _U)
            for k in range(size):
                s += mix64(h[k : n - size + 1 + k]) * odd[k]
            out.append(np.unique(mix64(s)))
    return out


def _streams(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    x = rng.integers(0, 2**63, p.m, dtype=np.int64).astype(_U)
    return x, rng.integers(0, 2**63, p.m, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def registers(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """One row of m uint16 registers for each set (all zero for an empty set)."""
    x, odd = _streams(p)
    out = np.zeros((len(sets), p.m), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    for lo, hi in spans([len(sets[i]) for i in full], 1 << 15):
        ids = full[lo:hi]
        flat = np.concatenate([sets[i] for i in ids])
        starts = segment_starts(np.array([len(sets[i]) for i in ids]))
        least = np.empty((p.m, len(ids)), _U)
        v = np.empty_like(flat)
        for j in range(p.m):
            np.bitwise_xor(flat, x[j], out=v)
            np.multiply(v, odd[j], out=v)
            least[j] = np.minimum.reduceat(v, starts)
        u = (least.T.astype(np.float64) + 0.5) / 2.0**64
        e = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / p.a
        out[ids] = np.clip(np.floor(1 - np.log(e) / np.log(p.b)), 0, 65535).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, b: float) -> np.ndarray:
    """Maximum-likelihood Jaccard of register rows ra, rb with set sizes na, nb (bisection of the slope)."""
    ra, rb = ra.astype(np.int32), rb.astype(np.int32)
    gt, lt = (ra > rb).sum(1), (ra < rb).sum(1)
    eq = ra.shape[1] - gt - lt
    total = np.maximum(na + nb, 1).astype(np.float64)
    u, v = na / total, nb / total
    c, ln = (b - 1) / b, np.log(b)
    hi = np.minimum(u / np.maximum(v, 1e-300), v / np.maximum(u, 1e-300))
    lo = np.zeros_like(hi)
    tiny = 1e-12
    for _ in range(40):
        j = (lo + hi) / 2
        xu, xv = np.maximum(u - v * j, tiny), np.maximum(v - u * j, tiny)
        pu, pv = -np.log1p(-xu * c) / ln, -np.log1p(-xv * c) / ln
        du, dv = c / (ln * (1 - xu * c)), c / (ln * (1 - xv * c))
        slope = eq * (v * du + u * dv) / np.maximum(1 - pu - pv, tiny) - gt * v * du / pu - lt * u * dv / pv
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


# ---------------------------------------------------------------- Spark stages

ROWS = "doc_id long, tk string, n_shingles long, ck binary, regs binary"


def _sketch_rows(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            for lo, hi in spans([len(t or "") for t in texts], 4_000_000):
                sets = shingle_sets(texts[lo:hi], p.shingle, cache)
                regs = registers(sets, p)
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[lo:hi].to_numpy(),
                    "tk": pdf["tk"].iloc[lo:hi].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "ck": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "regs": [r.tobytes() if len(s) else None for r, s in zip(regs, sets)],
                })

    return run


def _set_rows(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for pdf in batches:
            texts = list(pdf["text"])
            for lo, hi in spans([len(t or "") for t in texts], 4_000_000):
                sets = shingle_sets(texts[lo:hi], p.shingle, cache)
                yield pd.DataFrame({"ck": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "elems": [s.tobytes() for s in sets]})

    return run


def _estimated(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ra, rb = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1) for c in ("ra", "rb"))
                est = estimate(ra, rb, pdf["na"].to_numpy(np.float64), pdf["nb"].to_numpy(np.float64), p.b)
                yield pdf.loc[est >= p.floor, ["a", "b"]]

    return run


def _verified(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (ea, eb) in enumerate(zip(pdf["ea"], pdf["eb"])):
                x, y = np.frombuffer(ea, _U), np.frombuffer(eb, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= p.percent * (len(x) + len(y) - both)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _cross_blocks(p: Params):
    """Links between different components within whole (bucket, block i, block j) groups: pairs that share
    this band first and pass the estimate are verified on the full sets; links that join nothing new in the
    group are left out, so a group gives fewer links than it has members."""
    width, most = p.rows, 1 << 16

    def pairs_of(blk: np.ndarray, bi: int, bj: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        for part in np.array_split(left, max(1, len(left) * len(right) // most)):
            i, j = np.repeat(part, len(right)), np.tile(right, len(part))
            ok = i < j if bi == bj else np.ones(len(i), bool)
            yield i[ok], j[ok]

    def links(g: pd.DataFrame) -> Iterator[tuple[int, int]]:
        regs = np.frombuffer(b"".join(g["regs"]), np.uint16).reshape(len(g), -1)
        bands = regs.reshape(len(g), -1, width)
        n, band = g["n"].to_numpy(np.float64), int(g["band"].iloc[0])
        root = pd.factorize(g["root"].map(bytes))[0]
        up = list(range(root.max() + 1))  # disjoint sets of components

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        elems = [np.frombuffer(e, _U) for e in g["elems"]]
        names = np.unique(np.concatenate(elems))
        elems = [np.searchsorted(names, e) for e in elems]
        mark = np.zeros(len(names), bool)
        for i, j in pairs_of(g["blk"].to_numpy(), int(g["bi"].iloc[0]), int(g["bj"].iloc[0])):
            ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * 100 >= p.percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            if band and len(i):  # a pair is handled in the first band it shares
                ok = ~(bands[i, :band] == bands[j, :band]).all(2).any(1)
                i, j = i[ok], j[ok]
            if not len(i):
                continue
            ok = estimate(regs[i], regs[j], n[i], n[j], p.b) >= p.floor
            i, j = i[ok], j[ok]
            for x in np.unique(i):
                ys = [y for y in j[i == x] if find(root[x]) != find(root[y])]
                if not ys:
                    continue
                mark[elems[x]] = True
                sizes = np.array([len(elems[y]) for y in ys])
                both = np.add.reduceat(mark[np.concatenate([elems[y] for y in ys])].astype(np.int64), segment_starts(sizes))
                mark[elems[x]] = False
                for k in np.flatnonzero(100 * both >= p.percent * (len(elems[x]) + sizes - both)):
                    u, v = find(root[x]), find(root[ys[k]])
                    if u != v:
                        up[u] = v
                        yield int(x), int(ys[k])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in pdf.groupby(["band", "h", "bi", "bj"], sort=True):
            keys = g["ck"].to_numpy()
            for x, y in links(g):
                a.append(min(keys[x], keys[y]))
                b.append(max(keys[x], keys[y]))
        return pd.DataFrame({"a": a, "b": b})

    return run


def _full_sets(used: DataFrame, classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Full sets (ck, elems) of the class keys in `used` (ck), made anew from one text of each class."""
    reps = used.join(classes.select("ck", "rep"), "ck").select(F.col("rep").alias("rep_id")).distinct()
    texts = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep_id"]), "left_semi").select("text")
    return materialize(texts.mapInPandas(_set_rows(p), "ck binary, elems binary").join(used, "ck", "left_semi").dropDuplicates(["ck"]), "setsketch-sets")


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Of candidate pairs (a, b) of class keys, those whose full sets are linked."""
    c = classes.select("ck", "n", "regs")
    both = (pairs.join(c.select(F.col("ck").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
            .join(c.select(F.col("ck").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
            .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent))
    pairs = materialize(both.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(_estimated(p), "a binary, b binary"), "setsketch-pairs")
    used = pairs.select(F.col("a").alias("ck")).union(pairs.select("b")).distinct()
    sets = _full_sets(used, classes, docs, p)
    full = (pairs.join(sets.select(F.col("ck").alias("b"), F.col("elems").alias("eb")), "b")
            .join(sets.select(F.col("ck").alias("a"), F.col("elems").alias("ea")), "a"))
    return full.select("a", "b", "ea", "eb").mapInPandas(_verified(p), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (ck, root), root the least key reachable.

    Rounds of neighbour minimum and pointer jumping, each written to the
    shared folder, until no label changes."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(edges, "cc-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("ck")).agg(F.min(F.least("a", "b")).alias("root")), "cc-labels")
    while True:
        seen = edges.join(labels.select(F.col("ck").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("ck")).agg(F.min("r").alias("r"))
        near = labels.join(seen, "ck").select("ck", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = near.alias("x").join(labels.select(F.col("ck").alias("k"), F.col("root").alias("up")), F.col("x.root") == F.col("k"))
        new = materialize(jump.select("x.ck", F.least("x.root", "up").alias("root"), "x.was"), "cc-labels")
        if new.filter("root <> was").isEmpty():
            return new.select("ck", "root")
        labels = new.select("ck", "root")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, exact_copies.

    component_id is the least doc_id reachable over links, kept marks that
    document itself, exact_copies counts rows whose shingle set is equal."""
    out = grouped(docs, p)
    cid = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(False)).alias("kept"), F.coalesce("copies", F.lit(1)).alias("exact_copies"))


def text_key(text: Column) -> Column:
    """Names a text (null: null)."""
    return F.md5(text.cast("string").cast("binary"))


def grouped(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, tk (its text_key), n_shingles, root (its component; null
    without words), component_id (the component's least doc_id, if it has any), copies."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(docs.select("doc_id", "text", text_key(F.col("text")).alias("tk")).mapInPandas(_sketch_rows(p), ROWS), "setsketch-rows")
    classes = materialize(rows.filter("n_shingles > 0").groupBy("ck").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs")), "setsketch-classes")

    width = 2 * p.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(p.m // p.rows - 1)),
                        lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))).alias("h")))
    members = classes.select("ck", F.explode(bands).alias("x")).select("ck", "x.band", "x.h")
    ends = members.groupBy("band", "h").agg(F.min("ck").alias("lo"), F.max("ck").alias("hi"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # written first, so the join has a shuffle on each side and a hot bucket's members are split over tasks
    ends = materialize(ends, "setsketch-ends")
    buckets = materialize(members.join(ends, ["band", "h"]), "setsketch-buckets")
    star = buckets.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("ck").alias("b")), F.struct(F.col("ck").alias("a"), F.col("hi").alias("b")))).alias("x"))
    star = star.select("x.a", "x.b").filter("a <> b").distinct()
    links = materialize(_checked(star, classes, docs, p), "setsketch-links")
    roots = components(links)

    # what is left: buckets of three and more whose members lie in different components
    labelled = buckets.filter("size > 2").select("band", "h", "ck").join(roots, "ck", "left").withColumn("root", F.coalesce("root", "ck"))
    labelled = labelled.join(classes.select("ck", "n", "regs"), "ck")
    mixed = labelled.groupBy("band", "h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("elements")).filter("r0 <> r1")
    blocks = F.greatest(F.ceil(F.col("size") / p.block), F.ceil(F.col("elements") / p.block_elements)).cast("int")
    open_rows = materialize(labelled.join(mixed.select("band", "h", blocks.alias("nb")), ["band", "h"]), "setsketch-open")
    sets = _full_sets(open_rows.select("ck").distinct(), classes, docs, p)
    open_rows = open_rows.withColumn("blk", F.pmod(F.xxhash64("ck"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    paired = open_rows.select("*", other).withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o"))
    # block pairs share tasks: about a block's elements in each
    total = paired.agg(F.sum("n")).first()[0] or 0
    task = F.pmod(F.xxhash64("band", "h", "bi", "bj"), F.lit(max(1, total // p.block_elements)))
    cross = (paired.join(sets, "ck").select("band", "h", "bi", "bj", "blk", "ck", "root", "n", "regs", "elems", task.alias("task"))
             .groupBy("task").applyInPandas(_cross_blocks(p), "a binary, b binary").distinct())
    more = materialize(cross, "setsketch-links")
    if not more.isEmpty():
        roots = components(links.union(more))

    least = classes.join(roots, "ck", "left").select("ck", "rep", "copies", F.coalesce("root", "ck").alias("root"))
    comp = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled_classes = least.join(comp, "root").select("ck", "root", "component_id", "copies")
    return rows.select("doc_id", "tk", "n_shingles", "ck").join(labelled_classes, "ck", "left").drop("ck")
