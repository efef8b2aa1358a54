"""Nearest neighbours by stable projections and a kd-tree (operator 5).

Vectors are scaled to length 1 (so nearest by cosine is nearest by distance) and
projected by `m` Gaussian directions.  For a pair at distance s, the squared
distance of the projections over s^2 is chi-square distributed with m degrees of
freedom.  A query takes up projected neighbours in order of their distance from
a kd-tree, a leaf at a time, verifies each on the original vectors, and stops
when an unseen vector nearer than the k-th best would have shown up by now with
probability `p` (the chi-square test: next projected distance^2 >= t * d_k^2).

On Spark the upper kd-tree is fitted on a bounded sample of projections
(`sample` rows) and deals every vector to a cell of about `cell_rows`; each task
builds the rest of the tree for its cell.  A query first searches its own cell;
its k-th distance then tells by the same test which other cells' boxes can hold
more - found by a walk down the upper tree, some queries at a time - and only those
are searched.  A cell with more than `chunk` queries is handed out once for each
chunk of its own queries, any other once.

Components keep the type they come in; double-precision vectors are indexed and
scored as such.  Vectors are scaled by a power of two before anything is squared,
so very small and very large ones count like any other.

Equal vectors are indexed once, with their k+1 smallest ids: more can never be
among the k nearest.  All rows are indexed.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part.  Null vec_id: takes no part.  Vectors of different dimensions are
never neighbours.  Repeated rows count once.  Fewer than k candidates: all.
Ties: smaller vec_id first.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import materialize


@dataclass(frozen=True)
class Params:
    k: int = 5
    m: int = 8
    p: float = 0.97
    leaf: int = 64
    cell_rows: int = 16_384
    sample: int = 20_000
    chunk: int = 4_096
    seed: int = 23


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    h, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= h / (i + 1)
    return 1 - math.exp(-h) * total


def stop_factor(p: Params) -> float:
    """t with chi_square(t) = p."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, p.m) < p.p else (lo, mid)
    return hi


def directions(dim: int, p: Params) -> np.ndarray:
    return np.random.default_rng([p.seed, dim]).normal(size=(dim, p.m))


def unpacked(rows, kind: str) -> np.ndarray:
    """Packed vectors of one dimension as rows in double precision, each scaled by a power of two."""
    v = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def project(vectors: np.ndarray, p: Params) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ directions(vectors.shape[1], p)


# ---------------------------------------------------------------- trees


def top_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Median splits (axis, value) of a complete tree of the given depth, in heap order."""
    out: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    parts = {0: points}
    for node in range(len(out)):
        x = parts.pop(node)
        axis = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
        cut = float(np.median(x[:, axis])) if len(x) else 0.0
        out[node] = (axis, cut)
        parts[2 * node + 1], parts[2 * node + 2] = x[x[:, axis] < cut], x[x[:, axis] >= cut]
    return out


def cell_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if tree:
        axis, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        for _ in range(len(tree).bit_length()):
            node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= cut[node])
    return node - len(tree)


class Leaves:
    """kd-tree of one cell: points reordered so that each leaf is a slice, with the leaves' boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        order, slices = np.arange(len(points)), []
        stack = [(0, len(points))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= leaf:
                slices.append((lo, hi))
                continue
            x = points[order[lo:hi]]
            axis, mid = int(np.ptp(x, axis=0).argmax()), (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(x[:, axis], mid)]
            stack += [(lo, lo + mid), (lo + mid, hi)]
        self.order, self.slices = order, sorted(slices)
        self.low = np.array([points[order[a:b]].min(0) for a, b in self.slices])
        self.high = np.array([points[order[a:b]].max(0) for a, b in self.slices])


def box_distance2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows of q) to boxes."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        d = np.maximum(np.maximum(low[:, j][None] - q[:, j][:, None], q[:, j][:, None] - high[:, j][None]), 0.0)
        out += d * d
    return out


def reached(points: np.ndarray, bound2: np.ndarray, tree: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(point, cell) of the cells whose part of space lies nearer to the point than its squared bound: a walk down
    the tree that takes a far side only where it is near enough."""
    at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    off, dist = np.zeros_like(points), np.zeros(len(points))
    if tree:
        axis, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        for _ in range(len(tree).bit_length()):
            a, row = axis[node], np.arange(len(at))
            gap = points[at, a] - cut[node]
            side = gap >= 0
            far = dist - off[row, a] ** 2 + gap**2
            go = np.flatnonzero(far < bound2[at])
            away = off[go]
            away[np.arange(len(go)), a[go]] = gap[go]
            at, off, dist = np.r_[at, at[go]], np.r_[off, away], np.r_[dist, far[go]]
            node = np.r_[2 * node + 1 + side, (2 * node + 2 - side)[go]]
    return at, node - len(tree)


def search(cell: pd.DataFrame, queries: pd.DataFrame, p: Params, t: float, kind: str = "<f4") -> pd.DataFrame:
    """The k nearest of a cell for each query (with bound d2: only what is nearer than that)."""
    v = unpacked(cell["vec"], kind)
    pts = np.stack([np.frombuffer(b, np.float64) for b in cell["proj"]])
    ids = [np.asarray(x) for x in cell["ids"]]
    tree = Leaves(pts, p.leaf)
    v, ids = v[tree.order], [ids[i] for i in tree.order]
    norm = np.linalg.norm(v, axis=1)
    lone = np.array([x[0] if len(x) == 1 else np.iinfo(np.int64).min for x in ids])
    least = np.array([x[0] for x in ids])
    out: list[tuple[int, int, float]] = []
    qv = unpacked(queries["vec"], kind)
    qp = np.stack([np.frombuffer(b, np.float64) for b in queries["proj"]])
    bound, qid = queries["d2"].to_numpy(np.float64), queries["query_id"].to_numpy()
    for lo in range(0, len(qv), 512):
        far = box_distance2(qp[lo : lo + 512], tree.low, tree.high)
        nearest_first = np.argsort(far, axis=1)
        for r in range(len(far)):
            q, me = qv[lo + r], qid[lo + r]
            q_norm, d2 = np.linalg.norm(q), bound[lo + r]
            at, score = np.empty(0, np.int64), np.empty(0)
            order, dist = nearest_first[r], far[r][nearest_first[r]]
            i, step = 0, 2
            while i < len(order) and dist[i] < t * d2:
                rows = np.concatenate([np.arange(*tree.slices[x]) for x in order[i : i + step]])
                rows = rows[lone[rows] != me]
                s = (v[rows] @ q) / (norm[rows] * q_norm)
                at, score = np.concatenate([at, rows]), np.concatenate([score, s])
                if len(score) > p.k:
                    keep = np.lexsort((least[at], -score))[: p.k + 1]
                    at, score = at[keep], score[keep]
                if len(score) >= p.k:
                    d2 = min(d2, max(0.0, 2 - 2 * score[p.k - 1]) + 1e-12)
                i, step = i + step, min(2 * step, 16)
            for a, s in zip(at, score):
                out += [(int(me), int(x), float(s)) for x in ids[a] if x != me]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


# ---------------------------------------------------------------- Spark


def _usable(vec: Column) -> Column:
    """Vectors that take part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _projected(p: Params, trees: dict[int, list[tuple[int, float]]], kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["vec"].map(len), sort=False):
                dim = size // np.dtype(kind).itemsize
                x = project(unpacked(part["vec"], kind), p)
                yield part.assign(proj=[r.tobytes() for r in x], dim=dim, cell=cell_of(x, trees.get(dim, [])), coords=list(x))

    return run


def _packed(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [np.asarray(v, kind).tobytes() for v in pdf["vec"]]})

    return run


def _single(df: DataFrame) -> bool:
    """Whether the components are single precision."""
    return df.schema["embedding"].dataType.simpleString() == "array<float>"


FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, p: Params = Params()) -> DataFrame:
    """For each row of queries (vec_id, embedding) its k nearest of vectors (vec_id, embedding) other than
    itself: query_id, rank, vec_id, score (cosine in double precision)."""
    t = stop_factor(p)
    kind, sql = ("<f4", "float") if _single(vectors) and _single(queries) else ("<f8", "double")
    width = np.dtype(kind).itemsize

    def usable(df: DataFrame) -> DataFrame:
        cols = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{sql}>").alias("vec"))
        return cols.filter(F.col("vec_id").isNotNull() & _usable(F.col("vec"))).mapInPandas(_packed(kind), "vec_id long, vec binary").distinct()

    few = Window.partitionBy("vec").orderBy("vec_id")
    index = usable(vectors).withColumn("nr", F.row_number().over(few)).filter(F.col("nr") <= p.k + 1)
    index = materialize(index.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "srs-vectors")
    counts = {r["dim"]: r["n"] for r in index.groupBy((F.octet_length("vec") / width).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    trees: dict[int, list[tuple[int, float]]] = {}
    for dim, n in counts.items():
        depth = max(0, math.ceil(math.log2(n / p.cell_rows))) if n else 0
        if depth:
            share = F.lit(min(1.0, p.sample / n) * (1 << 20))
            got = index.filter((F.octet_length("vec") == width * dim) & (F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < share)).select("vec").limit(2 * p.sample).toPandas()
            trees[dim] = top_tree(project(unpacked(sorted(got["vec"]), kind), p), depth)
    coords = "proj binary, dim int, cell long, coords array<double>"
    placed = materialize(index.mapInPandas(_projected(p, trees, kind), f"vec binary, ids array<long>, {coords}"), "srs-cells")
    asked = usable(queries).withColumnRenamed("vec_id", "query_id").mapInPandas(_projected(p, trees, kind), f"query_id long, vec binary, {coords}").drop("coords")
    asked = materialize(asked, "srs-queries")
    boxes = placed.groupBy("dim", "cell").agg(*[f(F.col("coords")[j]).alias(f"{n}{j}") for n, f in (("lo", F.min), ("hi", F.max)) for j in range(p.m)]).toPandas()
    placed = placed.drop("coords")

    def hunt(q: DataFrame) -> DataFrame:
        """Search cells: rows of q (dim, cell, query_id, vec, proj, d2), a cell's queries in chunks of its own."""
        sizes = q.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / p.chunk).alias("chunks"))  # a row for each cell
        q = q.join(sizes, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        q = materialize(q.select("dim", "cell", "chunk", "query_id", "vec", "proj", "d2"), "srs-hunt")
        where = q.select("dim", "cell", "chunk").distinct().toDF("to_dim", "to_cell", "to_chunk")
        there = placed.join(where, (F.col("dim") == F.col("to_dim")) & (F.col("cell") == F.col("to_cell")))

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return search(left, right, p, t, kind)

        return there.groupBy("to_dim", "to_cell", "to_chunk").cogroup(q.groupBy("dim", "cell", "chunk")).applyInPandas(run, FOUND)

    columns = ["dim", "cell", "query_id", "vec", "proj", "d2"]
    home = asked.withColumn("d2", F.lit(float("inf")))
    first = materialize(hunt(home.select(columns)), "srs-first")
    kth = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.withColumn("nr", F.row_number().over(kth)).filter(F.col("nr") == p.k)
    # room for rounding in the bound; queries with fewer than k so far have none
    reach = ranked.select("query_id", F.greatest(F.lit(0.0), F.lit(2.0) - 2 * F.col("score")).alias("d2") + F.lit(1e-12))
    reach = reach.toDF("query_id", "d2")
    again = asked.join(reach, "query_id", "left").withColumn("d2", F.coalesce("d2", F.lit(float("inf"))))
    box = {d: (g["cell"].to_numpy(), *(g[[f"{n}{j}" for j in range(p.m)]].to_numpy(np.float64) for n in ("lo", "hi"))) for d, g in boxes.groupby("dim")}
    few_queries = max(16, 4_000_000 // max(1, len(boxes)))  # even if all cells are within reach

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                if dim not in box:
                    continue
                cells, low, high = box[dim]
                nr = np.full(1 << max(0, len(trees.get(dim, [])).bit_length()), -1)
                nr[cells] = np.arange(len(cells))
                for lo in range(0, len(part), few_queries):
                    some = part.iloc[lo : lo + few_queries]
                    pts, bound2 = np.stack([np.frombuffer(b, np.float64) for b in some["proj"]]), t * some["d2"].to_numpy(np.float64)
                    i, cell = reached(pts, bound2, trees.get(dim, []))
                    ok = (cell != some["cell"].to_numpy()[i]) & (nr[cell] >= 0)
                    i, cell = i[ok], cell[ok]
                    gap = np.maximum(np.maximum(low[nr[cell]] - pts[i], pts[i] - high[nr[cell]]), 0.0)
                    ok = (gap**2).sum(1) < bound2[i]
                    yield some.iloc[i[ok]].assign(cell=cell[ok])

    rest = again.select("dim", "cell", "query_id", "vec", "proj", "d2").mapInPandas(onward, "dim int, cell long, query_id long, vec binary, proj binary, d2 double")
    rest = materialize(rest.select(columns), "srs-visits")
    found = first if rest.isEmpty() else first.union(hunt(rest))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = best.withColumn("rank", F.row_number().over(kth)).filter(F.col("rank") <= p.k)
    return out.select("query_id", "rank", "vec_id", "score")
