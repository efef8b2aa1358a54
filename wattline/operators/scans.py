"""Segmented scans: running values per key without one task per key.

A plain ``Window.partitionBy(room).orderBy(ts)`` sends every row of a room to
one task; if one room holds a third of a 100 TB log that task never finishes.
These helpers scan in two levels instead:

1. a window over ``(key, block)`` where ``block`` is a coarse, order-compatible
   bucket of the ordering (an hour of the timestamp, a day), so each task holds
   one block;
2. a small per-block summary (block total / maximum / last value), scanned per
   key over blocks — one row per block, so tiny even for a hot key — and joined
   back on ``(key, block)``.

The result equals the single-level window exactly (integers) or up to float
summation order (doubles).  The block expression must be non-decreasing in the
ordering.

The input is read once: rows are shuffled by (key, block) first, and both levels read
that shuffle (``ReusedExchange`` in the plan).  Spark reuses an exchange only if both
readers want the same columns of it, so the summary takes a hash of every column
(``_pin``), and a caller hands over just the columns it goes on to use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLK = "_scan_blk"


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _part(keys: Sequence[str]) -> list[str]:
    """Columns that hold a row's (key, block) without nulls: windows partition by them and the block
    summary joins on them by plain equality, so one shuffle and sort of the rows serves both."""
    return [*_key_names(keys), "_scan_b"]


def _key_names(keys: Sequence[str]) -> list[str]:
    return [f"_scan_k{i}" for i in range(len(keys))]


def _open(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """``df`` shuffled by (key, block), with the columns of ``_part``; a null key is a group of its own, like in a
    window.  Whatever else the two levels need is computed above the shuffle."""
    plain = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in [*_cols(keys), block]]
    return df.withColumns(dict(zip(_part(keys), plain))).repartition(*_part(keys)).withColumn(_BLK, block)


def _blocks(d: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """A row per block, with its place in the order (``d``: what ``_open`` gave, other columns added)."""
    shuffled = d.columns[: d.columns.index(_BLK)]
    pin = F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in shuffled])).alias("_scan_pin")
    return d.groupBy(*_part(keys)).agg(*aggs, F.min(_BLK).alias(_BLK), pin).where("_scan_pin IS NOT NULL").drop("_scan_pin")


def _join_blocks(d: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return d.join(summary.drop(_BLK), _part(keys), "left").drop(*_part(keys))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    out: str,
    block: Column,
) -> DataFrame:
    """``out`` = sum of ``value`` over all rows of the key up to and including this row."""
    d = _open(df, keys, block).withColumn("_scan_v", value)
    w_in = Window.partitionBy(*_part(keys)).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_scan_local", F.sum("_scan_v").over(w_in))
    w_blk = Window.partitionBy(*_key_names(keys)).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        _blocks(d, keys, F.sum("_scan_v").alias("_scan_bsum"))
        .withColumn("_scan_carry", F.sum("_scan_bsum").over(w_blk))
        .drop("_scan_bsum")
    )
    d = _join_blocks(d, summary, keys)
    res = F.when(F.col("_scan_local").isNull(), F.col("_scan_carry")).otherwise(
        F.coalesce(F.col("_scan_carry"), F.lit(0)) + F.col("_scan_local")
    )
    return d.withColumn(out, res).drop(_BLK, "_scan_v", "_scan_local", "_scan_carry")


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    out: str,
    block: Column,
) -> DataFrame:
    """``out`` = max of ``value`` (nulls ignored) over the key up to this row."""
    d = _open(df, keys, block).withColumn("_scan_v", value)
    w_in = Window.partitionBy(*_part(keys)).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_scan_local", F.max("_scan_v").over(w_in))
    w_blk = Window.partitionBy(*_key_names(keys)).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        _blocks(d, keys, F.max("_scan_v").alias("_scan_bmax"))
        .withColumn("_scan_carry", F.max("_scan_bmax").over(w_blk))
        .drop("_scan_bmax")
    )
    d = _join_blocks(d, summary, keys)
    return d.withColumn(out, F.greatest("_scan_carry", "_scan_local")).drop(
        _BLK, "_scan_v", "_scan_local", "_scan_carry"
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    out: str,
    block: Column,
) -> DataFrame:
    """``out`` = ``value`` of the previous row of the key (``lag(value, 1)``)."""
    order_cols = _cols(order)
    d = _open(df, keys, block).withColumn("_scan_v", value)
    w_in = Window.partitionBy(*_part(keys)).orderBy(*order_cols)
    d = d.withColumn("_scan_lag", F.lag("_scan_v").over(w_in)).withColumn(
        "_scan_first", F.row_number().over(w_in) == 1
    )
    w_blk = Window.partitionBy(*_key_names(keys)).orderBy(_BLK)
    summary = (
        _blocks(d, keys, F.max_by("_scan_v", F.struct(*order_cols)).alias("_scan_last"))
        .withColumn("_scan_carry", F.lag("_scan_last").over(w_blk))
        .drop("_scan_last")
    )
    d = _join_blocks(d, summary, keys)
    res = F.when(F.col("_scan_first"), F.col("_scan_carry")).otherwise(F.col("_scan_lag"))
    return d.withColumn(out, res).drop(_BLK, "_scan_v", "_scan_lag", "_scan_first", "_scan_carry")


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    block: Column,
) -> DataFrame:
    """1-based position of the row within its key (``row_number``), segmented."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, block)


def rolling_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, Column],
    n: int,
    block: Column,
    block_rows: int = 100_000,
) -> DataFrame:
    """Sums of ``values`` over the last ``n`` rows of the key (``rowsBetween(-(n-1), 0)``)
    plus ``_rr_n`` (rows in the frame), without one task per key.

    Rows are numbered per key (segmented ``row_index``) and cut into blocks of
    ``block_rows``; the last ``n - 1`` rows of each block are copied into the
    next block as context, so a window per (key, block) sees every frame whole.
    """
    if n - 1 > block_rows:
        raise ValueError(f"frames of {n} rows need blocks of at least {n - 1} rows")
    d = row_index(df, keys, order, "_rr_idx", block)
    d = d.withColumn("_rr_own", ((F.col("_rr_idx") - 1 - (F.col("_rr_idx") - 1) % block_rows) / block_rows).cast("long"))
    tail = (F.col("_rr_idx") - 1) % block_rows >= block_rows - (n - 1)
    # one pass: every row goes to its own block; a tail row also goes to the next one as context
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    u = d.withColumn("_rr_copy", F.explode(copies)).withColumn("_rr_blk", F.col("_rr_own") + F.col("_rr_copy")) \
        .withColumn("_rr_ctx", F.col("_rr_copy") == 1).drop("_rr_own", "_rr_copy")
    w = Window.partitionBy(*keys, "_rr_blk").orderBy("_rr_idx").rowsBetween(-(n - 1), 0)
    u = u.withColumns({name: F.sum(col).over(w) for name, col in values.items()}).withColumn(
        "_rr_n", F.count(F.lit(1)).over(w)
    )
    return u.where(~F.col("_rr_ctx")).drop("_rr_blk", "_rr_ctx", "_rr_idx")


def segmented_sessions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    t: Column,
    gap: int,
    block: Column,
    strict: bool = False,
    prev_out: str = "prev_t",
    group_out: str = "group_no",
) -> DataFrame:
    """Gap-based grouping per key in one two-level pass: ``prev_out`` is the
    previous row's ``t`` (a long, e.g. microseconds) and ``group_out`` numbers
    the groups 1, 2, ... where a new group starts at the first row of the key or
    when ``t - prev >= gap`` (``> gap`` if ``strict``).

    Inside a (key, block) window each row gets its lag and a running count of
    starts; the first row of a block is resolved at block level from the
    previous block's last ``t``, and the per-block start counts are carried
    forward — one join back, no chained scans."""
    order_cols = _cols(order)

    def starts(cur, prev):
        return (cur - prev > gap) if strict else (cur - prev >= gap)

    d = _open(df, keys, block).withColumn("_ss_t", t)
    w_in = Window.partitionBy(*_part(keys)).orderBy(*order_cols)
    d = d.withColumn("_ss_prev", F.lag("_ss_t").over(w_in)).withColumn("_ss_first", F.row_number().over(w_in) == 1)
    new_local = F.when(F.col("_ss_first"), F.lit(0)).otherwise(starts(F.col("_ss_t"), F.col("_ss_prev")).cast("int"))
    d = d.withColumn("_ss_new", new_local).withColumn(
        "_ss_cnt", F.sum("_ss_new").over(w_in.rowsBetween(Window.unboundedPreceding, 0)))
    w_blk = Window.partitionBy(*_key_names(keys)).orderBy(_BLK)
    blk = (
        _blocks(
            d, keys,
            F.min_by("_ss_t", F.struct(*order_cols)).alias("_ss_bfirst"),
            F.max_by("_ss_t", F.struct(*order_cols)).alias("_ss_blast"),
            F.sum("_ss_new").alias("_ss_inner"),
        )
        .withColumn("_ss_pblast", F.lag("_ss_blast").over(w_blk))
        .withColumn("_ss_fnew", (F.col("_ss_pblast").isNull() | starts(F.col("_ss_bfirst"), F.col("_ss_pblast"))).cast("int"))
        .withColumn("_ss_carry", F.coalesce(
            F.sum(F.col("_ss_inner") + F.col("_ss_fnew")).over(w_blk.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        .select(*_part(keys), _BLK, "_ss_pblast", "_ss_fnew", "_ss_carry")
    )
    d = _join_blocks(d, blk, keys)
    prev = F.when(F.col("_ss_first"), F.col("_ss_pblast")).otherwise(F.col("_ss_prev"))
    group = (F.col("_ss_carry") + F.col("_ss_fnew") + F.col("_ss_cnt")).cast("long")
    return d.withColumn(prev_out, prev).withColumn(group_out, group).drop(
        _BLK, "_ss_t", "_ss_prev", "_ss_first", "_ss_new", "_ss_cnt", "_ss_pblast", "_ss_fnew", "_ss_carry")


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, block: Column) -> DataFrame:
    """Top ``k`` rows per key by ``order`` in two levels: top k per (key, block),
    then top k of those candidates per key (at most k per block)."""
    w1 = Window.partitionBy(*keys, "_tk_blk").orderBy(*order)
    cand = df.withColumn("_tk_blk", block).withColumn("_tk_rn", F.row_number().over(w1)).where(F.col("_tk_rn") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return cand.withColumn("_tk_rn", F.row_number().over(w2)).where(F.col("_tk_rn") <= k).drop("_tk_blk", "_tk_rn")
