"""Daily feature table and data summaries (SURVEY A1, A2, A8-A12, A15, F6-F11,
P0b-P0d, U3, U5, M2-M4).

The reference builds the daily table with three pandas groupbys merged back
together; here it is one ``groupBy(room, date).agg(...)`` (partial aggregation
on the map side), followed by projections.  Energies are summed in integer
units of the stored precision (1e-8 kWh), so totals do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import exact
from ..functions.scalars import (
    calendar_features,
    coerce_numeric,
    coerce_ts,
    cyclic,
    floor_of_room,
    room_type_from_floor,
)

ENERGY_DECIMALS = exact.ENERGY

# Keyword -> canonical name; the first matching rule wins, like the reference.
HEADER_RULES = [
    ("contains", ("date",), "date"),
    ("contains", ("time", "hour"), "time"),
    ("contains", ("energy", "kwh"), "energy_kwh"),
    ("exact", ("Room",), "room"),
    ("exact", ("Room_Type",), "room_type"),
    ("contains", ("voltage", "volt"), "voltage"),
    ("contains", ("current",), "current"),
]


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename columns by keyword (metadata only, no data pass)."""
    mapping = {}
    for col in df.columns:
        low = col.lower().strip()
        for kind, keys, target in HEADER_RULES:
            hit = any(k in low for k in keys) if kind == "contains" else col in keys
            if hit:
                mapping[col] = target
                break
    return df.withColumnsRenamed(mapping) if mapping else df


def require_columns(df: DataFrame, required=("date", "energy_kwh", "room")) -> DataFrame:
    """S3: fail loudly when a required column is missing (schema check only)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def clean_training_text(raw: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Normalise a text training table and drop invalid rows.

    Adds ``ts`` from date[+time]; energy to number.  Rows whose timestamp or
    energy does not parse are dropped (coerce-then-drop).  With
    ``drop_invalid=False`` they are kept and marked (``_valid``) instead, for
    ``daily_totals`` to skip: a filter here would be pushed below the parsing
    projection and parse every row twice.
    """
    df = require_columns(normalize_headers(raw))
    cols = {"room": F.trim(F.col("room").cast("string"))}
    if "room_type" in df.columns:
        cols["room_type"] = F.trim(F.col("room_type").cast("string"))
    cols["ts"] = coerce_ts(F.col("date"), F.col("time") if "time" in df.columns else None)
    cols["energy_kwh"] = coerce_numeric(F.col("energy_kwh"))
    for c in ("voltage", "current"):
        if c in df.columns:
            cols[c] = coerce_numeric(F.col(c))
    df = df.withColumns(cols)
    if not drop_invalid:
        return df.withColumn("_valid", F.col("ts").isNotNull() & F.col("energy_kwh").isNotNull())
    return df.where(F.col("ts").isNotNull()).where(F.col("energy_kwh").isNotNull())


def invalid_counts(cleaned_input: DataFrame) -> DataFrame:
    """P0b counters: rows, rows with a bad timestamp, rows with bad energy (after ts)."""
    df = require_columns(normalize_headers(cleaned_input))
    ts = coerce_ts(F.col("date"), F.col("time") if "time" in df.columns else None)
    e = coerce_numeric(F.col("energy_kwh"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ts.isNull()).alias("invalid_timestamps"),
        F.count_if(ts.isNotNull() & e.isNull()).alias("invalid_energy"),
        F.count_if(ts.isNotNull() & e.isNotNull()).alias("n_valid"),
    )


#: Optional columns averaged per day, with their stored decimals.
_MEANS = {"voltage": exact.VOLTAGE, "current": exact.CURRENT}


def daily_totals(readings: DataFrame) -> DataFrame:
    """A1: one row per (room, date): energy sum, mean voltage/current, mode room type.

    Two hash aggregates instead of a map-valued ``mode`` buffer: first per
    (room, date, room_type) — counts and integer-unit sums, pre-aggregated on the
    map side — then per (room, date), where the mode is the type with the most
    rows (lowest name on ties; nulls never win, A2) and the sums add up."""
    has_rt = "room_type" in readings.columns
    marked = "_valid" in readings.columns          # rows marked by clean_training_text(drop_invalid=False)
    ok = F.col("_valid") if marked else F.lit(True)

    def only_valid(c):
        return F.when(ok, c)

    d = readings.withColumn("date", F.to_date("ts"))
    if not has_rt:
        d = d.withColumn("room_type", F.lit(None).cast("string"))
    parts = [F.count_if(ok).alias("_n"),
             exact.total(only_valid(exact.units(F.col("energy_kwh"), ENERGY_DECIMALS))).alias("_e")]
    for c, decimals in _MEANS.items():
        if c in readings.columns:
            parts += [exact.total(only_valid(exact.units(F.col(c), decimals))).alias(f"_s_{c}"),
                      F.count(only_valid(F.col(c))).alias(f"_c_{c}")]
    first = d.groupBy("room", "date", "room_type").agg(*parts)
    aggs = [exact.units_rounded(F.sum("_e"), ENERGY_DECIMALS, ENERGY_DECIMALS).alias("energy_kwh")]
    for c, decimals in _MEANS.items():
        if c in readings.columns:
            aggs.append(exact.ratio_rounded(F.sum(f"_s_{c}"), F.sum(f"_c_{c}"), decimals, 4).alias(c))
    if has_rt:
        pick = F.min_by(F.col("room_type"), F.struct(
            (F.col("_n") == 0).alias("none"), F.col("room_type").isNull().alias("z"),
            (-F.col("_n")).alias("n"), F.col("room_type")))
        aggs.append(F.coalesce(pick, F.lit("unknown")).alias("room_type"))
    out = first.groupBy("room", "date").agg(*aggs, F.sum("_n").alias("_n_valid"))
    # groups of invalid rows only (the null date of unparsed timestamps) drop out after the aggregate
    return out.where(F.col("_n_valid") > 0).drop("_n_valid")


def daily_features(readings: DataFrame) -> DataFrame:
    """A1 + F6/F7/F9/F10: the daily training table."""
    d = daily_totals(readings)
    cal = calendar_features(F.col("date"))
    msin, mcos = cyclic(F.month("date"), 12)
    d = d.withColumns(cal).withColumns(
        {"month_sin": F.round(msin, 10), "month_cos": F.round(mcos, 10), "floor": floor_of_room(F.col("room"))}
    )
    if "room_type" not in d.columns:
        d = d.withColumn("room_type", room_type_from_floor(F.col("floor")))
    return d


def dataset_summary(daily: DataFrame) -> DataFrame:
    """One row: records, date range, rooms, floors, energy sum/mean/min/max,
    mean of per-room means — one pass: per-room partials, then the room table."""
    u = exact.units(F.col("energy_kwh"), ENERGY_DECIMALS)
    per_room = daily.groupBy("room").agg(
        F.count(F.lit(1)).alias("n"), exact.total(u).alias("su"), F.count(u).alias("cu"),
        F.min("date").alias("dmin"), F.max("date").alias("dmax"),
        F.min("energy_kwh").alias("emin"), F.max("energy_kwh").alias("emax"),
        F.avg("energy_kwh").alias("room_mean"), F.first("floor").alias("floor"),
    )
    return per_room.agg(
        F.sum("n").alias("n_records"),
        F.min("dmin").alias("date_min"),
        F.max("dmax").alias("date_max"),
        F.count(F.lit(1)).alias("n_rooms"),
        F.count_distinct("floor").alias("n_floors"),
        exact.units_rounded(F.sum("su"), ENERGY_DECIMALS, 2).alias("total_energy"),
        exact.ratio_rounded(F.sum("su"), F.sum("cu"), ENERGY_DECIMALS, 4).alias("mean_energy"),
        F.round(F.min("emin"), 4).alias("min_energy"),
        F.round(F.max("emax"), 4).alias("max_energy"),
        F.round(F.avg("room_mean"), 4).alias("mean_room_daily_energy"),
    )


def floor_summary(daily: DataFrame) -> DataFrame:
    """Per floor — records, distinct rooms, mean daily energy."""
    return daily.groupBy("floor").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("room").alias("n_rooms"),
        exact.avg_rounded("energy_kwh", ENERGY_DECIMALS, 4).alias("mean_energy"),
    )


def rooms_by_floor(daily: DataFrame, sample: int = 5) -> DataFrame:
    """A10: per floor — distinct rooms, the first five (text order), '(+n more)'.

    Only the shown rooms are gathered: the first five per (floor, hash bucket of
    the room), then the first five per floor from those candidates; the room
    count is a separate aggregate."""
    from .scans import top_k_per_key

    rooms = daily.select("floor", "room").distinct()
    counts = rooms.groupBy("floor").agg(F.count(F.lit(1)).alias("n_rooms"))
    first = top_k_per_key(rooms, ["floor"], [F.col("room")], sample, F.abs(F.hash("room")) % 64)
    shown = first.groupBy("floor").agg(F.array_join(F.sort_array(F.collect_list("room")), ", ").alias("_shown"))
    more = F.when(F.col("n_rooms") > sample, F.format_string(", ... (+%d more)", F.col("n_rooms") - sample)).otherwise(F.lit(""))
    return counts.join(shown, "floor").select("floor", "n_rooms", F.concat(F.col("_shown"), more).alias("sample"))


def weekday_distribution(daily: DataFrame) -> DataFrame:
    """Records and share (%, 1 place) for all seven weekdays, zero-filled."""
    spark = daily.sparkSession
    counts = daily.groupBy(F.col("day_of_week").alias("weekday")).agg(F.count(F.lit(1)).alias("n_records"))
    days = spark.range(7).select(F.col("id").cast("int").alias("weekday"))
    names = F.array(*[F.lit(n) for n in fixed.WEEKDAY_NAMES])
    out = days.join(counts, "weekday", "left").fillna(0, ["n_records"])
    total = F.sum("n_records").over(Window.partitionBy())      # over the seven weekday rows
    out = out.withColumn("_total", total)
    total = F.col("_total")
    return out.select(
        "weekday",
        F.element_at(names, F.col("weekday") + 1).alias("day_name"),
        "n_records",
        F.when(total > 0, exact.ratio_rounded(F.col("n_records") * 1000, total, 0, 0) / F.lit(10.0)).alias("pct"),
    )


def weekend_coverage(daily: DataFrame) -> DataFrame:
    """A12: 'none' / 'limited' (< 10 % weekend records) / 'ok'."""
    g = daily.agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("day_of_week") >= 5).alias("n_weekend")
    )
    status = (
        F.when(F.col("n_weekend") == 0, F.lit("none"))
        .when(F.col("n_weekend") * 10 < F.col("n_records"), F.lit("limited"))
        .otherwise(F.lit("ok"))
    )
    return g.withColumn("status", status)


def filter_floors(daily: DataFrame, floors=(1, 7)) -> DataFrame:
    """Floor in the allowed list."""
    return daily.where(F.col("floor").isin(list(floors)))


def range_table(spark, ranges=fixed.DEFAULT_ROOM_RANGES) -> DataFrame:
    return spark.createDataFrame([(int(f), int(lo), int(hi)) for f, lo, hi in ranges], "floor int, lo int, hi int")


def filter_room_ranges(daily: DataFrame, ranges=fixed.DEFAULT_ROOM_RANGES, floors=(1, 7)) -> DataFrame:
    """P0d: per-floor inclusive numeric room range; non-numeric rooms and unlisted
    floors drop out.  How the range table travels is left to its size."""
    r = range_table(daily.sparkSession, ranges)
    num = F.col("room").try_cast("int")
    d = filter_floors(daily, floors)
    return d.join(r, (d["floor"] == r["floor"]) & num.between(r["lo"], r["hi"]), "left_semi")


def prediction_rooms(daily: DataFrame, ranges=fixed.DEFAULT_ROOM_RANGES) -> DataFrame:
    """Distinct rooms of the data inside the prediction ranges (numeric order on read)."""
    inside = filter_room_ranges(daily, ranges, floors=[f for f, _, _ in ranges])
    return inside.select("room").distinct().withColumn("room_no", F.col("room").cast("int"))


def default_rooms(spark, ranges=fixed.DEFAULT_ROOM_RANGES) -> DataFrame:
    rows = [(str(n),) for _, lo, hi in ranges for n in range(lo, hi + 1)]
    return spark.createDataFrame(rows, "room string")


def room_union(rooms: DataFrame, ranges=fixed.DEFAULT_ROOM_RANGES) -> DataFrame:
    """Default room list union rooms with data, distinct."""
    d = default_rooms(rooms.sparkSession, ranges)
    return rooms.select("room").union(d).distinct().withColumn("room_no", F.col("room").try_cast("int"))


def room_intersect(rooms: DataFrame, ranges=fixed.DEFAULT_ROOM_RANGES) -> DataFrame:
    """Rooms of the data that are also allowed; the allowed list if none are."""
    allowed = default_rooms(rooms.sparkSession, ranges)
    both = rooms.select("room").distinct().join(allowed, "room", "left_semi").withColumn("_real", F.lit(1))
    u = both.unionByName(allowed.withColumn("_real", F.lit(0)))
    u = u.withColumn("_any", F.max("_real").over(Window.partitionBy()))     # at most the allowed list + data rooms
    out = u.where((F.col("_real") == 1) | (F.col("_any") == 0)).select("room")
    return out.withColumn("room_no", F.col("room").cast("int"))


def sorted_rank(dic: DataFrame, col: str, out: str, blocks: int = 256, sample: int = 4096) -> DataFrame:
    """``out`` = 0-based rank of each value of a dictionary (distinct values of ``col``) in sorted order.

    The sorted range is cut at quantiles of a bounded sample (the ``sample`` values of least hash), so
    blocks are about even whatever the values look like; ranks are the place in the block plus the rows of
    the blocks before (a segmented scan).  No task holds more than a block of the dictionary."""
    from . import scans

    some = dic.orderBy(F.xxhash64(col), col).limit(sample).select(col).collect()
    some = sorted((r[0] for r in some), key=lambda v: v.encode() if isinstance(v, str) else v)   # as Spark orders text
    cuts = some[:: max(1, len(some) // blocks)][1:]
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(col))) if cuts else F.lit(0)
    ranked = scans.row_index(dic.select(col), [], [col], "_nr", block)
    return ranked.select(col, (F.col("_nr") - 1).cast("int").alias(out))


def label_encode(df: DataFrame, col: str, out: str, dictionary: DataFrame | None = None) -> DataFrame:
    """M2: index of the value in the sorted distinct dictionary; unseen -> number of classes."""
    dic = (dictionary if dictionary is not None else df).select(col).where(F.col(col).isNotNull()).distinct()
    k = dic.select(F.count(F.lit(1))).scalar().cast("int")
    return df.join(sorted_rank(dic, col, out), col, "left").withColumn(out, F.coalesce(F.col(out), k))


def hash_split(key: Column, test_tenths: int = 2) -> Column:
    """M4: deterministic 80/20 split from the md5 of a key ('test' when the
    first 8 hex digits mod 10 are below ``test_tenths``)."""
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.when(h % 10 < test_tenths, F.lit("test")).otherwise(F.lit("train"))


ENHANCED_FEATURES = [
    "year", "month", "day", "day_of_week", "is_weekend", "month_sin", "month_cos", "day_sin",
    "day_cos", "quarter", "is_holiday", "floor", "room_type_numeric", "room_encoded",
]


def training_matrix(daily: DataFrame) -> DataFrame:
    """M3: the enhanced feature set + target and the split column."""
    d = label_encode(enhanced_rows(daily), "room", "room_encoded")
    return d.select("room", "date", *ENHANCED_FEATURES, "energy_kwh", "split")


def enhanced_rows(daily: DataFrame) -> DataFrame:
    """The daily table with the enhanced features but the room's code, and the split column."""
    dsin, dcos = cyclic(F.col("day"), 31)
    d = daily.withColumns(
        {
            "day_sin": F.round(dsin, 10),
            "day_cos": F.round(dcos, 10),
            "quarter": F.quarter("date"),
            "is_holiday": F.lit(0),
            "room_type_numeric": F.when(F.col("room_type") == "lab", F.lit(1)).otherwise(F.lit(0)),
        }
    )
    key = F.concat_ws("|", F.col("room"), F.date_format("date", "yyyy-MM-dd"))
    return d.withColumn("split", hash_split(key))


def regression_metrics(pred: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R² in one pass; SST = n x var_pop(y) (Spark's stable
    merge of central moments, no second pass for the mean)."""
    by = by or []
    err = F.col(y) - F.col(yhat)
    g = pred.groupBy(*by) if by else pred
    stats = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("sst"),
    )
    return stats.select(
        *by, "n",
        F.round("mae", 6).alias("mae"),
        F.round("rmse", 6).alias("rmse"),
        F.round(F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")), 6).alias("r2"),
    )
