"""Threshold rules: recommendations and alerts.

A rule table is folded into one sorted array by a scalar subquery, so applying
it is a per-row ``filter`` / ``transform`` over that array: no join, no shuffle
of the rows being judged, and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import exact



def rules_table(spark: SparkSession, rules=fixed.RECOMMENDATION_RULES) -> DataFrame:
    """The rule table with its file order (``rule_order``)."""
    rows = [(t, float(v), txt, i) for i, (t, v, txt) in enumerate(rules)]
    return spark.createDataFrame(rows, "threshold_type string, threshold_value double, recommendation string, rule_order int")


_RANK = {"energy_kWh": 0, "energy_cost_Php": 1}


def rules_array(rules) -> Column:
    """Rules (a list, or a table) in the order they apply: kWh rules, then cost rules, each in file order.

    Of a table it is a scalar subquery: put it into a column before use in ``recommend``."""
    if isinstance(rules, list):
        items = sorted((_RANK[t], i, float(v), txt) for i, (t, v, txt) in enumerate(rules) if t in _RANK)
        rows = [F.struct(F.lit(r).alias("rank"), F.lit(i).alias("rule_order"), F.lit(v).alias("threshold_value"), F.lit(txt).alias("recommendation")) for r, i, v, txt in items]
        return F.array(*rows) if rows else F.array().cast("array<struct<rank:int,rule_order:int,threshold_value:double,recommendation:string>>")
    kind = F.col("threshold_type")
    rank = F.when(kind == "energy_kWh", 0).when(kind == "energy_cost_Php", 1)
    order = F.col("rule_order") if "rule_order" in rules.columns else F.monotonically_increasing_id()
    known = rules.select(rank.alias("rank"), order.alias("rule_order"), F.col("threshold_value").cast("double").alias("threshold_value"), "recommendation").where("rank is not null")
    return known.agg(F.array_sort(F.collect_list(F.struct("rank", "rule_order", "threshold_value", "recommendation")))).scalar()


def recommend(kwh: Column, cost: Column, rules: Column) -> Column:
    """Table rules (kWh rules first, then cost rules, each in file order,
    threshold <= value), then the dynamic advice, de-duplicated keeping the first
    occurrence; the default text if nothing applies."""
    arr = rules
    hit = F.filter(
        arr,
        lambda r: ((r["rank"] == 0) & (r["threshold_value"] <= kwh)) | ((r["rank"] == 1) & (r["threshold_value"] <= cost)),
    )
    table_texts = F.transform(hit, lambda r: r["recommendation"])
    dynamic = F.filter(
        F.array(
            F.when(kwh > 50, F.lit(fixed.ADVICE_HIGH_KWH)),
            F.when(cost > 800, F.lit(fixed.ADVICE_HIGH_COST)),
            F.when((kwh < 1) & (kwh > 0), F.lit(fixed.ADVICE_LOW_KWH)),
        ),
        lambda x: x.isNotNull(),
    )
    allx = F.array_distinct(F.concat(table_texts, dynamic))
    return F.when(F.size(allx) > 0, allx).otherwise(F.array(F.lit(fixed.ADVICE_DEFAULT)))


# --- N1 / N2: alert rules declared in data ----------------------------------

def alert_table(spark: SparkSession, rules=fixed.ALERT_RULES) -> DataFrame:
    rows = [(t, op, float(v), msg, pr, int(a), i) for i, (t, op, v, msg, pr, a) in enumerate(rules)]
    return spark.createDataFrame(
        rows,
        "notification_type string, op string, threshold double, message string, priority string, is_active int, rule_order int",
    )


def weekly_trend(daily: DataFrame, value_col: str = "energy_kwh") -> DataFrame:
    """Weekly total per room and % change vs the previous week (weeks start Monday).

    The ``lag`` window is per room over weekly rows (bounded by the calendar).
    """
    from pyspark.sql import Window

    wk = daily.groupBy("room", F.date_trunc("week", "date").cast("date").alias("week")).agg(
        exact.total(exact.units(F.col(value_col), exact.ENERGY)).alias("week_total")
    )
    w = Window.partitionBy("room").orderBy("week")
    prev = F.lag("week_total").over(w)
    prev_week = F.lag("week").over(w)
    wk = wk.withColumn("prev_total", prev).withColumn("prev_week", prev_week)
    consecutive = F.datediff("week", "prev_week") == 7
    # change in % to 2 places, exact half-up (away from zero) on integer kWh units
    cur, prv = F.col("week_total"), F.col("prev_total")
    diff = cur - prv
    mag = exact.ratio_units(F.abs(diff), prv, 0, 4)
    pct = F.when(consecutive & (prv > 0), F.signum(diff) * mag / F.lit(100.0) + F.lit(0.0))  # no negative zero
    out = wk.withColumn("change_pct", pct)
    text = (
        F.when(F.col("change_pct") > 0, F.replace(F.replace(F.lit(fixed.TREND_UP_TEXT), F.lit("{room}"), F.col("room")), F.lit("{value}"), F.col("change_pct").cast("string")))
        .when(F.col("change_pct") < 0, F.replace(F.replace(F.lit(fixed.TREND_DOWN_TEXT), F.lit("{room}"), F.col("room")), F.lit("{value}"), F.abs(F.col("change_pct")).cast("string")))
    )
    return out.select("room", "week", exact.units_rounded(F.col("week_total"), exact.ENERGY, 4).alias("week_total"), "change_pct", text.alias("message"))


_COMPARES = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t}


def _fires(value: Column, rule: Column) -> Column:
    out = F.lit(False)
    for op, compare in _COMPARES.items():
        out = F.when(rule["op"] == op, compare(value, rule["threshold"])).otherwise(out)
    return out


def alerts_multi(daily: DataFrame, alerts_df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """N1 for several kinds in one pass: ``kinds`` maps a notification type to
    its value column; one output row per (daily row, kind) that fires.

    A rule compares with its own ``op`` (``>``, ``>=``, ``<``, ``<=``); one without a comparison or
    a threshold never fires.  The strongest that fires counts: of upper bounds the highest, of lower
    bounds the lowest, upper before lower, then file order."""
    # one generator over the daily rows instead of a union of per-kind filters,
    # so the daily table is produced once
    packed_cols, fired_cols = {}, []
    for kind, col in kinds.items():
        usable = F.col("threshold").isNotNull() & F.col("op").isin(*_COMPARES)
        mine = alerts_df.where((F.col("notification_type") == kind) & (F.col("is_active") == 1) & usable)
        below = F.col("op").startswith("<")
        packed = F.struct(below.alias("below"), F.when(below, F.col("threshold")).otherwise(-F.col("threshold")).alias("reach"),
                          "rule_order", "threshold", "message", "priority", "op")
        packed_cols[f"_rules_{kind}"] = mine.agg(F.array_sort(F.collect_list(packed))).scalar()      # strongest first
        arr = F.col(f"_rules_{kind}")
        v = F.col(col)
        top = F.try_element_at(F.filter(arr, lambda r: _fires(v, r)), F.lit(1))
        fired_cols.append(F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"), top.alias("top")))
    d = daily.withColumns(packed_cols).select("room", "date", F.explode(F.array(*fired_cols)).alias("f")).where(F.col("f.top").isNotNull())
    value_txt = F.regexp_replace(F.format_number(F.col("f.value"), 2), ",", "")
    msg = F.replace(F.replace(F.replace(F.col("f.top.message"), F.lit("{room}"), F.col("room")), F.lit("{value}"), value_txt),
                    F.lit("{date}"), F.date_format("date", "yyyy-MM-dd"))
    return d.select("room", "date", F.col("f.value").alias("value"), F.col("f.top.threshold").alias("threshold"),
                    F.col("f.top.priority").alias("priority"), msg.alias("message"), F.col("f.kind").alias("kind"))
