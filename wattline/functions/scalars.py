"""Scalar column functions.

Every function maps Columns to a Column built from Spark's own expressions, so
it stays inside whole-stage codegen; nothing here runs Python per row.  ANSI
mode is assumed on: parsing uses the ``try_*`` family.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# Python's float() grammar (decimal, exponent, inf/nan, surrounding blanks).
# Spark's cast alone would also take '1d' / '1f' suffixes.
FLOAT_TEXT = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- F1 / F3 / F15: timestamps -------------------------------------------------

def parse_reading_ts(date_str: Column | str, time_str: Column | str) -> Column:
    """'Date' + 'Time' text -> timestamp, 12 h (AM/PM) first then 24 h.

    Empty parts or junk give null; so does a year outside 2020..2030.
    """
    d, t = F.trim(_c(date_str)), F.trim(_c(time_str))
    text = F.concat_ws(" ", d, t)
    # Only text ending in AM/PM can match the 12 h pattern and only text without
    # it the 24 h one, so the shape picks the pattern (a failed parse is costly).
    parsed = F.when(t.rlike(r"(?i)\s[ap]m$"), F.try_to_timestamp(text, F.lit("yyyy-M-d h:m:s a"))) \
        .otherwise(F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s")))
    ok = (F.length(d) > 0) & (F.length(t) > 0) & F.year(parsed).between(2020, 2030)
    return F.when(ok, parsed)


def coerce_ts(date_str: Column | str, time_str: Column | str | None = None) -> Column:
    """date [+ ' ' + time] -> timestamp; null when what is given does not parse."""
    d = F.trim(_c(date_str))
    date_only = (
        F.when(d.rlike("/"), F.try_to_timestamp(d, F.lit("M/d/yyyy")))
        .when(d.rlike(":"), F.try_to_timestamp(d, F.lit("yyyy-M-d H:m:s")))
        .otherwise(F.try_to_timestamp(d, F.lit("yyyy-M-d")))
    )
    if time_str is None:
        return date_only
    t = F.trim(_c(time_str))
    text = F.concat_ws(" ", d, t)
    # the text's shape picks the pattern; a failed parse is costly
    with_time = (
        F.when(t.rlike(r"(?i)\s[ap]m$"), F.try_to_timestamp(text, F.lit("yyyy-M-d h:m:s a")))
        .when(d.rlike("/"), F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")))
        .when(t.rlike("^[0-9]{1,2}:[0-9]{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy-M-d H:m")))
        .otherwise(F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s")))
    )
    return F.when(F.length(t) > 0, with_time).otherwise(date_only)


def device_event_time(text: Column | str, fallback: Column) -> Column:
    """'Time: MM/DD/YYYY HH:MM:SS' in the payload -> timestamp, else ``fallback``."""
    raw = F.regexp_extract(_c(text), r"Time:\s*([0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(raw, F.lit("MM/dd/yyyy HH:mm:ss")),
        F.try_to_timestamp(raw, F.lit("MM/dd/yyyy hh:mm:ss a")),
        fallback,
    )


# --- F2 / F4 / F5: numbers and keys ---------------------------------------------

def coerce_numeric(x: Column | str) -> Column:
    """text -> double, null when it is not a number (NaN text -> null)."""
    s = _c(x).cast("string")
    v = F.when(s.rlike(FLOAT_TEXT), F.trim(s).try_cast("double"))
    return F.nanvl(v, F.lit(None).cast("double"))          # one evaluation; NaN -> null


def safe_float(x: Column | str, default: float = 0.0) -> Column:
    """float or ``default``; a NaN text stays null (as the store keeps it)."""
    s = _c(x).cast("string")
    v = F.nanvl(F.trim(s).try_cast("double"), F.lit(None).cast("double"))   # one evaluation; NaN -> null
    return F.when(~s.rlike(FLOAT_TEXT) | s.isNull(), F.lit(default)).otherwise(v)


# --- F6-F12: calendar and room features ---------------------------------------

def weekday_mon0(d: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def is_weekend(d: Column | str) -> Column:
    return (weekday_mon0(d) >= 5).cast("int")


def calendar_features(d: Column | str) -> dict[str, Column]:
    """year, month, day, day_of_week (Mon=0), is_weekend."""
    c = _c(d)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "day_of_week": weekday_mon0(c),
        "is_weekend": is_weekend(c),
    }


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """sin/cos(2*pi*x/period)."""
    angle = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def floor_of_room(room: Column | str) -> Column:
    """first character of the trimmed room if it is a digit, else 0."""
    r = F.trim(_c(room).cast("string"))
    return F.when(r.rlike("^[0-9]"), F.substring(r, 1, 1).cast("int")).otherwise(F.lit(0))


def room_type_from_floor(floor: Column) -> Column:
    """F10 (training): floor 7 -> lab, else office."""
    return F.when(floor == 7, F.lit("lab")).otherwise(F.lit("office"))


def room_type_from_prefix(room: Column | str) -> Column:
    """F10 (prediction): room starting with '7' -> lab, else office."""
    return F.when(_c(room).cast("string").startswith("7"), F.lit("lab")).otherwise(F.lit("office"))


def room_type_label(room_type: Column, web: bool = False) -> Column:
    """Display label: Laboratory / Office (predictor) or Office/Classroom (dashboard)."""
    other = "Office/Classroom" if web else "Office"
    return F.when(room_type == "lab", F.lit("Laboratory")).otherwise(F.lit(other))


def room_type_numeric(room_type: Column) -> Column:
    """lab -> 1; lecture and anything else -> 0 (training and prediction agree)."""
    return F.when(room_type == "lab", F.lit(1)).otherwise(F.lit(0))


def quarter_hour_label(ts: Column | str) -> Column:
    """15-minute slot label 'HH:MM' within the day."""
    c = _c(ts)
    return F.format_string("%02d:%02d", F.hour(c), F.floor(F.minute(c) / 15).cast("int") * 15)


# --- F13 / F14 / F24: device payload ------------------------------------------

PAYLOAD_FIELDS = {
    "voltage": r"(?i)Voltage:\s*([0-9.]+)\s*V",
    "current": r"(?i)Current:\s*([0-9.]+)\s*A",
    "power": r"(?i)Power:\s*([0-9.]+)\s*W",
    "energy_kwh": r"(?i)Energy:\s*([0-9.]+)\s*kWh",
    "uptime": r"(?i)Uptime:\s*([0-9]+)\s*seconds",
}


def payload_number(text: Column | str, field: str) -> Column:
    """numeric field of the payload; absent (null) when the line is missing."""
    raw = F.regexp_extract(_c(text), PAYLOAD_FIELDS[field], 1)
    return F.nullif(raw, F.lit("")).try_cast("double")


def payload_status(text: Column | str) -> dict[str, Column]:
    """literal, case-sensitive flags."""
    t = _c(text)
    return {
        "light_state": F.when(t.contains("Light: ON"), F.lit("ON")).otherwise(F.lit("OFF")),
        "wifi": F.when(t.contains("WiFi: Connected"), F.lit("Connected")).otherwise(F.lit("Disconnected")),
        "cloud": F.when(t.contains("Cloud: Connected"), F.lit("Connected")).otherwise(F.lit("Disconnected")),
        "sd_card": F.when(t.contains("SD Card: OK"), F.lit("OK"))
        .when(t.contains("SD Card: Failed"), F.lit("Failed"))
        .otherwise(F.lit("Unknown")),
    }


def status_class(status: Column) -> Column:
    """chip colour class."""
    return (
        F.when(status.isin("Connected", "OK"), F.lit("ok"))
        .when(status.isin("Disconnected", "Failed"), F.lit("err"))
        .otherwise(F.lit("warn"))
    )


def confidence_class(conf: Column) -> Column:
    """>80 high, >60 medium, else low."""
    return F.when(conf > 80, F.lit("high")).when(conf > 60, F.lit("medium")).otherwise(F.lit("low"))


# --- F16-F22: prediction arithmetic ------------------------------------------

def week_of_month_factor(day: Column, fallback: bool = False) -> Column:
    """F16: model path .98/1.0/1.02/.97; fallback path .95/1.0/1.05/.9 by day of month."""
    a, b, c, d = (0.95, 1.0, 1.05, 0.9) if fallback else (0.98, 1.0, 1.02, 0.97)
    return (
        F.when(day <= 7, F.lit(a)).when(day <= 14, F.lit(b)).when(day <= 21, F.lit(c)).otherwise(F.lit(d))
    )


def season_factor(month: Column) -> Column:
    """May-Aug x1.2, Nov-Feb x0.8, else x1."""
    return (
        F.when(month.isin(5, 6, 7, 8), F.lit(1.2))
        .when(month.isin(11, 12, 1, 2), F.lit(0.8))
        .otherwise(F.lit(1.0))
    )


def clamp(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """max(lo, min(hi, x))."""
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    return x


def months_between_index(later: Column, earlier: Column) -> Column:
    """(y2 - y1) * 12 + (m2 - m1)."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def minutes_of_day(hhmm: Column) -> Column:
    """'HH:MM' -> minutes since midnight (null for other text)."""
    parts = F.split(hhmm, ":")
    return F.get(parts, 0).try_cast("int") * 60 + F.get(parts, 1).try_cast("int")


def hhmm(minutes: Column) -> Column:
    """minutes since midnight -> 'HH:MM'."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def prediction_id(room: Column, d: Column) -> Column:
    """'{room}_{yyyyMMdd}'."""
    return F.concat(room, F.lit("_"), F.date_format(d, "yyyyMMdd"))


def day_name(d: Column) -> Column:
    """English weekday name."""
    names = F.array(*[F.lit(n) for n in fixed.WEEKDAY_NAMES])
    return F.element_at(names, weekday_mon0(d) + 1)
