"""Device payload text: rendering from readings and parsing.

The device answers with lines such as ``Voltage: 220.1 V`` ... ``Time:
MM/DD/YYYY HH:MM:SS``.  ``payload_text`` renders the reading view in that
format (FIXTURES.md §2.2: every 30th reading lacks the current and energy
lines, every 11th writes ``voltage:`` in lower case, some status lines vary or
are missing); ``parse_payload`` is the parser used by batch and streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.scalars import device_event_time, payload_number, payload_status, status_class


def payload_text(readings: DataFrame) -> DataFrame:
    i = F.col("id")
    ts = F.col("ts")
    uptime = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    text = F.concat_ws(
        "\n",
        F.when(i % 11 == 0, F.format_string("voltage: %.1f V", F.col("voltage")))
        .otherwise(F.format_string("Voltage: %.1f V", F.col("voltage"))),
        F.when(i % 30 != 0, F.concat(
            F.lit("Current: "), exact.fixed_text(exact.current_e6(F.col("power"), F.col("voltage")), 6), F.lit(" A"))),
        F.format_string("Power: %.2f W", F.col("power")),
        F.when(i % 30 != 0, F.format_string("Energy: %.5f kWh", F.col("energy_counter_kwh"))),
        F.format_string("Uptime: %d seconds", uptime),
        F.concat(F.lit("Light: "), F.col("light_state")),
        F.concat(F.lit("WiFi: "), F.when(i % 13 == 0, F.lit("Disconnected")).otherwise(F.lit("Connected"))),
        F.concat(F.lit("Cloud: "), F.when(i % 17 == 0, F.lit("Disconnected")).otherwise(F.lit("Connected"))),
        F.when(i % 23 != 0, F.concat(F.lit("SD Card: "), F.when(i % 19 == 0, F.lit("Failed")).otherwise(F.lit("OK")))),
        F.concat(F.lit("Time: "), F.date_format(ts, "MM/dd/yyyy HH:mm:ss")),
    )
    return readings.select("id", "room", text.alias("text"))


def parse_payload(df: DataFrame, text: str = "text", ingest_ts: Column | None = None) -> DataFrame:
    """F13/F14/F15 (+F24): numbers (absent -> null), status flags, device time.

    ``ingest_ts``: the time of a payload whose own time is absent or unreadable (without it: null; the
    parser reads no clock)."""
    t = F.col(text)
    fallback = ingest_ts if ingest_ts is not None else F.lit(None).cast("timestamp")
    st = payload_status(t)
    cols = {
        "voltage": payload_number(t, "voltage"),
        "current": payload_number(t, "current"),
        "power": payload_number(t, "power"),
        "energy_kwh": payload_number(t, "energy_kwh"),
        "uptime": payload_number(t, "uptime"),
        **st,
        "device_ts": device_event_time(t, fallback),
        "wifi_class": status_class(st["wifi"]),
        "cloud_class": status_class(st["cloud"]),
        "sd_class": status_class(st["sd_card"]),
    }
    return df.withColumns(cols)
