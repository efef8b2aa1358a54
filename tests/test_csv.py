"""BOM-prefixed headered CSV files load with explicit schemas."""

import datetime as dt

from wattline.operators import rules, schedule, tariff
from wattline.sources import csv


def test_bom_csv_sources(spark, tmp_path):
    (tmp_path / "rate.csv").write_text("﻿year,month,rate_per_kWh\n2024,11,6.7832\n2024,12,6.9671\n", encoding="utf-8")
    (tmp_path / "rules.csv").write_text("﻿threshold_type,threshold_value,recommendation\nenergy_kWh,5,A\nenergy_cost_Php,50,B\n",
                                        encoding="utf-8")
    (tmp_path / "tt.csv").write_text("﻿room,day,start_time,end_time,event_name\n705,Monday,07:30,08:30,X\n", encoding="utf-8")
    rates = csv.load_rates(spark, str(tmp_path / "rate.csv"))
    assert sorted((r["month"], r["rate"]) for r in rates.collect()) == [(dt.date(2024, 11, 1), 6.7832), (dt.date(2024, 12, 1), 6.9671)]
    assert tariff.series_summary(rates).first()["last_rate"] == 6.9671
    rl = csv.load_rules(spark, str(tmp_path / "rules.csv"))
    got = spark.range(1).select(rules.rules_array(rl).alias("r")).first()["r"]
    assert [(x["threshold_value"], x["recommendation"]) for x in got] == [(5.0, "A"), (50.0, "B")]
    tt = csv.load_timetable(spark, str(tmp_path / "tt.csv"))
    assert tt.first()["start_min"] == 450
    ticks = spark.createDataFrame([(1, "705", dt.datetime(2024, 3, 4, 8, 0))], "id long, room string, ts timestamp")
    assert schedule.schedule_at(ticks, tt).first()["class_event"] == "X"


def test_columns_by_header_name(spark, tmp_path):
    """Columns in any order, blanks and case in names, extra columns, files of different order, a missing column."""
    import pytest

    one, two = tmp_path / "the rates", tmp_path / "short.csv"
    one.mkdir()
    (one / "a.csv").write_text("\ufeffrate_per_kWh, Month ,year\n6.5,11,2024\n", encoding="utf-8")
    (one / "b.csv").write_text("year,month,note,rate_per_kWh\n2025,1,\"x, y\",7.25\n2025,bad,z,7.5\n", encoding="utf-8")
    (one / "empty.csv").write_text("", encoding="utf-8")
    got = sorted((r["month"], r["rate"]) for r in csv.load_rates(spark, str(one)).where("month is not null").collect())
    assert got == [(dt.date(2024, 11, 1), 6.5), (dt.date(2025, 1, 1), 7.25)]
    two.write_text("year,rate_per_kWh\n2024,6.5\n", encoding="utf-8")
    with pytest.raises(ValueError, match="month"):
        csv.load_rates(spark, str(two))
    with pytest.raises(FileNotFoundError):
        csv.load_rates(spark, str(tmp_path / "none.csv"))


def test_alert_file(spark, tmp_path):
    f = tmp_path / "alerts.csv"
    f.write_text("priority,notification_type,trigger_condition,message,is_active\nhigh,consumption,>15,Much {value},1\nlow,consumption,<=0.5,Little {value},1\n"
                 "low,consumption,weekly,No comparison,1\nlow,consumption,>1,Off,0\n", encoding="utf-8")
    alerts = csv.load_alerts(spark, str(f))
    assert [(r["op"], r["threshold"], r["rule_order"]) for r in alerts.orderBy("rule_order").collect()] == [(">", 15.0, 0), ("<=", 0.5, 1), ("", None, 2), (">", 1.0, 3)]
    daily = spark.createDataFrame([("1", dt.date(2024, 1, 1), 20.0), ("2", dt.date(2024, 1, 1), 0.5), ("3", dt.date(2024, 1, 1), 5.0)], "room string, date date, energy_kwh double")
    got = {r["room"]: (r["threshold"], r["message"]) for r in rules.alerts_multi(daily, alerts, {"consumption": "energy_kwh"}).collect()}
    assert got == {"1": (15.0, "Much 20.00"), "2": (0.5, "Little 0.50")}


def test_alert_comparisons(spark):
    """Each rule by its own comparison; null thresholds and unknown comparisons never fire; the strongest counts."""
    table = [("c", ">", 5.0), ("c", ">", 10.0), ("c", "<", 2.0), ("c", "<", 1.0), ("c", ">=", 10.0), ("c", None, 0.0), ("c", ">", None), ("c", "<=", -1.0)]
    alerts = spark.createDataFrame([(k, op, t, f"{op}{t}", "p", 1, i) for i, (k, op, t) in enumerate(table)],
                                   "notification_type string, op string, threshold double, message string, priority string, is_active int, rule_order int")
    values = {"a": 12.0, "b": 10.0, "c": 9.0, "d": 2.0, "e": 1.5, "f": 0.5, "g": -1.0, "h": None}
    daily = spark.createDataFrame([(k, dt.date(2024, 1, 1), v) for k, v in values.items()], "room string, date date, x double")
    got = {r["room"]: r["message"] for r in rules.alerts_multi(daily, alerts, {"c": "x"}).collect()}
    assert got == {"a": ">10.0", "b": ">=10.0", "c": ">5.0", "e": "<2.0", "f": "<1.0", "g": "<=-1.0"}
