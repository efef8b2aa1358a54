"""DuckDB oracle SQL for the registered queries (same names, same columns).

The oracle states each query plainly — single-level windows, correlated
subqueries — over the driver's views; the Spark plans are the scalable form.
"""

from __future__ import annotations

from .present import sql_date, sql_ts


# Exact arithmetic in DuckDB's own DECIMAL and HUGEINT; stored: decimals the log keeps.

def counted(expr: str, stored: int) -> str:
    """Sum of a column in whole units of its last stored decimal."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,{stored}))) * {10 ** stored} AS HUGEINT)"


def ratio_shown(num: str, den: str, stored: int, shown: int) -> str:
    """num / den rounded half up to ``shown`` decimals; num in units of the stored decimal."""
    up, down = 10 ** max(0, shown - stored), 10 ** max(0, stored - shown)
    return (f"(CASE WHEN {den} > 0 THEN CAST((2 * ({num}) * {up} + {den} * {down}) // (2 * {den} * {down}) AS DOUBLE)"
            f" / {float(10 ** shown)} END)")


def mean_shown(expr: str, stored: int, shown: int) -> str:
    return ratio_shown(counted(expr, stored), f"count({expr})", stored, shown)


def shown(expr: str, stored: int, places: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(18,{stored})), {places}) AS DOUBLE)"


def spread_shown(expr: str, stored: int, places: int) -> str:
    d = f"CAST({expr} AS DECIMAL(18,{stored}))"
    return f"CAST(round(max({d}) - min({d}), {places}) AS DOUBLE)"

ORACLE: dict[str, str] = {}

# The reading log view (FIXTURES.md §2.1), without and with the meter counter.
READINGS_BASE = r"""
readings_base AS (
  SELECT event_id AS id, ts,
         CAST(100 * (1 + user_id % 7) + 1 + user_id % 11 AS VARCHAR) AS room,
         220 + (TRY_CAST(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+)', 1) AS INTEGER) - 50) / 10 + (event_id % 9) * 0.0111::DOUBLE AS voltage,
         (value / 3) / (220 + (TRY_CAST(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+)', 1) AS INTEGER) - 50) / 10 + (event_id % 9) * 0.0111::DOUBLE) AS current,
         value / 3 AS power,
         value / 3000 AS energy_kwh,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'ON' ELSE 'OFF' END AS light_state,
         event_type
  FROM events)"""

READINGS = READINGS_BASE + r""",
readings AS (
  SELECT id, ts, room, voltage, current, power, energy_kwh,
         round(sum(energy_kwh) OVER (PARTITION BY room ORDER BY ts, id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS energy_counter_kwh,
         light_state, event_type
  FROM readings_base)"""


def with_readings(body: str, extra_ctes: str = "") -> str:
    ctes = READINGS + ("," + extra_ctes if extra_ctes else "")
    return "WITH " + ctes + "\n" + body


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# --- rollups over the reading log -------------------------------------------

oracle("hourly_rollup", with_readings(f"""
SELECT room, {sql_ts("date_trunc('hour', ts)")} AS hour,
       {mean_shown('voltage', 4, 4)} AS avg_voltage,
       {mean_shown('current', 6, 6)} AS avg_current,
       {mean_shown('power', 4, 4)} AS avg_power,
       {spread_shown('energy_counter_kwh', 8, 8)} AS energy_consumed,
       count(*) AS n_readings
FROM readings GROUP BY room, date_trunc('hour', ts)"""))

oracle("power_15min", with_readings(f"""
SELECT room, {sql_date('ts')} AS date,
       printf('%02d:%02d', hour(ts), (minute(ts) // 15) * 15) AS slot,
       {mean_shown('power', 4, 2)} AS avg_power,
       count(*) AS n_readings
FROM readings_base GROUP BY ALL"""))

oracle("day_summary", with_readings(f"""
SELECT room, {sql_date('ts')} AS date,
       {mean_shown('power', 4, 2)} AS avg_power,
       {shown('max(power)', 4, 2)} AS max_power,
       {mean_shown('voltage', 4, 2)} AS avg_voltage,
       {mean_shown('current', 6, 6)} AS avg_current,
       {spread_shown('energy_counter_kwh', 8, 4)} AS total_energy,
       count(*) AS data_points
FROM readings GROUP BY ALL"""))

oracle("available_dates", with_readings(f"""
SELECT DISTINCT room, {sql_date('ts')} AS date FROM readings_base"""))

oracle("rooms_with_data", with_readings("""
SELECT DISTINCT room FROM readings_base WHERE room IS NOT NULL
UNION ALL SELECT '705' WHERE NOT EXISTS (SELECT 1 FROM readings_base WHERE room IS NOT NULL)"""))

oracle("room_counts", with_readings("""
SELECT room, count(*) AS n_rows FROM readings_base GROUP BY room"""))

oracle("weekday_power", with_readings(f"""
SELECT room, CAST(isodow(ts) - 1 AS BIGINT) AS weekday,
       {mean_shown('power', 4, 2)} AS avg_power, count(*) AS n_rows
FROM readings_base GROUP BY ALL"""))

oracle("latest_reading", with_readings(f"""
SELECT room, {sql_ts('ts')} AS ts, {shown('voltage', 4, 2)} AS voltage, round(current, 6) AS current,
       {shown('power', 4, 2)} AS power,
       {shown('energy_counter_kwh', 8, 3)} AS energy_kwh,
       light_state
FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY ts DESC, id DESC) AS rn FROM readings)
WHERE rn = 1"""))

oracle("nearest_available_date", with_readings(f"""
SELECT q.room, {sql_date('q.d')} AS requested,
       {sql_date("coalesce((SELECT max(a.d) FROM avail a WHERE a.room = q.room AND a.d <= q.d), q.lo)")} AS resolved
FROM req q""", """
avail AS (SELECT DISTINCT room, CAST(ts AS DATE) AS d FROM readings_base),
bounds AS (SELECT room, min(d) AS lo, max(d) AS hi FROM avail GROUP BY room),
req AS (SELECT room, lo, CAST(unnest(generate_series(lo - INTERVAL 2 DAY, hi + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS d
        FROM bounds)"""))


# --- profile forecast ----------------------------------------------------------

PROFILE_CTES = """
stats AS (SELECT room, isodow(ts) - 1 AS wd, hour(ts) AS h, count(power) AS n,
                 CAST(sum(CAST(power AS DECIMAL(18,4))) * 10000 AS HUGEINT) AS s
          FROM readings_base GROUP BY ALL),
dow AS (SELECT room, wd, sum(n) AS n_same, sum(s) AS s_same FROM stats GROUP BY ALL),
allh AS (SELECT room, h, sum(n) AS n_all, sum(s) AS s_all FROM stats GROUP BY ALL),
lastd AS (SELECT CAST(max(ts) AS DATE) AS d FROM readings_base),
targets AS (SELECT r.room, CAST(l.d + t.i * INTERVAL 1 DAY AS DATE) AS date
            FROM (SELECT DISTINCT room FROM readings_base) r, lastd l, generate_series(1, 7) t(i)),
grid AS (
  SELECT t.room, t.date, isodow(t.date) - 1 AS wd, hh.h,
         coalesce(d.n_same, 0) AS n_same, coalesce(d.s_same, 0) AS s_same,
         coalesce(a.n_all, 0) + coalesce(sm.n, 0) AS de,
         coalesce(a.s_all, 0) + coalesce(sm.s, 0) AS nu
  FROM targets t CROSS JOIN generate_series(0, 23) hh(h)
  LEFT JOIN dow d ON d.room = t.room AND d.wd = isodow(t.date) - 1
  LEFT JOIN allh a ON a.room = t.room AND a.h = hh.h
  LEFT JOIN stats sm ON sm.room = t.room AND sm.wd = isodow(t.date) - 1 AND sm.h = hh.h),
hp AS (
  SELECT *, (n_same = 0 OR s_same < n_same * 50000) AS is_zero_day,
         CASE WHEN de > 0 THEN (2 * nu + de * 100) // (200 * de)
              WHEN n_same > 0 THEN (2 * s_same + n_same * 100) // (200 * n_same) ELSE 0 END AS cw_weighted
  FROM grid),
hp2 AS (SELECT *, CASE WHEN is_zero_day THEN 0 ELSE cw_weighted END AS cw FROM hp),
hp3 AS (SELECT *, (cw + 5) // 10 AS kwh_e4 FROM hp2),
per_day AS (
  SELECT room, date, any_value(is_zero_day) AS is_zero_day, any_value(n_same) AS n_same,
         sum(kwh_e4) AS u, max(cw) AS peak_cw, arg_min(h, -cw * 100 + h) AS peak_hour
  FROM hp3 GROUP BY room, date),
pd2 AS (
  SELECT *, (u * 2200 + 10000) // 20000 AS c, peak_cw // 100 AS q, peak_cw % 100 AS r,
         ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(date)] AS dname
  FROM per_day),
rows_used AS (SELECT room, count(*) AS historical_rows_used FROM readings_base GROUP BY room)"""

oracle("weekday_zero_day", with_readings("""
SELECT g.room, CAST(g.wd AS BIGINT) AS weekday,
       CASE WHEN coalesce(d.n_same, 0) > 0 THEN CAST((2 * d.s_same + d.n_same * 100) // (200 * d.n_same) AS DOUBLE) / 100.0 ELSE 0.0 END AS dow_avg_power,
       CAST(coalesce(d.n_same, 0) AS BIGINT) AS n_rows,
       CAST((coalesce(d.n_same, 0) = 0 OR d.s_same < d.n_same * 50000) AS BIGINT) AS is_zero_day
FROM (SELECT DISTINCT room, w.wd FROM readings_base, generate_series(0, 6) w(wd)) g
LEFT JOIN dow d ON d.room = g.room AND d.wd = g.wd""", PROFILE_CTES))

oracle("weighted_hour_profile", with_readings("""
SELECT room, CAST(wd AS BIGINT) AS weekday, CAST(h AS BIGINT) AS hour,
       CAST(cw_weighted AS DOUBLE) / 100.0 AS avg_w, CAST(is_zero_day AS BIGINT) AS is_zero_day
FROM hp""", PROFILE_CTES))

oracle("predict_profile", with_readings("""
SELECT p.room, strftime(p.date, '%Y-%m-%d') AS date, dname AS day_of_week,
       CASE WHEN starts_with(p.room, '7') THEN 'Laboratory' ELSE 'Office/Classroom' END AS room_type,
       CAST(is_zero_day AS BIGINT) AS is_zero_day,
       u / 10000.0 AS total_daily_kwh, 11.0::DOUBLE AS predicted_rate,
       c / 100.0 AS total_cost_php,
       CAST((u * 2 + 24) // 48 AS DOUBLE) / 10000.0 AS avg_hourly_kwh,
       CAST((c * 2 + 24) // 48 AS DOUBLE) / 100.0 AS avg_hourly_cost_php,
       CAST(CASE WHEN is_zero_day THEN 95 ELSE least(95, 60 + n_same // 10) END AS BIGINT) AS confidence,
       CAST(peak_hour AS BIGINT) AS peak_hour, peak_cw / 100.0 AS peak_power_w,
       CASE WHEN is_zero_day THEN
              dname || 's show no energy consumption in historical data. | '
              || 'No classes or activities are scheduled on this day of the week. | Predicted consumption: 0 kWh.'
            ELSE coalesce(nullif(concat_ws(' | ',
              CASE WHEN peak_cw > 50000 THEN printf('Peak usage expected around %02d:00 (%d W).', peak_hour,
                   q + CASE WHEN r > 50 OR (r = 50 AND q % 2 = 1) THEN 1 ELSE 0 END) END,
              CASE WHEN u > 50000 THEN 'Projected ' || CAST(u / 10000.0 AS VARCHAR) || ' kWh — consider turning off AC during unscheduled hours.' END,
              CASE WHEN u <= 10000 THEN 'Low energy day projected based on historical patterns.' END), ''),
              'Normal ' || dname || ' usage projected.') END AS recommendations,
       CAST(coalesce(ru.historical_rows_used, 0) AS BIGINT) AS historical_rows_used,
       CASE WHEN (CASE WHEN is_zero_day THEN 95 ELSE least(95, 60 + n_same // 10) END) > 80 THEN 'high'
            WHEN (CASE WHEN is_zero_day THEN 95 ELSE least(95, 60 + n_same // 10) END) > 60 THEN 'medium'
            ELSE 'low' END AS confidence_class
FROM pd2 p LEFT JOIN rows_used ru ON ru.room = p.room""", PROFILE_CTES))

oracle("predict_profile_hourly", with_readings("""
SELECT room, strftime(date, '%Y-%m-%d') AS date, CAST(h AS BIGINT) AS hour,
       cw / 100.0 AS power_w, kwh_e4 / 10000.0 AS kwh
FROM hp3""", PROFILE_CTES))


# --- daily features -----------------------------------------------------------

TRAINING = r"""
training AS (
  SELECT CAST(100 * (1 + l_suppkey % 7) + 1 + l_suppkey % 11 AS VARCHAR) AS room,
         l_shipdate AS ts, l_quantity / 3 AS energy_kwh,
         CASE l_returnflag WHEN 'A' THEN 'lab' WHEN 'N' THEN 'lecture' ELSE 'office' END AS room_type,
         216 + l_tax * 100 AS voltage, l_discount * 100 AS current
  FROM lineitem),
mode_rt AS (
  SELECT room, date, room_type FROM (
    SELECT room, CAST(ts AS DATE) AS date, room_type,
           row_number() OVER (PARTITION BY room, CAST(ts AS DATE) ORDER BY count(*) DESC, room_type) AS rn
    FROM training GROUP BY room, CAST(ts AS DATE), room_type) WHERE rn = 1),
daily0 AS (
  SELECT room, CAST(ts AS DATE) AS date,
         CAST(sum(CAST(energy_kwh AS DECIMAL(18,8))) AS DOUBLE) AS energy_kwh,
         """ + mean_shown("voltage", 4, 4) + r""" AS voltage,
         """ + mean_shown("current", 6, 4) + r""" AS current
  FROM training GROUP BY room, CAST(ts AS DATE)),
daily AS (
  SELECT d.room, d.date, d.energy_kwh, d.voltage, d.current, m.room_type,
         year(d.date) AS year, month(d.date) AS month, day(d.date) AS day,
         isodow(d.date) - 1 AS day_of_week,
         CASE WHEN isodow(d.date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         round(sin(2 * pi() * month(d.date) / 12), 10) AS month_sin,
         round(cos(2 * pi() * month(d.date) / 12), 10) AS month_cos,
         CASE WHEN regexp_matches(trim(d.room), '^[0-9]') THEN CAST(substr(trim(d.room), 1, 1) AS INTEGER) ELSE 0 END AS floor
  FROM daily0 d JOIN mode_rt m ON m.room = d.room AND m.date = d.date),
allowed AS (
  SELECT CAST(r AS VARCHAR) AS room FROM generate_series(101, 111) t(r)
  UNION ALL SELECT CAST(r AS VARCHAR) FROM generate_series(701, 705) t(r)),
in_ranges AS (
  SELECT * FROM daily
  WHERE (floor = 1 AND TRY_CAST(room AS INTEGER) BETWEEN 101 AND 111)
     OR (floor = 7 AND TRY_CAST(room AS INTEGER) BETWEEN 701 AND 705))"""


def with_training(body: str, extra: str = "") -> str:
    return with_readings(body, TRAINING + ("," + extra if extra else ""))


oracle("daily_features", with_training("""
SELECT room, strftime(date, '%Y-%m-%d') AS date, energy_kwh, voltage, current, room_type,
       CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CAST(day AS BIGINT) AS day,
       CAST(day_of_week AS BIGINT) AS day_of_week, CAST(is_weekend AS BIGINT) AS is_weekend,
       month_sin, month_cos, CAST(floor AS BIGINT) AS floor
FROM daily"""))

oracle("dataset_summary", with_training("""
SELECT count(*) AS n_records, strftime(min(date), '%Y-%m-%d') AS date_min, strftime(max(date), '%Y-%m-%d') AS date_max,
       count(DISTINCT room) AS n_rooms, count(DISTINCT floor) AS n_floors,
       CAST(round(sum(CAST(energy_kwh AS DECIMAL(18,8))), 2) AS DOUBLE) AS total_energy,
       """ + mean_shown("energy_kwh", 8, 4) + """ AS mean_energy,
       round(min(energy_kwh), 4) AS min_energy, round(max(energy_kwh), 4) AS max_energy,
       (SELECT round(avg(m), 4) FROM (SELECT avg(energy_kwh) AS m FROM daily GROUP BY room)) AS mean_room_daily_energy
FROM daily"""))

oracle("floor_summary", with_training("""
SELECT CAST(floor AS BIGINT) AS floor, count(*) AS n_records, count(DISTINCT room) AS n_rooms,
       """ + mean_shown("energy_kwh", 8, 4) + """ AS mean_energy
FROM daily GROUP BY floor"""))

oracle("rooms_by_floor", with_training("""
SELECT CAST(floor AS BIGINT) AS floor, count(*) AS n_rooms,
       array_to_string(list_slice(list_sort(list(room)), 1, 5), ', ')
       || CASE WHEN count(*) > 5 THEN printf(', ... (+%d more)', count(*) - 5) ELSE '' END AS sample
FROM (SELECT DISTINCT floor, room FROM daily) GROUP BY floor"""))

oracle("weekday_distribution", with_training("""
SELECT CAST(w.wd AS BIGINT) AS weekday,
       ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][w.wd + 1] AS day_name,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_records,
       CAST((2 * coalesce(c.n, 0) * 1000 + t.total) // (2 * t.total) AS DOUBLE) / 10.0 AS pct
FROM generate_series(0, 6) w(wd)
LEFT JOIN (SELECT day_of_week, count(*) AS n FROM daily GROUP BY ALL) c ON c.day_of_week = w.wd
CROSS JOIN (SELECT count(*) AS total FROM daily) t"""))

oracle("weekend_coverage", with_training("""
SELECT count(*) AS n_records, count(*) FILTER (WHERE day_of_week >= 5) AS n_weekend,
       CASE WHEN count(*) FILTER (WHERE day_of_week >= 5) = 0 THEN 'none'
            WHEN count(*) FILTER (WHERE day_of_week >= 5) * 10 < count(*) THEN 'limited' ELSE 'ok' END AS status
FROM daily"""))

oracle("filter_floors", with_training("""
SELECT room, strftime(date, '%Y-%m-%d') AS date, CAST(floor AS BIGINT) AS floor, energy_kwh
FROM daily WHERE floor IN (1, 7)"""))

oracle("filter_room_ranges", with_training("""
SELECT room, strftime(date, '%Y-%m-%d') AS date, CAST(floor AS BIGINT) AS floor, energy_kwh FROM in_ranges"""))

oracle("prediction_rooms", with_training("""
SELECT DISTINCT room, CAST(room AS INTEGER)::BIGINT AS room_no FROM in_ranges"""))

oracle("room_union", with_training("""
SELECT room, TRY_CAST(room AS INTEGER)::BIGINT AS room_no FROM (
  SELECT DISTINCT room FROM readings_base WHERE room IS NOT NULL UNION SELECT room FROM allowed)"""))

oracle("room_intersect", with_training("""
SELECT room, CAST(room AS INTEGER)::BIGINT AS room_no FROM (
  SELECT DISTINCT room FROM daily WHERE room IN (SELECT room FROM allowed)
  UNION ALL SELECT room FROM allowed WHERE NOT EXISTS (SELECT 1 FROM daily WHERE room IN (SELECT room FROM allowed)))"""))

oracle("label_encode_room", with_training("""
SELECT r.room, CAST(coalesce(d.idx, (SELECT count(*) FROM dic)) AS BIGINT) AS room_encoded
FROM (SELECT DISTINCT room FROM readings_base) r LEFT JOIN (
  SELECT room, dense_rank() OVER (ORDER BY room) - 1 AS idx FROM dic) d ON d.room = r.room""",
  "dic AS (SELECT DISTINCT room FROM in_ranges)"))

oracle("training_matrix", with_training("""
SELECT d.room, strftime(d.date, '%Y-%m-%d') AS date,
       CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CAST(day AS BIGINT) AS day,
       CAST(day_of_week AS BIGINT) AS day_of_week, CAST(is_weekend AS BIGINT) AS is_weekend,
       month_sin, month_cos,
       round(sin(2 * pi() * day / 31), 10) AS day_sin, round(cos(2 * pi() * day / 31), 10) AS day_cos,
       CAST(quarter(d.date) AS BIGINT) AS quarter, CAST(0 AS BIGINT) AS is_holiday, CAST(floor AS BIGINT) AS floor,
       CAST(CASE WHEN room_type = 'lab' THEN 1 ELSE 0 END AS BIGINT) AS room_type_numeric,
       CAST(e.idx AS BIGINT) AS room_encoded, energy_kwh,
       CASE WHEN ('0x' || substr(md5(d.room || '|' || strftime(d.date, '%Y-%m-%d')), 1, 8))::BIGINT % 10 < 2
            THEN 'test' ELSE 'train' END AS split
FROM daily d JOIN (SELECT room, dense_rank() OVER (ORDER BY room) - 1 AS idx FROM (SELECT DISTINCT room FROM daily)) e
  ON e.room = d.room"""))


_SPLIT = "('0x' || substr(md5(room || '|' || strftime(date, '%Y-%m-%d')), 1, 8))::BIGINT % 10 < 2"

oracle("kwh_model_check", with_training(f"""
SELECT count(*) FILTER (WHERE {_SPLIT}) AS n,
       'year,month,day,day_of_week,is_weekend,month_sin,month_cos,day_sin,day_cos,quarter,is_holiday,floor,room_type_numeric,room_encoded' AS features,
       count(DISTINCT room) FILTER (WHERE NOT {_SPLIT}) AS rooms, 1::BIGINT AS same_when_loaded, 1::BIGINT AS top_in_order,
       1::BIGINT AS mae_below_rmse, 1::BIGINT AS has_r2, 1.0::DOUBLE AS importances, 14::BIGINT AS n_importances
FROM daily"""))


# --- tariff series -----------------------------------------------------------------

TARIFF = r"""
tariff AS (
  SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         """ + mean_shown("o_totalprice", 2, 0) + r""" / 10000.0 AS rate
  FROM orders
  GROUP BY ALL),
t_ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS rn FROM tariff WHERE rate IS NOT NULL),
t_summ AS (
  SELECT series, count(*) AS n_rows, max(month) AS last_month, arg_max(rate, month) AS last_rate,
         count(*) FILTER (WHERE rn <= 12) AS n_recent,
         arg_min(rate, month) FILTER (WHERE rn <= 12) AS first_recent
  FROM t_ranked GROUP BY series),
t_summ2 AS (SELECT *, CASE WHEN n_recent >= 2 THEN (last_rate - first_recent) / (n_recent - 1) END AS trend FROM t_summ)"""


def with_tariff(body: str, extra: str = "") -> str:
    return "WITH " + TARIFF + ("," + extra if extra else "") + "\n" + body


oracle("monthly_tariff", with_tariff("SELECT series, strftime(month, '%Y-%m-%d') AS month, rate FROM tariff"))

oracle("fill_month_grid", with_tariff("""
SELECT g.series, strftime(g.month, '%Y-%m-%d') AS month, t.rate
FROM (SELECT series, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
      FROM tariff GROUP BY series) g
LEFT JOIN tariff t ON t.series = g.series AND t.month = g.month"""))

oracle("recent_trend", with_tariff("""
SELECT series, n_rows, strftime(last_month, '%Y-%m-%d') AS last_month, last_rate, n_recent, first_recent,
       round(trend, 8) AS trend
FROM t_summ2"""))

oracle("extrapolate_rate", with_tariff("""
SELECT series, strftime(date, '%Y-%m-%d') AS date, round(
  CASE WHEN n_rows < 2 THEN 11.0 WHEN n_recent < 2 THEN last_rate
       ELSE greatest(least(last_rate + trend * ((year(date) - year(last_month)) * 12 + month(date) - month(last_month))
                           + sin(2 * pi() * month(date) / 12.0) * 0.3, 15.0), 10.0) END, 6) AS rate
FROM (SELECT s.*, CAST(s.last_month + h.h * INTERVAL 1 MONTH AS DATE) AS date
      FROM t_summ2 s, generate_series(1, 24) h(h))"""))

oracle("rate_for_date", with_tariff("""
SELECT d.series, strftime(d.date, '%Y-%m-%d') AS date, coalesce(t.rate, s.last_rate, 11.0) AS rate
FROM dates d
LEFT JOIN tariff t ON t.series = d.series AND t.month = CAST(date_trunc('month', d.date) AS DATE)
LEFT JOIN t_summ2 s ON s.series = d.series""", """
dates AS (
  SELECT series, CAST(m + INTERVAL 14 DAY AS DATE) AS date FROM (
    SELECT series, unnest(generate_series(min(month) - INTERVAL 3 MONTH, max(month) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS m
    FROM tariff GROUP BY series))"""))


# --- deterministic predictions and rules -------------------------------------------

from .. import fixed  # noqa: E402
from ..operators.predict import PATTERN_E3  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_recommend(k: str, c: str) -> str:
    """J3 in SQL over kWh in 1e-4 units (k) and cost in centavos (c)."""
    parts = []
    for t, v, txt in fixed.RECOMMENDATION_RULES:
        if t == "energy_kWh":
            parts.append(f"CASE WHEN {k} >= {int(v * 10000)} THEN {_q(txt)} END")
    for t, v, txt in fixed.RECOMMENDATION_RULES:
        if t == "energy_cost_Php":
            parts.append(f"CASE WHEN {c} >= {int(v * 100)} THEN {_q(txt)} END")
    parts.append(f"CASE WHEN {k} > 500000 THEN {_q(fixed.ADVICE_HIGH_KWH)} END")
    parts.append(f"CASE WHEN {c} > 80000 THEN {_q(fixed.ADVICE_HIGH_COST)} END")
    parts.append(f"CASE WHEN {k} < 10000 AND {k} > 0 THEN {_q(fixed.ADVICE_LOW_KWH)} END")
    return f"coalesce(nullif(concat_ws(' | ', {', '.join(parts)}), ''), {_q(fixed.ADVICE_DEFAULT)})"


_LAB = "[" + ",".join(map(str, PATTERN_E3["lab"])) + "]"
_OFFICE = "[" + ",".join(map(str, PATTERN_E3["office"])) + "]"

PRED = """
one_series AS (SELECT min(series) AS series FROM tariff),
prooms AS (SELECT DISTINCT room FROM in_ranges),
grid0 AS (SELECT p.room, CAST(unnest(generate_series((SELECT min(date) FROM daily), (SELECT max(date) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date
          FROM prooms p),
grid AS (SELECT s.series, g.room, g.date, coalesce(u.rate, s.last_rate, 11.0) AS rate
         FROM grid0 g CROSS JOIN t_summ2 s
         LEFT JOIN tariff u ON u.series = s.series AND u.month = CAST(date_trunc('month', g.date) AS DATE)),
calc AS (SELECT *, CASE WHEN starts_with(room, '7') THEN 'lab' ELSE 'office' END AS rt, isodow(date) - 1 AS wd,
                month(date) AS mo, day(date) AS dd, CAST(round(rate * 10000) AS BIGINT) AS r FROM grid),
calc2 AS (SELECT *,
  (CASE WHEN rt = 'lab' THEN 25 ELSE 15 END)
    * (CASE WHEN mo IN (5, 6, 7, 8) THEN 120 WHEN mo IN (11, 12, 1, 2) THEN 80 ELSE 100 END) AS base_season,
  CASE WHEN dd <= 7 THEN 95 WHEN dd <= 14 THEN 100 WHEN dd <= 21 THEN 105 ELSE 90 END AS w100 FROM calc),
calc3 AS (SELECT *, CAST(CASE WHEN wd = 6 THEN 0 WHEN wd = 5 THEN CASE WHEN rt = 'lab' THEN 15000 ELSE 10000 END
                 ELSE greatest(base_season * w100, 5000) END AS BIGINT) AS k FROM calc2),
pred AS (SELECT *, CASE WHEN wd = 6 THEN 0 ELSE (k * r * 2 + 1000000) // 2000000 END AS c FROM calc3)"""

DAYNAMES = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"


def with_pred(body: str, extra: str = "") -> str:
    return with_readings(body, TRAINING + "," + TARIFF + "," + PRED + ("," + extra if extra else ""))


PRED_SELECT = f"""
SELECT series, room, strftime(date, '%Y-%m-%d') AS date, rate, {DAYNAMES}[wd + 1] AS day_name,
       CASE WHEN rt = 'lab' THEN 'Laboratory' ELSE 'Office' END AS room_type,
       CAST(wd >= 5 AS BIGINT) AS is_weekend,
       CAST((k + 50) // 100 AS DOUBLE) / 100.0 AS total_daily_kwh,
       CAST((k * 2 + 240) // 480 AS DOUBLE) / 1000.0 AS avg_hourly_kwh,
       CAST((r + 50) // 100 AS DOUBLE) / 100.0 AS predicted_rate,
       c / 100.0 AS total_cost_php,
       CAST((c * 2 + 24) // 48 AS DOUBLE) / 100.0 AS avg_hourly_cost_php,
       CASE WHEN wd = 6 THEN {_q(fixed.ADVICE_SUNDAY)} WHEN wd = 5 THEN {_q(fixed.ADVICE_SATURDAY)}
            ELSE {sql_recommend('k', 'c')} END AS recommendations,
       CAST(dd AS BIGINT) AS day_of_month,
       CASE WHEN wd < 5 THEN room || '_' || strftime(date, '%Y%m%d') END AS prediction_id
FROM pred"""

oracle("predict_range", with_pred(PRED_SELECT))
oracle("predict_weekend", with_pred(PRED_SELECT + " WHERE wd >= 5"))

oracle("predict_model_check", with_pred("""
SELECT series, CAST(wd >= 5 AS BIGINT) AS is_weekend, count(*) AS n, count(DISTINCT room) AS rooms, count(DISTINCT date) AS days,
       count(*) AS n_not_negative, count(*) AS n_kwh, count(*) AS n_cost, count(*) AS n_advised
FROM pred GROUP BY ALL"""))

oracle("predict_fallback_kwh", with_pred("""
SELECT room, strftime(date, '%Y-%m-%d') AS date, rt AS room_type,
       CAST(greatest(base_season * w100, 5000) AS DOUBLE) / 10000.0 AS kwh FROM calc2 WHERE series = (FROM one_series)"""))

oracle("predict_last_resort", with_pred(f"""
SELECT room, strftime(date, '%Y-%m-%d') AS date, {DAYNAMES}[wd + 1] AS day_name,
       CASE WHEN rt = 'lab' THEN 'Laboratory' ELSE 'Office' END AS room_type, CAST(0 AS BIGINT) AS is_weekend,
       CAST((kk + 50) // 100 AS DOUBLE) / 100.0 AS total_daily_kwh,
       CAST((kk * 2 + 240) // 480 AS DOUBLE) / 1000.0 AS avg_hourly_kwh,
       11.0::DOUBLE AS predicted_rate,
       ((kk * 110000 * 2 + 1000000) // 2000000) / 100.0 AS total_cost_php,
       CAST((((kk * 110000 * 2 + 1000000) // 2000000) * 2 + 24) // 48 AS DOUBLE) / 100.0 AS avg_hourly_cost_php,
       {_q(fixed.ADVICE_FALLBACK_MODE)} AS recommendations,
       printf('%d-%d-%d', year(date), month(date), day(date)) AS date_text
FROM (SELECT *, CAST(base_season * 100 AS BIGINT) AS kk FROM calc2 WHERE series = (FROM one_series)) WHERE wd < 5"""))

oracle("client_fallback", with_pred("""
SELECT room, strftime(date, '%Y-%m-%d') AS date,
       CASE WHEN rt = 'lab' THEN 'Laboratory' ELSE 'Office' END AS room_type,
       t2 / 100.0 AS total_kwh, 11.0::DOUBLE AS rate, (t2 * 11) / 100.0 AS total_cost,
       CAST((t2 * 20 + 24) // 48 AS DOUBLE) / 1000.0 AS avg_hourly_kwh,
       CAST((t2 * 11 * 2 + 24) // 48 AS DOUBLE) / 100.0 AS avg_hourly_cost,
       'Using fallback prediction model | Check API connection' AS recommendations,
       CAST(65 AS BIGINT) AS confidence
FROM (SELECT *, CAST((CASE WHEN rt = 'lab' THEN 25 ELSE 15 END) * (CASE WHEN wd >= 5 THEN 30 ELSE 100 END) AS BIGINT) AS t2 FROM calc WHERE series = (FROM one_series))"""))

oracle("hourly_breakdown", with_pred(f"""
SELECT series, room, strftime(date, '%Y-%m-%d') AS date, CAST(h AS BIGINT) AS hour,
       CAST(CASE WHEN wd = 6 THEN 0 WHEN wd = 5 THEN (k * 40 + 5000) // 10000
            ELSE (k * (CASE WHEN rt = 'office' THEN {_OFFICE} ELSE {_LAB} END)[h + 1] + 5000) // 10000 END AS DOUBLE) / 1000.0 AS kwh
FROM pred, generate_series(0, 23) hh(h)"""))

_COST = "CAST(round(CAST(energy_kwh AS DECIMAL(18,8)) * 11, 2) * 100 AS BIGINT)"

oracle("recommend_daily", with_training(f"""
SELECT room, strftime(date, '%Y-%m-%d') AS date, energy_kwh, {_COST} / 100.0 AS cost,
       {sql_recommend('(CAST(energy_kwh AS DECIMAL(18,8)) * 10000)', _COST)} AS recommendations
FROM daily"""))


def _alert_sql(kind: str, value: str) -> str:
    rules = [(v, msg, pr) for t, _, v, msg, pr, a in fixed.ALERT_RULES if t == kind and a == 1]
    rules.sort(key=lambda r: -r[0])
    thr = "CASE " + " ".join(f"WHEN {value} > {v} THEN {v}" for v, _, _ in rules) + " END"
    pri = "CASE " + " ".join(f"WHEN {value} > {v} THEN {_q(p)}" for v, _, p in rules) + " END"
    msg = "CASE " + " ".join(f"WHEN {value} > {v} THEN {_q(m)}" for v, m, _ in rules) + " END"
    filled = (f"replace(replace(replace({msg}, '{{room}}', room), '{{value}}', printf('%.2f', {value})), "
              f"'{{date}}', strftime(date, '%Y-%m-%d'))")
    return (f"SELECT room, strftime(date, '%Y-%m-%d') AS date, {value} AS value, CAST({thr} AS DOUBLE) AS threshold, "
            f"{pri} AS priority, {filled} AS message, '{kind}' AS kind FROM dc WHERE {thr} IS NOT NULL")


oracle("alert_thresholds", with_training(
    _alert_sql("consumption", "energy_kwh") + "\nUNION ALL\n" + _alert_sql("cost", "cost"),
    f"dc AS (SELECT room, date, energy_kwh, {_COST} / 100.0 AS cost FROM daily)"))

oracle("weekly_trend", with_training(f"""
SELECT room, strftime(week, '%Y-%m-%d') AS week, CAST(round(week_total, 4) AS DOUBLE) AS week_total, change_pct,
       CASE WHEN change_pct > 0 THEN replace(replace({_q(fixed.TREND_UP_TEXT)}, '{{room}}', room), '{{value}}', CAST(change_pct AS VARCHAR))
            WHEN change_pct < 0 THEN replace(replace({_q(fixed.TREND_DOWN_TEXT)}, '{{room}}', room), '{{value}}', CAST(abs(change_pct) AS VARCHAR))
       END AS message
FROM (SELECT *, CASE WHEN date_diff('day', prev_week, week) = 7 AND pu > 0
                     THEN sign(cu - pu) * ((abs(cu - pu) * 20000 + pu) // (pu * 2)) / 100.0 END AS change_pct
      FROM (SELECT *, CAST(week_total * 100000000 AS HUGEINT) AS cu, CAST(prev_total * 100000000 AS HUGEINT) AS pu
            FROM (SELECT *, lag(week_total) OVER (PARTITION BY room ORDER BY week) AS prev_total,
                         lag(week) OVER (PARTITION BY room ORDER BY week) AS prev_week
                  FROM (SELECT room, CAST(date_trunc('week', date) AS DATE) AS week, sum(CAST(energy_kwh AS DECIMAL(18,8))) AS week_total
                        FROM daily GROUP BY ALL))))"""))

oracle("regression_metrics", with_training("""
SELECT pred_room_type, count(*) AS n, round(avg(abs(energy_kwh - pred)), 6) AS mae,
       round(sqrt(avg((energy_kwh - pred) * (energy_kwh - pred))), 6) AS rmse,
       round(1 - sum((energy_kwh - pred) * (energy_kwh - pred)) / sum((energy_kwh - ybar) * (energy_kwh - ybar)), 6) AS r2
FROM (SELECT *, avg(energy_kwh) OVER (PARTITION BY pred_room_type) AS ybar FROM (
  SELECT CASE WHEN starts_with(room, '7') THEN 'lab' ELSE 'office' END AS pred_room_type, energy_kwh,
         greatest((CASE WHEN starts_with(room, '7') THEN 25 ELSE 15 END)
           * (CASE WHEN month(date) IN (5, 6, 7, 8) THEN 120 WHEN month(date) IN (11, 12, 1, 2) THEN 80 ELSE 100 END)
           * (CASE WHEN day(date) <= 7 THEN 95 WHEN day(date) <= 14 THEN 100 WHEN day(date) <= 21 THEN 105 ELSE 90 END), 5000) / 10000.0 AS pred
  FROM daily))
GROUP BY pred_room_type"""))


# --- import, payload, export, retention -----------------------------------------

IMPORT = r"""
events_k AS (SELECT *, 220 + (TRY_CAST(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+)', 1) AS INTEGER) - 50) / 10 AS v FROM events),
imp AS (
  SELECT CASE WHEN event_id % 100 = 50 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d') END AS "Date",
         CASE WHEN event_id % 100 = 0 THEN '' WHEN event_id % 2 = 0 THEN strftime(ts, '%I:%M:%S %p')
              ELSE strftime(ts, '%H:%M:%S') END AS "Time",
         printf('%.1f', v) AS "Voltage(V)", CURRENT_TEXT_IMPORT AS "Current(A)",
         CASE WHEN event_id % 7 = 3 THEN 'n/a' ELSE printf('%.2f', value + d) END AS "Power(W)",
         printf('%.5f', value / 1000) AS "Energy(kWh)", event_id * 2 + d AS line_no
  FROM events_k, (VALUES (0), (1)) dd(d) WHERE d = 0 OR event_id % 20 = 0),
imp_ts AS (
  SELECT *, CASE WHEN year(t0) BETWEEN 2020 AND 2030 THEN t0 END AS ts FROM (
    SELECT *, CASE WHEN trim("Date") = '' OR trim("Time") = '' THEN NULL ELSE coalesce(
              try_strptime(trim("Date") || ' ' || trim("Time"), '%Y-%m-%d %I:%M:%S %p'),
              try_strptime(trim("Date") || ' ' || trim("Time"), '%Y-%m-%d %H:%M:%S')) END AS t0
    FROM imp)),
imp_parsed AS (
  SELECT line_no, ts, '705' AS room,
         round(SAFE_F("Voltage(V)"), 4) AS voltage, round(SAFE_F("Current(A)"), 6) AS current,
         round(SAFE_F("Power(W)"), 4) AS power, round(SAFE_F("Energy(kWh)"), 8) AS energy_kwh, 'OFF' AS light_state
  FROM imp_ts),
imp_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts, room ORDER BY line_no) AS rn
                 FROM imp_parsed WHERE ts IS NOT NULL) WHERE rn = 1),
imp_new AS (
  SELECT * FROM imp_first f
  WHERE NOT EXISTS (SELECT 1 FROM readings_base e WHERE e.room = '705' AND date_trunc('second', e.ts) = f.ts AND e.room = f.room))"""

_FLOAT_RE = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def sql_safe_float(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, '{_FLOAT_RE}') THEN 0.0 "
            f"WHEN isnan(TRY_CAST(trim({x}) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim({x}) AS DOUBLE) END)")


def _expand_safe(sql: str) -> str:
    import re as _re
    return _re.sub(r'SAFE_F\(("[^"]+")\)', lambda m: sql_safe_float(m.group(1)), sql)



def _current_text(power: str, voltage: str) -> str:
    """Current in A with six decimals from centiwatts and decivolts, half up."""
    cw, dv = f"CAST(round(({power}) * 100) AS BIGINT)", f"CAST(round(({voltage}) * 10) AS BIGINT)"
    ua = f"(({cw} * 200000 + {dv}) // ({dv} * 2))"
    return f"printf('%d.%06d', {ua} // 1000000, {ua} % 1000000)"


IMPORT = _expand_safe(IMPORT).replace("CURRENT_TEXT_IMPORT", _current_text("value", "v"))


def with_import(body: str) -> str:
    return with_readings(body, IMPORT)


oracle("parse_reading_ts", with_import("""
SELECT line_no, "Date", "Time", strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM imp_ts"""))

oracle("safe_float", with_import(_expand_safe("""
SELECT line_no, SAFE_F("Voltage(V)") AS voltage, SAFE_F("Current(A)") AS current,
       SAFE_F("Power(W)") AS power, SAFE_F("Energy(kWh)") AS energy_kwh FROM imp""")))

oracle("ingest_readings", with_import("""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, room, voltage, current, power, energy_kwh, light_state FROM imp_new"""))

oracle("ingest_counts", with_import("""
SELECT count(*) FILTER (WHERE ts IS NOT NULL) AS processed, count(*) FILTER (WHERE ts IS NULL) AS skipped,
       (SELECT count(*) FROM imp_first) AS unique_in_file, (SELECT count(*) FROM imp_new) AS added
FROM imp_parsed"""))

oracle("append_log", with_import("""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, room, voltage, current, power, energy_kwh, light_state FROM imp_first"""))

_PAYLOAD = r"""
pl AS (
  SELECT id, room, concat_ws(chr(10),
    CASE WHEN id % 11 = 0 THEN printf('voltage: %.1f V', voltage) ELSE printf('Voltage: %.1f V', voltage) END,
    CASE WHEN id % 30 <> 0 THEN 'Current: ' || CURRENT_TEXT_PAYLOAD || ' A' END,
    printf('Power: %.2f W', power),
    CASE WHEN id % 30 <> 0 THEN printf('Energy: %.5f kWh', energy_counter_kwh) END,
    printf('Uptime: %d seconds', hour(ts) * 3600 + minute(ts) * 60 + second(ts)),
    'Light: ' || light_state,
    'WiFi: ' || CASE WHEN id % 13 = 0 THEN 'Disconnected' ELSE 'Connected' END,
    'Cloud: ' || CASE WHEN id % 17 = 0 THEN 'Disconnected' ELSE 'Connected' END,
    CASE WHEN id % 23 <> 0 THEN 'SD Card: ' || CASE WHEN id % 19 = 0 THEN 'Failed' ELSE 'OK' END END,
    'Time: ' || strftime(ts, '%m/%d/%Y %H:%M:%S')) AS text
  FROM readings),
pp AS (
  SELECT id, room,
    TRY_CAST(nullif(regexp_extract(text, '(?i)Voltage:\s*([0-9.]+)\s*V', 1), '') AS DOUBLE) AS voltage,
    TRY_CAST(nullif(regexp_extract(text, '(?i)Current:\s*([0-9.]+)\s*A', 1), '') AS DOUBLE) AS current,
    TRY_CAST(nullif(regexp_extract(text, '(?i)Power:\s*([0-9.]+)\s*W', 1), '') AS DOUBLE) AS power,
    TRY_CAST(nullif(regexp_extract(text, '(?i)Energy:\s*([0-9.]+)\s*kWh', 1), '') AS DOUBLE) AS energy_kwh,
    TRY_CAST(nullif(regexp_extract(text, '(?i)Uptime:\s*([0-9]+)\s*seconds', 1), '') AS DOUBLE) AS uptime,
    CASE WHEN contains(text, 'Light: ON') THEN 'ON' ELSE 'OFF' END AS light_state,
    CASE WHEN contains(text, 'WiFi: Connected') THEN 'Connected' ELSE 'Disconnected' END AS wifi,
    CASE WHEN contains(text, 'Cloud: Connected') THEN 'Connected' ELSE 'Disconnected' END AS cloud,
    CASE WHEN contains(text, 'SD Card: OK') THEN 'OK' WHEN contains(text, 'SD Card: Failed') THEN 'Failed' ELSE 'Unknown' END AS sd_card,
    try_strptime(regexp_extract(text, 'Time:\s*([0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})', 1), '%m/%d/%Y %H:%M:%S') AS device_ts
  FROM pl)"""


def _cls(c: str) -> str:
    return (f"CASE WHEN {c} IN ('Connected', 'OK') THEN 'ok' WHEN {c} IN ('Disconnected', 'Failed') THEN 'err' "
            f"ELSE 'warn' END")


_PAYLOAD = _PAYLOAD.replace("CURRENT_TEXT_PAYLOAD", _current_text("power", "voltage"))

oracle("parse_payload", with_readings(f"""
SELECT id, room, voltage, current, power, energy_kwh, uptime, light_state, wifi, cloud, sd_card,
       strftime(device_ts, '%Y-%m-%d %H:%M:%S.%f') AS device_ts,
       {_cls('wifi')} AS wifi_class, {_cls('cloud')} AS cloud_class, {_cls('sd_card')} AS sd_class
FROM pp""", _PAYLOAD))

oracle("export_range", with_readings(f"""
SELECT {sql_ts('ts')} AS ts, room, voltage, current, power, energy_counter_kwh AS energy_kwh, light_state
FROM readings WHERE ts >= (SELECT max(ts) FROM readings) - INTERVAL 7 DAY"""))

oracle("retain_since", with_readings(f"""
SELECT id, {sql_ts('ts')} AS ts, room, power
FROM readings_base WHERE ts >= (SELECT max(ts) FROM readings_base) - INTERVAL 14 DAY"""))

oracle("export_days", with_readings(f"""
SELECT {sql_ts('ts')} AS ts, room, voltage, current, power, (run / 100000000)::DOUBLE AS energy_kwh, light_state
FROM (SELECT *, (sum(round(energy_kwh * 100000000)::BIGINT) OVER (PARTITION BY room ORDER BY ts))::DOUBLE AS run
      FROM (SELECT * FROM readings_base QUALIFY row_number() OVER (PARTITION BY room, date_trunc('second', ts) ORDER BY id) = 1))
WHERE ts >= (SELECT max(ts) FROM readings_base) - INTERVAL 3 DAY"""))

oracle("retain_tables", with_readings(f"""
SELECT t."table", id, {sql_ts('ts')} AS ts
FROM readings_base, (VALUES ('energy_log'), ('device_status'), ('person_events')) t("table")
WHERE ts >= (SELECT max(ts) FROM readings_base) - INTERVAL 14 DAY
  AND (t."table" = 'energy_log' OR (t."table" = 'device_status' AND id % 10 = 0)
       OR (t."table" = 'person_events' AND event_type = 'view'))"""))

oracle("filter_time_range", with_readings(f"""
SELECT id, {sql_ts('ts')} AS ts, room, power FROM readings_base
WHERE ts >= CAST(CAST((SELECT max(ts) FROM readings_base) AS DATE) AS TIMESTAMP)
  AND ts < CAST(CAST((SELECT max(ts) FROM readings_base) AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)"""))

oracle("downsample_status", with_readings(f"""
SELECT room, id, {sql_ts('ts')} AS ts, wifi_status, cloud_status, sd_card_status, poll_no FROM (
  SELECT room, id, ts,
         CASE WHEN id % 13 = 0 THEN 'Disconnected' ELSE 'Connected' END AS wifi_status,
         CASE WHEN id % 17 = 0 THEN 'Disconnected' ELSE 'Connected' END AS cloud_status,
         CASE WHEN id % 23 = 0 THEN 'Unknown' WHEN id % 19 = 0 THEN 'Failed' ELSE 'OK' END AS sd_card_status,
         row_number() OVER (PARTITION BY room ORDER BY ts, id) AS poll_no
  FROM readings_base) WHERE poll_no % 10 = 0"""))


# --- schedule and occupancy ----------------------------------------------------------

_TT_VALUES = ",\n".join(
    f"({_q(r)}, {_q(d)}, {_q(s)}, {_q(e)}, {_q(n)}, {i})" for i, (r, d, s, e, n) in enumerate(fixed.TIMETABLE)
)

OCC = r"""
tt AS (
  SELECT trim(room) AS room, lower(trim(day)) AS day, trim(start_time) AS start_time, trim(end_time) AS end_time,
         trim(event_name) AS event_name, rule_order,
         TRY_CAST(split_part(trim(start_time), ':', 1) AS INTEGER) * 60 + TRY_CAST(split_part(trim(start_time), ':', 2) AS INTEGER) AS start_min,
         TRY_CAST(split_part(trim(end_time), ':', 1) AS INTEGER) * 60 + TRY_CAST(split_part(trim(end_time), ':', 2) AS INTEGER) AS end_min
  FROM (VALUES TT_VALUES) v(room, day, start_time, end_time, event_name, rule_order)),
det AS (
  SELECT event_id AS det_id, CAST(100 * (1 + user_id % 7) + 1 + user_id % 11 AS VARCHAR) AS room, ts,
         date_trunc('minute', ts) AS frame_ts,
         CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS class_id,
         (TRY_CAST(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+)', 1) AS INTEGER) % 100) / 101.37::DOUBLE AS confidence
  FROM events),
pdet AS (SELECT * FROM det WHERE class_id = 0 AND confidence >= 0.7::DOUBLE),
frames0 AS (
  SELECT room, frame_ts, max(ts) AS tick_ts,
         count(*) FILTER (WHERE class_id = 0 AND confidence >= 0.7::DOUBLE) AS persons,
         avg(confidence) FILTER (WHERE class_id = 0 AND confidence >= 0.7::DOUBLE) AS mean_conf
  FROM det GROUP BY room, frame_ts),
frames AS (
  SELECT room, frame_ts, tick_ts, persons,
         CAST(CASE WHEN persons > 0 THEN trunc(mean_conf * 100) ELSE 0 END AS BIGINT) AS avg_confidence,
         CASE WHEN persons > 0 THEN 'OCCUPIED' ELSE 'VACANT' END AS status
  FROM frames0),
seen AS (
  SELECT f.*, CASE WHEN persons > 0 THEN tick_ts
                   ELSE (SELECT max(p.ts) FROM pdet p WHERE p.room = f.room AND p.ts <= f.tick_ts) END AS last_seen
  FROM frames f),
dec0 AS (
  SELECT s.*, (SELECT t.event_name FROM tt t WHERE t.room = trim(s.room) AND t.day = lower(strftime(s.tick_ts, '%A'))
                AND t.start_time <> '' AND t.end_time <> '' AND t.start_time <= strftime(s.tick_ts, '%H:%M') AND strftime(s.tick_ts, '%H:%M') < t.end_time
                AND t.start_time <> '' AND t.end_time <> '' ORDER BY t.rule_order LIMIT 1) AS class_event,
         epoch_us(tick_ts) - epoch_us(last_seen) AS gap_us
  FROM seen s),
dec AS (
  SELECT *, CASE WHEN class_event IS NOT NULL THEN 'SCHEDULE'
                 WHEN persons > 0 OR (last_seen IS NOT NULL AND gap_us < 300000000) THEN 'PERSON' ELSE 'OFF' END AS mode,
         CAST(CASE WHEN persons = 0 AND last_seen IS NOT NULL AND 300000000 - gap_us > 0
                   THEN (300000000 - gap_us) // 1000000 ELSE 0 END AS BIGINT) AS cd
  FROM dec0)""".replace("TT_VALUES", _TT_VALUES)


def with_occ(body: str, extra: str = "") -> str:
    return with_readings(body, OCC + ("," + extra if extra else ""))


oracle("detection_filter", with_occ(f"SELECT det_id, room, {sql_ts('ts')} AS ts, confidence FROM pdet"))

oracle("frame_occupancy", with_occ(f"""
SELECT room, {sql_ts('frame_ts')} AS frame_ts, {sql_ts('tick_ts')} AS tick_ts, persons, avg_confidence, status FROM frames"""))

oracle("occupancy_edges", with_occ(f"""
SELECT room, {sql_ts('frame_ts')} AS frame_ts, persons,
       CASE WHEN persons > 0 AND NOT prev THEN 'appeared' ELSE 'left' END AS edge
FROM (SELECT *, coalesce(lag(persons > 0) OVER (PARTITION BY room ORDER BY frame_ts), false) AS prev FROM frames)
WHERE (persons > 0) <> prev"""))

oracle("detection_changes", with_occ(f"""
SELECT room, {sql_ts('frame_ts')} AS frame_ts, persons, avg_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY room ORDER BY frame_ts DESC) AS rn FROM (
    SELECT *, coalesce(lag(persons) OVER (PARTITION BY room ORDER BY frame_ts), 0) AS prev FROM frames)
  WHERE persons > 0 AND persons <> prev) WHERE rn <= 15"""))

oracle("occupancy_sessions", with_occ(f"""
SELECT room, CAST(session_no AS BIGINT) AS session_no, {sql_ts('min(ts)')} AS session_start,
       {sql_ts('max(ts)')} AS session_end, count(*) AS n_detections
FROM (SELECT *, sum(new) OVER (PARTITION BY room ORDER BY ts, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
      FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 300000000
                           THEN 1 ELSE 0 END AS new
            FROM pdet WINDOW w AS (PARTITION BY room ORDER BY ts, det_id)))
GROUP BY room, session_no"""))

oracle("last_seen_asof", with_occ(f"""
SELECT room, {sql_ts('frame_ts')} AS frame_ts, {sql_ts('tick_ts')} AS tick_ts, persons, avg_confidence, status,
       {sql_ts('last_seen')} AS last_seen FROM seen"""))

oracle("light_decision", with_occ(f"""
SELECT room, {sql_ts('frame_ts')} AS frame_ts, {sql_ts('tick_ts')} AS tick_ts,
       CAST(class_event IS NOT NULL AS BIGINT) AS in_class, mode,
       CASE WHEN class_event IS NOT NULL THEN 'Class: ' || class_event
            WHEN persons > 0 THEN 'Person detected'
            WHEN mode = 'PERSON' THEN printf('Person left — OFF in %ds', cd)
            ELSE 'No class, no person' END AS event,
       CAST(CASE WHEN mode = 'PERSON' THEN cd ELSE 0 END AS BIGINT) AS countdown
FROM dec"""))

oracle("light_commands", with_occ(f"""
SELECT room, {sql_ts('tick_ts')} AS tick_ts, CASE WHEN mode <> 'OFF' THEN 'ON' ELSE 'OFF' END AS command, mode
FROM (SELECT *, coalesce(lag(mode <> 'OFF') OVER (PARTITION BY room ORDER BY tick_ts), false) AS prev_on FROM dec)
WHERE (mode <> 'OFF') <> prev_on"""))

oracle("notification_throttle", "WITH RECURSIVE " + (with_occ(f"""
SELECT room, {sql_ts('make_timestamp(us)')} AS notified_at FROM r WHERE emitted""", """
pn AS (SELECT room, epoch_us(ts) AS us, row_number() OVER (PARTITION BY room ORDER BY ts, det_id) AS rn FROM pdet),
r(room, rn, us, last_emit, emitted) AS (
  SELECT room, rn, us, us, true FROM pn WHERE rn = 1
  UNION ALL
  SELECT pn.room, pn.rn, pn.us,
         CASE WHEN pn.us - r.last_emit > 2000000 THEN pn.us ELSE r.last_emit END,
         pn.us - r.last_emit > 2000000
  FROM r JOIN pn ON pn.room = r.room AND pn.rn = r.rn + 1)""")[len("WITH "):]))

oracle("schedule_at", with_occ(f"""
SELECT id, room, {sql_ts('ts')} AS ts, CAST(ev IS NOT NULL AS BIGINT) AS in_class, ev AS class_event FROM (
  SELECT r.id, r.room, r.ts,
         (SELECT t.event_name FROM tt t WHERE t.room = trim(r.room) AND t.day = lower(strftime(r.ts, '%A'))
            AND t.start_time <> '' AND t.end_time <> '' AND t.start_time <= strftime(r.ts, '%H:%M') AND strftime(r.ts, '%H:%M') < t.end_time
          ORDER BY t.rule_order LIMIT 1) AS ev
  FROM readings_base r)"""))

_DAYSCHED = """
rd AS (SELECT DISTINCT room, CAST(ts AS DATE) AS date FROM readings_base),
ds AS (SELECT rd.room, rd.date, t.start_time, t.end_time, t.event_name, t.start_min, t.end_min, t.rule_order
       FROM rd JOIN tt t ON t.room = trim(rd.room) AND t.day = lower(strftime(rd.date, '%A')))"""

oracle("schedule_for_day", with_occ(f"""
SELECT room, {sql_date('date')} AS date, start_time, end_time, event_name, CAST(coalesce(start_min, -1) AS BIGINT) AS start_min,
       CAST(rule_order AS BIGINT) AS rule_order FROM ds""", _DAYSCHED))

oracle("schedule_gaps", with_occ(f"""
SELECT room, {sql_date('date')} AS date, printf('%02d:%02d', prev_end // 60, prev_end % 60) AS gap_start,
       start_time AS gap_end, CAST(start_min - prev_end AS BIGINT) AS gap_minutes, event_name AS next_event
FROM (SELECT *, lag(end_min) OVER (PARTITION BY room, date ORDER BY start_min, rule_order) AS prev_end FROM ds WHERE start_min IS NOT NULL AND end_min IS NOT NULL)
WHERE prev_end IS NOT NULL AND start_min - prev_end > 0 AND start_min - prev_end >= 10""", _DAYSCHED))

oracle("schedule_conflicts", with_occ(f"""
SELECT room, {sql_date('date')} AS date, event_name, start_time, end_time, holder_name AS overlaps_event,
       replace(replace(replace({_q(fixed.CONFLICT_TEXT)}, '{{room}}', room), '{{date}}', strftime(date, '%Y-%m-%d')),
               '{{time}}', start_time || '-' || holder_end) AS message
FROM (SELECT a.*,
             (SELECT b.event_name FROM bounded b WHERE b.room = a.room AND b.date = a.date
                AND (b.start_min < a.start_min OR (b.start_min = a.start_min AND b.rule_order < a.rule_order))
              ORDER BY b.end_min DESC, b.rule_order LIMIT 1) AS holder_name,
             (SELECT b.end_time FROM bounded b WHERE b.room = a.room AND b.date = a.date
                AND (b.start_min < a.start_min OR (b.start_min = a.start_min AND b.rule_order < a.rule_order))
              ORDER BY b.end_min DESC, b.rule_order LIMIT 1) AS holder_end,
             (SELECT max(b.end_min) FROM bounded b WHERE b.room = a.room AND b.date = a.date
                AND (b.start_min < a.start_min OR (b.start_min = a.start_min AND b.rule_order < a.rule_order))) AS prev_max
      FROM bounded a)
WHERE start_min < prev_max""", _DAYSCHED + ",\nbounded AS (SELECT * FROM ds WHERE start_min IS NOT NULL AND end_min IS NOT NULL)"))


# --- streaming twins (same results as the batch forms) ------------------------------

oracle("stream_hourly", with_readings(f"""
SELECT room, {sql_ts("date_trunc('hour', ts)")} AS window_start, {mean_shown('power', 4, 2)} AS avg_power,
       {mean_shown('voltage', 4, 4)} AS avg_voltage, {mean_shown('current', 6, 6)} AS avg_current,
       {shown('max(power)', 4, 2)} AS max_power, CAST(sum(CAST(energy_kwh AS DECIMAL(18,8))) AS DOUBLE) AS energy_kwh, count(power) AS n_readings
FROM readings_base GROUP BY room, date_trunc('hour', ts)"""))

oracle("stream_hourly_counter", with_readings(f"""
SELECT room, {sql_ts("date_trunc('hour', ts)")} AS window_start, {mean_shown('power', 4, 2)} AS avg_power,
       {mean_shown('voltage', 4, 4)} AS avg_voltage, {mean_shown('current', 6, 6)} AS avg_current,
       {shown('max(power)', 4, 2)} AS max_power,
       (round(max(energy_counter_kwh) * 100000000)::BIGINT - round(min(energy_counter_kwh) * 100000000)::BIGINT)::DOUBLE / 100000000 AS energy_kwh,
       count(power) AS n_readings
FROM readings GROUP BY room, date_trunc('hour', ts)"""))

oracle("stream_15min", with_readings(f"""
SELECT room, {sql_ts("date_trunc('hour', ts) + (minute(ts) // 15) * INTERVAL 15 MINUTE")} AS window_start,
       {mean_shown('power', 4, 2)} AS avg_power, {mean_shown('voltage', 4, 4)} AS avg_voltage, {mean_shown('current', 6, 6)} AS avg_current,
       {shown('max(power)', 4, 2)} AS max_power, CAST(sum(CAST(energy_kwh AS DECIMAL(18,8))) AS DOUBLE) AS energy_kwh, count(power) AS n_readings
FROM readings_base GROUP BY room, date_trunc('hour', ts) + (minute(ts) // 15) * INTERVAL 15 MINUTE"""))

oracle("stream_latest", with_readings(f"""
SELECT room, {sql_ts('ts')} AS ts, voltage, current, power, energy_kwh, light_state FROM (
  SELECT *, row_number() OVER (PARTITION BY room ORDER BY ts DESC, id DESC) AS rn FROM readings_base) WHERE rn = 1"""))

oracle("stream_sessions", with_occ(f"""
SELECT room, {sql_ts('min(ts)')} AS session_start, {sql_ts('max(ts)')} AS session_end, count(*) AS n_detections
FROM (SELECT *, sum(new) OVER (PARTITION BY room ORDER BY ts, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
      FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 300000000
                           THEN 1 ELSE 0 END AS new
            FROM pdet WINDOW w AS (PARTITION BY room ORDER BY ts, det_id)))
GROUP BY room, session_no"""))

ORACLE["stream_throttle"] = ORACLE["notification_throttle"]
ORACLE["stream_status_downsample"] = ORACLE["downsample_status"]

oracle("stream_light_decision", with_occ(f"""
SELECT room, {sql_ts('frame_ts')} AS frame_ts, {sql_ts('tick_ts')} AS tick_ts,
       CAST(class_event IS NOT NULL AS BIGINT) AS in_class, mode,
       CASE WHEN class_event IS NOT NULL THEN 'Class: ' || class_event
            WHEN persons > 0 THEN 'Person detected'
            WHEN mode = 'PERSON' THEN printf('Person left — OFF in %ds', cd)
            ELSE 'No class, no person' END AS event,
       CAST(CASE WHEN mode = 'PERSON' THEN cd ELSE 0 END AS BIGINT) AS countdown,
       CASE WHEN (mode <> 'OFF') <> coalesce(lag(mode <> 'OFF') OVER (PARTITION BY room ORDER BY tick_ts), false)
            THEN CASE WHEN mode <> 'OFF' THEN 'ON' ELSE 'OFF' END END AS command
FROM dec"""))


oracle("rolling_last_60", with_readings(f"""
SELECT id, room, {sql_ts('ts')} AS ts, n_window,
       {ratio_shown('sp', 'np', 4, 2)} AS avg_power, {ratio_shown('sv', 'nv', 4, 2)} AS avg_voltage,
       {ratio_shown('sc', 'nc', 6, 6)} AS avg_current
FROM (SELECT id, room, ts,
             count(*) OVER w AS n_window,
             CAST(sum(CAST(power AS DECIMAL(18,4))) OVER w * 10000 AS HUGEINT) AS sp, count(power) OVER w AS np,
             CAST(sum(CAST(voltage AS DECIMAL(18,4))) OVER w * 10000 AS HUGEINT) AS sv, count(voltage) OVER w AS nv,
             CAST(sum(CAST(current AS DECIMAL(18,6))) OVER w * 1000000 AS HUGEINT) AS sc, count(current) OVER w AS nc
      FROM readings_base WINDOW w AS (PARTITION BY room ORDER BY ts, id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""))


# --- models ------------------------------------------------------------------------------

from ..operators.models import BASIC_FEATURES  # noqa: E402

_LABELS = """
lbl AS (SELECT room_type, row_number() OVER (ORDER BY room_type) - 1 AS idx FROM (
  SELECT DISTINCT room_type FROM daily
  WHERE ('0x' || substr(md5(room || '|' || strftime(date, '%Y-%m-%d')), 1, 8))::BIGINT % 10 >= 2))"""

oracle("onehot_room_type", with_training("""
SELECT d.room, strftime(d.date, '%Y-%m-%d') AS date, d.room_type,
       CAST(coalesce(l.idx, (SELECT count(*) FROM lbl)) AS BIGINT) AS room_type_idx,
       array_to_string(list_transform(range((SELECT count(*) FROM lbl)),
                       lambda i: CASE WHEN i = coalesce(l.idx, -1) THEN '1' ELSE '0' END), ',') AS room_type_onehot
FROM daily d LEFT JOIN lbl l ON l.room_type = d.room_type""", _LABELS))


# --- text training file --------------------------------------------------------------

def _num(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, '{_FLOAT_RE}') AND NOT isnan(TRY_CAST(trim({x}) AS DOUBLE)) "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END)")


TTEXT = r"""
ttext AS (
  SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'bad-date' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d,
         CASE WHEN l_orderkey % 83 = 0 THEN 'late' ELSE printf('%02d:00', l_linenumber + 6) END AS h,
         CASE WHEN l_orderkey % 89 = 0 THEN 'n/a' ELSE printf('%.1f', l_quantity) END AS e,
         CASE WHEN l_linenumber = 1 THEN ' ' || r || ' ' ELSE r END AS room_raw,
         CASE l_returnflag WHEN 'A' THEN 'lab' WHEN 'N' THEN 'lecture' ELSE 'office' END AS room_type,
         printf('%.2f', 216 + l_tax * 100) AS v, printf('%.2f', l_discount * 100) AS c
  FROM (SELECT *, CAST(100 * (1 + l_suppkey % 7) + 1 + l_suppkey % 11 AS VARCHAR) AS r FROM lineitem)),
tparsed AS (
  SELECT trim(room_raw) AS room, room_type,
         CASE WHEN trim(h) <> '' THEN try_strptime(trim(d) || ' ' || trim(h), '%Y-%m-%d %H:%M') ELSE try_strptime(trim(d), '%Y-%m-%d') END AS ts,
         NUM_E AS energy_kwh, NUM_V AS voltage, NUM_C AS current
  FROM ttext)""".replace("NUM_E", _num("e")).replace("NUM_V", _num("v")).replace("NUM_C", _num("c"))

oracle("training_text_daily", "WITH " + TTEXT + """,
tvalid AS (SELECT * FROM tparsed WHERE ts IS NOT NULL AND energy_kwh IS NOT NULL),
tfirst AS (SELECT room, CAST(ts AS DATE) AS date, room_type, count(*) AS n,
                  sum(CAST(energy_kwh AS DECIMAL(18,8))) AS e,
                  """ + counted("voltage", 4) + """ AS sv, count(voltage) AS cv,
                  """ + counted("current", 6) + """ AS sc, count(current) AS cc
           FROM tvalid GROUP BY ALL)
SELECT room, strftime(date, '%Y-%m-%d') AS date, CAST(sum(e) AS DOUBLE) AS energy_kwh,
       """ + ratio_shown("CAST(sum(sv) AS HUGEINT)", "sum(cv)", 4, 4) + """ AS voltage,
       """ + ratio_shown("CAST(sum(sc) AS HUGEINT)", "sum(cc)", 6, 4) + """ AS current,
       coalesce(arg_min(room_type, (room_type IS NULL, -n, room_type)), 'unknown') AS room_type
FROM tfirst GROUP BY room, date""")

oracle("training_invalid_counts", "WITH " + TTEXT + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts IS NULL) AS invalid_timestamps,
       count(*) FILTER (WHERE ts IS NOT NULL AND energy_kwh IS NULL) AS invalid_energy,
       count(*) FILTER (WHERE ts IS NOT NULL AND energy_kwh IS NOT NULL) AS n_valid
FROM tparsed""")


# --- Holt-Winters fold as a recursive CTE (the same arithmetic, step by step) ---------

from ..operators.tariff import DEFAULT_GRID  # noqa: E402


def _vals(xs) -> str:
    return ", ".join(f"({float(x)!r}::DOUBLE)" for x in xs)


HW = TARIFF + f""",
hw_grid AS (
  SELECT g.series, g.month, t.rate FROM (
    SELECT series, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
    FROM tariff GROUP BY series) g
  LEFT JOIN tariff t ON t.series = g.series AND t.month = g.month),
hw_arr AS (
  SELECT series, list(rate ORDER BY month) AS y, max(month) AS last_month, count(*) AS n
  FROM hw_grid GROUP BY series HAVING count(*) >= 24),
hw_par AS (
  SELECT a.a, b.b, c.g FROM (VALUES {_vals(DEFAULT_GRID['alpha'])}) a(a),
                          (VALUES {_vals(DEFAULT_GRID['beta'])}) b(b),
                          (VALUES {_vals(DEFAULT_GRID['gamma'])}) c(g)),
hw_init AS (
  SELECT series, y, n, last_month, m1, (m2 - m1) / 12.0 AS t0,
         list_transform(y[1:12], lambda x: coalesce(x, m1) - m1) AS s0
  FROM (SELECT *,
          list_reduce(list_prepend(0.0::DOUBLE, list_transform(y[1:12], lambda x: coalesce(x, 0.0::DOUBLE))), lambda p, q: p + q)
            / greatest(len(list_filter(y[1:12], lambda x: x IS NOT NULL)), 1) AS m1,
          list_reduce(list_prepend(0.0::DOUBLE, list_transform(y[13:24], lambda x: coalesce(x, 0.0::DOUBLE))), lambda p, q: p + q)
            / greatest(len(list_filter(y[13:24], lambda x: x IS NOT NULL)), 1) AS m2
        FROM hw_arr)),
hw(series, a, b, g, i, l, t, s, sse, nobs) AS (
  SELECT series, a, b, g, 0, m1, t0, s0, 0.0::DOUBLE, 0 FROM hw_init, hw_par
  UNION ALL
  SELECT h.series, h.a, h.b, h.g, h.i + 1,
         CASE WHEN yy IS NOT NULL THEN h.a * (yy - sk) + (1.0 - h.a) * (h.l + h.t) ELSE h.l + h.t END,
         CASE WHEN yy IS NOT NULL
              THEN h.b * ((h.a * (yy - sk) + (1.0 - h.a) * (h.l + h.t)) - h.l) + (1.0 - h.b) * h.t ELSE h.t END,
         list_transform(h.s, lambda v, j: CASE WHEN j = h.i % 12 + 1 AND yy IS NOT NULL
              THEN h.g * (yy - (h.a * (yy - sk) + (1.0 - h.a) * (h.l + h.t))) + (1.0 - h.g) * sk ELSE v END),
         h.sse + CASE WHEN yy IS NOT NULL THEN (yy - (h.l + h.t + sk)) * (yy - (h.l + h.t + sk)) ELSE 0.0 END,
         h.nobs + CASE WHEN yy IS NOT NULL THEN 1 ELSE 0 END
  FROM (SELECT h.*, hw_init.y[h.i + 1] AS yy, h.s[h.i % 12 + 1] AS sk, hw_init.n AS n
        FROM hw h JOIN hw_init ON hw_init.series = h.series) h
  WHERE h.i < h.n),
hw_best AS (
  SELECT * FROM (
    SELECT hw.*, i.last_month,
           row_number() OVER (PARTITION BY hw.series ORDER BY sse, a, b, g) AS rn
    FROM hw JOIN hw_init i ON i.series = hw.series WHERE hw.i = i.n) WHERE rn = 1)"""


def with_hw(body: str, extra: str = "") -> str:
    return "WITH RECURSIVE " + HW + ("," + extra if extra else "") + "\n" + body


oracle("holt_winters_fit", with_hw("""
SELECT series, strftime(last_month, '%Y-%m-%d') AS last_month, a AS alpha, b AS beta, g AS gamma,
       round(sse, 8) AS sse, CAST(nobs AS BIGINT) AS n_obs, CAST(i AS BIGINT) AS n_steps,
       round(l, 8) AS level, round(t, 8) AS trend,
       round(nobs * ln(greatest(sse, 1e-300) / nobs) + 34, 8) AS aic,
       round(nobs * ln(greatest(sse, 1e-300) / nobs) + 17.0 * ln(CAST(nobs AS DOUBLE)), 8) AS bic
FROM hw_best"""))

oracle("holt_winters_estimate", with_hw("""
SELECT series, strftime(last_month, '%Y-%m-%d') AS last_month, CAST(nobs AS BIGINT) AS n_obs, CAST(i AS BIGINT) AS n_steps,
       12::BIGINT AS season_terms, 1::BIGINT AS not_above_grid, 1::BIGINT AS in_bounds
FROM hw_best"""))

oracle("forecast_rates", with_hw("""
SELECT series, strftime(CAST(last_month + h * INTERVAL 1 MONTH AS DATE), '%Y-%m-%d') AS month, CAST(h AS BIGINT) AS horizon,
       round(l + h * t + s[(i + h - 1) % 12 + 1], 8) AS rate
FROM hw_best, generate_series(1, 12) hh(h)"""))

oracle("rate_for_date_forecast", with_hw("""
SELECT d.series, strftime(d.date, '%Y-%m-%d') AS date, round(coalesce(
         tt.rate,
         CASE WHEN f.series IS NOT NULL AND hm > 0 THEN f.l + hm * f.t + f.s[(f.i + hm - 1) % 12 + 1] END,
         s.last_rate, 11.0), 8) AS rate
FROM (SELECT d0.*, (year(d0.date) - year(s0.last_month)) * 12 + month(d0.date) - month(s0.last_month) AS hm
      FROM dates d0 LEFT JOIN t_summ2 s0 ON s0.series = d0.series) d
LEFT JOIN tariff tt ON tt.series = d.series AND tt.month = CAST(date_trunc('month', d.date) AS DATE)
LEFT JOIN t_summ2 s ON s.series = d.series
LEFT JOIN hw_best f ON f.series = d.series""", """
dates AS (
  SELECT series, CAST(m + INTERVAL 14 DAY AS DATE) AS date FROM (
    SELECT series, unnest(generate_series(min(month) - INTERVAL 3 MONTH, max(month) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS m
    FROM tariff GROUP BY series))"""))


oracle("stream_readings", with_readings(f"""
SELECT room, {sql_ts('device_ts')} AS ts, round(voltage, 4) AS voltage, round(current, 6) AS current,
       round(power, 4) AS power, round(energy_kwh, 8) AS energy_kwh, light_state, wifi, cloud, sd_card
FROM (SELECT pp.*, row_number() OVER (PARTITION BY pp.room, pp.device_ts ORDER BY r.ts, pl.text) AS rn
      FROM pp JOIN pl ON pl.id = pp.id JOIN readings r ON r.id = pp.id) WHERE rn = 1""", _PAYLOAD))


oracle("model_registry", with_training("""
SELECT 'kwh_model' AS model, '1.0' AS version, 'Energy prediction models for rooms 1xx and 7xx' AS description,
       '[' || array_to_string(list_transform(BASIC_LIST || (SELECT list('room_type_' || room_type ORDER BY idx) FROM lbl), lambda x: '"' || x || '"'), ', ') || ']' AS features,
       200::BIGINT AS n
UNION ALL SELECT 'rate_model', '1.0', 'Energy prediction models for rooms 1xx and 7xx',
       '["series", "last_month", "alpha", "beta", "gamma", "sse", "n_obs", "n_steps", "level", "trend", "season", "aic", "bic"]',
       (SELECT count(DISTINCT o_orderpriority) FROM orders)
UNION ALL SELECT 'room_encoder', '1.0', 'Energy prediction models for rooms 1xx and 7xx', '["room", "room_encoded"]',
       (SELECT count(DISTINCT 100 * (1 + l_suppkey % 7) + 1 + l_suppkey % 11) FROM lineitem)
UNION ALL SELECT 'recommendations', '1.0', 'Energy prediction models for rooms 1xx and 7xx',
       '["threshold_type", "threshold_value", "recommendation", "rule_order"]', 6""".replace("BASIC_LIST", str(list(BASIC_FEATURES))), _LABELS))
