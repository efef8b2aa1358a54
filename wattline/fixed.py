"""Fixed values that must equal the reference's for matching results.

FIXED VALUES — stated plainly, in their natural order.  These are data
(thresholds, rule texts, hourly shares), not logic.  The weekly timetable is this library's own.
"""

from __future__ import annotations

# --- Threshold rules (threshold_type, threshold_value, recommendation), file order.
RECOMMENDATION_RULES = [
    ("energy_kWh", 5.0, "Consider turning off unused appliances in this room"),
    ("energy_kWh", 10.0, "Optimize air conditioning schedules for better efficiency"),
    ("energy_kWh", 15.0, "This room is consuming too much energy - consider an energy audit"),
    ("energy_cost_Php", 50.0, "Monitor this room's usage during peak hours"),
    ("energy_cost_Php", 100.0, "Consider implementing energy-saving measures in this room"),
    ("energy_cost_Php", 150.0, "This room's energy cost is very high - investigate potential issues"),
]

# Dynamic advice texts appended after the table rules.
ADVICE_HIGH_KWH = "High energy consumption detected. Consider scheduling equipment usage during off-peak hours."
ADVICE_HIGH_COST = "Cost exceeding typical range. Review peak hour usage and consider energy-efficient alternatives."
ADVICE_LOW_KWH = "Low energy usage - typical for weekends or holidays."
ADVICE_DEFAULT = "Monitor energy consumption patterns for optimization opportunities."
ADVICE_SUNDAY = "No energy consumption expected on Sundays (building closed)"
ADVICE_SATURDAY = "Minimal energy consumption expected on Saturdays (limited operations)"
ADVICE_FALLBACK_MODE = "Using fallback prediction mode"

# Profile forecast texts (weekday name is filled in).
PROFILE_ZERO_DAY_TEXTS = [
    "{day}s show no energy consumption in historical data.",
    "No classes or activities are scheduled on this day of the week.",
    "Predicted consumption: 0 kWh.",
]
PROFILE_PEAK_TEXT = "Peak usage expected around {hour}:00 ({watts} W)."
PROFILE_HIGH_TEXT = "Projected {kwh} kWh — consider turning off AC during unscheduled hours."
PROFILE_LOW_TEXT = "Low energy day projected based on historical patterns."

# --- Hourly shares of the daily total, hours 0..23, by room type.
HOURLY_PATTERN_LAB = [
    0.01, 0.005, 0.003, 0.002, 0.002, 0.01,
    0.02, 0.05, 0.08, 0.10, 0.10, 0.10,
    0.08, 0.07, 0.06, 0.05, 0.04, 0.03,
    0.03, 0.02, 0.02, 0.015, 0.01, 0.01,
]
HOURLY_PATTERN_OFFICE = [
    0.002, 0.001, 0.001, 0.001, 0.001, 0.01,
    0.03, 0.08, 0.12, 0.15, 0.15, 0.12,
    0.08, 0.04, 0.03, 0.02, 0.01, 0.005,
    0.003, 0.002, 0.002, 0.001, 0.001, 0.001,
]

# --- Default room lists: floor 1 rooms 101..111 and floor 7 rooms 701..705.
DEFAULT_ROOM_RANGES = [(1, 101, 111), (7, 701, 705)]

# --- Operating constants.
DEFAULT_RATE = 11.0          # Php per kWh when nothing else is known
ZERO_DAY_WATTS = 5.0         # weekday average below this -> zero day
PERSON_GONE_SECONDS = 300    # lights stay on this long after the last person
NOTIFY_COOLDOWN_SECONDS = 2  # at most one person notification per 2 s
CONFIDENCE_DEFAULT = 0.70
CONFIDENCE_MIN, CONFIDENCE_MAX = 0.10, 0.99
RETENTION_DAYS = 365
STATUS_EVERY_N_POLLS = 10
RATE_CLAMP = (10.0, 15.0)

# --- A timetable of our own (room, day, start, end, event), file order: regular hours in
# four rooms, overlapping bookings, bookings without a bound, one that ends before it starts.
TIMETABLE = [
    (room, day, f"{7 + n + 2 * k:02d}:30", f"{8 + n + 2 * k:02d}:30", f"{day[:3].upper()}-{room}-{k + 1}")
    for n, room in enumerate(("705", "101", "204", "508"))
    for day in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
    for k in range(4)
] + [
    ("705", "Tuesday", "07:00", "10:00", "Exam"),             # over two of the regular hours
    ("705", "Wednesday", "13:00", "16:30", "Workshop"),
    ("101", "Monday", "09:00", "11:00", "Visit"),
    ("101", " monday ", "10:00", "12:00", "Repair"),
    ("204", "Friday", "", "12:00", "No start"),
    ("204", "Friday", "13:00", "", "No end"),
    ("508", "Thursday", "15:00", "14:00", "Backwards"),
    ("508", "Saturday", "09:00", "23:59", "Open day"),
]

# --- Alert rules (type, comparison, threshold, message, priority, active), file order.
ALERT_RULES = [
    ("consumption", ">", 15.0, "⚠️ High energy consumption alert! Room {room} consumed {value}kWh on {date}. This is significantly above average.", "high", 1),
    ("consumption", ">", 10.0, "ℹ️ Room {room} consumed {value}kWh on {date}. Consider optimizing usage during peak hours.", "medium", 1),
    ("consumption", ">", 5.0, "ℹ️ Room {room} consumed {value}kWh on {date}. Usage is within normal range.", "low", 1),
    ("cost", ">", 200.0, "⚠️ Critical cost alert! Room {room} energy cost reached ₱{value} on {date}. Immediate action recommended.", "high", 1),
    ("cost", ">", 150.0, "⚠️ High cost alert! Room {room} energy cost reached ₱{value} on {date}. Review usage patterns.", "high", 1),
    ("cost", ">", 100.0, "ℹ️ Room {room} energy cost was ₱{value} on {date}. Consider energy-saving measures.", "medium", 1),
]
TREND_UP_TEXT = "📈 Increasing trend detected in Room {room}. Weekly consumption increased by {value}% compared to last week."
TREND_DOWN_TEXT = "📉 Decreasing trend detected in Room {room}. Weekly consumption decreased by {value}%. Good job!"
CONFLICT_TEXT = "⏰ Schedule conflict detected in Room {room} on {date}. Multiple bookings between {time}."

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
