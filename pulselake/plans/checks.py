"""SQL statements for DuckDB that must give the same rows as the registered queries, column by column.

They state each question directly over the derived tables, without buckets, salts, blocks or fused scans.
"""

from __future__ import annotations

from pulselake.plans.driver_tables import END, START, WORKOUT_TYPES
from pulselake.tables import RECORD_TYPES

S, E = f"DATE '{START}'", f"DATE '{END}'"
DAYS = (END - START).days
PS, PE = f"({S} - {DAYS})", f"({S} - 1)"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# The derivation of driver_tables.py, then the base views, as common table expressions.
DERIVED_SQL = f"""
base AS (
  SELECT event_id, event_type, user_id // 15 AS subject_id,
         date_trunc('second', ts) + to_days((30 * (user_id % 3))::INT) AS ts,
         (floor(value * 4) / 4)::DOUBLE AS v, event_id // 18 AS q
  FROM events),
subjects AS (SELECT DISTINCT subject_id FROM base),
records AS (
  SELECT subject_id, kind AS record_type, ts AS start_date,
         ts + CASE WHEN kind = 'SleepAnalysis' THEN to_minutes(event_id % 600) ELSE to_seconds(event_id % 600) END
           AS end_date,
         (CASE kind
           WHEN 'StepCount' THEN 500 + q % 4000 + 0.5 * (q % 2)
           WHEN 'HeartRate' THEN 55 + q % 120 + 0.25 * (q % 4)
           WHEN 'RestingHeartRate' THEN 48 + q % 20 + 0.25 * (q % 3)
           WHEN 'VO2Max' THEN 35 + q % 15 + 0.125 * (q % 7)
           WHEN 'HeartRateVariabilitySDNN' THEN 30 + q % 50 + 0.5 * (q % 3)
           WHEN 'RespiratoryRate' THEN 12 + q % 8 + 0.25 * (q % 3)
           WHEN 'OxygenSaturation' THEN CASE WHEN q % 5 = 0 THEN 90 + q % 10 ELSE (57 + q % 8)::DOUBLE / 64 END
           WHEN 'WalkingSpeed' THEN 1 + 0.125 * (q % 8)
           WHEN 'FlightsClimbed' THEN q % 12
           WHEN 'DistanceWalkingRunning' THEN v / 8
           WHEN 'DistanceCycling' THEN v / 8
           WHEN 'ActiveEnergyBurned' THEN v
           WHEN 'BodyMass' THEN 140 + q % 80 + 0.5 * (q % 2)
           WHEN 'RunningSpeed' THEN 2 + 0.125 * (q % 16)
           WHEN 'RunningPower' THEN 180 + q % 120 + 0.5 * (q % 2)
           WHEN 'RunningGroundContactTime' THEN 220 + q % 60
           WHEN 'RunningVerticalOscillation' THEN 7 + 0.125 * (q % 16)
         END)::DOUBLE AS value
  FROM (SELECT *, ({_list(RECORD_TYPES)})[event_id % 18 + 1] AS kind FROM base)),
workouts AS (
  SELECT subject_id, ts AS start_date, ts + to_minutes(minutes) AS end_date,
         'HKWorkoutActivityType' || ({_list(WORKOUT_TYPES)})[event_id % 8 + 1] AS workout_activity_type,
         minutes::DOUBLE AS duration, 'min' AS duration_unit,
         CASE WHEN event_id % 5 <> 0 THEN v / 16 END AS total_distance,
         CASE WHEN event_id % 2 = 0 THEN 'km' ELSE 'mi' END AS total_distance_unit,
         CASE WHEN event_id % 7 <> 0 THEN v * 2 END AS total_energy_burned,
         'kcal' AS total_energy_burned_unit, ts::DATE AS d
  FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN 4 ELSE 60 + event_id % 120 END AS minutes FROM base)
  WHERE event_type = 'purchase' AND (day(ts) + subject_id) % 4 <> 0),
activity AS (
  SELECT subject_id, d AS date_components, energy AS active_energy_burned,
         CASE WHEN (day(d) + subject_id) % 13 = 0 THEN 0.0 ELSE 400.0 END::DOUBLE AS active_energy_burned_goal,
         3.0::DOUBLE * n AS apple_exercise_time, 30::DOUBLE AS apple_exercise_time_goal,
         m + 0.5::DOUBLE AS apple_stand_hours, 10::DOUBLE AS apple_stand_hours_goal
  FROM (SELECT subject_id, ts::DATE AS d, sum(v) AS energy, count(*) AS n, sum(event_id % 3) AS m
        FROM base GROUP BY ALL)
  WHERE (day(d) + subject_id) % 9 <> 0),
sleep AS (
  SELECT subject_id, ts AS start_time, ts + INTERVAL 8 HOUR AS end_time, ts::DATE AS d,
         (32 + event_id % 29)::DOUBLE / 64 AS sleep_quality,
         CASE WHEN event_id % 7 <> 0 THEN (30 + event_id % 31)::DOUBLE / 64 END AS regularity,
         60::DOUBLE * (event_id % 40) AS awake_seconds,
         60::DOUBLE * (40 + event_id % 60) AS dream_seconds,
         60::DOUBLE * (120 + event_id % 120) AS light_seconds,
         CASE WHEN event_id % 23 <> 0 THEN 60::DOUBLE * (20 + event_id % 100) END AS deep_seconds,
         CASE WHEN event_id % 6 <> 0 THEN 48::DOUBLE + event_id % 20 END AS heart_rate_bpm,
         100000::DOUBLE + event_id % 500 AS air_pressure_pa,
         CASE WHEN event_id % 10 <> 0 THEN 0.25::DOUBLE * (event_id % 64) END AS movements_per_hour,
         CASE WHEN event_id % 29 = 0 THEN 0 ELSE 60::DOUBLE * (360 + event_id % 180) END AS time_in_bed_seconds,
         CASE WHEN event_id % 31 = 0 THEN 0 ELSE 60::DOUBLE * (330 + event_id % 170) END AS time_asleep_seconds,
         CASE WHEN event_id % 9 <> 0 THEN 30::DOUBLE * (event_id % 80) END AS time_before_sleep_seconds,
         15::DOUBLE * (event_id % 200) AS snore_time_seconds,
         CASE WHEN event_id % 8 <> 0 THEN 30 + 0.5::DOUBLE * (event_id % 60) END AS weather_temperature_f
  FROM base WHERE event_type = 'signup' AND event_id % 3 <> 2),
points AS (
  SELECT subject_id, 'r' || subject_id || '_' || (date_diff('day', DATE '2024-01-01', ts::DATE) // 7) || '.gpx'
           AS gpx_file,
         event_id AS point_no, ts + INTERVAL 7 HOUR AS recorded_at,
         47 + (event_id % 1000)::DOUBLE / 1024 AS latitude, -122 - (event_id % 997)::DOUBLE / 1024 AS longitude,
         CASE WHEN event_id % 19 <> 0 THEN 0.25::DOUBLE * (event_id % 300) END AS elevation,
         CASE WHEN event_id % 17 <> 0 THEN 0.125::DOUBLE * (event_id % 40) END AS speed
  FROM base WHERE event_type = 'view'),
profile AS (
  SELECT subject_id, key, value FROM (
    SELECT subject_id, unnest([
      {{'key': 'age', 'value': CASE WHEN subject_id % 4 = 0 THEN NULL WHEN subject_id % 7 = 6 THEN 'n/a'
                               ELSE (25 + subject_id % 40)::VARCHAR END}},
      {{'key': 'date_of_birth', 'value': CASE WHEN subject_id % 8 = 0
                               THEN (1960 + subject_id % 40)::VARCHAR || '-05-17' END}},
      {{'key': 'sex', 'value': CASE WHEN subject_id % 2 = 0 THEN 'female' ELSE 'male' END}},
      {{'key': 'weight_lbs', 'value': (140 + subject_id % 80)::VARCHAR}},
      {{'key': 'height_in', 'value': CASE WHEN subject_id % 3 <> 0 THEN (60 + subject_id % 15)::VARCHAR END}}],
      recursive := true)
    FROM subjects)
  WHERE value IS NOT NULL),
wide AS (
  SELECT subject_id, max(value) FILTER (key = 'age') AS age, max(value) FILTER (key = 'sex') AS sex,
         max(value) FILTER (key = 'weight_lbs') AS weight_lbs, max(value) FILTER (key = 'height_in') AS height_in,
         max(value) FILTER (key = 'date_of_birth') AS date_of_birth
  FROM profile GROUP BY subject_id),
d_steps AS (
  SELECT subject_id, start_date::DATE AS date, sum(value)::BIGINT AS steps
  FROM records WHERE record_type = 'StepCount' GROUP BY ALL),
d_hr AS (
  SELECT subject_id, start_date::DATE AS date, round(avg(value), 1) AS avg_hr, round(min(value), 1) AS min_hr,
         round(max(value), 1) AS max_hr
  FROM records WHERE record_type = 'HeartRate' GROUP BY ALL),
d_rhr AS (
  SELECT subject_id, start_date::DATE AS date, round(avg(value), 1) AS resting_hr
  FROM records WHERE record_type = 'RestingHeartRate' GROUP BY ALL),
device_nights AS (
  SELECT subject_id, start_date::DATE AS date, max(epoch(end_date) - epoch(start_date)) AS duration_seconds
  FROM records WHERE record_type = 'SleepAnalysis' GROUP BY ALL HAVING duration_seconds > 3600),
nights AS (
  SELECT subject_id, d AS date, 'sleep_cycle' AS source, sleep_quality, time_asleep_seconds AS duration_seconds,
         deep_seconds, light_seconds, dream_seconds, awake_seconds, heart_rate_bpm
  FROM sleep
  UNION ALL BY NAME
  SELECT n.*, 'apple_health' AS source FROM device_nights n
  WHERE NOT EXISTS (SELECT 1 FROM sleep a WHERE a.subject_id = n.subject_id AND a.d = n.date)),
good_nights AS (SELECT * FROM nights WHERE date BETWEEN {S} AND {E} AND duration_seconds > 0),
w AS (SELECT * FROM workouts WHERE d BETWEEN {S} AND {E}),
z AS (SELECT * FROM sleep WHERE d BETWEEN {S} AND {E}),
minutes_by_day AS (SELECT subject_id, d AS date, sum(duration) AS workout_min FROM workouts GROUP BY ALL),
rings AS (
  SELECT subject_id, date_components AS date,
         (active_energy_burned >= active_energy_burned_goal AND active_energy_burned_goal > 0)::INT AS r1,
         (apple_exercise_time >= apple_exercise_time_goal AND apple_exercise_time_goal > 0)::INT AS r2,
         (apple_stand_hours >= apple_stand_hours_goal AND apple_stand_hours_goal > 0)::INT AS r3,
         active_energy_burned, apple_exercise_time, apple_stand_hours
  FROM activity),
in_run AS (
  SELECT w.subject_id, w.start_date, w.d, r.record_type, r.value
  FROM w JOIN records r ON r.subject_id = w.subject_id AND r.start_date BETWEEN w.start_date AND w.end_date
  WHERE contains(w.workout_activity_type, 'Running')),
run_miles AS (
  SELECT subject_id, start_date, sum(value) AS miles FROM in_run
  WHERE record_type = 'DistanceWalkingRunning' GROUP BY ALL),
walk_miles AS (
  SELECT w.subject_id, w.start_date, sum(r.value) AS miles
  FROM w JOIN records r ON r.subject_id = w.subject_id AND r.start_date BETWEEN w.start_date AND w.end_date
  WHERE contains(w.workout_activity_type, 'Walking') AND r.record_type = 'DistanceWalkingRunning' GROUP BY ALL),
ride_miles AS (
  SELECT w.subject_id, w.start_date, sum(r.value) AS miles
  FROM w JOIN records r ON r.subject_id = w.subject_id AND r.start_date BETWEEN w.start_date AND w.end_date
  WHERE contains(w.workout_activity_type, 'Cycling') AND r.record_type = 'DistanceCycling' GROUP BY ALL),
top_six AS (
  SELECT subject_id, workout_activity_type AS type FROM w GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY count(*) DESC, type) <= 6),
streaks AS (
  SELECT subject_id, d - row_number() OVER (PARTITION BY subject_id ORDER BY d)::INT AS run
  FROM (SELECT DISTINCT subject_id, d FROM w)),
best_streak AS (
  SELECT subject_id, max(n) AS workout_streak
  FROM (SELECT subject_id, run, count(*) AS n FROM streaks GROUP BY ALL) GROUP BY ALL),
routes AS (
  SELECT subject_id, gpx_file, min(recorded_at) AS first_at, min(recorded_at) - INTERVAL 7 HOUR AS route_start,
         max(recorded_at) - INTERVAL 7 HOUR AS route_end, count(*) AS pt_count
  FROM points WHERE recorded_at::DATE BETWEEN {S} AND {E} GROUP BY ALL),
legs AS (
  SELECT subject_id, gpx_file, latitude AS a1, longitude AS o1, lead(latitude) OVER p AS a2, lead(longitude) OVER p AS o2
  FROM points SEMI JOIN routes USING (subject_id, gpx_file)
  WINDOW p AS (PARTITION BY subject_id, gpx_file ORDER BY recorded_at, point_no)),
route_miles AS (
  SELECT subject_id, gpx_file,
         round(sum(2 * 3959 * asin(sqrt(pow(sin(radians(a2 - a1) / 2), 2)
               + cos(radians(a1)) * cos(radians(a2)) * pow(sin(radians(o2 - o1) / 2), 2)))), 2) AS miles
  FROM legs GROUP BY ALL),
route_rows AS (
  SELECT r.subject_id, r.gpx_file, r.route_start, replace(m.workout_activity_type, 'HKWorkoutActivityType', '')
           AS workout_type, m.d AS date, nullif(round(m.duration, 1), 0) AS duration_min,
         nullif(g.miles, 0) AS distance_mi, r.pt_count
  FROM routes r
  LEFT JOIN (
    SELECT r.subject_id, r.gpx_file, x.* EXCLUDE (subject_id)
    FROM routes r JOIN workouts x ON x.subject_id = r.subject_id
     AND x.start_date <= r.route_end AND x.end_date >= r.route_start
    QUALIFY row_number() OVER (PARTITION BY r.subject_id, r.gpx_file
      ORDER BY abs(epoch(x.start_date) - epoch(r.route_start)), x.start_date, x.workout_activity_type, x.duration) = 1
  ) m ON m.subject_id = r.subject_id AND m.gpx_file = r.gpx_file
  LEFT JOIN route_miles g ON g.subject_id = r.subject_id AND g.gpx_file = r.gpx_file),
placed AS (
  SELECT p.*, r.pt_count, row_number() OVER t AS pos, count(*) OVER (PARTITION BY p.subject_id, p.gpx_file) AS total
  FROM points p JOIN routes r ON r.subject_id = p.subject_id AND r.gpx_file = p.gpx_file
  WINDOW t AS (PARTITION BY p.subject_id, p.gpx_file ORDER BY p.recorded_at, p.point_no)),
sampled AS (
  SELECT subject_id, gpx_file, pos, latitude, longitude, elevation, speed
  FROM placed
  WHERE pos = 1 OR pos = total OR pos % greatest(1, pt_count // 4) = 0),
scores AS (
  SELECT subject_id, d AS date, start_time, end_time, time_in_bed_seconds, time_asleep_seconds,
         greatest(0, least(100, (
           (CASE WHEN h < 7 THEN greatest(0, h / 7 * 100) WHEN h > 8 THEN greatest(0, 100 - (h - 8) * 25) ELSE 100 END)
             * 0.4::DOUBLE
           + coalesce(CASE WHEN time_in_bed_seconds > 0 THEN time_asleep_seconds / time_in_bed_seconds * 100 END, 0)
             * 0.25::DOUBLE
           + coalesce(regularity * 100, 0) * 0.15::DOUBLE
           + coalesce(CASE WHEN l IS NOT NULL THEN greatest(0, least(100, (60 - l) / 50 * 100)) END, 0) * 0.1::DOUBLE
           + coalesce(CASE WHEN st > 0 THEN least(100, deep_seconds / st * 100 / 20 * 100) END, 0) * 0.1::DOUBLE
         )::BIGINT)) AS score
  FROM (SELECT *, time_asleep_seconds / 3600 AS h, time_before_sleep_seconds / 60 AS l,
               deep_seconds + light_seconds + dream_seconds + awake_seconds AS st FROM z)
  WHERE time_asleep_seconds > 0),
top_rates AS (
  SELECT s.subject_id,
         (CASE WHEN p.age IS NOT NULL THEN coalesce(220 - TRY_CAST(p.age AS BIGINT), 190)
               WHEN p.date_of_birth IS NOT NULL
                 THEN 220 - floor(date_diff('day', p.date_of_birth::DATE, {E}) / 365) ELSE 190 END)::BIGINT AS max_hr
  FROM subjects s LEFT JOIN wide p USING (subject_id)),
head_now AS (
  SELECT s.subject_id, a.avg_steps, b.avg_resting_hr, c.avg_sleep_hours, d.avg_hrv
  FROM subjects s
  LEFT JOIN (SELECT subject_id, round(avg(steps))::BIGINT AS avg_steps FROM d_steps
             WHERE date BETWEEN {S} AND {E} GROUP BY ALL) a USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(resting_hr), 1) AS avg_resting_hr FROM d_rhr
             WHERE date BETWEEN {S} AND {E} GROUP BY ALL) b USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(duration_seconds) / 3600, 1) AS avg_sleep_hours FROM good_nights
             GROUP BY ALL) c USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(value))::BIGINT AS avg_hrv FROM records
             WHERE record_type = 'HeartRateVariabilitySDNN' AND start_date::DATE BETWEEN {S} AND {E}
             GROUP BY ALL) d USING (subject_id)),
head_before AS (
  SELECT s.subject_id, a.avg_steps, b.avg_resting_hr, c.avg_sleep_hours, d.avg_hrv
  FROM subjects s
  LEFT JOIN (SELECT subject_id, round(avg(steps))::BIGINT AS avg_steps FROM d_steps
             WHERE date BETWEEN {PS} AND {PE} GROUP BY ALL) a USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(resting_hr), 1) AS avg_resting_hr FROM d_rhr
             WHERE date BETWEEN {PS} AND {PE} GROUP BY ALL) b USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(duration_seconds) / 3600, 1) AS avg_sleep_hours FROM nights
             WHERE date BETWEEN {PS} AND {PE} AND duration_seconds > 0 GROUP BY ALL) c USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(value))::BIGINT AS avg_hrv FROM records
             WHERE record_type = 'HeartRateVariabilitySDNN' AND start_date::DATE BETWEEN {PS} AND {PE}
             GROUP BY ALL) d USING (subject_id)),
pace AS (
  SELECT subject_id, start_date::DATE AS date, round(duration, 1) AS duration_min, round(total_distance, 2) AS distance,
         (format('{{:.2f}}', nullif(ms, 0) * 2.23694::DOUBLE))::DOUBLE AS avg_speed_mph
  FROM (SELECT w.subject_id, w.start_date, w.duration, w.total_distance, w.total_distance_unit,
               round(avg(r.value), 2) AS ms
        FROM w LEFT JOIN records r ON r.subject_id = w.subject_id AND r.record_type = 'RunningSpeed'
         AND r.start_date BETWEEN w.start_date AND w.end_date AND r.end_date BETWEEN w.start_date AND w.end_date
        WHERE contains(w.workout_activity_type, 'Running') AND w.duration > 5 GROUP BY ALL)),
run_distance AS (
  SELECT w.subject_id, w.start_date, w.d AS date, w.duration, round(sum(r.value), 2) AS distance
  FROM w JOIN records r ON r.subject_id = w.subject_id AND r.record_type = 'DistanceWalkingRunning'
   AND r.start_date BETWEEN w.start_date AND w.end_date AND r.end_date BETWEEN w.start_date AND w.end_date
  WHERE contains(w.workout_activity_type, 'Running') AND w.duration > 5 GROUP BY ALL),
ride_totals AS (
  SELECT w.subject_id, w.start_date,
         round(sum(r.value) FILTER (r.record_type = 'DistanceCycling'), 2) AS distance,
         round(sum(r.value) FILTER (r.record_type = 'ActiveEnergyBurned'), 0) AS calories
  FROM w JOIN records r ON r.subject_id = w.subject_id
   AND r.start_date BETWEEN w.start_date AND w.end_date AND r.end_date BETWEEN w.start_date AND w.end_date
  WHERE contains(w.workout_activity_type, 'Cycling') GROUP BY ALL),
rides AS (
  SELECT w.subject_id, w.d AS date, x.distance, round(w.duration, 1) AS duration_min, x.calories
  FROM w LEFT JOIN ride_totals x ON x.subject_id = w.subject_id AND x.start_date = w.start_date
  WHERE contains(w.workout_activity_type, 'Cycling') AND w.duration > 5)
"""

_REC = f"record_type = '{{}}' AND start_date::DATE BETWEEN {S} AND {E}"
_NIGHT_FRAME = (
    "(PARTITION BY subject_id ORDER BY {}, start_time, end_time, time_in_bed_seconds, time_asleep_seconds, {} "
    "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
)


def _daily(kind: str, agg: str, rows: int) -> str:
    return f"""
SELECT subject_id, start_date::DATE AS date, round({agg}(value), 2) AS val,
       round(avg({agg}(value)) OVER (PARTITION BY subject_id ORDER BY start_date::DATE
             ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), 2) AS ma
FROM records WHERE {_REC.format(kind)} GROUP BY subject_id, start_date::DATE"""


def _night_trend(metric: str, keep: str) -> str:
    return f"""
SELECT subject_id, d AS date, round({metric}, 1) AS val, round(avg({metric}) OVER {_NIGHT_FRAME.format('d', metric)}, 1) AS ma
FROM z WHERE {keep}"""


def _best(rows: str, rank: str, ties: str, shown: str) -> str:
    """First row per subject by rank, then ties."""
    return f"""SELECT {shown} FROM {rows}
  QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY {rank}, {ties}) = 1"""


_MILES = "CASE WHEN total_distance_unit = 'km' THEN total_distance * 0.621371::DOUBLE ELSE total_distance END"


def _session_record(label: str, kind: str, as_text: bool) -> str:
    day = "d::VARCHAR" if as_text else "d"
    rows = f"(SELECT *, {_MILES} AS mi FROM w WHERE contains(workout_activity_type, '{kind}') AND total_distance IS NOT NULL)"
    return _best(
        rows, "mi DESC", "d", f"subject_id, '{label}' AS label, round(mi, 1)::VARCHAR || ' mi' AS value, {day} AS date"
    )


def _spark(series: str, rows: str, value: str, order: str) -> str:
    desc = ", ".join(f"{c} DESC" for c in order.split(", "))
    return f"""SELECT subject_id, '{series}' AS series,
       row_number() OVER (PARTITION BY subject_id ORDER BY back DESC) AS place, value::DOUBLE AS value
FROM (SELECT subject_id, {value} AS value, row_number() OVER (PARTITION BY subject_id ORDER BY {desc}) AS back
      FROM ({rows}) WHERE {value} IS NOT NULL) WHERE back <= 30"""


_WEEKLY = """
SELECT w.subject_id, date_trunc('week', w.d)::DATE AS week, coalesce(t.type, 'Other') AS type, {} 
FROM w LEFT JOIN top_six t ON t.subject_id = w.subject_id AND t.type = w.workout_activity_type GROUP BY 1, 2, 3"""
_WEEKLY_COUNT = _WEEKLY.format("count(*) AS count")
_WEEKLY_MINUTES = _WEEKLY.format("round(sum(w.duration), 0)::BIGINT AS minutes")

_STEPS = f"""
SELECT subject_id, date, steps, (avg(steps) OVER (PARTITION BY subject_id ORDER BY date
       ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::BIGINT AS steps_7d_avg
FROM d_steps WHERE date BETWEEN {S} AND {E}"""

_HEART = f"""
SELECT h.subject_id, h.date, h.avg_hr, h.min_hr, h.max_hr, r.resting_hr
FROM d_hr h LEFT JOIN d_rhr r ON r.subject_id = h.subject_id AND r.date = h.date
WHERE h.date BETWEEN {S} AND {E}"""

_RINGS = f"""
SELECT subject_id, date_components AS date, active_energy_burned AS energy, active_energy_burned_goal AS energy_goal,
       apple_exercise_time AS exercise, apple_exercise_time_goal AS exercise_goal,
       apple_stand_hours AS stand, apple_stand_hours_goal AS stand_goal
FROM activity WHERE date_components BETWEEN {S} AND {E}"""

_SLEEP = """
SELECT subject_id, date, source, round(duration_seconds / 3600, 2) AS hours, sleep_quality AS quality
FROM good_nights"""

_SCORES = f"""
SELECT subject_id, date, score, (avg(score) OVER {_NIGHT_FRAME.format("date", "score")})::BIGINT AS score_7d_avg
FROM scores"""

_EFFICIENCY = _night_trend("time_asleep_seconds / nullif(time_in_bed_seconds, 0) * 100", "time_in_bed_seconds > 0")
_LATENCY = _night_trend("time_before_sleep_seconds / 60", "time_before_sleep_seconds > 0")
_SNORE = _night_trend("snore_time_seconds / 60", "snore_time_seconds > 0")

_MONTHLY = f"""
SELECT k.subject_id, strftime(k.month, '%Y-%m') AS month, a.total_steps, a.avg_daily_steps, b.workouts,
       b.total_workout_min, c.avg_sleep_hrs, d.avg_resting_hr, e.avg_vo2max, f.avg_hrv
FROM (SELECT DISTINCT s.subject_id, date_trunc('month', g.day)::DATE AS month
      FROM subjects s, (SELECT unnest(generate_series({S}, {E}, INTERVAL 1 DAY)) AS day) g) k
LEFT JOIN (SELECT subject_id, date_trunc('month', date)::DATE AS month, sum(steps)::BIGINT AS total_steps,
                  round(avg(steps))::BIGINT AS avg_daily_steps
           FROM d_steps WHERE date BETWEEN {S} AND {E} GROUP BY 1, 2) a USING (subject_id, month)
LEFT JOIN (SELECT subject_id, date_trunc('month', d)::DATE AS month, count(*) AS workouts,
                  round(sum(duration)) AS total_workout_min FROM w GROUP BY 1, 2) b USING (subject_id, month)
LEFT JOIN (SELECT subject_id, date_trunc('month', date)::DATE AS month,
                  round(avg(duration_seconds) / 3600, 1) AS avg_sleep_hrs
           FROM good_nights GROUP BY 1, 2) c USING (subject_id, month)
LEFT JOIN (SELECT subject_id, date_trunc('month', date)::DATE AS month, round(avg(resting_hr), 1) AS avg_resting_hr
           FROM d_rhr WHERE date BETWEEN {S} AND {E} GROUP BY 1, 2) d USING (subject_id, month)
LEFT JOIN (SELECT subject_id, date_trunc('month', start_date)::DATE AS month, round(avg(value), 1) AS avg_vo2max
           FROM records WHERE {_REC.format("VO2Max")} GROUP BY 1, 2) e USING (subject_id, month)
LEFT JOIN (SELECT subject_id, date_trunc('month', start_date)::DATE AS month, round(avg(value), 1) AS avg_hrv
           FROM records WHERE {_REC.format("HeartRateVariabilitySDNN")} GROUP BY 1, 2) f USING (subject_id, month)"""

_PACE = """
SELECT subject_id, date, duration_min, distance, avg_speed_mph,
       CASE WHEN avg_speed_mph > 0 THEN format('{:.2f}', 60.0::DOUBLE / avg_speed_mph)::DOUBLE END AS pace_min_per_mi
FROM pace"""

_CORRELATION = f"""
SELECT t.subject_id, t.date, t.steps, r.resting_hr, n.sleep_hrs, n.sleep_quality, m.workout_min
FROM d_steps t
LEFT JOIN d_rhr r ON r.subject_id = t.subject_id AND r.date = t.date
LEFT JOIN (SELECT subject_id, date, max(duration_seconds) / 3600 AS sleep_hrs, max(sleep_quality) AS sleep_quality
           FROM nights WHERE duration_seconds > 0 GROUP BY 1, 2) n ON n.subject_id = t.subject_id AND n.date = t.date
LEFT JOIN minutes_by_day m ON m.subject_id = t.subject_id AND m.date = t.date
WHERE t.date BETWEEN {S} AND {E} AND t.steps IS NOT NULL"""

_ZONES = f"""
SELECT r.subject_id, date_trunc('week', r.start_date)::DATE AS week,
       (coalesce(sum(m) FILTER (value < 0.5 * max_hr), 0) / 60)::BIGINT AS rest,
       (coalesce(sum(m) FILTER (value >= 0.5 * max_hr AND value < 0.6 * max_hr), 0) / 60)::BIGINT AS fat_burn,
       (coalesce(sum(m) FILTER (value >= 0.6 * max_hr AND value < 0.7 * max_hr), 0) / 60)::BIGINT AS cardio,
       (coalesce(sum(m) FILTER (value >= 0.7 * max_hr AND value < 0.85 * max_hr), 0) / 60)::BIGINT AS peak,
       (coalesce(sum(m) FILTER (value >= 0.85 * max_hr), 0) / 60)::BIGINT AS max_zone
FROM (SELECT *, greatest(epoch(end_date) - epoch(start_date), 60) AS m FROM records
      WHERE {_REC.format("HeartRate")}) r JOIN top_rates t ON t.subject_id = r.subject_id
GROUP BY 1, 2"""

_BMI = f"""
SELECT subject_id, date, bmi, format('{{:.1f}}', avg(bmi) OVER (PARTITION BY subject_id ORDER BY date
       ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::DOUBLE AS bmi_7d_avg
FROM (SELECT r.subject_id, r.start_date::DATE AS date,
             round(avg(r.value) * 0.453592::DOUBLE
                   / ((p.height_in::DOUBLE * 0.0254::DOUBLE) * (p.height_in::DOUBLE * 0.0254::DOUBLE)), 1) AS bmi
      FROM records r JOIN wide p ON p.subject_id = r.subject_id
      WHERE {_REC.format("BodyMass")} AND p.height_in IS NOT NULL GROUP BY r.subject_id, date, p.height_in)"""

_WEIGHT = f"""
SELECT subject_id, start_date::DATE AS date, round(avg(value), 1) AS weight
FROM records WHERE {_REC.format("BodyMass")} GROUP BY 1, 2"""

_PCT = "CASE WHEN value <= 1 THEN value * 100 ELSE value END"

_CARD_PARTS = f"""
c_rec AS (
  SELECT subject_id,
         round(max_by(value, start_date) FILTER (record_type = 'VO2Max'), 1) AS vo2max_latest,
         round(max(value) FILTER (record_type = 'VO2Max'), 1) AS vo2max_peak,
         round(avg(value) FILTER (record_type = 'HeartRateVariabilitySDNN'))::BIGINT AS avg_hrv,
         round(sum(value) FILTER (record_type = 'FlightsClimbed'))::BIGINT AS total_flights,
         round(avg(value) FILTER (record_type = 'WalkingSpeed'), 1) AS avg_walking_speed,
         round(avg({_PCT}) FILTER (record_type = 'OxygenSaturation'), 1) AS avg_spo2,
         round(avg(value) FILTER (record_type = 'RespiratoryRate'), 1) AS avg_resp_rate
  FROM records WHERE start_date::DATE BETWEEN {S} AND {E} GROUP BY 1),
c_dist AS (
  SELECT subject_id, round(avg(x), 1) AS avg_daily_distance
  FROM (SELECT subject_id, start_date::DATE AS d, sum(value) AS x FROM records
        WHERE {_REC.format("DistanceWalkingRunning")} GROUP BY 1, 2) GROUP BY 1),
c_work AS (
  SELECT subject_id, count(*) AS workouts, count(DISTINCT d) AS active_days,
         round(sum(duration) / 60, 0)::BIGINT AS total_workout_hrs, round(avg(duration))::BIGINT AS avg_workout_dur,
         round(sum(total_energy_burned))::BIGINT AS total_calories,
         count(*) FILTER (contains(workout_activity_type, 'Running')) AS run_count,
         round(avg(duration) FILTER (contains(workout_activity_type, 'Running')))::BIGINT AS avg_run_dur,
         count(*) FILTER (contains(workout_activity_type, 'Cycling')) AS cycling_count,
         count(*) FILTER (strong) AS strength_count,
         round(sum(duration) FILTER (strong))::BIGINT AS strength_total_min,
         round(avg(duration) FILTER (strong))::BIGINT AS strength_avg_min,
         round(sum(total_energy_burned) FILTER (strong))::BIGINT AS strength_total_cal
  FROM (SELECT *, regexp_matches(workout_activity_type,
               'HIIT|FunctionalStrengthTraining|CoreTraining|TraditionalStrengthTraining') AS strong FROM w) GROUP BY 1),
c_night AS (SELECT subject_id, round(avg(duration_seconds) / 3600, 1) AS avg_sleep_hours FROM good_nights GROUP BY 1),
c_stage AS (
  SELECT subject_id, round(avg(deep_seconds) / 3600, 1) AS avg_deep_sleep,
         round(avg(dream_seconds) / 3600, 1) AS avg_rem_sleep,
         round(max(sleep_quality) * 100, 0)::BIGINT AS best_sleep_quality
  FROM z WHERE deep_seconds + light_seconds + dream_seconds + awake_seconds > 0 GROUP BY 1),
c_ring AS (
  SELECT subject_id, round(100.0::DOUBLE * sum(r1 * r2 * r3) / count(*), 1) AS ring_close_pct
  FROM rings WHERE date BETWEEN {S} AND {E} GROUP BY 1),
c_run AS (
  SELECT subject_id, count(*) FILTER (miles >= 26) AS marathons,
         count(*) FILTER (miles >= 13 AND miles < 26) AS half_marathons,
         round(max(miles), 1) AS longest_run_mi, round(sum(miles), 0)::BIGINT AS total_run_mi
  FROM run_miles GROUP BY 1),
c_walk AS (SELECT subject_id, round(max(miles), 1) AS longest_walk_mi FROM walk_miles GROUP BY 1),
c_ride AS (
  SELECT subject_id, round(sum(miles), 0)::BIGINT AS total_cycling_mi, round(max(miles), 1) AS longest_ride_mi
  FROM ride_miles GROUP BY 1),
c_power AS (
  SELECT subject_id, round(avg(value))::BIGINT AS avg_run_power FROM in_run
  WHERE record_type = 'RunningPower' GROUP BY 1)"""

_CARDS = """
SELECT s.subject_id, coalesce(h.avg_steps, 0) AS avg_steps, h.avg_resting_hr, coalesce(workouts, 0) AS workouts,
       n.avg_sleep_hours, ring_close_pct, coalesce(marathons, 0) AS marathons,
       coalesce(half_marathons, 0) AS half_marathons, coalesce(longest_run_mi, 0) AS longest_run_mi,
       coalesce(total_run_mi, 0) AS total_run_mi, coalesce(longest_walk_mi, 0) AS longest_walk_mi,
       coalesce(workout_streak, 0) AS workout_streak, coalesce(active_days, 0) AS active_days,
       coalesce(cycling_count, 0) AS cycling_count, coalesce(total_cycling_mi, 0) AS total_cycling_mi,
       coalesce(longest_ride_mi, 0) AS longest_ride_mi, coalesce(total_workout_hrs, 0) AS total_workout_hrs,
       vo2max_latest, vo2max_peak, r.avg_hrv, coalesce(total_flights, 0) AS total_flights, avg_walking_speed,
       avg_deep_sleep, avg_rem_sleep, best_sleep_quality, avg_run_power, coalesce(run_count, 0) AS run_count,
       avg_run_dur, coalesce(total_calories, 0) AS total_calories, avg_workout_dur, avg_spo2, avg_resp_rate,
       avg_daily_distance, coalesce(strength_count, 0) AS strength_count,
       coalesce(strength_total_min, 0) AS strength_total_min, coalesce(strength_avg_min, 0) AS strength_avg_min,
       coalesce(strength_total_cal, 0) AS strength_total_cal
FROM subjects s LEFT JOIN head_now h USING (subject_id) LEFT JOIN c_rec r USING (subject_id)
LEFT JOIN c_dist USING (subject_id) LEFT JOIN c_work USING (subject_id) LEFT JOIN c_night n USING (subject_id)
LEFT JOIN c_stage USING (subject_id) LEFT JOIN c_ring USING (subject_id) LEFT JOIN c_run USING (subject_id)
LEFT JOIN c_walk USING (subject_id) LEFT JOIN c_ride USING (subject_id) LEFT JOIN c_power USING (subject_id)
LEFT JOIN best_streak USING (subject_id)"""

_STAT_PARTS = f"""
s_steps AS (
  SELECT s.subject_id, coalesce(total, 0)::BIGINT AS total, coalesce(daily_avg, 0) AS daily_avg,
         coalesce(min_day, 0) AS min_day, coalesce(max_day, 0) AS max_day,
         coalesce(prior_daily_avg, 0) AS prior_daily_avg
  FROM subjects s
  LEFT JOIN (SELECT subject_id, sum(steps) AS total, round(avg(steps))::BIGINT AS daily_avg, min(steps) AS min_day,
                    max(steps) AS max_day FROM d_steps WHERE date BETWEEN {S} AND {E} GROUP BY 1) a USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(steps))::BIGINT AS prior_daily_avg FROM d_steps
             WHERE date BETWEEN {PS} AND {PE} GROUP BY 1) b USING (subject_id)),
s_heart AS (
  SELECT s.subject_id, a.* EXCLUDE (subject_id), b.* EXCLUDE (subject_id), c.prior_avg_resting
  FROM subjects s
  LEFT JOIN (SELECT subject_id, round(avg(resting_hr), 1) AS avg_resting, round(min(resting_hr), 1) AS min_resting,
                    round(max(resting_hr), 1) AS max_resting
             FROM d_rhr WHERE date BETWEEN {S} AND {E} GROUP BY 1) a USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(avg_hr), 1) AS avg_overall, round(min(min_hr), 1) AS min_overall,
                    round(max(max_hr), 1) AS max_overall
             FROM d_hr WHERE date BETWEEN {S} AND {E} GROUP BY 1) b USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(resting_hr), 1) AS prior_avg_resting
             FROM d_rhr WHERE date BETWEEN {PS} AND {PE} GROUP BY 1) c USING (subject_id)),
s_sleep AS (
  SELECT s.subject_id, avg_hours, min_hours, max_hours, coalesce(nights_tracked, 0) AS nights_tracked,
         avg_quality_pct, prior_avg_hours, avg_deep_min, avg_light_min, avg_dream_min, avg_awake_min
  FROM subjects s
  LEFT JOIN (SELECT subject_id, round(avg(duration_seconds) / 3600, 1) AS avg_hours,
                    round(min(duration_seconds) / 3600, 1) AS min_hours,
                    round(max(duration_seconds) / 3600, 1) AS max_hours, count(*) AS nights_tracked
             FROM good_nights GROUP BY 1) a USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(sleep_quality) * 100, 1) AS avg_quality_pct
             FROM z WHERE sleep_quality > 0 GROUP BY 1) b USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(duration_seconds) / 3600, 1) AS prior_avg_hours FROM nights
             WHERE date BETWEEN {PS} AND {PE} AND duration_seconds > 0 GROUP BY 1) c USING (subject_id)
  LEFT JOIN (SELECT subject_id, round(avg(deep_seconds) / 60, 0) AS avg_deep_min,
                    round(avg(light_seconds) / 60, 0) AS avg_light_min,
                    round(avg(dream_seconds) / 60, 0) AS avg_dream_min,
                    round(avg(awake_seconds) / 60, 0) AS avg_awake_min FROM z GROUP BY 1) d USING (subject_id)),
s_work AS (
  SELECT s.subject_id, coalesce(n, 0) AS count, coalesce(mins, 0) AS total_duration_min,
         coalesce(dist, 0) AS total_distance, coalesce(kcal, 0) AS avg_calories
  FROM subjects s
  LEFT JOIN (SELECT subject_id, count(*) AS n, round(sum(duration), 0) AS mins, round(sum(total_distance), 1) AS dist,
                    round(avg(total_energy_burned), 0) AS kcal FROM w GROUP BY 1) a USING (subject_id)),
s_types AS (
  SELECT subject_id, workout_activity_type AS type, count(*) AS count, round(sum(duration), 0) AS total_min,
         round(sum(total_distance), 1) AS total_dist,
         row_number() OVER (PARTITION BY subject_id ORDER BY count(*) DESC, workout_activity_type) AS rank
  FROM w GROUP BY 1, 2 QUALIFY rank <= 10),
s_rings AS (
  SELECT s.subject_id, coalesce(days_tracked, 0) AS days_tracked, move_close_pct, exercise_close_pct, stand_close_pct,
         all_rings_closed_days
  FROM subjects s
  LEFT JOIN (SELECT subject_id, count(*) AS days_tracked, round(100.0::DOUBLE * sum(r1) / count(*), 1) AS move_close_pct,
                    round(100.0::DOUBLE * sum(r2) / count(*), 1) AS exercise_close_pct,
                    round(100.0::DOUBLE * sum(r3) / count(*), 1) AS stand_close_pct,
                    sum(r1 * r2 * r3)::BIGINT AS all_rings_closed_days
             FROM rings WHERE date BETWEEN {S} AND {E} GROUP BY 1) a USING (subject_id))"""

_DIGEST = f"""
SELECT s.subject_id,
  '# Health data for {START} to {END}' || chr(10) || 'Period length: {DAYS} days' || chr(10) || chr(10)
  || CASE WHEN p.subject_id IS NULL THEN '' ELSE '## User Profile' || chr(10)
     || coalesce('- Age: ' || p.age || ' years' || chr(10), '') || coalesce('- Sex: ' || p.sex || chr(10), '')
     || coalesce('- Weight: ' || p.weight_lbs || ' lbs' || chr(10), '')
     || coalesce('- Height: ' || p.height_in || ' inches' || chr(10), '') || chr(10) END
  || '## Steps' || chr(10) || format('- Daily average: {{:,}}', t.daily_avg) || chr(10)
  || format('- Total: {{:,}}', t.total) || chr(10) || format('- Best day: {{:,}} steps', t.max_day) || chr(10)
  || format('- Lowest day: {{:,}} steps', t.min_day) || chr(10)
  || CASE WHEN t.prior_daily_avg <> 0
     THEN format('- Prior period daily average: {{:,}}', t.prior_daily_avg) || chr(10) ELSE '' END
  || chr(10) || '## Heart Rate' || chr(10)
  || CASE WHEN h.avg_resting <> 0 THEN '- Average resting HR: ' || h.avg_resting || ' bpm' || chr(10)
     || '- Resting HR range: ' || h.min_resting || ' - ' || h.max_resting || ' bpm' || chr(10) ELSE '' END
  || CASE WHEN h.avg_overall <> 0
     THEN '- Overall HR range: ' || h.min_overall || ' - ' || h.max_overall || ' bpm' || chr(10) ELSE '' END
  || CASE WHEN h.prior_avg_resting <> 0
     THEN '- Prior period avg resting HR: ' || h.prior_avg_resting || ' bpm' || chr(10) ELSE '' END
  || chr(10) || '## Sleep' || chr(10)
  || CASE WHEN n.avg_hours <> 0 THEN '- Average sleep: ' || n.avg_hours || ' hours/night' || chr(10)
     || '- Range: ' || n.min_hours || ' - ' || n.max_hours || ' hours' || chr(10)
     || '- Nights tracked: ' || n.nights_tracked || chr(10) ELSE '' END
  || CASE WHEN n.avg_quality_pct <> 0
     THEN '- Average sleep quality (SleepCycle): ' || n.avg_quality_pct || '%' || chr(10) ELSE '' END
  || CASE WHEN n.avg_deep_min <> 0 THEN format(
     '- Sleep stages avg: {{:.0f}}min deep, {{:.0f}}min light, {{:.0f}}min dream, {{:.0f}}min awake',
     n.avg_deep_min, n.avg_light_min, n.avg_dream_min, n.avg_awake_min) || chr(10) ELSE '' END
  || CASE WHEN n.prior_avg_hours <> 0
     THEN '- Prior period avg: ' || n.prior_avg_hours || ' hours/night' || chr(10) ELSE '' END
  || chr(10) || '## Workouts' || chr(10) || '- Total workouts: ' || k.count || chr(10)
  || CASE WHEN k.total_duration_min <> 0
     THEN format('- Total duration: {{:.0f}} minutes', k.total_duration_min) || chr(10) ELSE '' END
  || CASE WHEN k.total_distance <> 0 THEN format('- Total distance: {{:.1f}}', k.total_distance) || chr(10) ELSE '' END
  || CASE WHEN k.avg_calories <> 0
     THEN format('- Average calories burned: {{:.0f}} kcal', k.avg_calories) || chr(10) ELSE '' END
  || coalesce('- Breakdown by type:' || chr(10) || y.lines || chr(10), '')
  || chr(10) || '## Activity Rings' || chr(10) || '- Days tracked: ' || g.days_tracked
  || CASE WHEN g.days_tracked > 0 THEN chr(10) || '- Move ring closed: ' || g.move_close_pct || '% of days' || chr(10)
     || '- Exercise ring closed: ' || g.exercise_close_pct || '% of days' || chr(10)
     || '- Stand ring closed: ' || g.stand_close_pct || '% of days' || chr(10)
     || '- All three rings closed: ' || g.all_rings_closed_days || ' days' ELSE '' END AS digest
FROM subjects s LEFT JOIN wide p USING (subject_id) JOIN s_steps t USING (subject_id)
JOIN s_heart h USING (subject_id) JOIN s_sleep n USING (subject_id) JOIN s_work k USING (subject_id)
JOIN s_rings g USING (subject_id)
LEFT JOIN (SELECT subject_id, string_agg(format('  - {{}}: {{}}x ({{:.0f}} min)',
                  replace(type, 'HKWorkoutActivityType', ''), count, total_min), chr(10) ORDER BY rank) AS lines
           FROM s_types GROUP BY 1) y USING (subject_id)"""

_DRAWN = "SEMI JOIN (SELECT DISTINCT subject_id, gpx_file FROM sampled WHERE latitude <> 0 AND longitude <> 0) USING (subject_id, gpx_file)"

_PERSONAL = f"""
SELECT subject_id, 'Most Steps' AS label, format('{{:,}}', steps) AS value, date
FROM ({_best("d_steps", "steps DESC", "date", "subject_id, steps, date").replace("FROM d_steps", f"FROM d_steps WHERE date BETWEEN {S} AND {E}")})
UNION ALL ({_session_record("Longest Run", "Running", False)})
UNION ALL
SELECT subject_id, 'Lowest Resting HR', resting_hr::VARCHAR || ' bpm', date
FROM ({_best("d_rhr", "resting_hr", "date", "subject_id, resting_hr, date").replace("FROM d_rhr", f"FROM d_rhr WHERE date BETWEEN {S} AND {E}")})
UNION ALL
SELECT subject_id, 'Peak VO2Max', round(value, 1)::VARCHAR, start_date::DATE
FROM ({_best("records", "value DESC", "start_date", "subject_id, value, start_date").replace("FROM records", f"FROM records WHERE {_REC.format('VO2Max')}")})
UNION ALL
SELECT subject_id, 'Best Sleep Quality', round(sleep_quality * 100, 0)::BIGINT::VARCHAR || '%', d
FROM ({_best("z", "sleep_quality DESC", "d", "subject_id, sleep_quality, d")})
UNION ALL
SELECT subject_id, 'Most Flights', format('{{:,}}', v), date
FROM ({_best(f"(SELECT subject_id, start_date::DATE AS date, sum(value)::BIGINT AS v FROM records WHERE {_REC.format('FlightsClimbed')} GROUP BY 1, 2)", "v DESC", "date", "subject_id, v, date")})"""

_PLAIN_TYPE = "replace(workout_activity_type, 'HKWorkoutActivityType', '')"

_TRAINING = f"""
SELECT subject_id, 'Longest Workout' AS label, v || ' min (' || t || ')' AS value, d::VARCHAR AS date
FROM ({_best("w", "duration DESC", "d, workout_activity_type", f"subject_id, round(duration, 0)::BIGINT AS v, {_PLAIN_TYPE} AS t, d")}) WHERE v <> 0
UNION ALL
SELECT subject_id, 'Most Calories', format('{{:,}}', v) || ' kcal (' || t || ')', d::VARCHAR
FROM ({_best("(SELECT * FROM w WHERE total_energy_burned > 0)", "total_energy_burned DESC", "d, workout_activity_type", f"subject_id, round(total_energy_burned)::BIGINT AS v, {_PLAIN_TYPE} AS t, d")}) WHERE v <> 0
UNION ALL SELECT * FROM ({_session_record("Longest Run", "Running", True)}) WHERE value <> '0.0 mi'
UNION ALL SELECT * FROM ({_session_record("Longest Ride", "Cycling", True)}) WHERE value <> '0.0 mi'
UNION ALL
SELECT subject_id, 'Peak Run Power', round(p)::BIGINT || ' W', start_date::DATE::VARCHAR
FROM ({_best("(SELECT subject_id, start_date, avg(value) AS p FROM in_run WHERE record_type = 'RunningPower' GROUP BY 1, 2)", "p DESC", "start_date", "subject_id, p, start_date")})
UNION ALL
SELECT subject_id, 'Busiest Week', n || ' workouts', 'Week of ' || week
FROM ({_best("(SELECT subject_id, date_trunc('week', d)::DATE AS week, count(*) AS n FROM w GROUP BY 1, 2)", "n DESC", "week", "subject_id, n, week")}) WHERE n > 1
UNION ALL
SELECT subject_id, 'Most Steps (Day)', format('{{:,}}', steps), date::VARCHAR
FROM ({_best(f"(SELECT * FROM d_steps WHERE date BETWEEN {S} AND {E})", "steps DESC", "date", "subject_id, steps, date")}) WHERE steps <> 0"""


def _json(dataset: str, rows: str, fields: list[str]) -> str:
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    return f"SELECT '{dataset}' AS dataset, subject_id, json_object({pairs})::VARCHAR AS json FROM ({rows})"


_ROW_COUNTS = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS \"table\", count(*) AS rows FROM {source}"
    for name, source in [
        ("records", "records"),
        ("workouts", "workouts"),
        ("activity", "activity"),
        ("route_points", "points"),
        ("sleep", "sleep"),
        ("profile", "profile"),
        ("subjects", "subjects"),
    ]
)

# Queries over the common tables alone.
_PLAIN: dict[str, str] = {
    "view_daily_steps": "SELECT * FROM d_steps",
    "view_daily_heart_rate": "SELECT * FROM d_hr",
    "view_daily_resting_hr": "SELECT * FROM d_rhr",
    "view_daily_summary": """
SELECT a.subject_id, a.date_components AS date, a.active_energy_burned, a.active_energy_burned_goal,
       a.apple_exercise_time, a.apple_exercise_time_goal, a.apple_stand_hours, a.apple_stand_hours_goal,
       t.steps, x.distance, r.resting_hr
FROM activity a
LEFT JOIN d_steps t ON t.subject_id = a.subject_id AND t.date = a.date_components
LEFT JOIN (SELECT subject_id, start_date::DATE AS date, round(sum(value), 2) AS distance FROM records
           WHERE record_type = 'DistanceWalkingRunning' GROUP BY 1, 2) x
  ON x.subject_id = a.subject_id AND x.date = a.date_components
LEFT JOIN d_rhr r ON r.subject_id = a.subject_id AND r.date = a.date_components""",
    "view_workout_summary": """
SELECT w.subject_id, w.start_date, w.end_date, w.workout_activity_type, w.duration, w.duration_unit, w.total_distance,
       w.total_distance_unit, w.total_energy_burned, w.total_energy_burned_unit,
       round(avg(r.value) FILTER (r.record_type = 'HeartRate'), 1) AS avg_heart_rate,
       round(min(r.value) FILTER (r.record_type = 'HeartRate'), 1) AS min_heart_rate,
       round(max(r.value) FILTER (r.record_type = 'HeartRate'), 1) AS max_heart_rate,
       round(avg(r.value) FILTER (r.record_type = 'RunningSpeed'), 2) AS avg_speed
FROM workouts w LEFT JOIN records r ON r.subject_id = w.subject_id AND r.record_type IN ('HeartRate', 'RunningSpeed')
 AND r.start_date BETWEEN w.start_date AND w.end_date AND r.end_date BETWEEN w.start_date AND w.end_date
GROUP BY ALL""",
    "view_sleep_combined": """
SELECT subject_id, date, source, sleep_quality, duration_seconds, deep_seconds, light_seconds, dream_seconds,
       awake_seconds, heart_rate_bpm FROM nights""",
    "steps_series": _STEPS,
    "heart_rate_series": _HEART,
    "rings_series": _RINGS,
    "weekday_profile": f"""
SELECT a.subject_id, a.dow, (['Sun','Mon','Tue','Wed','Thu','Fri','Sat'])[a.dow + 1] AS day,
       round(a.x)::BIGINT AS avg_steps, round(coalesce(b.x, 0), 1) AS avg_workout_min,
       round(coalesce(c.x, 0), 1) AS avg_sleep_hrs
FROM (SELECT subject_id, dayofweek(date) AS dow, avg(steps) AS x FROM d_steps
      WHERE date BETWEEN {S} AND {E} GROUP BY 1, 2) a
LEFT JOIN (SELECT subject_id, dayofweek(d) AS dow, sum(duration) / count(DISTINCT d) AS x FROM w GROUP BY 1, 2) b
  ON b.subject_id = a.subject_id AND b.dow = a.dow
LEFT JOIN (SELECT subject_id, dayofweek(date) AS dow, avg(duration_seconds) / 3600 AS x FROM good_nights GROUP BY 1, 2) c
  ON c.subject_id = a.subject_id AND c.dow = a.dow""",
    "monthly_summary": _MONTHLY,
    "correlation_rows": _CORRELATION,
    "daily_minimum_heart_rate": _daily("HeartRate", "min", 5),
    "vo2max_series": _daily("VO2Max", "avg", 30),
    "hrv_series": _daily("HeartRateVariabilitySDNN", "avg", 7),
    "respiratory_series": _daily("RespiratoryRate", "avg", 7),
    "walking_speed_series": _daily("WalkingSpeed", "avg", 14),
    "flights_series": _daily("FlightsClimbed", "sum", 7),
    "spo2_series": f"""
SELECT subject_id, start_date::DATE AS date, round(avg({_PCT}), 1) AS avg_pct, round(min({_PCT}), 1) AS min_pct
FROM records WHERE {_REC.format("OxygenSaturation")} GROUP BY 1, 2""",
    "weight_series": _WEIGHT,
    "bmi_series": _BMI,
    "activity_calendar": f"""
SELECT s.subject_id, g.day::DATE AS date, coalesce(r.r1 + r.r2 + r.r3, 0)::BIGINT AS rings,
       round(r.active_energy_burned)::BIGINT AS move_cal, round(r.apple_exercise_time)::BIGINT AS exercise_min,
       r.apple_stand_hours::BIGINT AS stand_hrs
FROM subjects s CROSS JOIN (SELECT unnest(generate_series({S}, {E}, INTERVAL 1 DAY)) AS day) g
LEFT JOIN rings r ON r.subject_id = s.subject_id AND r.date = g.day::DATE""",
    "week_review": f"""
SELECT s.subject_id, g.day::DATE AS date, strftime(g.day, '%a') AS day,
       EXISTS (SELECT 1 FROM workouts x WHERE x.subject_id = s.subject_id AND x.d = g.day::DATE) AS had_workout,
       coalesce(r.r1 + r.r2 + r.r3, 0)::BIGINT AS rings_closed
FROM subjects s CROSS JOIN (SELECT unnest(generate_series({E} - 6, {E}, INTERVAL 1 DAY)) AS day) g
LEFT JOIN rings r ON r.subject_id = s.subject_id AND r.date = g.day::DATE""",
    "heart_rate_zones": _ZONES,
    "max_heart_rate": "SELECT * FROM top_rates",
    "workout_type_counts": "SELECT subject_id, workout_activity_type AS type, count(*) AS count FROM w GROUP BY 1, 2",
    "running_pace": _PACE,
    "running_distance": """
SELECT subject_id, date, distance, round(duration, 1) AS duration_min FROM run_distance""",
    "cycling_sessions": "SELECT * FROM rides",
    "weekly_workouts": _WEEKLY_COUNT,
    "weekly_minutes": _WEEKLY_MINUTES,
    "workout_heatmap": """
SELECT subject_id, d AS date, dayofweek(d) AS dow, round(sum(duration), 0) AS total_min FROM w GROUP BY 1, 2, 3""",
    "running_mechanics": """
SELECT x.subject_id, x.d AS date, round(avg(value) FILTER (record_type = 'RunningPower'), 1) AS power,
       round(avg(value) FILTER (record_type = 'RunningGroundContactTime'), 1) AS gct,
       round(avg(value) FILTER (record_type = 'RunningVerticalOscillation'), 2) AS osc,
       round(avg(value) FILTER (record_type = 'RunningSpeed'), 2) AS speed
FROM in_run x JOIN w ON w.subject_id = x.subject_id AND w.start_date = x.start_date AND w.duration > 5
 AND contains(w.workout_activity_type, 'Running')
WHERE record_type IN ('RunningPower', 'RunningGroundContactTime', 'RunningVerticalOscillation', 'RunningSpeed')
GROUP BY 1, 2""",
    "longest_streak": """
SELECT s.subject_id, coalesce(workout_streak, 0) AS workout_streak FROM subjects s LEFT JOIN best_streak USING (subject_id)""",
    "current_streak": f"""
SELECT s.subject_id, coalesce(n, 0) AS current_streak
FROM subjects s LEFT JOIN (
  SELECT subject_id, max_by(n, last_day) AS n
  FROM (SELECT subject_id, run, count(*) AS n, max(d) AS last_day
        FROM (SELECT subject_id, d, d - row_number() OVER (PARTITION BY subject_id ORDER BY d)::INT AS run
              FROM (SELECT DISTINCT subject_id, d FROM workouts WHERE d <= {E})) GROUP BY 1, 2)
  GROUP BY 1) USING (subject_id)""",
    "workout_consistency": f"""
SELECT s.subject_id, coalesce(a.n, 0)::BIGINT AS current_streak, b.pct AS consistency_pct,
       coalesce(c.gap, 0)::DOUBLE AS longest_rest_gap
FROM subjects s
LEFT JOIN (SELECT subject_id, 1 AS n FROM workouts WHERE d <= {E} GROUP BY 1) a USING (subject_id)
LEFT JOIN (SELECT subject_id,
                  format('{{:.1f}}', count(*) FILTER (n >= 3)::DOUBLE / count(*) * 100)::DOUBLE AS pct
           FROM (SELECT subject_id, date_trunc('week', d) AS week, count(*) AS n FROM w GROUP BY 1, 2)
           GROUP BY 1) b USING (subject_id)
LEFT JOIN (SELECT subject_id, max(gap) AS gap
           FROM (SELECT subject_id, d - lag(d) OVER (PARTITION BY subject_id ORDER BY d) AS gap
                 FROM (SELECT DISTINCT subject_id, d FROM w)) GROUP BY 1) c USING (subject_id)""",
    "route_distances": "SELECT * FROM route_miles",
    "workout_routes": "SELECT * FROM route_rows",
    "route_points_sampled": "SELECT * FROM sampled",
    "route_elevation_gain": f"""
SELECT k.subject_id, k.gpx_file, CASE WHEN g.n > 1 THEN round_even(g.up * 3.28084::DOUBLE, 0) END AS ele_gain_ft
FROM (SELECT DISTINCT subject_id, gpx_file FROM placed {_DRAWN}) k
LEFT JOIN (SELECT subject_id, gpx_file, count(*) AS n, sum(greatest(0, rise)) FILTER (rise IS NOT NULL) AS up
           FROM (SELECT *, elevation - lag(elevation) OVER (PARTITION BY subject_id, gpx_file ORDER BY pos) AS rise
                 FROM placed WHERE elevation IS NOT NULL) GROUP BY 1, 2) g USING (subject_id, gpx_file)""",
    "route_elevation_profile": f"""
SELECT subject_id, gpx_file, pos, format('{{:.0f}}', elevation * 3.28084::DOUBLE)::DOUBLE AS ele_ft,
       format('{{:.1f}}', nullif(speed, 0) * 2.23694::DOUBLE)::DOUBLE AS speed_mph
FROM placed {_DRAWN} WHERE elevation IS NOT NULL""",
    "route_labels": """
SELECT subject_id, gpx_file,
       CASE WHEN label <> '' THEN label ELSE replace(gpx_file, '.gpx', '') END AS label,
       CASE WHEN p > 0 THEN floor(p)::BIGINT || ':' || lpad(floor((p - floor(p)) * 60 + 0.5)::BIGINT::VARCHAR, 2, '0') END AS pace
FROM (SELECT subject_id, gpx_file, duration_min / distance_mi AS p,
             concat_ws(' — ', strftime(date, '%b %d'), workout_type, CASE WHEN x <> '' THEN '(' || x || ')' END) AS label
      FROM (SELECT *, concat_ws(', ', format('{:.1f} mi', distance_mi), trunc(duration_min)::BIGINT || ' min') AS x
            FROM route_rows))""",
    "sleep_series": _SLEEP,
    "sleep_stages": """
SELECT subject_id, d AS date, round(deep_seconds / 3600, 2) AS deep, round(light_seconds / 3600, 2) AS light,
       round(dream_seconds / 3600, 2) AS rem, round(awake_seconds / 3600, 2) AS awake
FROM z WHERE deep_seconds + light_seconds + dream_seconds + awake_seconds > 0""",
    "sleep_efficiency": _EFFICIENCY,
    "sleep_latency": _LATENCY,
    "snore_series": _SNORE,
    "sleep_regularity": _night_trend("regularity * 100", "regularity > 0"),
    "night_heart_rate": """
SELECT z.subject_id, z.d AS date, z.heart_rate_bpm AS sleep_hr, r.resting_hr
FROM z LEFT JOIN d_rhr r ON r.subject_id = z.subject_id AND r.date = z.d WHERE z.heart_rate_bpm IS NOT NULL""",
    "sleep_environment": """
SELECT z.subject_id, z.d AS date, z.weather_temperature_f AS temp_f, z.air_pressure_pa AS pressure,
       z.movements_per_hour AS movements, round(z.sleep_quality * 100, 1) AS quality
FROM z LEFT JOIN (
  SELECT subject_id, quantile_cont(weather_temperature_f, 0.05) AS a, quantile_cont(weather_temperature_f, 0.95) AS b,
         quantile_cont(movements_per_hour, 0.05) AS c, quantile_cont(movements_per_hour, 0.95) AS e
  FROM z WHERE weather_temperature_f IS NOT NULL AND movements_per_hour IS NOT NULL GROUP BY 1
) x ON x.subject_id = z.subject_id
WHERE (z.weather_temperature_f IS NULL OR z.weather_temperature_f BETWEEN x.a AND x.b)
  AND (z.movements_per_hour IS NULL OR z.movements_per_hour BETWEEN x.c AND x.e)""",
    "sleep_impact": f"""
SELECT n.subject_id, n.date + 1 AS date, round(n.duration_seconds / 3600, 1) AS sleep_hrs,
       round(n.sleep_quality * 100, 1) AS sleep_quality, t.steps, r.resting_hr, round(m.workout_min, 0) AS workout_min
FROM good_nights n
JOIN d_steps t ON t.subject_id = n.subject_id AND t.date = n.date + 1 AND t.steps IS NOT NULL
LEFT JOIN d_rhr r ON r.subject_id = n.subject_id AND r.date = n.date + 1
LEFT JOIN minutes_by_day m ON m.subject_id = n.subject_id AND m.date = n.date + 1""",
    "sleep_score": _SCORES,
    "personal_records": _PERSONAL,
    "training_records": _TRAINING,
    "prior_period_summary": """
SELECT subject_id, coalesce(avg_steps, 0) AS avg_steps, avg_resting_hr, avg_sleep_hours, avg_hrv FROM head_before""",
    "period_deltas": """
SELECT subject_id, metric, c AS current, p AS prior,
       CASE WHEN p <> 0 AND pct <> 0 THEN CASE WHEN pct > 0 THEN '+' ELSE '' END || pct || '%' END AS delta,
       CASE WHEN p <> 0 AND c <> p
            THEN CASE WHEN (c > p) = (metric <> 'avg_resting_hr') THEN 'good' ELSE 'bad' END END AS direction
FROM (SELECT *, ((c - p) / nullif(abs(p), 0) * 100)::BIGINT AS pct
      FROM (SELECT subject_id, 'avg_steps' AS metric, coalesce(a.avg_steps, 0)::DOUBLE AS c,
                   coalesce(b.avg_steps, 0)::DOUBLE AS p
            FROM head_now a JOIN head_before b USING (subject_id)
            UNION ALL SELECT subject_id, 'avg_resting_hr', a.avg_resting_hr, b.avg_resting_hr
            FROM head_now a JOIN head_before b USING (subject_id)
            UNION ALL SELECT subject_id, 'avg_sleep_hours', a.avg_sleep_hours, b.avg_sleep_hours
            FROM head_now a JOIN head_before b USING (subject_id)
            UNION ALL SELECT subject_id, 'avg_hrv', a.avg_hrv, b.avg_hrv
            FROM head_now a JOIN head_before b USING (subject_id)))""",
    "sparklines": "\nUNION ALL\n".join(
        [
            _spark("steps", _STEPS, "steps", "date"),
            _spark("resting_hr", _HEART, "resting_hr", "date"),
            _spark("sleep", _SLEEP, "hours", "date, hours"),
            _spark("energy", _RINGS, "energy", "date, energy"),
            _spark("vo2max", _daily("VO2Max", "avg", 30), "val", "date"),
            _spark("hrv", _daily("HeartRateVariabilitySDNN", "avg", 7), "val", "date"),
            _spark("sleep_score", _SCORES, "score", "date, score"),
            _spark("weekly_workouts", _WEEKLY_COUNT, "count", "week, type"),
            _spark("weekly_minutes", _WEEKLY_MINUTES, "minutes", "week, type"),
        ]
    ),
    "monthly_flags": "SELECT subject_id, month"
    + "".join(
        f""", CASE WHEN {m} {good} avg({m}) OVER s THEN 'above-avg' WHEN {m} {bad} avg({m}) OVER s THEN 'below-avg' END
       AS {m}_flag"""
        for m, good, bad in [
            ("avg_daily_steps", ">", "<"),
            ("avg_sleep_hrs", ">", "<"),
            ("avg_resting_hr", "<", ">"),
            ("avg_vo2max", ">", "<"),
            ("avg_hrv", ">", "<"),
        ]
    )
    + f"\nFROM ({_MONTHLY}) WINDOW s AS (PARTITION BY subject_id)",
    "series_cards": f"""
SELECT s.subject_id, avg_efficiency, avg_latency, avg_snore, avg_sleep_score, avg_run_dist, avg_ride_dist,
       avg_ride_dur, total_ride_cal
FROM subjects s
LEFT JOIN (SELECT subject_id, format('{{:.1f}}', avg(val))::DOUBLE AS avg_efficiency FROM ({_EFFICIENCY}) GROUP BY 1) a USING (subject_id)
LEFT JOIN (SELECT subject_id, format('{{:.0f}}', avg(val))::DOUBLE AS avg_latency FROM ({_LATENCY}) GROUP BY 1) b USING (subject_id)
LEFT JOIN (SELECT subject_id, format('{{:.0f}}', avg(val))::DOUBLE AS avg_snore FROM ({_SNORE}) GROUP BY 1) c USING (subject_id)
LEFT JOIN (SELECT subject_id, format('{{:.0f}}', avg(score))::DOUBLE AS avg_sleep_score FROM scores GROUP BY 1) d USING (subject_id)
LEFT JOIN (SELECT subject_id, format('{{:.1f}}', avg(nullif(distance, 0)))::DOUBLE AS avg_run_dist FROM run_distance GROUP BY 1) e USING (subject_id)
LEFT JOIN (SELECT subject_id, format('{{:.1f}}', avg(nullif(distance, 0)))::DOUBLE AS avg_ride_dist,
                  format('{{:.0f}}', avg(nullif(duration_min, 0)))::DOUBLE AS avg_ride_dur,
                  format('{{:.0f}}', sum(nullif(calories, 0)))::DOUBLE AS total_ride_cal FROM rides GROUP BY 1) f USING (subject_id)""",
    "period_windows": f"""
SELECT subject_id, period, CASE WHEN period = 'current' THEN {S} ELSE {PS}::DATE END AS start,
       CASE WHEN period = 'current' THEN {E} ELSE {PE}::DATE END AS "end", count(*) AS days, sum(steps)::BIGINT AS steps
FROM (SELECT *, CASE WHEN date >= {S} THEN 'current' ELSE 'prior' END AS period
      FROM d_steps WHERE date BETWEEN {PS} AND {E}) GROUP BY 1, 2""",
    "profile_wide": "SELECT subject_id, age, sex, weight_lbs, height_in, date_of_birth FROM wide",
    "profile_upsert": """
SELECT subject_id, key, CASE WHEN key = 'weight_lbs' THEN (100 + subject_id)::VARCHAR
                             WHEN key = 'age' AND subject_id % 2 = 0 THEN '50' ELSE value END AS value FROM profile
UNION ALL SELECT s.subject_id, 'age', '50' FROM subjects s WHERE s.subject_id % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM profile p WHERE p.subject_id = s.subject_id AND p.key = 'age')""",
    "load_row_counts": _ROW_COUNTS,
    "stored_row_counts": _ROW_COUNTS,
    "interval_join_both_ends": """
SELECT w.subject_id, count(*) AS pairs, sum(r.value) AS total
FROM workouts w JOIN records r ON r.subject_id = w.subject_id AND r.start_date BETWEEN w.start_date AND w.end_date
 AND r.end_date BETWEEN w.start_date AND w.end_date GROUP BY 1""",
    "interval_join_start_only": """
SELECT w.subject_id, count(*) AS pairs, sum(r.value) AS total
FROM workouts w JOIN records r ON r.subject_id = w.subject_id AND r.start_date BETWEEN w.start_date AND w.end_date
GROUP BY 1""",
    "interval_overlap_join": """
SELECT r.subject_id, r.gpx_file, count(*) AS pairs, sum(x.duration) AS minutes
FROM routes r JOIN workouts x ON x.subject_id = r.subject_id AND x.start_date <= r.route_end
 AND x.end_date >= r.route_start GROUP BY 1, 2""",
    "load_top_types": """
SELECT record_type, count(*) AS cnt FROM records GROUP BY 1 ORDER BY cnt DESC, record_type LIMIT 15""",
    "json_payload": "\nUNION ALL\n".join(
        [
            _json("steps", _STEPS, ["date", "steps", "steps_7d_avg"]),
            _json("heart_rate", _HEART, ["date", "avg_hr", "min_hr", "max_hr", "resting_hr"]),
            _json("weight", _WEIGHT, ["date", "weight"]),
            _json("weekly_workouts", _WEEKLY_COUNT, ["week", "type", "count"]),
            _json("running_pace", _PACE, ["date", "duration_min", "distance", "avg_speed_mph", "pace_min_per_mi"]),
        ]
    ),
    "parsed_records": """
SELECT subject_id, CASE WHEN value % 2 = 0 THEN 'Tom & "Watch" > 1' ELSE 'Tom > 1' END AS source_name, record_type, start_date, end_date, value FROM records""",
    "parsed_workouts": """
SELECT subject_id, workout_activity_type, start_date, end_date, duration, total_distance, total_distance_unit,
       total_energy_burned FROM workouts""",
    "parsed_activity": """
SELECT subject_id, date_components, active_energy_burned, active_energy_burned_goal, apple_exercise_time,
       apple_stand_hours FROM activity""",
    "parsed_profile": """
SELECT subject_id, key, value FROM profile WHERE key IN ('sex', 'date_of_birth')""",
    "parsed_route_points": "SELECT subject_id, gpx_file, recorded_at, latitude, longitude, elevation, speed FROM points",
    "parsed_nights": """
SELECT subject_id, start_time, sleep_quality, regularity, deep_seconds, heart_rate_bpm, weather_temperature_f
FROM sleep""",
}

# Queries that need further common tables.
_WITH_CARDS = {
    "summary_cards": _CARDS,
    "headline_cards": """
SELECT s.subject_id, coalesce(h.avg_steps, 0) AS avg_steps, h.avg_resting_hr, coalesce(workouts, 0) AS workouts,
       h.avg_sleep_hours
FROM subjects s LEFT JOIN head_now h USING (subject_id) LEFT JOIN c_work USING (subject_id)""",
    "distance_bands": """
SELECT s.subject_id, coalesce(marathons, 0) AS marathons, coalesce(half_marathons, 0) AS half_marathons,
       coalesce(longest_run_mi, 0) AS longest_run_mi, coalesce(total_run_mi, 0) AS total_run_mi
FROM subjects s LEFT JOIN c_run USING (subject_id)""",
    "walk_and_ride_totals": """
SELECT s.subject_id, coalesce(longest_walk_mi, 0) AS longest_walk_mi, coalesce(total_cycling_mi, 0) AS total_cycling_mi,
       coalesce(longest_ride_mi, 0) AS longest_ride_mi, coalesce(cycling_count, 0) AS cycling_count
FROM subjects s LEFT JOIN c_walk USING (subject_id) LEFT JOIN c_ride USING (subject_id)
LEFT JOIN c_work USING (subject_id)""",
}
_WITH_STATS = {
    "step_stats": "SELECT * FROM s_steps",
    "heart_rate_stats": "SELECT * FROM s_heart",
    "sleep_stats": "SELECT * FROM s_sleep",
    "workout_stats": "SELECT * FROM s_work",
    "workout_stats_by_type": "SELECT * FROM s_types",
    "ring_stats": "SELECT * FROM s_rings",
    "period_stats": """
SELECT s.subject_id, t.daily_avg, t.prior_daily_avg, h.avg_resting, n.avg_hours, n.nights_tracked, k.count AS workouts,
       g.days_tracked, p.age, (SELECT count(*) FROM s_types y WHERE y.subject_id = s.subject_id) AS types
FROM subjects s JOIN s_steps t USING (subject_id) JOIN s_heart h USING (subject_id) JOIN s_sleep n USING (subject_id)
JOIN s_work k USING (subject_id) JOIN s_rings g USING (subject_id) LEFT JOIN wide p USING (subject_id)""",
    "period_digest": _DIGEST,
    "question_digest": f"""
SELECT subject_id, '## My question' || chr(10) || chr(10) || 'Am I sleeping enough?' || chr(10) || chr(10) || '---'
  || chr(10) || chr(10) || '## My health data' || chr(10) || chr(10) || digest AS digest
FROM ({_DIGEST})""",
}


def oracle_statements() -> dict[str, str]:
    out = {name: f"WITH {DERIVED_SQL}\n{sql}" for name, sql in _PLAIN.items()}
    out |= {name: f"WITH {DERIVED_SQL},\n{_CARD_PARTS}\n{sql}" for name, sql in _WITH_CARDS.items()}
    out |= {name: f"WITH {DERIVED_SQL},\n{_STAT_PARTS}\n{sql}" for name, sql in _WITH_STATS.items()}
    return out
