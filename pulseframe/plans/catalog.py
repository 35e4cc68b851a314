"""Every query of the library by name, with SQL that gives the same rows.

Doubles are rounded to six places on both sides, as the last step only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import scores
from ..operators import calendar, cardio_dedup, features, goals, joins, pace, power, rules, sleep, spine, stats, strength
from ..sinks import tables as sinks
from ..sources import scans
from . import testmap as T

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}
AS_OF = "2024-01-24"
GOAL_DAY = "1998-03-13"  # a Friday
TIE = 1.3e-9  # exact halves of the last place go up on both sides


def query(sql: str | None = None, doubles: str = "", ctes: tuple[str, ...] = ()):
    """Register a function of (spark, sf) with its SQL; `doubles` names the columns to round."""

    def add(f):
        cols = doubles.split()

        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = f(spark, sf)
            return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(TIE), 6) + F.lit(0.0) for c in cols}) if cols else df

        _queries[f.__name__] = run
        if sql:
            with_ = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
            rep = " REPLACE (" + ", ".join(f"round(CAST({c} AS DOUBLE) + {TIE}, 6) + 0.0 AS {c}" for c in cols) + ")" if cols else ""
            _sql[f.__name__] = f"{with_}SELECT *{rep} FROM ({sql})"
        return f

    return add


# --- the first slice: daily load, windows, flag

@query("""SELECT user_id, event_date, CAST(cardio_minutes_7d AS DOUBLE) AS cardio_minutes_7d, acute_chronic_ratio, CASE WHEN acute_chronic_ratio > 1.5 THEN 'HIGH_TRAINING_LOAD' END AS flag FROM
 (SELECT user_id, event_date, sum(m) OVER a AS cardio_minutes_7d, sum(m) OVER a / nullif(sum(m) OVER b / 4, 0) AS acute_chronic_ratio FROM (SELECT user_id, event_date, sum(duration_min) AS m FROM load GROUP BY 1, 2)
 WINDOW a AS (PARTITION BY user_id ORDER BY event_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_date RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW))""", "cardio_minutes_7d acute_chronic_ratio", (T.CARDIO, T.LOAD))
def slice_daily_load_flags(spark, sf):
    d = features.cardio_load(features.cardio_days(T.cardio(spark, sf), apply_dedup=False))
    return d.select("user_id", "event_date", "cardio_minutes_7d", "acute_chronic_ratio", F.when(F.col("acute_chronic_ratio") > 1.5, "HIGH_TRAINING_LOAD").alias("flag"))


# --- projections and predicates

@query("""SELECT source_id, mode, family, CASE WHEN family = 'walk' THEN 'walk' ELSE family END AS family_again, pace, coalesce(pace < 210 OR pace > 1080, FALSE) AS suspect, coalesce(pace < 210, FALSE) AS over_recorded,
 family = 'walk' AND coalesce(source_app = 'Fitbit', FALSE) AS bridge_walk, family <> 'strength' AND NOT (family = 'walk' AND coalesce(source_app = 'Fitbit', FALSE)) AS counts,
 CASE source_app WHEN 'Nike Run Club' THEN 40 WHEN 'Fitbit' THEN 10 WHEN 'Strava' THEN 30 WHEN 'Apple Watch' THEN 20 ELSE 15 END AS app_rank, CASE source WHEN 'wahoo_fit' THEN 50 WHEN 'strava_export' THEN 40 WHEN 'strava' THEN 25 ELSE 20 END AS source_rank, CAST(date_trunc('week', event_date) AS DATE) AS week_start, distance_miles * 1.609344 AS km FROM cardio""", "pace km", (T.CARDIO,))
def prj_cardio_columns(spark, sf):
    c = T.cardio(spark, sf)
    flags = P.pace_flags()
    return c.select("source_id", S.cardio_mode("activity_type").alias("mode"), F.when(P.strength_like("activity_type"), "strength").otherwise(S.activity_family("activity_type")).alias("family"), F.when(P.strength_like("activity_type"), "strength").otherwise(S.activity_family("activity_type")).alias("family_again"), S.run_pace("duration_min", "distance_miles", "activity_type").alias("pace"), P.suspect_distance(flags).alias("suspect"), P.over_recorded().alias("over_recorded"), P.bridge_walk().alias("bridge_walk"), P.counts_as_load().alias("counts"), S.app_rank("source_app").alias("app_rank"), S.power_source_rank("source").alias("source_rank"), S.week_start("event_date").alias("week_start"), S.miles_to_km("distance_miles").alias("km"))


@query("""SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || chr(10) || '[truncated]' ELSE text END AS shown FROM documents""")
def prj_truncate(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", S.truncate("text").alias("shown"))


@query("""SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(text, '(\\d+)', 1), '') AS INT) AS number FROM conversations""")
def prj_first_integer(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", S.first_integer("text").alias("number"))


@query("""SELECT DISTINCT event_date, CAST(date_trunc('month', event_date) AS DATE) AS first, last_day(event_date) AS last, CAST(date_trunc('month', event_date) - INTERVAL 1 MONTH AS DATE) AS before FROM sets""", "", (T.SETS,))
def prj_month_bounds(spark, sf):
    a, b = S.month_bounds("event_date")
    return T.sets(spark, sf).select("event_date", a.alias("first"), b.alias("last"), S.previous_month("event_date").alias("before")).distinct()


@query("""SELECT p_name, CASE WHEN up AND low THEN 'mixed' WHEN up THEN 'upper' WHEN low THEN 'lower' ELSE 'other' END AS focus FROM (SELECT DISTINCT p_name, regexp_matches(lower(p_name), 'bench|press|chest|shoulder|overhead|ohp|row|pull|lat|pulldown|chin|curl|tricep|bicep|fly|raise|dip') AS up, regexp_matches(lower(p_name), 'squat|deadlift|rdl|leg|calf|lunge|hip|glute|hamstring|extension|thrust') AS low FROM part)""")
def prj_session_focus(spark, sf):
    return T.table(spark, sf, "part").select("p_name", S.session_focus("p_name").alias("focus")).distinct()


# --- scans

@query("""SELECT user_id, source_id, started_at_us FROM (SELECT user_id, source_id, epoch_us(started_at) AS started_at_us, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC NULLS LAST, source_id) AS rn FROM cardio WHERE avg_watts IS NOT NULL) WHERE rn <= 20""", "", (T.CARDIO,))
def scan_power_rides(spark, sf):
    return scans.power_rides(T.cardio(spark, sf), 20).select("user_id", "source_id", F.unix_micros("started_at").alias("started_at_us"))


@query(f"""SELECT user_id, metric_date, sleep_hours, steps FROM metrics WHERE metric_date > DATE '{AS_OF}' - 10 AND metric_date <= DATE '{AS_OF}'""", "sleep_hours", (T.METRICS,))
def scan_bounded_history(spark, sf):
    return scans.history(T.metrics(spark, sf), "daily_health_metrics", ["metric_date", "sleep_hours", "steps"], AS_OF, 10).withColumn("steps", F.col("steps").cast("long"))


@query(f"""SELECT user_id, metric_date, resting_hr FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY metric_date DESC) AS rn FROM metrics WHERE metric_date <= DATE '{AS_OF}') WHERE rn = 1""", "", (T.METRICS,))
def scan_latest_as_of(spark, sf):
    return scans.latest(T.metrics(spark, sf), "metric_date", AS_OF).select("user_id", "metric_date", F.col("resting_hr").cast("long").alias("resting_hr"))


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2""")
def scan_chat_tail(spark, sf):
    c = T.table(spark, sf, "conversations").withColumn("user_id", F.col("conv_id").cast("string")).withColumn("created_at", F.col("turn"))
    return scans.chat_tail(c, 2).select("conv_id", "turn", "text")


@query("""SELECT DISTINCT c.source_id FROM cardio c SEMI JOIN metrics m ON m.user_id = c.user_id AND m.metric_date = c.event_date AND m.sleep_hours > 5""", "", (T.CARDIO, T.METRICS))
def scan_on_days(spark, sf):
    days = T.metrics(spark, sf).where("sleep_hours > 5").select("user_id", F.col("metric_date").alias("event_date"))
    return scans.on_days(T.cardio(spark, sf), days).select("source_id").distinct()


# --- joins

_NEAR_HUB = "a.user_id = b.user_id AND a.event_date = b.event_date AND a.family = b.family AND a.source_id < b.source_id AND a.source = 'apple_health' AND b.source = 'apple_health' AND abs(epoch_us(a.started_at) - epoch_us(b.started_at)) <= 900000000"


@query(f"SELECT a.user_id, a.source_id AS a, b.source_id AS b FROM cardio a JOIN cardio b ON {_NEAR_HUB}", "", (T.CARDIO,))
def join_near_hub(spark, sf):
    return cardio_dedup.near_pairs(T.cardio(spark, sf))


@query(f"SELECT a.user_id, a.source_id AS a, b.source_id AS b FROM cardio a JOIN cardio b ON {_NEAR_HUB.replace(chr(39) + 'apple_health' + chr(39), 'a.source', 1).replace(chr(39) + 'apple_health' + chr(39), 'b.source')}", "", (T.CARDIO,))
def join_near_power(spark, sf):
    return cardio_dedup.near_pairs(T.cardio(spark, sf), power=True)


@query("""SELECT source_id FROM cardio c WHERE NOT (source = 'apple_health' AND family = 'strength' AND EXISTS (SELECT 1 FROM sets s WHERE s.user_id = c.user_id AND s.event_date + 9000 = c.event_date))""", "", (T.CARDIO, T.SETS))
def join_strength_mirrors(spark, sf):
    shifted = T.sets(spark, sf).withColumn("event_date", F.date_add("event_date", 9000))
    return cardio_dedup.drop_strength_mirrors(T.cardio(spark, sf), shifted).select("source_id")


@query("""SELECT user_id, d, name, start_date FROM (SELECT c.user_id, c.event_date AS d, p.name, p.start_date, row_number() OVER (PARTITION BY c.user_id, c.event_date ORDER BY p.start_date DESC NULLS LAST, p.name) AS rn FROM (SELECT DISTINCT user_id, event_date FROM cardio) c LEFT JOIN phases p ON p.user_id = c.user_id AND c.event_date BETWEEN p.start_date AND p.end_date AND coalesce(p.is_active, TRUE)) WHERE rn = 1""", "", (T.CARDIO, T.PHASES))
def join_active_phase(spark, sf):
    days = T.cardio(spark, sf).select("user_id", F.col("event_date").alias("d")).distinct()
    return joins.active_phase(days, T.phases(spark, sf)).select("user_id", "d", "name", "start_date")


@query("""SELECT c.user_id, c.source_id, m.metric_date AS r_metric_date, CAST(m.steps AS BIGINT) AS r_steps FROM cardio c ASOF LEFT JOIN (SELECT * FROM metrics WHERE steps >= 2000) m ON m.user_id = c.user_id AND m.metric_date <= c.event_date""", "", (T.CARDIO, T.METRICS))
def join_as_of(spark, sf):
    m = T.metrics(spark, sf).where("steps >= 2000").select("user_id", "metric_date", F.col("steps").cast("long").alias("steps"))
    return joins.as_of_join(T.cardio(spark, sf).select("user_id", "source_id", "event_date"), m, "event_date", "metric_date").select("user_id", "source_id", "r_metric_date", "r_steps")


@query(f"""SELECT user_id, name, weeks_total, weeks_elapsed, weeks_remaining, progress_pct FROM (SELECT *, CAST(ceil((end_date - start_date + 1) / 7.0) AS BIGINT) AS weeks_total, CAST(ceil((DATE '{AS_OF}' - start_date + 1) / 7.0) AS BIGINT) AS weeks_elapsed, CAST(ceil((end_date - DATE '{AS_OF}') / 7.0) AS BIGINT) AS weeks_remaining, (DATE '{AS_OF}' - start_date + 1) * 100.0 / (end_date - start_date + 1) AS progress_pct FROM phases WHERE name = 'taper')""", "progress_pct", (T.CARDIO, T.PHASES))
def join_phase_progress(spark, sf):
    p = T.phases(spark, sf).where("name = 'taper'").withColumn("d", F.lit(AS_OF).cast("date"))
    return joins.phase_progress(p).select("user_id", "name", "weeks_total", "weeks_elapsed", "weeks_remaining", "progress_pct")


@query(f"""SELECT c.source_id, p.name FROM cardio c JOIN phases p ON p.user_id = c.user_id AND c.event_date BETWEEN p.start_date AND p.end_date""", "", (T.CARDIO, T.PHASES))
def join_interval(spark, sf):
    return joins.in_phase(T.cardio(spark, sf).select("user_id", "source_id", "event_date"), T.phases(spark, sf), "event_date").select("source_id", "name")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT 2 * o_custkey FROM orders)""")
def join_missing(spark, sf):
    return joins.missing(T.table(spark, sf, "customer"), T.table(spark, sf, "orders").select((2 * F.col("o_custkey")).alias("c_custkey")), ["c_custkey"]).select("c_custkey")


# --- aggregates

@query("""SELECT user_id, CAST(date_trunc('week', event_date) AS DATE) AS week_start, count(DISTINCT event_date) AS sessions, count(*) FILTER (hard) AS hard_sets, coalesce(sum(reps * weight_lbs) FILTER (hard), 0) AS volume_lbs, coalesce(sum(reps * weight_lbs) FILTER (hard), 0) / 2000 AS short_tons FROM sets GROUP BY 1, 2""", "volume_lbs short_tons", (T.SETS,))
def agg_week_strength(spark, sf):
    return strength.week_volume(T.sets(spark, sf))


@query(f"""SELECT user_id, event_date, source, coalesce(source_app, '(unknown)') AS source_app, activity_type, count(*) AS sessions, sum(duration_min) AS minutes FROM cardio WHERE event_date > DATE '{AS_OF}' - 7 AND event_date <= DATE '{AS_OF}' GROUP BY 1, 2, 3, 4, 5""", "minutes", (T.CARDIO,))
def agg_breakdown(spark, sf):
    return pace.breakdown(T.cardio(spark, sf), AS_OF)


@query("""SELECT u.user_id, m.mode, coalesce(s, 0) AS sessions, coalesce(x, 0) AS minutes, coalesce(y, 0) AS miles FROM (SELECT DISTINCT user_id FROM cardio) u CROSS JOIN (VALUES ('running'), ('cycling'), ('other')) m(mode) LEFT JOIN (SELECT user_id, mode, count(*) AS s, sum(duration_min) AS x, sum(CASE WHEN coalesce(pace < 210, FALSE) THEN 0 ELSE distance_miles END) AS y FROM cardio GROUP BY 1, 2) g ON g.user_id = u.user_id AND g.mode = m.mode""", "minutes miles", (T.CARDIO,))
def agg_by_mode(spark, sf):
    return pace.totals_by_mode(T.cardio(spark, sf))


_RUN_WEEKS = "rw AS (SELECT user_id, CAST(date_trunc('week', d) AS DATE) AS week_start, sum(km) AS running_km FROM (SELECT user_id, session_date AS d, distance_km AS km FROM running UNION ALL SELECT user_id, event_date, distance_miles * 1.609344 FROM cardio WHERE mode = 'running' AND NOT coalesce(pace < 210, FALSE)) GROUP BY 1, 2)"


@query("SELECT * FROM rw", "running_km", (T.CARDIO, T.RUNNING, _RUN_WEEKS))
def agg_running_km(spark, sf):
    return pace.running_weeks(T.running(spark, sf), T.cardio(spark, sf))


@query("""SELECT user_id, week_start, km AS this_week_km, prev AS last_week_km, CASE WHEN prev > 0 THEN (km - prev) / prev * 100 END AS change_pct, CASE WHEN prev > 0 AND (km - prev) / prev * 100 > 15 THEN 'mileage_spike' END AS flag FROM (SELECT s.user_id, s.week_start, coalesce(running_km, 0) AS km, coalesce(lag(coalesce(running_km, 0)) OVER (PARTITION BY s.user_id ORDER BY s.week_start), 0) AS prev FROM (SELECT user_id, CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAYS)) AS DATE) AS week_start FROM rw GROUP BY 1) s LEFT JOIN rw USING (user_id, week_start))""", "this_week_km last_week_km change_pct", (T.CARDIO, T.RUNNING, _RUN_WEEKS))
def agg_mileage_ramp(spark, sf):
    return pace.mileage_ramp(pace.running_weeks(T.running(spark, sf), T.cardio(spark, sf)))


@query("""SELECT user_id, CAST(date_trunc('week', event_date) AS DATE) AS week_start, sum(duration_min) AS minutes, coalesce(sum(CASE WHEN coalesce(pace < 210, FALSE) THEN 0 ELSE distance_miles END) FILTER (mode = 'running'), 0) AS running_miles, coalesce(sum(distance_miles) FILTER (mode = 'cycling'), 0) AS cycling_miles, count(DISTINCT event_date) FILTER (duration_min > 0) AS sessions FROM cardio GROUP BY 1, 2""", "minutes running_miles cycling_miles", (T.CARDIO,))
def agg_cardio_weeks(spark, sf):
    return pace.cardio_week_load(T.cardio(spark, sf))


@query("""SELECT user_id, event_date, any_sets, hard_sets, volume_lb, rpe * hard_sets * 3 AS strength_au FROM (SELECT user_id, event_date, count(*) AS any_sets, count(*) FILTER (hard) AS hard_sets, coalesce(sum(reps * weight_lbs) FILTER (hard), 0) AS volume_lb, avg(rpe) FILTER (hard) AS rpe FROM sets GROUP BY 1, 2)""", "volume_lb strength_au", (T.SETS,))
def agg_strength_days(spark, sf):
    return features.strength_days(T.sets(spark, sf))


@query("""SELECT user_id, event_date, count(*) FILTER (pace < 210 OR pace > 1080) AS suspect, sum(session_rpe * duration_min) FILTER (family <> 'strength' AND duration_min > 0) AS cardio_au FROM cardio GROUP BY 1, 2""", "cardio_au", (T.CARDIO,))
def agg_cardio_quality(spark, sf):
    return features.cardio_quality_days(T.cardio(spark, sf))


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS metric_date, arg_max(value, ts) FILTER (event_type = 'view') AS view, arg_max(value, ts) FILTER (event_type = 'click') AS click, CAST(round_even(arg_max(value, ts) FILTER (event_type = 'error'), 0) AS INT) AS error FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2""", "view click")
def agg_pivot_metrics(spark, sf):
    long = T.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("date").alias("event_date"), F.col("event_type").alias("metric"), "value", "ts")
    return features.pivot_metrics(long, ["view", "click", "error"], ["ts"], ("error",))


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, 'x' AS source, CAST(ts AS DATE) AS event_date, m AS metric, CASE WHEN m = 'steps' THEN sum(value) WHEN m = 'sleep_hours' THEN greatest(0, max(value)) ELSE avg(value) END AS value, arg_min(event_type, event_id) AS unit FROM (SELECT *, CASE event_type WHEN 'view' THEN 'steps' WHEN 'click' THEN 'sleep_hours' ELSE 'vo2_max' END AS m FROM events) GROUP BY 1, 3, 4""", "value")
def agg_rollup_samples(spark, sf):
    e = T.table(spark, sf, "events")
    m = F.when(F.col("event_type") == "view", "steps").when(F.col("event_type") == "click", "sleep_hours").otherwise("vo2_max")
    return features.rollup_samples(e.select(F.col("user_id").cast("string").alias("user_id"), F.lit("x").alias("source"), F.col("ts").cast("date").alias("event_date"), m.alias("metric"), "value", F.col("event_type").alias("unit"), F.col("event_id").alias("seq")))


_SESSIONS = """sd AS (SELECT user_id, event_date, sum(coalesce(reps * weight_lbs, 0)) AS volume_lbs, coalesce(sum(reps * weight_lbs) FILTER (up AND NOT low), 0) AS u, coalesce(sum(reps * weight_lbs) FILTER (low AND NOT up), 0) AS l, coalesce(sum(reps * weight_lbs) FILTER (up AND low), 0) AS m, coalesce(sum(reps * weight_lbs) FILTER (NOT up AND NOT low), 0) AS o, count(DISTINCT exercise_name) AS exercise_count FROM
 (SELECT *, regexp_matches(lower(exercise_name), 'bench|press|chest|shoulder|overhead|ohp|row|pull|lat|pulldown|chin|curl|tricep|bicep|fly|raise|dip') AS up, regexp_matches(lower(exercise_name), 'squat|deadlift|rdl|leg|calf|lunge|hip|glute|hamstring|extension|thrust') AS low FROM sets WHERE hard) GROUP BY 1, 2),
sf AS (SELECT user_id, event_date, volume_lbs, exercise_count, CASE WHEN u + l + m + o <= 0 THEN 'unknown' WHEN u / (u + l + m + o) >= 0.55 THEN 'upper' WHEN l / (u + l + m + o) >= 0.55 THEN 'lower' WHEN u + l + m > 0 THEN 'full' ELSE 'other' END AS session_focus FROM sd)"""


@query("SELECT user_id, event_date, volume_lbs, session_focus, exercise_count FROM sf", "volume_lbs", (T.SETS, _SESSIONS))
def agg_session_days(spark, sf):
    return strength.session_days(T.sets(spark, sf))


@query("""SELECT user_id, exercise_name, event_date, greatest(0, max(weight_lbs)) AS top_weight_lbs, sum(reps * weight_lbs) AS volume_lbs, count(*) AS hard_sets FROM sets WHERE hard GROUP BY 1, 2, 3""", "top_weight_lbs volume_lbs", (T.SETS,))
def agg_exercise_sessions(spark, sf):
    return strength.exercise_sessions(T.sets(spark, sf))


@query("""SELECT user_id, CAST(date_trunc('week', d) AS DATE) AS week_start, count(DISTINCT d) AS run_days FROM (SELECT user_id, session_date AS d FROM running UNION ALL SELECT user_id, event_date FROM cardio WHERE mode = 'running') GROUP BY 1, 2""", "", (T.CARDIO, T.RUNNING))
def agg_run_days(spark, sf):
    return calendar.run_days(T.running(spark, sf), T.cardio(spark, sf))


@query("""SELECT user_id, arg_max(hrv_rmssd, metric_date) AS latest, CASE WHEN count(*) > 1 THEN arg_max(hrv_rmssd, metric_date) - arg_min(hrv_rmssd, metric_date) FILTER (rn <= 8) END AS delta FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY metric_date DESC) AS rn FROM metrics WHERE hrv_rmssd IS NOT NULL) GROUP BY 1""", "latest delta", (T.METRICS,))
def agg_latest_delta(spark, sf):
    return sleep.latest_and_delta(T.metrics(spark, sf), "hrv_rmssd")


@query("""SELECT label, d AS duration, max(m) AS watts FROM (SELECT label, d, max(m) AS m FROM (SELECT ride_id, d, CASE WHEN count(*) OVER w = d THEN avg(watts) OVER w END AS m FROM series, (VALUES (5)) t(d) WINDOW w AS (PARTITION BY ride_id, d ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) s JOIN embeddings ON vec_id = ride_id GROUP BY 1, 2) GROUP BY 1, 2""", "watts", (T.SERIES,))
def agg_best_curve(spark, sf):
    curve = power.mean_maximal(T.series(spark, sf), durations=(5,)).join(T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ride_id"), F.col("label").cast("string").alias("user_id")), "ride_id")
    maps = curve.groupBy("user_id", "ride_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("duration").cast("string"), F.lit(".0")), "watts"))).alias("power_mmp_json"))
    return power.best_curve(maps).select(F.col("user_id").cast("int").alias("label"), "duration", "watts")


@query("""SELECT ride_id, avg(watts) AS avg_watts, max(watts) AS max_watts, sum(greatest(watts, 0)) / 1000 AS work_kj FROM series GROUP BY 1""", "avg_watts max_watts work_kj", (T.SERIES,))
def agg_power_totals(spark, sf):
    return power.totals(T.series(spark, sf))


# --- windows

@query("""SELECT user_id, event_date, count(*) OVER a AS cardio_sessions_7d, sum(m) OVER a AS cardio_minutes_7d, sum(m) OVER c AS cardio_minutes_14d, sum(m) OVER b AS cardio_minutes_28d, sum(m) OVER a / nullif(sum(m) OVER b / 4, 0) AS acute_chronic_ratio FROM (SELECT user_id, event_date, sum(duration_min) AS m FROM load GROUP BY 1, 2)
 WINDOW a AS (PARTITION BY user_id ORDER BY event_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_date RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW), c AS (PARTITION BY user_id ORDER BY event_date RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW)""", "cardio_minutes_7d cardio_minutes_14d cardio_minutes_28d acute_chronic_ratio", (T.CARDIO, T.LOAD))
def win_cardio_load(spark, sf):
    return features.cardio_load(features.cardio_days(T.cardio(spark, sf), apply_dedup=False))


_WEEKS = "wk AS (SELECT user_id, CAST(date_trunc('week', event_date) AS DATE) AS week_start, coalesce(sum(reps * weight_lbs) FILTER (hard), 0) AS v FROM sets GROUP BY 1, 2), sp AS (SELECT s.user_id, s.week_start, coalesce(v, 0) AS v FROM (SELECT user_id, CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAYS)) AS DATE) AS week_start FROM wk GROUP BY 1) s LEFT JOIN wk USING (user_id, week_start))"


@query("""SELECT user_id, week_start, v AS volume_lbs, v / 2000 AS volume_short_tons, CASE WHEN lag(v) OVER w > 0 THEN (v - lag(v) OVER w) / lag(v) OVER w * 100 END AS change_pct FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY week_start)""", "volume_lbs volume_short_tons change_pct", (T.SETS, _WEEKS))
def win_weekly_rollups(spark, sf):
    return strength.weekly_rollups(T.sets(spark, sf))


@query("""SELECT user_id, week_start, v AS load, CASE WHEN lag(v) OVER w > 0 THEN (v - lag(v) OVER w) / lag(v) OVER w * 100 END AS wow_change_pct, f AS four_week_avg_load, v / f AS acwr, (v / f - 1) * 100 AS vs_monthly_avg_pct FROM (SELECT *, CASE WHEN count(*) OVER g = 4 AND max(v) OVER g > 0 THEN avg(v) OVER g END AS f FROM sp WINDOW g AS (PARTITION BY user_id ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WINDOW w AS (PARTITION BY user_id ORDER BY week_start)""", "load wow_change_pct four_week_avg_load acwr vs_monthly_avg_pct", (T.SETS, _WEEKS))
def win_weekly_enrich(spark, sf):
    return pace.weekly_enrich(strength.week_volume(T.sets(spark, sf)), "volume_lbs")


_ROLL = "rp AS (SELECT user_id, event_date, " + ", ".join(f"coalesce(sum(m) OVER (PARTITION BY user_id ORDER BY event_date RANGE BETWEEN INTERVAL {6 + 7 * k} DAYS PRECEDING AND INTERVAL {7 * k} DAYS PRECEDING), 0) AS w{k}" for k in range(5)) + " FROM (SELECT user_id, event_date, sum(duration_min) AS m FROM load GROUP BY 1, 2)), pr AS (SELECT *, CASE WHEN greatest(w1, w2, w3, w4) > 0 THEN (w1 + w2 + w3 + w4) / 4 END AS f, CASE WHEN w1 > 0 THEN (w0 - w1) / w1 * 100 WHEN w0 > 0 THEN 100 END AS wow FROM rp)"


@query("SELECT user_id, event_date, w0 AS acute_load, w1 AS prior_7d_load, f AS four_week_avg_load, wow AS wow_change_pct, w0 / f AS acwr, (w0 / f - 1) * 100 AS vs_monthly_avg_pct FROM pr", "acute_load prior_7d_load four_week_avg_load wow_change_pct acwr vs_monthly_avg_pct", (T.CARDIO, T.LOAD, _ROLL))
def win_rolling_pace(spark, sf):
    return pace.rolling_pace(features.cardio_days(T.cardio(spark, sf), apply_dedup=False), "minutes")


@query("SELECT user_id, metric_date, avg(hrv_rmssd) OVER (PARTITION BY user_id ORDER BY metric_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS hrv_7 FROM metrics", "hrv_7", (T.METRICS,))
def win_trailing_rows(spark, sf):
    return T.metrics(spark, sf).select("user_id", "metric_date", sleep.trailing_rows("hrv_rmssd").alias("hrv_7"))


_LONG = "lg AS (SELECT user_id, metric_date AS d, 'hrv_rmssd' AS metric, hrv_rmssd AS value FROM metrics WHERE hrv_rmssd IS NOT NULL UNION ALL SELECT user_id, metric_date, 'sleep_hours', sleep_hours FROM metrics WHERE sleep_hours IS NOT NULL UNION ALL SELECT user_id, metric_date, 'resting_hr', resting_hr FROM metrics UNION ALL SELECT user_id, metric_date, 'steps', steps FROM metrics)"
_L = ("hrv_rmssd", "sleep_hours", "resting_hr", "steps")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT user_id, d AS metric_date, metric, {w} AS window_days, avg(value) OVER w AS mean_value, stddev_samp(value) OVER w AS stdev_value, count(value) OVER w AS sample_n FROM lg WINDOW w AS (PARTITION BY user_id, metric ORDER BY d RANGE BETWEEN INTERVAL {w} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)" for w in (7, 28, 90)) + ") WHERE sample_n >= 2", "mean_value stdev_value", (T.METRICS, _LONG))
def win_baselines(spark, sf):
    return stats.baselines(stats.to_long(T.metrics(spark, sf), _L))


@query("SELECT user_id, d AS metric_date, metric, value, n AS sample_n, (value - m) / s AS z, CASE WHEN value > m THEN 'above_baseline' ELSE 'below_baseline' END AS direction FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM lg WINDOW w AS (PARTITION BY user_id, metric ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAYS PRECEDING)) WHERE metric <> 'steps' AND metric <> 'resting_hr' AND n >= 5 AND s > 0 AND abs((value - m) / s) > 2", "value z", (T.METRICS, _LONG))
def win_z_scores(spark, sf):
    return stats.z_scores(stats.to_long(T.metrics(spark, sf), _L[:2]), least=5)


@query(f"SELECT l.user_id, l.d AS metric_date, l.metric, l.value, q1, q3, CASE WHEN value > q3 + 1.5 * (q3 - q1) THEN 'above_baseline' ELSE 'below_baseline' END AS direction FROM lg l JOIN (SELECT user_id, metric, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lg WHERE d < DATE '{AS_OF}' GROUP BY 1, 2) q ON q.user_id = l.user_id AND q.metric = l.metric WHERE l.d = DATE '{AS_OF}' AND n >= 5 AND q3 > q1 AND (value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1))", "value q1 q3", (T.METRICS, _LONG))
def win_iqr(spark, sf):
    return stats.iqr_outliers(stats.to_long(T.metrics(spark, sf), _L), AS_OF, least=5)


@query("""SELECT user_id, metric, CAST(n AS INT) AS sample_n, (r - p) / abs(p) AS rel, CASE WHEN r > p THEN 'rising' ELSE 'declining' END AS direction FROM (SELECT user_id, metric, max(k) AS n, avg(e) FILTER (k <= c // 2) AS p, avg(e) FILTER (k > c // 2) AS r FROM (SELECT *, count(*) OVER (PARTITION BY user_id, metric) AS c FROM ew) GROUP BY 1, 2) WHERE n >= 14 AND abs((r - p) / abs(p)) >= 0.15""", "rel", (T.METRICS, _LONG, "nu AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric ORDER BY d) AS k FROM lg)", "ew AS (SELECT user_id, metric, k, value AS e FROM nu WHERE k = 1 UNION ALL SELECT nu.user_id, nu.metric, nu.k, 0.3 * nu.value + 0.7 * ew.e FROM ew JOIN nu ON nu.user_id = ew.user_id AND nu.metric = ew.metric AND nu.k = ew.k + 1)"))
def win_ewma(spark, sf):
    return stats.ewma_drift(stats.to_long(T.metrics(spark, sf), _L))


_GROUPED = "gl AS (SELECT CAST(user_id % 10 AS VARCHAR) AS user_id, CAST(ts AS DATE) AS d, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2, 3)"
_PAIRS = (("view", "click"), ("view", "purchase"), ("click", "error"))


@query("SELECT * FROM (SELECT a.user_id, a.metric AS metric_a, b.metric AS metric_b, lag_days, count(*) AS sample_n, covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) AS correlation FROM gl a CROSS JOIN (VALUES (0), (1), (2)) t(lag_days) JOIN gl b ON b.user_id = a.user_id AND b.d = a.d + lag_days WHERE (a.metric, b.metric) IN (('view', 'click'), ('view', 'purchase'), ('click', 'error')) GROUP BY 1, 2, 3, 4) WHERE sample_n >= 14 AND abs(correlation) >= 0.2", "correlation", (_GROUPED,))
def win_lagged_correlation(spark, sf):
    g = T.table(spark, sf, "events").groupBy((F.col("user_id") % 10).cast("string").alias("user_id"), F.col("ts").cast("date").alias("d"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return stats.lagged_correlations(g, _PAIRS, min_r=0.2)


@query(f"""SELECT user_id, coalesce(max(n) FILTER (last >= DATE '{AS_OF}' - 1), 0) AS current_streak, max(n) AS longest_streak, CAST(sum(n) AS BIGINT) AS days_count FROM (SELECT user_id, isle, count(*) AS n, max(d) AS last FROM (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS isle FROM (SELECT DISTINCT user_id, event_date AS d FROM cardio WHERE event_date <= DATE '{AS_OF}')) GROUP BY 1, 2) GROUP BY 1""", "", (T.CARDIO,))
def win_streaks(spark, sf):
    return calendar.streaks(T.cardio(spark, sf).select("user_id", F.col("event_date").alias("d")), AS_OF)


@query("""SELECT user_id, exercise_name, n AS session_count, event_date AS latest_date, w AS latest_top_weight_lbs, v AS latest_volume_lbs, w - pw AS weight_delta_vs_prior, CASE WHEN pv > 0 THEN (v - pv) / pv * 100 END AS volume_change_pct_vs_prior, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, lower(exercise_name), exercise_name) AS INT) AS rank FROM (SELECT *, count(*) OVER x AS n, row_number() OVER (PARTITION BY user_id, exercise_name ORDER BY event_date DESC) AS rn, lag(w) OVER y AS pw, lag(v) OVER y AS pv FROM (SELECT user_id, exercise_name, event_date, max(weight_lbs) AS w, sum(reps * weight_lbs) AS v FROM sets WHERE hard GROUP BY 1, 2, 3) WINDOW x AS (PARTITION BY user_id, exercise_name), y AS (PARTITION BY user_id, exercise_name ORDER BY event_date)) WHERE rn = 1 QUALIFY rank <= 12""", "latest_top_weight_lbs latest_volume_lbs weight_delta_vs_prior volume_change_pct_vs_prior", (T.SETS,))
def win_top_exercises(spark, sf):
    return strength.top_exercises(T.sets(spark, sf))


@query("SELECT ride_id, CAST(d AS INT) AS duration, max(m) AS watts FROM (" + " UNION ALL ".join(f"SELECT ride_id, {k} AS d, avg(watts) OVER w AS m, count(*) OVER w AS c FROM series WINDOW w AS (PARTITION BY ride_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (5, 15, 30, 60, 180)) + ") WHERE c = d GROUP BY 1, 2", "watts", (T.SERIES,))
def win_mean_maximal(spark, sf):
    return power.mean_maximal(T.series(spark, sf), durations=(5, 15, 30, 60, 180))


@query("SELECT ride_id, pow(avg(pow(m, 4)) FILTER (c = 30), 0.25) AS normalized_power FROM (SELECT ride_id, avg(watts) OVER w AS m, count(*) OVER w AS c FROM series WINDOW w AS (PARTITION BY ride_id ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) GROUP BY 1", "normalized_power", (T.SERIES,))
def win_normalized_power(spark, sf):
    return power.normalized(T.series(spark, sf))


@query("SELECT ride_id AS user_id, CAST(i + 1 AS INT) AS duration, min(watts) OVER (PARTITION BY ride_id ORDER BY i) AS watts FROM series", "watts", (T.SERIES,))
def win_monotone(spark, sf):
    return power.monotone(T.series(spark, sf).select(F.col("ride_id").alias("user_id"), (F.col("i") + 1).alias("duration"), "watts"))


# --- dedup, rules, scores

@query("SELECT arg_max(source_id, CAST(source_id AS BIGINT)) AS source_id, user_id, event_date FROM cardio GROUP BY 2, 3", "", (T.CARDIO,))
def ded_last_wins(spark, sf):
    c = T.cardio(spark, sf).select("user_id", "event_date", "source_id", F.col("source_id").cast("long").alias("n"))
    return cardio_dedup.last_wins(c, ["user_id", "event_date"], "n").select("source_id", "user_id", "event_date")


_REC = "rc AS (SELECT user_id, metric_date, count(sleep_hours) OVER w AS recovery_sleep_days_7d, count(hrv_rmssd) OVER w AS recovery_hrv_days_7d, CASE WHEN count(sleep_hours) OVER w > 0 THEN sum(CASE WHEN sleep_hours IS NOT NULL THEN greatest(0, 8 - sleep_hours) END) OVER w END AS sleep_debt_7d, list(hrv_rmssd) OVER w AS h, avg(hrv_rmssd) OVER w AS m FROM metrics WINDOW w AS (PARTITION BY user_id ORDER BY metric_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)), re AS (SELECT user_id, metric_date, recovery_sleep_days_7d, recovery_hrv_days_7d, sleep_debt_7d, CAST(coalesce(len(list_filter(h, lambda x: x < m * 0.85)), 0) AS BIGINT) AS hrv_suppressed_days FROM rc)"


@query("SELECT * FROM re", "sleep_debt_7d", (T.METRICS, _REC))
def fea_recovery(spark, sf):
    return features.recovery(T.metrics(spark, sf))


@query("SELECT user_id, metric_date, CASE WHEN recovery_sleep_days_7d > 0 OR recovery_hrv_days_7d > 0 THEN greatest(0, least(100, 100 - least(40, coalesce(sleep_debt_7d * 4, 0)) - least(40, hrv_suppressed_days * 8))) END AS readiness FROM re", "readiness", (T.METRICS, _REC))
def sco_readiness(spark, sf):
    r = features.recovery(T.metrics(spark, sf)).withColumn("acute_chronic_ratio", F.lit(None).cast("double"))
    return r.select("user_id", "metric_date", scores.readiness().alias("readiness"))


_PART = """SELECT user_id, metric_date, sleep_hours AS h, greatest(0, least(1, CASE WHEN sleep_hours >= 8 THEN 1 - 0.5 * (sleep_hours - 8) / 8 ELSE 1 - 1.5 * (8 - sleep_hours) / 8 END)) AS c1,
 CASE WHEN sleep_deep_hrs >= 0 THEN greatest(0, least(1, 1 - abs(sleep_deep_hrs / sleep_hours - 0.18) / 0.18)) END AS cd, CASE WHEN sleep_rem_hrs >= 0 THEN greatest(0, least(1, 1 - abs(sleep_rem_hrs / sleep_hours - 0.22) / 0.22)) END AS cr,
 CASE WHEN hb > 0 AND hrv_rmssd IS NOT NULL THEN greatest(0, least(1, 0.65 + (hrv_rmssd - hb) / hb * 1.5)) END AS c3, CASE WHEN rb > 0 THEN greatest(0, least(1, 0.65 - (resting_hr - rb) / rb * 1.5)) END AS c4 FROM (SELECT *, CASE WHEN count(hrv_rmssd) OVER w >= 2 THEN avg(hrv_rmssd) OVER w END AS hb, CASE WHEN count(resting_hr) OVER w >= 2 THEN avg(resting_hr) OVER w END AS rb FROM metrics WINDOW w AS (PARTITION BY user_id ORDER BY metric_date RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))"""


@query(f"SELECT user_id, metric_date, CASE WHEN h > 0 THEN (0.5 * c1 + coalesce(0.25 * c2, 0) + coalesce(0.05 * c3, 0) + coalesce(0.15 * c4, 0)) / (0.5 + CASE WHEN c2 IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c3 IS NULL THEN 0 ELSE 0.05 END + CASE WHEN c4 IS NULL THEN 0 ELSE 0.15 END) * 100 END AS sleep_score FROM (SELECT *, CASE WHEN cd IS NOT NULL AND cr IS NOT NULL THEN (cd + cr) / 2 ELSE coalesce(cd, cr) END AS c2 FROM ({_PART}))", "sleep_score", (T.METRICS,))
def sco_sleep(spark, sf):
    return sleep.fill_scores(T.metrics(spark, sf)).select("user_id", "metric_date", "sleep_score")


@query("""SELECT user_id, feature_date, code, severity FROM (SELECT user_id, metric_date AS feature_date, unnest(list_filter([CASE WHEN recovery_sleep_days_7d = 0 AND recovery_hrv_days_7d = 0 THEN 'SPARSE_RECOVERY_DATA:info' END, CASE WHEN sleep_hours < 6 THEN 'LOW_SLEEP:warning' END, CASE WHEN sleep_debt_7d > 5 AND recovery_sleep_days_7d > 0 THEN 'HIGH_SLEEP_DEBT:warning' END, CASE WHEN hrv_suppressed_days > 2 AND recovery_hrv_days_7d > 0 THEN 'LOW_HRV:alert' END], lambda x: x IS NOT NULL)) AS f, split_part(f, ':', 1) AS code, split_part(f, ':', 2) AS severity FROM re JOIN metrics USING (user_id, metric_date))""", "", (T.METRICS, _REC))
def rul_flags(spark, sf):
    m = T.metrics(spark, sf)
    f = features.recovery(m).withColumnRenamed("metric_date", "feature_date")
    return rules.flags(f, m).select("user_id", "feature_date", "code", "severity")


_LIGHT = "CASE WHEN a IS NULL THEN 0 WHEN a > 1.5 THEN 3 WHEN a > 1.3 THEN 2 ELSE 1 END AS ra, CASE WHEN wow IS NULL THEN 0 WHEN wow >= 15 THEN 3 WHEN wow >= 10 THEN 2 ELSE 1 END AS rw, CASE WHEN v IS NULL THEN 0 WHEN v >= 50 THEN 3 WHEN v >= 30 THEN 2 ELSE 1 END AS rv"


@query(f"SELECT user_id, event_date, CASE greatest(ra, rw, rv) WHEN 3 THEN 'red' WHEN 2 THEN 'yellow' WHEN 1 THEN 'green' ELSE 'unknown' END AS status, CASE WHEN greatest(ra, rw, rv) >= 2 THEN 'high' WHEN a < 0.8 OR wow <= -25 OR v <= -30 THEN 'low' END AS direction FROM (SELECT *, {_LIGHT} FROM (SELECT user_id, event_date, w0 / f AS a, wow, (w0 / f - 1) * 100 AS v FROM pr))", "", (T.CARDIO, T.LOAD, _ROLL))
def sco_pace_lights(spark, sf):
    return pace.pace_lights(features.cardio_days(T.cardio(spark, sf), apply_dedup=False), "minutes", "cardio").select("user_id", "event_date", "status", "direction")


@query(f"""SELECT user_id, CAST(n AS BIGINT) AS completed, CASE WHEN user_id IN ('3', '7') THEN 'skipped' WHEN n >= 4 THEN 'done' WHEN 2 < 4 - n THEN 'urgent' ELSE 'behind' END AS status, CASE user_id WHEN '3' THEN 'Travel' WHEN '7' THEN 'Scheduled exception' END AS schedule_note FROM (SELECT user_id, count(DISTINCT event_date) FILTER (event_date >= DATE '{GOAL_DAY}' - 4 AND event_date <= DATE '{GOAL_DAY}' + 2) AS n FROM sets GROUP BY 1)""", "", (T.SETS,))
def sco_goal_status(spark, sf):
    s = T.sets(spark, sf)
    g = s.select("user_id").distinct().select("user_id", F.lit("strength_sessions").alias("goal_type"), F.lit(4.0).alias("target_min"), F.lit(None).cast("double").alias("target_max"), F.lit(None).cast("string").alias("target_label"), F.lit(True).alias("is_active"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_until"))
    rows = [("3", "1998-03-01", "1998-03-31", ["strength_sessions"], "Travel", None), ("7", GOAL_DAY, GOAL_DAY, ["strength_sessions"], None, None), ("8", "1998-03-14", "1998-03-31", ["strength_sessions"], "Later", None), ("9", "1998-03-01", "1998-03-31", ["other"], "Other", None)]
    x = spark.createDataFrame(rows, "user_id string, a string, b string, affected_goal_types array<string>, override_hint string, reason string").select("user_id", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"), "affected_goal_types", "override_hint", "reason")
    return goals.goal_status(g, s, x, GOAL_DAY).select("user_id", "completed", "status", "schedule_note")


@query("SELECT user_id, CAST(unnest(generate_series(min(event_date), max(event_date), INTERVAL 1 DAY)) AS DATE) AS d FROM cardio GROUP BY 1", "", (T.CARDIO,))
def spine_days(spark, sf):
    return spine.spine(T.cardio(spark, sf), ["user_id"], "event_date")


# --- sinks

@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, a.w AS w FROM (SELECT c_custkey AS k, c_acctbal AS v, c_name AS w FROM customer) a FULL JOIN (SELECT 2 * c_custkey AS k, -c_acctbal AS v FROM customer) b ON a.k = b.k""", "v")
def snk_sparse_upsert(spark, sf):
    c = T.table(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("w"))
    return sinks.upsert(a, c.select((2 * F.col("c_custkey")).alias("k"), (-F.col("c_acctbal")).alias("v")), ["k"])


@query("""SELECT c_custkey AS k, 'old' AS s FROM customer UNION ALL SELECT 2 * c_custkey, 'new' FROM customer WHERE 2 * c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def snk_insert_if_absent(spark, sf):
    c = T.table(spark, sf, "customer")
    return sinks.insert_if_absent(c.select(F.col("c_custkey").alias("k"), F.lit("old").alias("s")), c.select((2 * F.col("c_custkey")).alias("k"), F.lit("new").alias("s")), ["k"])


def _all() -> None:
    from . import catalog_composed, catalog_more, catalog_sources  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)



