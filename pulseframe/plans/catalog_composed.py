"""Queries over composed results: snapshots, summaries, contexts, documents, thresholds, bounded scans, streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, goals, joins, pace, rules, stats, strength
from ..sources import loaders, scans
from . import jobs
from . import testmap as T
from .catalog import _L, _LONG, AS_OF, GOAL_DAY, TIE, _queries, _sql, query
from .catalog_more import scratch


def composed(sql: str, doubles: str = ""):
    """query() over the SQL of other queries, {name} in braces, rounded as they are."""
    return query(sql.format_map({k: f"({v})" for k, v in _sql.items()}), doubles)


# --- goals, thresholds

def _goals(spark, sf):
    u = T.sets(spark, sf).select("user_id").distinct()
    none = F.lit(None)
    return u.select("user_id", F.lit("strength_sessions").alias("goal_type"), F.lit(4.0).alias("target_min"), none.cast("double").alias("target_max"), none.cast("string").alias("target_label"), F.lit(True).alias("is_active"), none.cast("date").alias("effective_from"), none.cast("date").alias("effective_until"))


def _exceptions(spark):
    rows = [("3", "1998-03-01", "1998-03-31", ["strength_sessions"], "Travel", None), ("7", GOAL_DAY, GOAL_DAY, ["strength_sessions"], None, None), ("8", "1998-03-14", "1998-03-31", ["strength_sessions"], "Later", None), ("9", "1998-03-01", "1998-03-31", ["other"], "Other", None)]
    return spark.createDataFrame(rows, "user_id string, a string, b string, affected_goal_types array<string>, override_hint string, reason string").select("user_id", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"), "affected_goal_types", "override_hint", "reason")


@query(f"""SELECT user_id, DATE '{GOAL_DAY}' AS snapshot_date, completed, status, coalesce(nullif(concat_ws(' · ', goal, CASE WHEN (goal IS NOT NULL OR user_id IN ('3', '7', '9') AND hint IS NOT NULL) AND CAST(user_id AS INT) % 4 = 0 THEN 'Busy: Block ' || user_id END, hint), ''), 'On track — no urgent sessions flagged for today.') AS todays_focus FROM
 (SELECT *, CASE WHEN status IN ('behind', 'urgent') THEN 'Strength' || CASE status WHEN 'urgent' THEN ' needed' ELSE ' session' END || ' — ' || completed || ' of 4x done' END AS goal, CASE user_id WHEN '3' THEN 'Travel' WHEN '9' THEN 'Other' END AS hint FROM
 (SELECT user_id, n AS completed, CASE WHEN user_id IN ('3', '7') THEN 'skipped' WHEN n >= 4 THEN 'done' WHEN 2 < 4 - n THEN 'urgent' ELSE 'behind' END AS status FROM (SELECT user_id, count(DISTINCT event_date) FILTER (event_date >= DATE '{GOAL_DAY}' - 4 AND event_date <= DATE '{GOAL_DAY}' + 2) AS n FROM sets GROUP BY 1)))""", "", (T.SETS,))
def sco_goal_snapshot(spark, sf):
    """SCO-10, SCO-11, SCO-12, FLT-09: every user's snapshot of a day, its JSON read back by typed paths."""
    s = T.sets(spark, sf)
    busy = s.select("user_id").distinct().where(F.col("user_id").cast("int") % 4 == 0)
    busy = busy.select("user_id", F.lit(GOAL_DAY).cast("date").alias("event_date"), F.lit("calendar").alias("category"), F.concat(F.lit("Block "), "user_id").alias("description"))
    more = busy.withColumn("description", F.lit("Zeppelin"))  # a later block of the day isn't shown
    shot = goals.goal_snapshot(_goals(spark, sf), s, T.running(spark, sf), T.cardio(spark, sf), _exceptions(spark), busy.union(more), GOAL_DAY)
    v = F.parse_json("goals_status")
    return shot.select("user_id", "snapshot_date", F.try_variant_get(v, "$.completed", "bigint").alias("completed"), F.try_variant_get(v, "$.status", "string").alias("status"), "todays_focus")


@query("SELECT user_id, CASE WHEN CAST(user_id AS INT) % 3 = 0 THEN 7.5 ELSE 6.0 END AS min_sleep_hours, 1.5 AS max_acute_chronic_ratio, CASE WHEN CAST(user_id AS INT) % 5 = 0 THEN -2.0 ELSE 60.0 END AS min_readiness_score, 210.0 AS run_pace_min_sec_mi FROM (SELECT DISTINCT user_id FROM cardio)", "min_sleep_hours max_acute_chronic_ratio min_readiness_score run_pace_min_sec_mi", (T.CARDIO,))
def sco_thresholds(spark, sf):
    """SCO-04: overrides by user over the defaults; what is no number, or has an unknown name, doesn't count."""
    u = T.cardio(spark, sf).select("user_id").distinct()
    n = F.col("user_id").cast("int")
    rows = F.array(F.when(n % 3 == 0, F.struct(F.lit("min_sleep_hours").alias("name"), F.lit("7.5").alias("value"))), F.when(n % 2 == 0, F.struct(F.lit("max_acute_chronic_ratio").alias("name"), F.lit("much").alias("value"))), F.when(n % 5 == 0, F.struct(F.lit("min_readiness_score").alias("name"), F.lit("-2").alias("value"))), F.struct(F.lit("unknown").alias("name"), F.lit("1").alias("value")))
    over = u.select("user_id", F.explode(F.array_compact(rows)).alias("x")).select("user_id", "x.*")
    return rules.thresholds(u, over).select("user_id", "min_sleep_hours", "max_acute_chronic_ratio", "min_readiness_score", "run_pace_min_sec_mi")


# --- weeks

@composed("""SELECT user_id, week_start, coalesce(a.sessions, 0) AS lifting_days, coalesce(hard_sets, 0) AS hard_sets, coalesce(volume_lbs, 0) AS volume_lbs, coalesce(run_days, 0) AS run_days, coalesce(minutes, 0) AS minutes, coalesce(running_miles, 0) AS running_miles, coalesce(cycling_miles, 0) AS cycling_miles
 FROM {agg_week_strength} a FULL JOIN {agg_run_days} b USING (user_id, week_start) FULL JOIN {agg_cardio_weeks} c USING (user_id, week_start)""", "volume_lbs minutes running_miles cycling_miles")
def agg_glance(spark, sf):
    """AGG-23: of each week lifting, run days, minutes by mode."""
    return goals.glance(T.sets(spark, sf), T.running(spark, sf), T.cardio(spark, sf)).select("user_id", "week_start", "lifting_days", "hard_sets", "volume_lbs", "run_days", "minutes", "running_miles", "cycling_miles")


WEEK = "1998-03-09"  # of GOAL_DAY


@composed(f"SELECT user_id, count(*) FILTER (week_start <= DATE '{WEEK}' AND week_start > DATE '{WEEK}' - 56) AS weeks, sum(volume_lbs) FILTER (week_start = DATE '{WEEK}') AS this_week, sum(volume_lbs) FILTER (week_start = DATE '{WEEK}' - 7) AS last_week, sum(change_pct) FILTER (week_start = DATE '{WEEK}') AS change, coalesce(max(change_pct) FILTER (week_start = DATE '{WEEK}') >= 12, FALSE) AS spike FROM {{win_weekly_rollups}} GROUP BY 1", "this_week last_week change")
def sco_strength_summary(spark, sf):
    """SCO-16, PRJ-22, WIN-13: eight weeks of each user up to a day, with the last two and the flag of a jump."""
    r = strength.progress_summary(T.sets(spark, sf), GOAL_DAY)
    return r.select("user_id", F.size("weekly_rollups").cast("long").alias("weeks"), F.col("this_week_volume_lbs").alias("this_week"), F.col("last_week_volume_lbs").alias("last_week"), F.col("week_over_week_change_pct").alias("change"), F.coalesce(F.array_contains("progress_flags", "STRENGTH_VOLUME_SPIKE"), F.lit(False)).alias("spike"))


_W = ", ".join(f"coalesce(sum(duration_min) FILTER (event_date BETWEEN DATE '{AS_OF}' - {6 + 7 * k} AND DATE '{AS_OF}' - {7 * k}), 0) AS w{k}" for k in range(5))


@query("""SELECT user_id, w0 AS acute_load, f AS four_week_avg_load, a AS acwr, CASE greatest(ra, rw, rv) WHEN 3 THEN 'red' WHEN 2 THEN 'yellow' WHEN 1 THEN 'green' ELSE 'unknown' END AS status, CASE WHEN greatest(ra, rw, rv) >= 2 THEN 'high' WHEN a < 0.8 OR wow <= -25 OR v <= -30 THEN 'low' END AS direction, lift IS NOT NULL AS lifts FROM
 (SELECT *, CASE WHEN a IS NULL THEN 0 WHEN a > 1.5 THEN 3 WHEN a > 1.3 THEN 2 ELSE 1 END AS ra, CASE WHEN wow IS NULL THEN 0 WHEN wow >= 15 THEN 3 WHEN wow >= 10 THEN 2 ELSE 1 END AS rw, CASE WHEN v IS NULL THEN 0 WHEN v >= 50 THEN 3 WHEN v >= 30 THEN 2 ELSE 1 END AS rv FROM
 (SELECT *, w0 / f AS a, (w0 / f - 1) * 100 AS v FROM (SELECT *, CASE WHEN greatest(w1, w2, w3, w4) > 0 THEN (w1 + w2 + w3 + w4) / 4 END AS f, CASE WHEN w1 > 0 THEN (w0 - w1) / w1 * 100 WHEN w0 > 0 THEN 100 END AS wow FROM wn)))
 LEFT JOIN (SELECT DISTINCT user_id AS lift FROM sets) ON lift = user_id""", "acute_load four_week_avg_load acwr", (T.CARDIO, T.LOAD, T.SETS, f"wn AS (SELECT user_id, {_W} FROM load GROUP BY 1)"))
def sco_pace_summary(spark, sf):
    """SCO-06: each user's cardio block on one day, days without sessions too, and whether there is a lifting block."""
    p = pace.pace_summary(T.sets(spark, sf), T.cardio(spark, sf), AS_OF, apply_dedup=False).where("cardio is not null")
    return p.select("user_id", "cardio.acute_load", "cardio.four_week_avg_load", "cardio.acwr", "cardio.status", "cardio.direction", F.col("lifting").isNotNull().alias("lifts"))


# --- phases, documents

@query(f"""SELECT user_id, a.name AS active, CAST(ceil((end_date - start_date + 1) / 7.0) AS BIGINT) AS weeks_total, CAST(ceil((DATE '{AS_OF}' - start_date + 1) / 7.0) AS BIGINT) AS weeks_elapsed, (DATE '{AS_OF}' - start_date + 1) * 100.0 / (end_date - start_date + 1) AS progress_pct, coalesce(up, '') AS upcoming, n AS phases FROM (SELECT DISTINCT user_id FROM phases) u
 LEFT JOIN (SELECT DISTINCT ON (user_id) * FROM phases WHERE coalesce(is_active, TRUE) AND DATE '{AS_OF}' BETWEEN start_date AND end_date ORDER BY user_id, start_date DESC) a USING (user_id)
 LEFT JOIN (SELECT user_id, string_agg(name, ',' ORDER BY start_date) AS up FROM phases WHERE coalesce(is_active, TRUE) AND start_date > DATE '{AS_OF}' GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM phases WHERE coalesce(is_active, TRUE) GROUP BY 1) USING (user_id)""", "progress_pct", (T.CARDIO, T.PHASES))
def sco_phase_context(spark, sf):
    """SCO-17, SCAN-05, SCAN-22, SRT-04: the active phase with its progress, the next ones, all that are active."""
    c = joins.phase_context(T.phases(spark, sf), AS_OF)
    return c.select("user_id", F.col("active.name").alias("active"), F.col("active.weeks_total").alias("weeks_total"), F.col("active.weeks_elapsed").alias("weeks_elapsed"), F.col("active.progress_pct").alias("progress_pct"), F.coalesce(F.array_join("upcoming.name", ","), F.lit("")).alias("upcoming"), F.size("phases").cast("long").alias("phases"))


@query(f"""SELECT user_id, metric_date, sleep_hours, CAST(steps AS BIGINT) AS steps, load_date, minutes, coalesce(n, 0) AS phases, coalesce(first_phase, '') AS first_phase, FALSE AS has_goals FROM
 (SELECT DISTINCT ON (user_id) user_id, metric_date, sleep_hours, steps FROM metrics WHERE metric_date <= DATE '{AS_OF}' ORDER BY user_id, metric_date DESC) m FULL JOIN
 (SELECT DISTINCT ON (user_id) user_id, event_date AS load_date, sum(duration_min) AS minutes FROM load WHERE event_date <= DATE '{AS_OF}' GROUP BY 1, 2 ORDER BY user_id, event_date DESC) l USING (user_id) FULL JOIN (SELECT user_id, count(*) AS n, min(name) AS first_phase FROM phases GROUP BY 1) p USING (user_id)""", "sleep_hours minutes", (T.METRICS, T.CARDIO, T.LOAD, T.PHASES))
def sco_context_document(spark, sf):
    """SCO-15, PRJ-25: the document parsed once as a VARIANT and read by typed paths; an empty section isn't there."""
    load = features.cardio_days(T.cardio(spark, sf), apply_dedup=False).select("user_id", F.col("event_date").alias("feature_date"), "minutes")
    phases = T.phases(spark, sf).select("user_id", "name", "start_date")
    d = jobs.context_document({"metrics": T.metrics(spark, sf), "load": load, "phases": phases, "goals": _goals(spark, sf).limit(0)}, AS_OF)
    at = lambda path, kind: F.try_variant_get("parsed", path, kind)
    sorted_names = at("$.phases", "array<struct<name:string>>")
    return d.select("user_id", at("$.metrics.metric_date", "date").alias("metric_date"), at("$.metrics.sleep_hours", "double").alias("sleep_hours"), at("$.metrics.steps", "bigint").alias("steps"), at("$.load.feature_date", "date").alias("load_date"), at("$.load.minutes", "double").alias("minutes"), F.size(sorted_names).cast("long").alias("phases"), F.coalesce(F.get(sorted_names, F.lit(0))["name"], F.lit("")).alias("first_phase"), at("$.goals", "variant").isNotNull().alias("has_goals"))


@query(f"""SELECT user_id, d, sleep_hours, CAST(steps AS BIGINT) AS steps, m AS cardio_minutes FROM (SELECT user_id, metric_date AS d, sleep_hours, hrv_rmssd, resting_hr, steps FROM metrics) FULL JOIN (SELECT user_id, event_date AS d, sum(duration_min) AS m FROM load GROUP BY 1, 2) USING (user_id, d) WHERE d <= DATE '{AS_OF}' AND d >= DATE '{AS_OF}' - 60 AND coalesce(sleep_hours, hrv_rmssd, resting_hr, steps, m) IS NOT NULL""", "sleep_hours cardio_minutes", (T.METRICS, T.CARDIO, T.LOAD))
def agg_weekly_payload(spark, sf):
    """AGG-30: each user's last sixty days as compact JSON, read back day by day."""
    feats = features.cardio_days(T.cardio(spark, sf), apply_dedup=False).select("user_id", F.col("event_date").alias("feature_date"), F.lit(None).cast("double").alias("overall_readiness_score"), F.col("minutes").alias("cardio_minutes_7d"), F.lit(None).cast("double").alias("strength_tonnage_7d"))
    p = jobs.weekly_payload(T.metrics(spark, sf), feats, AS_OF)
    return p.select("user_id", F.explode(F.from_json("payload", "array<struct<d:date,sleep_hours:double,steps:bigint,cardio_minutes_7d:double>>")).alias("x")).select("user_id", "x.d", "x.sleep_hours", "x.steps", F.col("x.cardio_minutes_7d").alias("cardio_minutes"))


# --- scans

@query(f"SELECT user_id, source_id, event_date, avg_watts FROM cardio WHERE avg_watts IS NOT NULL AND event_date <= DATE '{AS_OF}' AND event_date > DATE '{AS_OF}' - 90 AND source <> 'apple_health'", "avg_watts", (T.CARDIO,))
def scan_rides_in_lookback(spark, sf):
    """SCAN-24, SCAN-34: power rides of the other sources within ninety days."""
    c = T.cardio(spark, sf).where("avg_watts is not null and source <> 'apple_health'")
    return scans.recent(c, "event_date", AS_OF, 90).select("user_id", "source_id", "event_date", "avg_watts")


@query(f"""SELECT user_id, feature_date, minutes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY feature_date DESC) AS rn FROM (SELECT user_id, event_date AS feature_date, sum(duration_min) AS minutes FROM load WHERE event_date <= DATE '{AS_OF}' AND event_date > DATE '{AS_OF}' - 370 GROUP BY 1, 2)) WHERE rn <= 500""", "minutes", (T.CARDIO, T.LOAD))
def scan_feature_history(spark, sf):
    """SCAN-27, SCAN-28: bounded history of features by allowed columns."""
    f = features.cardio_days(T.cardio(spark, sf), apply_dedup=False).withColumnRenamed("event_date", "feature_date")
    return scans.history(f, "daily_features", ["feature_date", "minutes"], AS_OF, 9999)


@query("SELECT user_id, goal_type, n AS users FROM (SELECT DISTINCT user_id, 'strength_sessions' AS goal_type FROM sets), (SELECT count(DISTINCT user_id) AS n FROM sets)", "", (T.SETS,))
def scan_goals_and_users(spark, sf):
    """SCAN-09, SCAN-36: goals in effect on a day, from tables in a store, with the number of users known to it."""
    from ..functions import predicates as P
    from ..sinks.store import Store

    store = Store(spark, scratch(spark, "pulseframe-scans"))
    g = _goals(spark, sf)
    off = g.withColumns({"goal_type": F.lit("off"), "is_active": F.lit(False)})
    over = g.withColumns({"goal_type": F.lit("over"), "effective_until": F.lit("1998-03-12").cast("date")})
    with store.transaction() as t:
        t.replace("goals", g.unionByName(off).unionByName(over))
        t.replace("user_settings", g.select("user_id"))
    day = F.lit(GOAL_DAY).cast("date")
    found = store.read("goals").where(P.in_effect("is_active", "effective_from", "effective_until", day))
    return found.join(F.broadcast(store.read("user_settings").agg(F.count_distinct("user_id").alias("users")))).select("user_id", "goal_type", "users")


_LOADED = f"""SELECT 'biometrics_today' AS what, user_id, d, metric AS label, value AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS z FROM lg WHERE d = DATE '{AS_OF}'
 UNION ALL SELECT 'daily_metrics_window', user_id, metric_date, NULL, sleep_hours, hrv_rmssd, resting_hr FROM metrics WHERE metric_date BETWEEN DATE '{AS_OF}' - 27 AND DATE '{AS_OF}'
 UNION ALL SELECT 'daily_features_window', user_id, event_date, NULL, minutes, sessions, NULL FROM (SELECT user_id, event_date, sum(duration_min) AS minutes, count(*) AS sessions FROM load GROUP BY 1, 2) WHERE event_date BETWEEN DATE '{AS_OF}' - 27 AND DATE '{AS_OF}'
 UNION ALL SELECT 'strength_events', user_id, event_date + 9000, exercise_name || CASE WHEN hard THEN ':working' ELSE '' END, reps, weight_lbs, rpe FROM sets WHERE event_date + 9000 BETWEEN DATE '{AS_OF}' - 34 AND DATE '{AS_OF}'
 UNION ALL SELECT 'cardio_events', user_id, event_date, activity_type, distance_miles, duration_min, session_rpe FROM cardio WHERE event_date BETWEEN DATE '{AS_OF}' - 34 AND DATE '{AS_OF}'
 UNION ALL SELECT 'running_sessions', user_id, event_date, 'run:' || source, distance_miles * 2, duration_min, NULL FROM cardio WHERE activity_type = 'Rowing' AND event_date BETWEEN DATE '{AS_OF}' - 34 AND DATE '{AS_OF}'
 UNION ALL SELECT 'interventions', user_id, event_date, source, NULL, NULL, NULL FROM cardio WHERE event_date BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' + 7
 UNION ALL SELECT 'schedule_exceptions', user_id, event_date, source_id, NULL, NULL, NULL FROM cardio WHERE event_date >= DATE '{AS_OF}' - 14
 UNION ALL SELECT 'active_patterns', user_id, NULL, metric_a, correlation, lag_days, NULL FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN k % 5 > 0 THEN k % 11 END DESC NULLS LAST, metric_a) AS rk FROM (SELECT CAST(c_nationkey AS VARCHAR) AS user_id, c_custkey AS k, 'm' || c_custkey AS metric_a, c_acctbal / 10000 AS correlation, c_custkey % 3 AS lag_days FROM customer) WHERE k % 4 > 0) WHERE rk <= 12
 UNION ALL SELECT 'goals', CAST(c_nationkey AS VARCHAR), NULL, 'g' || c_custkey, c_acctbal, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT 'training_phases', user_id, start_date, name, NULL, NULL, NULL FROM phases
 UNION ALL SELECT 'journal_entries', user_id, d, body, NULL, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, o_orderdate + to_seconds(o_orderkey) DESC, body) AS rk FROM (SELECT CAST(o_custkey % 25 AS VARCHAR) AS user_id, CAST(o_orderdate AS DATE) + 9000 AS d, o_orderdate, o_orderkey, CAST(o_orderkey AS VARCHAR) AS body FROM orders) WHERE d <= DATE '{AS_OF}') WHERE rk <= 40"""


def _stored(spark, sf, table, since=None, until=None):
    """The views by the names of stored tables; the days asked for are left to the scan."""
    cardio, k, none = T.cardio(spark, sf), F.col("c_custkey"), F.lit(None)
    user = F.col("c_nationkey").cast("string").alias("user_id")
    if table == "biometrics":
        return stats.to_long(T.metrics(spark, sf), _L).withColumnRenamed("d", "event_date")
    if table == "daily_features":
        return features.cardio_days(cardio, apply_dedup=False).withColumnRenamed("event_date", "feature_date")
    if table == "strength_events":
        return T.sets(spark, sf).withColumn("event_date", F.date_add("event_date", 9000))
    if table == "interventions":
        return cardio.select("user_id", "event_date", F.col("source").alias("category"), F.col("source_id").alias("description"))
    if table == "schedule_exceptions":
        return cardio.select("user_id", F.col("event_date").alias("start_date"), F.col("event_date").alias("end_date"), F.array("source").alias("affected_goal_types"), F.col("source_id").alias("override_hint"), F.col("source").alias("reason"))
    if table == "metric_patterns":
        c = T.table(spark, sf, "customer").select(user, F.concat(F.lit("m"), k.cast("string")).alias("metric_a"), F.col("c_mktsegment").alias("metric_b"), (k % 3).cast("int").alias("lag_days"), (F.col("c_acctbal") / 10000).alias("correlation"), F.lit(9).alias("sample_n"), F.when(k % 4 > 0, "active").otherwise("inactive").alias("status"), F.lit("").alias("description"), F.when(k % 5 > 0, F.timestamp_seconds(k % 11)).alias("last_confirmed_at"))
        return c
    if table == "goals":
        active = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
        return T.table(spark, sf, "customer").select(user, F.concat(F.lit("g"), k.cast("string")).alias("goal_type"), F.col("c_acctbal").alias("target_min"), none.cast("double").alias("target_max"), none.cast("string").alias("target_label"), F.lit("week").alias("period"), active.alias("is_active"), none.cast("date").alias("effective_from"), none.cast("date").alias("effective_until"))
    if table == "athlete_journal_entries":
        return T.table(spark, sf, "orders").select((F.col("o_custkey") % 25).cast("string").alias("user_id"), F.date_add(F.col("o_orderdate").cast("date"), 9000).alias("entry_date"), F.lit("note").alias("category"), F.col("o_orderkey").cast("string").alias("body"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey")).alias("created_at"))
    return {"daily_health_metrics": T.metrics, "cardio_events": lambda *_: cardio, "running_sessions": T.running, "training_phases": T.phases}[table](spark, sf)


@query(_LOADED, "x y z", (T.CARDIO, T.LOAD, T.METRICS, T.SETS, T.PHASES, _LONG))
def scan_daily_loaders(spark, sf):
    """SRC-28, SCAN-01 to 12: the rows of the daily job's twelve scans, three numbers and a label of each."""
    found = loaders.loaders(lambda table, since=None, until=None: _stored(spark, sf, table, since, until), date.fromisoformat(AS_OF))
    n, t = F.lit(None).cast("double"), F.lit(None).cast("string")
    shown = {
        "biometrics_today": (F.lit(AS_OF), "metric", "value", n, n), "daily_metrics_window": ("metric_date", t, "sleep_hours", "hrv_rmssd", "resting_hr"), "daily_features_window": ("feature_date", t, "minutes", "sessions", n),
        "strength_events": ("event_date", F.concat("exercise_name", F.when(F.col("set_type") == "working", ":working").otherwise("")), "reps", "weight_lbs", "rpe"), "cardio_events": ("event_date", "activity_type", "distance_miles", "duration_min", "session_rpe"),
        "running_sessions": ("session_date", F.concat_ws(":", "run_type", "source"), "distance_km", "duration_min", n), "interventions": ("event_date", "category", n, n, n), "schedule_exceptions": ("end_date", "override_hint", n, n, n),
        "active_patterns": (t, "metric_a", "correlation", "lag_days", n), "goals": (t, "goal_type", "target_min", n, n), "training_phases": ("start_date", "name", n, n, n), "journal_entries": ("entry_date", "body", n, n, n),
    }
    out = None
    for name, (d, label, *numbers) in shown.items():
        c = lambda v: F.col(v) if isinstance(v, str) else v
        rows = found[name].select(F.lit(name).alias("what"), "user_id", c(d).cast("date").alias("d"), c(label).alias("label"), *[c(v).cast("double").alias(a) for v, a in zip(numbers, "xyz")])
        out = rows if out is None else out.union(rows)
    return out


@query(f"SELECT user_id, event_date, source_id, source, source_app, activity_type, distance_miles, duration_min, avg_watts, epoch_us(started_at) AS started_us, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_date DESC, source_id) AS rank FROM cardio WHERE event_date BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}')", "distance_miles duration_min avg_watts", (T.CARDIO,))
def scan_cardio_window(spark, sf):
    """SCAN-24: a week's sessions of each user, newest first."""
    d = loaders.cardio_window(T.cardio(spark, sf), date.fromisoformat(AS_OF))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_date"), "source_id"))
    return d.select("user_id", "event_date", "source_id", "source", "source_app", "activity_type", "distance_miles", "duration_min", "avg_watts", F.unix_micros("started_at").alias("started_us"), place.alias("rank"))


@query("""SELECT user_id, metric_a, metric_b, lag_days, correlation FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(correlation) DESC, metric_a, metric_b, lag_days) AS rk FROM (SELECT user_id, 'm' || (event_id % 7) AS metric_a, event_type AS metric_b, CAST(event_id % 3 AS INTEGER) AS lag_days, arg_max(c, abs(c)) AS correlation FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, event_type, (value - 50) * 0.01 + event_id * 1e-9 AS c FROM events) GROUP BY 1, 2, 3, 4)) WHERE rk <= 12""", "correlation")
def ded_patterns(spark, sf):
    """DED-05, SRT-02: of found patterns each pair and lag once, the strongest; each user's twelve strongest."""
    e = T.table(spark, sf, "events")
    p = e.select(F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string")).alias("metric_a"), F.col("event_type").alias("metric_b"), (F.col("event_id") % 3).cast("int").alias("lag_days"), ((F.col("value") - 50) * 0.01 + F.col("event_id") * 1e-9).alias("correlation"))
    return stats.top_patterns(p).drop("rank")


@query("SELECT source_id, CASE WHEN pace < 210 OR pace > 1080 THEN 1 ELSE 0 END AS n_flags, coalesce(pace < 210 OR pace > 1080, FALSE) AS implausible FROM cardio", "", (T.CARDIO,))
def prj_quality_flags(spark, sf):
    """ARR-08, FLT-04: flags as an array, and whether one is among them."""
    from ..functions import predicates as P

    return T.cardio(spark, sf).select("source_id", F.size(P.pace_flags()).alias("n_flags"), P.suspect_distance(P.pace_flags()).alias("implausible"))


# --- streams

@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(user_id AS VARCHAR) AS user_id, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3", "total")
def str_daily_windows(spark, sf):
    """STR-07, an extension: tumbling days of a stream with repeats, complete when the input ends."""
    from ..streaming import ingest

    at, out = scratch(spark, "pulseframe-windows"), scratch(spark, "pulseframe-windows-out")
    e = T.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"), "event_type", "value")
    e.unionByName(e.where("event_id % 3 = 0")).repartition(4, "user_id").write.parquet(at)
    q = ingest.daily_windows(spark.readStream.schema(e.schema).parquet(at), late="400 days").writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress)
    return spark.read.schema("day timestamp, user_id string, event_type string, n long, total double").parquet(f"{out}/{last}")
