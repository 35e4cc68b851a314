"""More queries with SQL: vendor payloads, projections, scans, sinks and greedy resolution.

Vendor payloads are made as JSON from the driver's tables and normalized; the SQL computes the rows from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import calendar, cardio_dedup, features, joins, pace, power, sleep, stats, strength
from ..sinks import tables as sinks
from ..sources import scans, vendors
from . import testmap as T
from .catalog import _L, _LONG, _RUN_WEEKS, _SESSIONS, _WEEKS, AS_OF, query


def _ev(spark, sf):
    """events with user_id as text, the day, k."""
    return T.table(spark, sf, "events").withColumns({"user_id": F.col("user_id").cast("string"), "day": F.col("ts").cast("date"), "k": F.get_json_object("props", "$.k").cast("double")})


def _by(n: int, *values):
    """The value at event_id modulo n."""
    return T._pick(F.col("event_id") % n, values)


# --- vendor payloads

@query("""SELECT CAST(o_custkey % 25 AS VARCHAR) AS user_id, 'hevy' AS source, l_orderkey || ':' || l_linenumber || ':0' AS source_id, CAST(o_orderdate AS DATE) AS event_date, l_shipday AS exercise_name, l_linestatus AS superset_id, CAST(1 AS INT) AS set_number, CAST(l_quantity AS INT) AS reps, round(l_extendedprice / 1000 * 2.2046226218, 4) AS weight_lbs, l_discount * 100 AS rpe, CASE l_returnflag WHEN 'N' THEN 'working' WHEN 'A' THEN 'warmup' ELSE 'failure' END AS set_type, o_orderpriority AS notes
 FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS l_shipday FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 2""", "weight_lbs rpe")
def src_strength_pages(spark, sf):
    """SRC-01, SRC-02, ARR-01, PRJ-01, PRJ-09."""
    j = T.table(spark, sf, "lineitem").join(T.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "N", "normal").when(F.col("l_returnflag") == "A", "warmup").otherwise(" Failure ")
    one = F.struct(F.lit(0).alias("index"), kind.alias("type"), (F.col("l_extendedprice") / 1000).alias("weight_kg"), F.col("l_quantity").cast("int").alias("reps"), (F.col("l_discount") * 100).alias("rpe"))
    # exercises without a title are skipped
    ex = F.struct(F.col("l_linenumber").alias("index"), F.when(F.col("l_linenumber") != 2, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("title"), F.col("o_orderpriority").alias("notes"), F.col("l_linestatus").alias("superset_id"), F.array(one).alias("sets"))
    w = j.groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.collect_list(ex).alias("exercises"))
    work = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00+02:00")).alias("start_time"), "exercises")
    broken = F.struct(F.lit(None).cast("string").alias("id"), F.lit("never").alias("start_time"), F.col("exercises"))
    pages = w.select((F.col("o_custkey") % 25).cast("string").alias("user_id"), F.to_json(F.struct(F.lit(1).alias("page"), F.lit(1).alias("page_count"), F.array(work, broken).alias("workouts"))).alias("raw"))
    return vendors.strength_sets(pages).drop("muscle_group", "movement_type")


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, 'strava' AS source, 'strava:' || event_id AS source_id, CAST(ts AS DATE) AS event_date, event_type AS activity_type, round(value, 4) AS duration_min, round(k * 100 / 1609.344, 4) AS distance_miles, round(value * 3.280839895, 2) AS elevation_ft, CAST(round_even(value + 60.25, 0) AS INT) AS avg_hr, CASE WHEN event_id % 2 = 0 THEN CAST(round_even(k + 100.25, 0) AS INT) END AS max_hr,
 CASE WHEN round(k * 100 / 1609.344, 4) > 1e-9 THEN CAST(round_even(value * 60 / round(k * 100 / 1609.344, 4), 0) AS INT) END AS avg_pace_sec_mi, CASE WHEN event_id % 3 = 0 THEN value ELSE k * 0.239006 END AS calories, epoch_us(date_trunc('second', ts)) AS started_us FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE value >= 0 AND event_id % 7 <> 0""", "duration_min distance_miles elevation_ft calories")
def src_cardio_pages(spark, sf):
    """SRC-04, PRJ-03, PRJ-07, PRJ-12, PRJ-36."""
    e = _ev(spark, sf)
    item = F.struct(F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string")).alias("id"), (F.col("k") * 100).alias("distance"), (F.col("value") * 60).alias("moving_time"), F.col("value").alias("total_elevation_gain"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_date"), (F.col("value") + 60.25).alias("average_heartrate"), F.when(F.col("event_id") % 2 == 0, F.col("k") + 100.25).otherwise(-1.0).alias("max_heartrate"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("calories"), F.col("k").alias("kilojoules"))
    pages = e.groupBy("user_id", "day").agg(F.to_json(F.collect_list(item)).alias("raw"))
    out = vendors.cardio_sessions(pages)
    return out.select("user_id", "source", "source_id", "event_date", "activity_type", "duration_min", "distance_miles", "elevation_ft", "avg_hr", "max_hr", "avg_pace_sec_mi", "calories", F.unix_micros("started_at").alias("started_us"))


_SAMPLES = """sm AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS event_date, event_id, event_type, value, CASE event_type WHEN 'view' THEN 'steps' WHEN 'click' THEN 'hrv_rmssd' WHEN 'purchase' THEN 'body_weight_lbs' WHEN 'signup' THEN 'sleep_hours' END AS metric,
 CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN round(value * 2.2046226218, 4) ELSE value END WHEN 'signup' THEN CASE WHEN value > 72 THEN value / 3600 WHEN value > 0 THEN value END ELSE value END AS v FROM events WHERE event_type <> 'error'),
 ru AS (SELECT user_id, event_date, metric, CASE WHEN metric = 'steps' THEN sum(v) WHEN metric = 'sleep_hours' THEN greatest(0, max(v)) ELSE avg(v) END AS value FROM sm WHERE v IS NOT NULL GROUP BY 1, 2, 3)"""


def _export(spark, sf, which=None):
    """A payload a user and day with a metric entry for each event, or for those that `which` chooses."""
    e = _ev(spark, sf) if which is None else _ev(spark, sf).where(which)
    name = F.when(F.col("event_type") == "view", "Step Count").when(F.col("event_type") == "click", "heart_rate_variability").when(F.col("event_type") == "purchase", "HKQuantityTypeIdentifierbody_mass").when(F.col("event_type") == "signup", "sleep_analysis").otherwise("blood_glucose")
    unit = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, "kg").otherwise("lb")).otherwise("u")
    sleep_ = F.col("event_type") == "signup"
    s = F.struct(F.when(~sleep_, F.col("value")).alias("qty"), F.when(sleep_, F.col("value")).alias("totalSleep"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss' +0000'").alias("date"))
    m = F.struct(name.alias("name"), unit.alias("units"), F.array(s).alias("data"))
    return e.groupBy("user_id", "day").agg(F.to_json(F.struct(F.struct(F.collect_list(m).alias("metrics")).alias("data"))).alias("raw"))


@query("SELECT user_id, event_date, metric, value FROM ru", "value", (_SAMPLES,))
def src_health_export(spark, sf):
    """SRC-06, SRC-07, SRC-08, AGG-01, PRJ-04, PRJ-10."""
    return vendors.health_metrics(_export(spark, sf)).select("user_id", "event_date", "metric", "value")


def _envelopes(spark, sf):
    e = _ev(spark, sf)
    name = F.when(F.col("event_type") == "view", "steps").when(F.col("event_type") == "click", "SPO2_PCT").when(F.col("event_type") == "purchase", "weight_body_mass").otherwise("mystery")
    m = F.struct(name.alias("metric"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("qty"))
    return e.groupBy("user_id", "day").agg(F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("event_date"), F.collect_list(m).alias("metrics"))).alias("raw"))


_ENV = "en AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS event_date, CASE event_type WHEN 'view' THEN 'steps' WHEN 'click' THEN 'spo2_pct' ELSE 'body_weight_lbs' END AS metric, value FROM events WHERE event_type IN ('view', 'click', 'purchase'))"


@query("SELECT user_id, 'apple_health' AS source, event_date, metric, count(*) AS n, sum(value) AS total FROM en GROUP BY 1, 3, 4", "total", (_ENV,))
def src_daily_envelope(spark, sf):
    """SRC-09, FLT-10."""
    return vendors.daily_envelope(_envelopes(spark, sf)).groupBy("user_id", "source", "event_date", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""SELECT user_id, event_date, metric, CASE WHEN metric = 'steps' THEN sum(v) WHEN metric = 'sleep_hours' THEN greatest(0, max(v)) ELSE avg(v) END AS value FROM (SELECT user_id, event_date, metric, v FROM sm WHERE v IS NOT NULL UNION ALL SELECT user_id, event_date, metric, value FROM en) GROUP BY 1, 2, 3""", "value", (_SAMPLES, _ENV))
def src_payload_dispatch(spark, sf):
    """SRC-10: lists of payloads, exports and envelopes."""
    a, b = _export(spark, sf), _envelopes(spark, sf)
    both = a.join(b.withColumnRenamed("raw", "other"), ["user_id", "day"], "full")
    raw = both.select("user_id", F.concat(F.lit("["), F.concat_ws(",", "raw", "other"), F.lit("]")).alias("raw"))
    return vendors.health_payloads(raw).select("user_id", "event_date", "metric", "value")


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, 'w' || event_id AS source_id, CAST(ts AS DATE) AS event_date, event_type AS activity_type, value AS duration_min, round(CASE event_id % 3 WHEN 0 THEN k / 10 * 0.621371192 WHEN 1 THEN k / 10 ELSE k / 10 / 1609.344 END, 4) AS distance_miles, CASE event_id % 4 WHEN 0 THEN 141 WHEN 1 THEN 121 WHEN 2 THEN 90 END AS avg_hr, CASE event_id % 4 WHEN 0 THEN 170 WHEN 1 THEN NULL WHEN 2 THEN 99 END AS max_hr,
 CASE event_id % 5 WHEN 0 THEN 'Nike Run Club' WHEN 1 THEN 'Health Sync' WHEN 2 THEN 'My  Apple Watch' WHEN 3 THEN NULL ELSE 'Fitbit' END AS source_app, value * 2 * CASE WHEN event_id % 2 = 0 THEN 0.239006 ELSE 1 END AS calories FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE value > 0""", "duration_min distance_miles calories")
def src_workouts(spark, sf):
    """SRC-11, SRC-12, PRJ-08, PRJ-12, PRJ-13, PRJ-18, ARR-02."""
    e = _ev(spark, sf)
    q = lambda v, u: F.struct(v.alias("qty"), u.alias("units"))
    chains = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("iPhone|Nike Run Club"), F.lit("Strava|Fitbit"))).when(F.col("event_id") % 5 == 1, F.array(F.lit("SuperPhone|Health Sync|Nike Run Club"), F.lit("Fitbit"))).when(F.col("event_id") % 5 == 2, F.array(F.lit("Google"), F.lit(" My  Apple Watch "))).when(F.col("event_id") % 5 == 3, F.array(F.lit("SuperPhone"))).otherwise(F.array(F.lit("Unknown App"), F.lit("Fitbit")))
    unit = F.when(F.col("event_id") % 2 == 0, "kJ").otherwise("kcal")
    energy = F.concat(F.transform(chains, lambda c: F.struct(F.lit(0.0).alias("qty"), unit.alias("units"), c.alias("source"))), F.array(F.struct((F.col("value") * 2).alias("qty"), unit.alias("units"), F.lit(None).cast("string").alias("source"))))
    block = F.when(F.col("event_id") % 4 == 0, '{"Avg":{"qty":140.6},"Max":170}').when(F.col("event_id") % 4 == 1, '{"avg":121,"max":null}').otherwise("[]")
    w = F.struct(F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss' +0000'").alias("start"), (F.col("value") * 60).alias("duration"), q(F.col("k") / 10, _by(3, "km", "mi", "m")).alias("distance"), F.when(F.col("event_id") % 4 == 2, q(F.lit(90.2), F.lit("bpm"))).alias("avgHeartRate"), F.when(F.col("event_id") % 4 == 2, q(F.lit(99.0), F.lit("bpm"))).alias("maxHeartRate"), energy.alias("activeEnergy"), F.lit("@").alias("heartRate"))
    raw = e.select("user_id", F.replace(F.to_json(F.struct(F.struct(F.array(w).alias("workouts")).alias("data"))), F.lit('"@"'), block).alias("raw"))
    return vendors.workouts(raw).select("user_id", "source_id", "event_date", "activity_type", "duration_min", "distance_miles", "avg_hr", "max_hr", "source_app", "calories")


@query("""SELECT CAST(o_custkey % 25 AS VARCHAR) AS user_id, CAST(o_orderdate AS DATE) AS event_date, 'calendar' AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'Busy' ELSE o_orderpriority END || CASE WHEN o_orderkey % 2 = 0 THEN ' (' || strftime(o_orderdate, '%Y-%m-%d') || ' – ' || strftime(o_orderdate + INTERVAL 2 DAYS, '%Y-%m-%d') || ')' ELSE '' END AS description, FALSE AS is_ongoing, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate + INTERVAL 2 DAYS AS DATE) END AS end_date, 'source=caldav' AS notes FROM orders""")
def src_calendar(spark, sf):
    """SRC-13."""
    o = T.table(spark, sf, "orders")
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "yyyy-MM-dd'T'09:00:00")
    return vendors.calendar_blocks(o.select((F.col("o_custkey") % 25).cast("string").alias("user_id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).otherwise("  ").alias("title"), day(0).alias("start"), F.when(F.col("o_orderkey") % 2 == 0, day(2)).otherwise(day(0)).alias("end")))


@query("SELECT n_nationkey, n_name AS name FROM nation WHERE contains(lower(n_name), 'nation_1') OR lower(n_name) = 'nation_7'")
def src_named_calendars(spark, sf):
    """SRC-14."""
    n = T.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return vendors.named_calendars(n, ["Nation_1", "NATION_7"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name END AS title FROM part""")
def src_file_titles(spark, sf):
    """SRC-21, JOIN-12."""
    p = T.table(spark, sf, "part")
    n = F.col("p_partkey").cast("string")
    files = p.select("p_partkey", F.concat(F.lit("/data/in/"), n, F.lit(".FIT.gz")).alias("path"))
    names = p.where("p_partkey % 3 < 2").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("activities/"), n, F.lit(".fit.gz"))).otherwise(F.concat(n, F.lit(".fit"))).alias("filename"), F.col("p_name").alias("title"))
    return joins.titles(files, names).select("p_partkey", "title")


# --- projections

_UNIT = "CASE event_id % 6 WHEN 0 THEN 'km' WHEN 1 THEN 'Miles' WHEN 2 THEN 'm' WHEN 3 THEN 'ft' WHEN 4 THEN 'Meters' END"


@query(f"""SELECT event_id, CASE u WHEN 'km' THEN v * 0.621371192 WHEN 'Miles' THEN v WHEN 'ft' THEN v / 5280 ELSE v / 1609.344 END AS miles, CASE u WHEN 'km' THEN v * 1000 * 3.280839895 WHEN 'Miles' THEN v * 5280 WHEN 'ft' THEN v ELSE v * 3.280839895 END AS feet, CASE WHEN event_id % 2 = 0 THEN round(v * 2.2046226218, 4) ELSE v END AS lb, CASE WHEN v * 10 > 72 THEN v * 10 / 3600 WHEN v > 0 THEN v * 10 END AS sleep,
 CASE event_id % 4 WHEN 0 THEN v * 40 / 60 WHEN 1 THEN v * 40 / 3600 WHEN 2 THEN v * 40 ELSE CASE WHEN v * 40 > 1440 THEN v * 40 / 3600 WHEN v * 40 > 24 THEN v * 40 / 60 ELSE v * 40 END END AS stage, CASE WHEN event_id % 2 = 0 THEN v * 0.239006 ELSE v END AS kcal, CASE WHEN event_id % 20 > 0 THEN CAST(round_even(v * 60 / (event_id % 20), 0) AS INT) END AS pace, v / 1.609344 AS km_miles
 FROM (SELECT *, value AS v, {_UNIT} AS u FROM events)""", "miles feet lb sleep stage kcal km_miles")
def prj_units(spark, sf):
    """PRJ-07 to PRJ-12, PRJ-36."""
    e = _ev(spark, sf)
    u, v = _by(6, "km", "Miles", "m", "ft", "Meters", None), F.col("value")
    return e.select("event_id", S.quantity_to_miles(v, u).alias("miles"), S.quantity_to_feet(v, u).alias("feet"), S.mass_to_lb(v, _by(2, "KG", "lb")).alias("lb"), S.sleep_hours(v * 10, F.lit(None)).alias("sleep"), S.stage_hours(v * 40, _by(4, "min", "seconds", "hr", None)).alias("stage"), S.kilocalories(v, _by(2, "kJ", "kcal")).alias("kcal"), S.pace_seconds(v * 60, (F.col("event_id") % 20).cast("double")).alias("pace"), S.km_to_miles(v).alias("km_miles"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN CAST(ts AS DATE) END AS d, CASE WHEN event_id % 4 < 2 THEN value END AS n, CASE event_id % 4 WHEN 3 THEN NULL ELSE epoch_us(date_trunc('second', ts)) - CASE event_id % 4 WHEN 1 THEN 7200000000 WHEN 2 THEN -19800000000 ELSE 0 END END AS at_us, epoch_us(date_trunc('second', ts)) AS fit_us, CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END AS direction,
 CASE WHEN value >= 75 THEN 'High' WHEN value >= 50 THEN 'Moderate' ELSE 'Low' END AS band, CASE event_id % 3 WHEN 0 THEN 'mine' WHEN 1 THEN '2-5x' ELSE '3x' END AS target, CASE WHEN event_id % 30 > 0 THEN least(greatest(value / (event_id % 30), 0), 1) END AS share, 'x:' || substr(sha256(event_id || '|' || event_type), 1, 20) AS made_id, CASE event_type WHEN 'view' THEN 'Run' WHEN 'click' THEN 'Ride' WHEN 'purchase' THEN 'Workout' WHEN 'signup' THEN 'Hike' ELSE 'Kite Surfing' END AS sport,
 CASE WHEN event_id % 2 = 1 THEN 'out_of_range' WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'both' WHEN event_id % 4 = 0 THEN 'lifting' WHEN event_id % 5 = 0 THEN 'fitbit' WHEN event_id % 3 = 0 THEN 'cardio' ELSE 'rest' END AS status FROM events""", "n share")
def prj_values(spark, sf):
    """PRJ-01, 02, 03, 21, 24, 28, 30, 31, 32, 39, 40."""
    e, i = _ev(spark, sf), F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(i % 4 == 0, F.concat(iso, F.lit("Z"))).when(i % 4 == 1, F.concat(F.replace(iso, F.lit("T"), F.lit(" ")), F.lit(" +0200"))).when(i % 4 == 2, F.concat(iso, F.lit("-05:30"))).otherwise("soon")
    num = F.when(i % 4 < 2, F.col("value").cast("string")).when(i % 4 == 2, "NaN").otherwise("n/a")
    sport = F.when(F.col("event_type") == "view", "trail_running").when(F.col("event_type") == "click", "2").when(F.col("event_type") == "purchase", "").when(F.col("event_type") == "signup", "HIKING").otherwise("kite_surfing")
    label = F.when(i % 3 == 0, "mine").otherwise(" ")
    return e.select("event_id", S.as_date(F.when(i % 5 != 4, iso).otherwise("yesterday")).alias("d"), S.number(num).alias("n"), F.unix_micros(S.instant(text)).alias("at_us"), F.unix_micros(S.fit_time(F.unix_timestamp("ts") - 631065600)).alias("fit_us"), S.correlation_direction(F.col("value") - 50).alias("direction"), S.readiness_band("value").alias("band"), S.target_label(label, F.when(i % 3 == 1, 2.0).otherwise(3.0), F.when(i % 3 == 1, 5.0)).alias("target"), S.completion("value", (i % 30).cast("double")).alias("share"), S.stable_id("x:", "event_id", "event_type").alias("made_id"), S.sport_activity(sport).alias("sport"), S.calendar_status(i % 2 == 0, i % 4 == 0, i % 3 == 0, i % 5 == 0).alias("status"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Nike  Run Club' WHEN 1 THEN 'Fitbit' WHEN 2 THEN 'STRAVA' WHEN 3 THEN 'Mason''s Apple Watch' WHEN 5 THEN 'iPhone' WHEN 6 THEN 'Google Fit' END AS app, CASE event_id % 8 WHEN 0 THEN 40 WHEN 1 THEN 10 WHEN 2 THEN 30 WHEN 3 THEN 20 WHEN 5 THEN 18 WHEN 6 THEN 10 ELSE 15 END AS rank FROM events""")
def prj_provenance(spark, sf):
    """PRJ-17, PRJ-18, ARR-02, ARR-03 on chains of several apps."""
    i = F.col("event_id") % 8
    arr = lambda *x: F.array(*[F.lit(v).cast("string") for v in x])
    chains = F.when(i == 0, arr("iPhone| Nike  Run Club ", "Strava|Fitbit")).when(i == 1, arr("Strava|Fitbit")).when(i == 2, arr("SuperPhone|STRAVA", "strava")).when(i == 3, arr("Mason's Apple Watch|iPhone")).when(i == 4, arr("SuperPhone", "Other")).when(i == 5, arr("iPhone")).when(i == 6, arr("Unknown", "Google Fit|Strava", "Fitbit")).otherwise(arr(None, " | "))
    d = _ev(spark, sf).select("event_id", S.best_app(chains).alias("app"))
    return d.withColumn("rank", S.app_rank("app"))


@query("""SELECT source_id, CASE WHEN distance_miles IS NOT NULL THEN 2 ELSE 0 END AS hub, CASE WHEN distance_miles IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN avg_watts IS NOT NULL THEN 5 ELSE 0 END AS power FROM cardio""", "", (T.CARDIO,))
def prj_richness(spark, sf):
    """PRJ-20."""
    return T.cardio(spark, sf).select("source_id", S.richness().alias("hub"), S.richness(power=True).alias("power"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'First part.' ELSE 'First part. Second!' END AS said, '# Morning Check-In · Sunday, March 9' || chr(10) || chr(10) || role AS whole, CASE WHEN turn % 2 = 0 THEN 'SELECT ' || turn ELSE 'select ' || role END AS statement FROM conversations""")
def prj_briefing_text(spark, sf):
    """PRJ-34, PRJ-35."""
    c = T.table(spark, sf, "conversations")
    note = F.when(F.col("turn") % 2 == 0, "First part. And how was it?").otherwise("First part. Second! Why? Really?\n")
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Sure:\n```sql\nSELECT "), F.col("turn").cast("string"), F.lit(";\n```\nDone."))).otherwise(F.concat(F.lit("  select "), F.col("role"), F.lit(" ; ")))
    return c.select("conv_id", "turn", S.without_last_question(note).alias("said"), S.briefing_text(F.concat(F.lit("## Morning check-in\n\n"), F.col("role")), F.lit("2025-03-09").cast("date")).alias("whole"), F.trim(S.fenced(fenced)).alias("statement"))


@query("""SELECT o_orderkey, o_orderkey % 3 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND (o_orderkey % 2 = 0 OR CAST(o_orderdate AS DATE) <= DATE '1998-01-01') AS in_effect, o_orderkey % 4 = 1 AS affected, o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 AS pattern FROM orders""")
def flt_goals_and_patterns(spark, sf):
    """FLT-09, FLT-11, FLT-12."""
    o, k = T.table(spark, sf, "orders"), F.col("o_orderkey")
    types = F.when(k % 4 == 1, F.array(F.lit("strength_sessions"), F.lit("x"))).when(k % 4 == 2, F.array(F.lit("x")))
    return o.select("o_orderkey", P.in_effect(F.when(k % 3 == 0, F.lit(False)), F.lit("1996-01-01").cast("date"), F.when(k % 2 == 1, F.lit("1998-01-01").cast("date")), F.col("o_orderdate").cast("date")).alias("in_effect"), P.affects(types, F.lit("strength_sessions")).alias("affected"), P.active_pattern(F.when(k % 3 == 0, "active").otherwise("inactive"), F.when(k % 2 == 1, "text").otherwise("  ")).alias("pattern"))


# --- scans

def _scan_days(column: str) -> str:
    return f"SELECT user_id, {column} AS d, count(*) AS n FROM {{t}} WHERE {column} > DATE '{AS_OF}' - {{days}} AND {column} <= DATE '{AS_OF}' GROUP BY 1, 2"


@query(f"""SELECT 'cardio' AS what, * FROM ({_scan_days('event_date').format(t='cardio', days=35)}) UNION ALL SELECT 'metrics', * FROM ({_scan_days('metric_date').format(t='metrics', days=28)}) UNION ALL SELECT 'runs', * FROM ({_scan_days('session_date').format(t='running', days=35)}) UNION ALL SELECT 'sets', user_id, event_date + 9000, count(*) FROM sets WHERE event_date + 9000 > DATE '{AS_OF}' - 84 AND event_date + 9000 <= DATE '{AS_OF}' GROUP BY 2, 3""", "", (T.CARDIO, T.METRICS, T.RUNNING, T.SETS))
def scan_trailing(spark, sf):
    """SCAN-01 to 04, 07, 10, 20, 21."""
    one = lambda what, df, c, days: scans.recent(df, c, AS_OF, days).groupBy("user_id", F.col(c).alias("d")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "user_id", "d", "n")
    s = T.sets(spark, sf).withColumn("event_date", F.date_add("event_date", 9000))
    return one("cardio", T.cardio(spark, sf), "event_date", 35).union(one("metrics", T.metrics(spark, sf), "metric_date", 28)).union(one("runs", T.running(spark, sf), "session_date", 35)).union(one("sets", s, "event_date", 84))


@query("""SELECT user_id, entry_date, body, CAST(rank AS INT) AS rank FROM (SELECT CAST(o_custkey % 25 AS VARCHAR) AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS entry_date, o_orderkey AS body, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderdate + to_seconds(o_orderkey) DESC NULLS LAST) AS rank FROM orders) WHERE rank <= 40""")
def scan_journal(spark, sf):
    """SCAN-06, SCAN-23, SRT-05, PRJ-37."""
    o = T.table(spark, sf, "orders").select((F.col("o_custkey") % 25).cast("string").alias("user_id"), F.col("o_orderdate").cast("date").alias("entry_date"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey")).alias("created_at"), F.col("o_orderkey").alias("body"))
    return scans.journal(o, 40).select("user_id", "entry_date", "body", "rank")


_PAT = "pt AS (SELECT CAST(c_nationkey AS VARCHAR) AS user_id, 'm' || c_custkey AS metric_a, c_mktsegment AS metric_b, CAST(c_custkey % 3 AS INT) AS lag_days, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal / 10000 END AS correlation, CASE WHEN c_custkey % 4 > 0 THEN 'active' ELSE 'inactive' END AS status FROM customer)"


def _patterns(spark, sf):
    k = F.col("c_custkey")
    return T.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("user_id"), F.concat(F.lit("m"), k.cast("string")).alias("metric_a"), F.col("c_mktsegment").alias("metric_b"), (k % 3).cast("int").alias("lag_days"), F.when(k % 5 > 0, F.col("c_acctbal") / 10000).alias("correlation"), F.when(k % 4 > 0, "active").otherwise("inactive").alias("status"))


@query("SELECT user_id, metric_a, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(correlation) DESC NULLS LAST, metric_a, metric_b, lag_days) AS rank FROM pt WHERE status = 'active') WHERE rank <= 12", "", (_PAT,))
def scan_active_patterns(spark, sf):
    """SCAN-08, SCAN-19, SRT-02."""
    return scans.active_patterns(_patterns(spark, sf), 12, by_strength=True).select("user_id", "metric_a", "rank")


@query(f"SELECT source_id, CASE WHEN event_date >= DATE '{AS_OF}' - 14 THEN TRUE ELSE FALSE END AS later, abs(event_date - DATE '{AS_OF}') <= 7 AS near FROM cardio", "", (T.CARDIO,))
def scan_exceptions_and_interventions(spark, sf):
    """SCAN-11, SCAN-12."""
    c = T.cardio(spark, sf)
    a = scans.exceptions_from(c.withColumn("end_date", F.col("event_date")), AS_OF).select("source_id", F.lit(True).alias("later"))
    b = scans.around(c, AS_OF).select("source_id", F.lit(True).alias("near"))
    return c.select("source_id").join(a, "source_id", "left").join(b, "source_id", "left").fillna(False, ["later", "near"])


@query(f"SELECT user_id, detected_date, metric, CAST(rank AS INT) AS rank FROM (SELECT user_id, d AS detected_date, metric, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, metric) AS rank FROM lg) WHERE rank <= 8", "", (T.METRICS, _LONG))
def scan_newest_anomalies(spark, sf):
    """SCAN-18, SCAN-24."""
    a = stats.to_long(T.metrics(spark, sf), _L).select("user_id", F.col("d").alias("detected_date"), "metric")
    return scans.top_rows(a, 8, F.desc("detected_date"), "metric")


@query("""SELECT user_id, week_start, v AS strength_volume_lbs, v / 2000 AS strength_short_tons, NULL::DOUBLE AS upper_volume_lbs, 7.5 AS lower_volume_lbs FROM wk WHERE week_start >= DATE '1998-03-11' - 84 AND week_start <= DATE '1998-03-11'""", "strength_volume_lbs strength_short_tons upper_volume_lbs lower_volume_lbs", (T.SETS, _WEEKS))
def scan_weekly_summaries(spark, sf):
    """SCAN-29, PRJ-25."""
    w = strength.week_volume(T.sets(spark, sf))
    w = w.select("user_id", "week_start", F.to_json(F.struct(F.col("volume_lbs").alias("strength_volume_lbs"), F.col("short_tons").alias("strength_short_tons"), F.lit("n/a").alias("upper_volume_lbs"), F.lit("7.5").alias("lower_volume_lbs"))).alias("summary_json"))
    return scans.weekly_summaries(w, "1998-03-11", 12).drop("summary_json")


@query(f"SELECT source_id, event_date, event_date >= DATE '{AS_OF}' AS recent FROM cardio WHERE source = 'apple_health'", "", (T.CARDIO,))
def scan_hub_rows(spark, sf):
    """SCAN-37, SCAN-38."""
    c = T.cardio(spark, sf)
    new = scans.hub_rows(c, AS_OF).select("source_id", F.lit(True).alias("recent"))
    return scans.hub_rows(c).select("source_id", "event_date").join(new, "source_id", "left").fillna(False, ["recent"])


@query("SELECT CAST(ts AS DATE) AS d, CAST(event_id AS DOUBLE) AS event_id, NULL::DOUBLE AS event_type, value FROM events WHERE event_id % 3 > 0", "event_id event_type value")
def scan_chart_rows(spark, sf):
    """ARR-11."""
    e = _ev(spark, sf).select(F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise("never").alias("d"), "event_id", "event_type", F.col("value").cast("string").alias("value"))
    return scans.chart_rows(e, "d")


# --- sinks

@query("SELECT user_id, metric, d, CASE WHEN b IS NULL THEN a ELSE b END AS value, CASE WHEN b IS NULL THEN 'old' ELSE 'new' END AS unit FROM (SELECT user_id, metric, d, max(v) FILTER (side = 'a') AS a, max(v) FILTER (side = 'b') AS b FROM (SELECT user_id, metric, d, value AS v, 'a' AS side FROM lg UNION ALL SELECT user_id, metric, d + 10, value * 2, 'b' FROM lg) GROUP BY 1, 2, 3)", "value", (T.METRICS, _LONG))
def snk_full_upsert(spark, sf):
    """SNK-03, SNK-05: whole rows replace those with their key."""
    lg = stats.to_long(T.metrics(spark, sf), _L)
    old, new = lg.withColumn("unit", F.lit("old")), lg.select("user_id", F.date_add("d", 10).alias("d"), "metric", (F.col("value") * 2).alias("value"), F.lit("new").alias("unit"))
    return sinks.upsert(old, new, ["user_id", "metric", "d"])


@query(f"SELECT user_id, d, metric, value FROM lg WHERE NOT (metric = 'steps' AND d = DATE '{AS_OF}') UNION ALL SELECT user_id, d, 'fresh', value FROM lg WHERE metric = 'steps' AND d = DATE '{AS_OF}'", "value", (T.METRICS, _LONG))
def snk_replace_scope(spark, sf):
    """SNK-04."""
    lg = stats.to_long(T.metrics(spark, sf), _L)
    today = lg.where((F.col("metric") == "steps") & (F.col("d") == F.lit(AS_OF).cast("date")))
    return sinks.replace_matching(lg, today.withColumn("metric", F.lit("fresh")), today, ["user_id", "d", "metric"])


@query("""SELECT user_id, metric_a, status FROM pt WHERE status <> 'active' AND user_id <> '3' UNION ALL SELECT user_id, metric_a, status FROM pt WHERE status = 'active' AND user_id NOT IN ('3', '4') UNION ALL SELECT user_id, metric_a, 'active' FROM pt WHERE user_id = '3' UNION ALL SELECT user_id, metric_a, 'inactive' FROM pt WHERE user_id = '4' AND FALSE UNION ALL SELECT '4', 'brand new', 'active'""", "", (_PAT,))
def snk_replace_patterns(spark, sf):
    """SNK-06: a user's active patterns go, keys that come back are active again, other users keep theirs."""
    p = _patterns(spark, sf)
    back = p.where("user_id = '3'").withColumn("status", F.lit("active"))
    one = p.limit(1).select(F.lit("4").alias("user_id"), F.lit("brand new").alias("metric_a"), F.lit("x").alias("metric_b"), F.lit(0).alias("lag_days"), F.lit(0.5).alias("correlation"), F.lit("active").alias("status"))
    return sinks.replace_patterns(p, back.union(one)).select("user_id", "metric_a", "status")


@query("SELECT user_id, source_id FROM cardio WHERE mode <> 'cycling'", "", (T.CARDIO,))
def snk_delete_ids(spark, sf):
    """SNK-07."""
    c = T.cardio(spark, sf)
    return sinks.delete_ids(c, c.where(S.cardio_mode("activity_type") == "cycling").select("user_id", "source_id")).select("user_id", "source_id")


@query("""SELECT user_id, event_date, notes, count(*) AS n FROM (SELECT user_id, event_date, notes FROM iv WHERE NOT (notes LIKE '%source=caldav%' AND day_has_run) UNION ALL SELECT user_id, event_date, 'source=caldav' FROM iv WHERE mode = 'running') GROUP BY 1, 2, 3""", "", (T.CARDIO, "iv AS (SELECT user_id, event_date, mode, CASE WHEN CAST(source_id AS BIGINT) % 2 = 0 THEN 'x source=caldav' ELSE 'own' END AS notes, bool_or(mode = 'running') OVER (PARTITION BY user_id, event_date) AS day_has_run FROM cardio)"))
def snk_replace_calendar(spark, sf):
    """SNK-08: tagged rows of the touched dates are replaced."""
    c = T.cardio(spark, sf)
    old = c.select("user_id", "event_date", F.when(F.col("source_id").cast("long") % 2 == 0, "x source=caldav").otherwise("own").alias("notes"))
    new = c.where(S.cardio_mode("activity_type") == "running").select("user_id", "event_date", F.lit("source=caldav").alias("notes"))
    return sinks.replace_calendar(old, new).groupBy("user_id", "event_date", "notes").agg(F.count("*").alias("n"))


@query("""SELECT user_id, name, CASE WHEN name = 'peak' THEN DATE '2024-03-01' ELSE end_date END AS end_date FROM phases UNION ALL SELECT user_id, name || ' again', end_date FROM phases""", "", (T.CARDIO, T.PHASES))
def snk_phases(spark, sf):
    """SNK-09, SNK-10."""
    import datetime

    p = T.phases(spark, sf)
    more = sinks.append(p, p.withColumns({"name": F.concat("name", F.lit(" again")), "id": F.concat("id", F.lit("2"))}), "training_phases")
    return sinks.update_phase(more, "peak", end_date=datetime.date(2024, 3, 1)).select("user_id", "name", "end_date")


@query("SELECT user_id, metric_date, CASE WHEN steps > 1000 THEN 1 ELSE sleep_hours END AS sleep_hours, steps, steps > 1000 AS touched FROM metrics", "sleep_hours", (T.METRICS,))
def snk_update_times(spark, sf):
    """SNK-01: only the supplied columns change, and only written rows get a new updated_at."""
    m = T.metrics(spark, sf)
    new = m.where("steps > 1000").select("user_id", "metric_date", F.lit(1.0).alias("sleep_hours"))
    return sinks.upsert(m, new, ["user_id", "metric_date"]).select("user_id", "metric_date", "sleep_hours", "steps", F.col("updated_at").isNotNull().alias("touched"))


# --- joins, windows

@query("SELECT source_id, coalesce(source_app, 'filled') AS source_app FROM cardio", "", (T.CARDIO,))
def join_enrich(spark, sf):
    """JOIN-10."""
    c = T.cardio(spark, sf).select("user_id", "source_id", "source_app")
    return joins.enrich(c, c.select("user_id", "source_id", F.lit("filled").alias("source_app")), ["user_id", "source_id"], ["source_app"]).select("source_id", "source_app")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE lang = 'de' AND text IS NOT NULL)")
def join_unseen(spark, sf):
    """JOIN-13."""
    d = T.table(spark, sf, "documents").where("text is not null").select("doc_id", "lang", F.col("text").cast("binary").alias("content"))
    return joins.unseen(d, d.where("lang = 'de'").select(F.sha2("content", 256).alias("sha256"))).select("doc_id", "sha256")


@query("""SELECT user_id, CAST(rank AS INT) AS rank, name FROM (SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY start_date, name) AS rank FROM phases WHERE coalesce(is_active, TRUE) AND start_date > DATE '2024-01-05') WHERE rank <= 3""", "", (T.CARDIO, T.PHASES))
def join_upcoming_phases(spark, sf):
    """SRT-04."""
    return joins.upcoming_phases(T.phases(spark, sf), "2024-01-05").select("user_id", "rank", "name")


@query("""SELECT user_id, week_start, upper_volume_lbs, lower_volume_lbs, full_volume_lbs, other_volume_lbs, CASE WHEN lag(upper_volume_lbs) OVER w > 0 THEN (upper_volume_lbs - lag(upper_volume_lbs) OVER w) / lag(upper_volume_lbs) OVER w * 100 END AS upper_change_pct FROM (SELECT s.user_id, s.week_start, coalesce(u, 0) AS upper_volume_lbs, coalesce(l, 0) AS lower_volume_lbs, coalesce(f, 0) AS full_volume_lbs, coalesce(o, 0) AS other_volume_lbs
 FROM (SELECT user_id, CAST(unnest(generate_series(min(w), max(w), INTERVAL 7 DAYS)) AS DATE) AS week_start FROM fw GROUP BY 1) s LEFT JOIN fw ON fw.user_id = s.user_id AND fw.w = s.week_start) WINDOW w AS (PARTITION BY user_id ORDER BY week_start)""", "upper_volume_lbs lower_volume_lbs full_volume_lbs other_volume_lbs upper_change_pct", (T.SETS, _SESSIONS, "fw AS (SELECT user_id, CAST(date_trunc('week', event_date) AS DATE) AS w, sum(volume_lbs) FILTER (session_focus = 'upper') AS u, sum(volume_lbs) FILTER (session_focus = 'lower') AS l, sum(volume_lbs) FILTER (session_focus = 'full') AS f, sum(volume_lbs) FILTER (session_focus IN ('other', 'unknown')) AS o FROM sf GROUP BY 1, 2)"))
def agg_weekly_focus(spark, sf):
    """AGG-19."""
    return strength.weekly_focus(T.sets(spark, sf))


@query("""SELECT ride_id, avg(watts) AS avg_hr, max(watts) AS max_hr, coalesce(sum(greatest(watts - p, 0)), 0) AS gain_m FROM (SELECT *, lag(watts) OVER (PARTITION BY ride_id ORDER BY i) AS p FROM series) GROUP BY 1""", "avg_hr max_hr gain_m", (T.SERIES,))
def agg_track_totals(spark, sf):
    """AGG-27."""
    return power.track_totals(T.series(spark, sf).withColumns({"hr": F.col("watts"), "altitude": F.col("watts")}))


@query("SELECT user_id, min(value) - CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) * 0.05 ELSE 1 END AS low, max(value) + CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) * 0.05 ELSE 1 END AS high FROM lg GROUP BY 1", "low high", (T.METRICS, _LONG))
def agg_domain_bounds(spark, sf):
    """AGG-31, ARR-09."""
    return sleep.domain_bounds(stats.to_long(T.metrics(spark, sf), _L))


@query("""SELECT * FROM (SELECT user_id, metric_date, 'deep' AS stage, sleep_deep_hrs AS hours FROM metrics UNION ALL SELECT user_id, metric_date, 'rem', sleep_rem_hrs FROM metrics UNION ALL SELECT user_id, metric_date, 'light', CASE WHEN sleep_hours IS NOT NULL THEN greatest(sleep_hours - coalesce(sleep_deep_hrs, 0) - coalesce(sleep_rem_hrs, 0), 0) ELSE 0 END FROM metrics) WHERE hours > 0.01""", "hours", (T.METRICS,))
def agg_sleep_stages(spark, sf):
    """ARR-10."""
    return sleep.stage_hours(T.metrics(spark, sf))


@query("""SELECT user_id, code FROM (SELECT user_id, 'STRENGTH_VOLUME_SPIKE' AS code FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week_start DESC) AS rn FROM wr) WHERE rn = 1 AND change_pct >= 12 UNION ALL SELECT user_id, 'STRENGTH_VOLUME_PLATEAU' FROM (SELECT user_id, count(*) AS n, avg(v) AS m, min(v) AS lo, max(v) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week_start DESC) AS rn FROM wr WHERE v > 0) WHERE rn <= 3 GROUP BY 1) WHERE n >= 3 AND greatest(hi - m, m - lo) / m * 100 <= 30)""", "", (T.SETS, _WEEKS, "wr AS (SELECT user_id, week_start, v, CASE WHEN lag(v) OVER w > 0 THEN (v - lag(v) OVER w) / lag(v) OVER w * 100 END AS change_pct FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY week_start))"))
def win_plateau(spark, sf):
    """WIN-13, at a band of 30 % so that there are some."""
    return strength.progress_flags(strength.weekly_rollups(T.sets(spark, sf)), band=30.0)


# --- greedy resolution

_NATIVE = "CASE source_app WHEN 'Nike Run Club' THEN 40 WHEN 'Fitbit' THEN 10 WHEN 'Strava' THEN 30 WHEN 'Apple Watch' THEN 20 ELSE 15 END"
_HUB_KEY = f"{_NATIVE} AS k1, CASE WHEN coalesce(pace < 210 OR pace > 1080, FALSE) THEN 0 ELSE 1 END AS k2, CASE WHEN distance_miles IS NOT NULL THEN 2 ELSE 0 END AS k3"
_POWER_KEY = "CASE source WHEN 'wahoo_fit' THEN 50 WHEN 'strava_export' THEN 40 WHEN 'strava' THEN 25 ELSE 20 END AS k1, 0 AS k2, CASE WHEN distance_miles IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN avg_watts IS NOT NULL THEN 5 ELSE 0 END AS k3"


def _greedy(name: str, rows: str, key: str, entry: str = "o.at", kind: str = "BIGINT", near: str = "abs(y - o.at) <= 900000000") -> str:
    """CTEs: the rows of `rows` that stay when they are taken by descending key within user, day and family; a row goes that is `near` to a kept entry y."""
    copy = f"len(list_filter(r.kept, lambda y: {near})) > 0"
    return f"""{name}_o AS (SELECT *, epoch_us(started_at) AS at, row_number() OVER (PARTITION BY user_id, event_date, family ORDER BY k1 DESC, k2 DESC, k3 DESC, source_id DESC) AS rn FROM (SELECT *, {key} FROM {rows})),
 {name}_r AS (SELECT user_id, event_date, family, CAST(0 AS BIGINT) AS k, CAST([] AS {kind}[]) AS kept, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT user_id, event_date, family FROM {name}_o)
  UNION ALL SELECT r.user_id, r.event_date, r.family, o.rn, CASE WHEN {copy} THEN r.kept ELSE list_append(r.kept, {entry}) END, CASE WHEN {copy} THEN r.ids ELSE list_append(r.ids, o.source_id) END
  FROM {name}_r r JOIN {name}_o o ON o.user_id = r.user_id AND o.event_date = r.event_date AND o.family = r.family AND o.rn = r.k + 1),
 {name} AS (SELECT unnest(arg_max(ids, k)) AS source_id FROM {name}_r GROUP BY user_id, event_date, family)"""


_HUB = "hub AS (SELECT * FROM cardio WHERE source = 'apple_health')"
_TL = ("lh AS (SELECT * FROM load WHERE source = 'apple_health')", _greedy("lhk", "lh", _HUB_KEY), "pw AS (SELECT * FROM load WHERE source <> 'apple_health' OR source_id IN (SELECT source_id FROM lhk))", _greedy("pwk", "pw", _POWER_KEY), "tl AS (SELECT * FROM load WHERE source_id IN (SELECT source_id FROM pwk))")


@query("SELECT user_id, source_id FROM hub WHERE source_id IN (SELECT source_id FROM hk)", "", (T.CARDIO, _HUB, _greedy("hk", "hub", _HUB_KEY)))
def ded_hub(spark, sf):
    """DED-01."""
    return cardio_dedup.dedupe_hub(T.cardio(spark, sf).where("source = 'apple_health'")).select("user_id", "source_id")


@query("SELECT user_id, source_id, duration_min FROM tl", "duration_min", (T.CARDIO, T.LOAD, *_TL))
def ded_training_load(spark, sf):
    """DED-02, DED-03."""
    return cardio_dedup.training_load_sessions(T.cardio(spark, sf)).select("user_id", "source_id", "duration_min")


# a third of the rows without a start, a seventh without a distance
_UNTIMED = """un AS (SELECT * REPLACE (CASE WHEN CAST(source_id AS BIGINT) % 3 > 0 THEN started_at END AS started_at, CASE WHEN CAST(source_id AS BIGINT) % 7 > 0 THEN distance_miles END AS distance_miles, CASE WHEN CAST(source_id AS BIGINT) % 7 > 0 THEN pace END AS pace) FROM cardio)"""
_ENTRY = {"entry": "{'s': o.at, 'm': o.duration_min, 'd': o.distance_miles}", "kind": "STRUCT(s BIGINT, m DOUBLE, d DOUBLE)"}
_ALIKE = "coalesce(abs(y.s - o.at) <= 900000000, abs(coalesce(y.m, 0) - coalesce(o.duration_min, 0)) <= 5"


def _untimed(spark, sf):
    n = F.col("source_id").cast("long")
    return T.cardio(spark, sf).withColumns({"started_at": F.when(n % 3 > 0, F.col("started_at")), "distance_miles": F.when(n % 7 > 0, F.col("distance_miles"))})


@query("SELECT user_id, source_id FROM uh WHERE source_id IN (SELECT source_id FROM uk)", "", (T.CARDIO, _UNTIMED, "uh AS (SELECT * FROM un WHERE source = 'apple_health')", _greedy("uk", "uh", _HUB_KEY, **_ENTRY, near=f"{_ALIKE} AND coalesce(abs(y.d - o.distance_miles) <= 0.15, TRUE))")))
def ded_hub_untimed(spark, sf):
    """DED-01, JOIN-04 where starts or distances are missing: by duration and, if both have one, distance."""
    return cardio_dedup.dedupe_hub(_untimed(spark, sf).where("source = 'apple_health'")).select("user_id", "source_id")


@query("SELECT user_id, source_id FROM un WHERE source_id IN (SELECT source_id FROM pk)", "", (T.CARDIO, _UNTIMED, _greedy("pk", "un", _POWER_KEY, **_ENTRY, near=f"{_ALIKE})")))
def ded_power_untimed(spark, sf):
    """DED-02, JOIN-05 where starts are missing: by duration alone."""
    return cardio_dedup.dedupe_power(_untimed(spark, sf)).select("user_id", "source_id")


_RESOLVED = "SELECT source_id, 'insert' AS what FROM st WHERE ins UNION ALL SELECT DISTINCT unnest(gone), 'delete' FROM st WHERE ins"


def _resolve_ctes(kept: str, stored: str, key: str) -> tuple[str, ...]:
    return (f"ne AS (SELECT *, {key} FROM cardio WHERE source_id IN (SELECT source_id FROM {kept}))", f"ol AS (SELECT *, {key} FROM {stored})", """st AS (SELECT n.source_id, coalesce(bool_and(ROW(n.k1, n.k2, n.k3, n.source_id) > ROW(o.k1, o.k2, o.k3, o.source_id)) FILTER (o.source_id IS NOT NULL), TRUE) AS ins, coalesce(list(o.source_id) FILTER (o.source_id IS NOT NULL), []) AS gone FROM ne n LEFT JOIN ol o ON o.user_id = n.user_id AND o.event_date = n.event_date AND o.family = n.family AND abs(epoch_us(o.started_at) - epoch_us(n.started_at)) <= 900000000 GROUP BY 1)""")


@query(_RESOLVED, "", (T.CARDIO, "inc AS (SELECT * FROM cardio WHERE source = 'apple_health' AND source_app IN ('Nike Run Club', 'Strava'))", "sto AS (SELECT * FROM cardio WHERE source = 'apple_health' AND coalesce(source_app, '') NOT IN ('Nike Run Club', 'Strava'))", _greedy("ik", "inc", _HUB_KEY), *_resolve_ctes("ik", "sto", _HUB_KEY)))
def ded_resolve(spark, sf):
    """JOIN-06: all hub rows, those of two apps against those of the others."""
    c = T.cardio(spark, sf).where("source = 'apple_health'")
    mine = F.coalesce(F.col("source_app").isin("Nike Run Club", "Strava"), F.lit(False))
    new, gone = cardio_dedup.resolve(c.where(mine), c.where(~mine))
    return new.select("source_id", F.lit("insert").alias("what")).union(gone.select("source_id", F.lit("delete").alias("what")))


@query(_RESOLVED, "", (T.CARDIO, "inc AS (SELECT * FROM cardio WHERE source IN ('wahoo_fit', 'apple_health'))", "sto AS (SELECT * FROM cardio WHERE source NOT IN ('wahoo_fit', 'apple_health'))", _greedy("ik", "inc", _POWER_KEY), *_resolve_ctes("ik", "sto", _POWER_KEY)))
def ded_resolve_power(spark, sf):
    """JOIN-07: rows of two sources against those of the others."""
    c = T.cardio(spark, sf)
    mine = F.col("source").isin("wahoo_fit", "apple_health")
    new, gone = cardio_dedup.resolve(c.where(mine), c.where(~mine), power=True)
    return new.select("source_id", F.lit("insert").alias("what")).union(gone.select("source_id", F.lit("delete").alias("what")))


_MAP = """dm AS (SELECT user_id, d, bool_or(lift) AS lifting, bool_or(card) AS cardio, bool_or(fb) AS fitbit, CASE WHEN bool_or(lift) AND bool_or(card) THEN 'both' WHEN bool_or(lift) THEN 'lifting' ELSE 'cardio' END AS kind FROM (SELECT *, max(s) OVER (PARTITION BY user_id, d) AS lifted FROM (SELECT DISTINCT user_id, event_date + 9000 AS d, 1 AS s, TRUE AS lift, FALSE AS card, FALSE AS fb FROM sets UNION ALL SELECT user_id, event_date, 0, family = 'strength', family <> 'strength', coalesce(source_app = 'Fitbit', FALSE) FROM cardio)) WHERE s = 1 OR lifted = 0 OR card GROUP BY 1, 2)"""


def _day_map(spark, sf):
    return calendar.day_map(T.sets(spark, sf).withColumn("event_date", F.date_add("event_date", 9000)), T.cardio(spark, sf))


@query("SELECT user_id, d, lifting, cardio, fitbit, kind FROM dm", "", (T.CARDIO, T.SETS, _MAP))
def cal_day_map(spark, sf):
    """AGG-21: sets and cardio."""
    return _day_map(spark, sf).select("user_id", "d", "lifting", "cardio", "fitbit", "kind")


@query("""SELECT g.user_id, g.d, CAST(date_trunc('week', g.d) AS DATE) AS week_start, g.d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AS in_month, CASE WHEN g.d > DATE '2024-01-31' THEN 'out_of_range' WHEN lifting AND cardio THEN 'both' WHEN lifting THEN 'lifting' WHEN fitbit THEN 'fitbit' WHEN cardio THEN 'cardio' ELSE 'rest' END AS status FROM (SELECT user_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT user_id FROM dm)) g LEFT JOIN dm ON dm.user_id = g.user_id AND dm.d = g.d""", "", (T.CARDIO, T.SETS, _MAP))
def cal_month_grid(spark, sf):
    """JOIN-14, SCO-18, PRJ-32."""
    return calendar.month_grid(_day_map(spark, sf), AS_OF).select("user_id", "d", "week_start", "in_month", "status")


# --- daily features

def _w(n: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)"


_DAYS = """fs AS (SELECT user_id, event_date + 9000 AS d, count(*) AS any_sets, count(*) FILTER (hard) AS hs, coalesce(sum(reps * weight_lbs) FILTER (hard), 0) AS vol, avg(rpe) FILTER (hard) * count(*) FILTER (hard) * 3 AS sau FROM sets GROUP BY 1, 2),
 fc AS (SELECT user_id, event_date AS d, count(*) AS sessions, sum(duration_min) AS minutes FROM tl GROUP BY 1, 2),
 fq AS (SELECT user_id, event_date AS d, count(*) FILTER (pace < 210 OR pace > 1080) AS suspect, sum(session_rpe * duration_min) FILTER (family <> 'strength' AND duration_min > 0) AS cau FROM cardio GROUP BY 1, 2),
 fu AS (SELECT user_id, d FROM fs UNION SELECT user_id, d FROM fc UNION SELECT user_id, d FROM fq UNION SELECT user_id, metric_date FROM metrics),
 fj AS (SELECT fu.user_id, fu.d, any_sets, hs, vol, sau, sessions, minutes, suspect, cau, sleep_hours, hrv_rmssd AS hrv, EXISTS (SELECT 1 FROM fq q WHERE q.user_id = fu.user_id AND q.d = fu.d) AS wanted FROM fu LEFT JOIN fs USING (user_id, d) LEFT JOIN fc USING (user_id, d) LEFT JOIN fq USING (user_id, d) LEFT JOIN metrics m ON m.user_id = fu.user_id AND m.metric_date = fu.d)"""
_FEATURE_SQL = f"""SELECT *, CASE WHEN recovery_sleep_days_7d > 0 OR recovery_hrv_days_7d > 0 THEN greatest(0, least(100, 100 - least(40, coalesce(sleep_debt_7d * 4, 0)) - least(40, hrv_suppressed_days * 8) - CASE WHEN acute_chronic_ratio > 1.5 THEN 20 ELSE 0 END)) END AS overall_readiness_score FROM (SELECT user_id, d AS feature_date,
 CAST(count(*) FILTER (any_sets > 0) {_w(7)} AS INT) AS strength_sessions_7d, CAST(coalesce(sum(hs) {_w(7)}, 0) AS INT) AS strength_hard_sets_7d, coalesce(sum(vol) {_w(7)}, 0) / 2000 AS strength_tonnage_7d, coalesce(sum(vol) {_w(28)}, 0) / 2000 AS training_load_strength_short_tons_28d, CAST(count(*) FILTER (sessions > 0) {_w(7)} AS INT) AS cardio_sessions_7d,
 coalesce(sum(minutes) {_w(7)}, 0) AS cardio_minutes_7d, coalesce(sum(minutes) {_w(14)}, 0) AS cardio_minutes_14d, CASE WHEN sum(minutes) {_w(28)} > 0 THEN coalesce(sum(minutes) {_w(7)}, 0) / (sum(minutes) {_w(28)} / 4) END AS acute_chronic_ratio, CAST(coalesce(sum(suspect) {_w(7)}, 0) AS INT) AS cardio_distance_suspect_7d,
 coalesce(sum(minutes) {_w(7)}, 0) + coalesce(sum(vol) {_w(7)}, 0) / 2000 * {features.MIN_PER_TON} AS effort_unified_index_7d, CASE WHEN sum(cau) {_w(7)} > 0 THEN sum(cau) {_w(7)} END AS effort_foster_cardio_au_7d, sum(sau) {_w(7)} AS effort_foster_strength_au_7d,
 CASE WHEN sum(cau) {_w(28)} > 0 OR sum(sau) {_w(28)} IS NOT NULL THEN coalesce(CASE WHEN sum(cau) {_w(28)} > 0 THEN sum(cau) {_w(28)} END, 0) + coalesce(sum(sau) {_w(28)}, 0) END AS effort_foster_au_28d, CAST(count(sleep_hours) {_w(7)} AS INT) AS recovery_sleep_days_7d, CAST(count(hrv) {_w(7)} AS INT) AS recovery_hrv_days_7d,
 CASE WHEN count(sleep_hours) {_w(7)} > 0 THEN sum(CASE WHEN sleep_hours IS NOT NULL THEN greatest(0, 8 - sleep_hours) END) {_w(7)} END AS sleep_debt_7d, CAST(coalesce(len(list_filter(list(hrv) FILTER (hrv IS NOT NULL) {_w(7)}, lambda x: x < mean * 0.85)), 0) AS INT) AS hrv_suppressed_days, wanted FROM (SELECT *, avg(hrv) {_w(7)} AS mean FROM fj)) WHERE wanted"""
_FEATURE_COLS = "strength_tonnage_7d training_load_strength_short_tons_28d cardio_minutes_7d cardio_minutes_14d acute_chronic_ratio effort_unified_index_7d effort_foster_cardio_au_7d effort_foster_strength_au_7d effort_foster_au_28d sleep_debt_7d overall_readiness_score"


@query(_FEATURE_SQL.replace("SELECT *, CASE WHEN recovery", "SELECT * EXCLUDE (wanted), CASE WHEN recovery", 1), _FEATURE_COLS, (T.CARDIO, T.LOAD, T.METRICS, T.SETS, *_TL, _DAYS))
def fea_daily(spark, sf):
    """AGG-03 to AGG-10, SCO-02: the whole tables."""
    sets = T.sets(spark, sf).withColumn("event_date", F.date_add("event_date", 9000))
    dates = T.cardio(spark, sf).select("user_id", F.col("event_date").alias("feature_date")).distinct()
    f = features.daily_features(sets, T.cardio(spark, sf), T.metrics(spark, sf), dates)
    return f.select("user_id", "feature_date", "strength_sessions_7d", "strength_hard_sets_7d", "strength_tonnage_7d", "training_load_strength_short_tons_28d", "cardio_sessions_7d", "cardio_minutes_7d", "cardio_minutes_14d", "acute_chronic_ratio", "cardio_distance_suspect_7d", "effort_unified_index_7d", "effort_foster_cardio_au_7d", "effort_foster_strength_au_7d", "effort_foster_au_28d", "recovery_sleep_days_7d", "recovery_hrv_days_7d", "sleep_debt_7d", "hrv_suppressed_days", "overall_readiness_score")


# --- power thresholds

_CURVE = "bc AS (SELECT ride_id AS user_id, [" + ", ".join(map(str, power.DURATIONS)) + "][i % 10 + 1] AS duration, max(watts) AS watts FROM series GROUP BY 1, 2), mc AS (SELECT user_id, duration, min(watts) OVER (PARTITION BY user_id ORDER BY duration) AS watts FROM bc)"


def _curve(spark, sf):
    """Every value of a series at one of the durations, the best of each."""
    at = F.element_at(F.array(*map(F.lit, power.DURATIONS)), (F.col("i") % 10 + 1).cast("int"))
    return T.series(spark, sf).groupBy(F.col("ride_id").alias("user_id"), at.alias("duration")).agg(F.max("watts").alias("watts"))


_CP = "cp AS (SELECT user_id, regr_intercept(watts, 1.0 / duration) AS cp, regr_slope(watts, 1.0 / duration) AS w_prime, least(0.85, 0.35 + 0.45 * coalesce(regr_r2(watts, 1.0 / duration), 1)) AS cp_confidence FROM {} WHERE duration IN (300, 720, 1200, 1800) AND watts > 0 GROUP BY 1 HAVING count(*) >= 3 AND regr_intercept(watts, 1.0 / duration) > 0)"


@query("SELECT * FROM cp", "cp w_prime cp_confidence", (T.SERIES, _CURVE, _CP.format("bc")))
def sco_critical_power(spark, sf):
    """SCO-09."""
    return power.critical_power(_curve(spark, sf))


@query("""SELECT user_id, CASE WHEN NOT soft THEN m60 WHEN soft30 AND cw IS NOT NULL THEN cw ELSE m30 * 0.95 END AS ftp_watts, CASE WHEN NOT soft THEN 'mmp_60' WHEN soft30 AND cw IS NOT NULL THEN 'coggan_20min' ELSE 'mmp_30' END AS ftp_method, CASE WHEN NOT soft THEN 0.92 WHEN soft30 AND cw IS NOT NULL THEN cc ELSE 0.80 END AS ftp_confidence
 FROM (SELECT *, m60 < m30 * 0.88 OR m60 < m20 * 0.70 AS soft, m30 < m20 * 0.88 AS soft30, CASE WHEN m20 > 0 AND NOT (m5 > 0 AND m20 / m5 < 0.85) THEN m20 * 0.9 END AS cw, least(0.85, 0.5 + 0.3 * least(1, greatest(0, (m20 / m5 - 0.85) / 0.1))) AS cc FROM (SELECT user_id, max(watts) FILTER (duration = 300) AS m5, max(watts) FILTER (duration = 1200) AS m20, max(watts) FILTER (duration = 1800) AS m30, max(watts) FILTER (duration = 3600) AS m60 FROM mc GROUP BY 1))""", "ftp_watts ftp_confidence", (T.SERIES, _CURVE))
def sco_threshold(spark, sf):
    """SCO-07, SCO-08, WIN-18."""
    return power.threshold(_curve(spark, sf)).select("user_id", "ftp_watts", "ftp_method", "ftp_confidence")


# --- jobs, ingest, ad-hoc SQL

def scratch(spark, name: str) -> str:
    """A new folder under the one that the cluster shares; a local session without one has its own."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='pulseframe-')}"
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _pushed(spark, sf, metrics, runs):
    """Payloads of the chosen events: a metric entry each, a workout each with its start to the microsecond."""
    e = _ev(spark, sf)
    body = F.struct(F.lit(0.0).alias("qty"), F.lit("kcal").alias("units"), _by(5, "Nike Run Club", "Fitbit", "Strava", None, "Apple Watch").alias("source"))
    kind = F.create_map(*[F.lit(x) for kv in T.ACTIVITIES.items() for x in kv])[F.col("event_type")]
    w = F.struct(F.col("event_id").cast("string").alias("id"), kind.alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS' +0000'").alias("start"), (F.col("value") * 60).alias("duration"), F.struct((F.col("k") / 10).alias("qty"), F.lit("mi").alias("units")).alias("distance"), F.array(body).alias("activeEnergy"))
    runs = e.where(runs).groupBy("user_id", "day").agg(F.collect_list(w).alias("w"))
    j = _export(spark, sf, metrics).join(runs, ["user_id", "day"], "full")
    m = F.coalesce(F.get_json_object("raw", "$.data.metrics"), F.lit("[]"))
    return j.select("user_id", F.concat(F.lit('{"data":{"metrics":'), m, F.lit(',"workouts":'), F.coalesce(F.to_json("w"), F.lit("[]")), F.lit("}}")).alias("raw"))


_PUSHED = (
    _SAMPLES, _SAMPLES.replace("sm AS", "s2 AS").replace("ru AS", "r2 AS").replace("FROM sm", "FROM s2").replace("event_type <> 'error'", "event_type <> 'error' AND event_id % 3 = 0"),
    T.CARDIO, "wk AS (SELECT * REPLACE (date_trunc('second', started_at) AS started_at) FROM cardio WHERE duration_min > 0)", "inc AS (SELECT * FROM wk WHERE source_app IN ('Nike Run Club', 'Strava'))", "pre AS (SELECT * FROM wk WHERE coalesce(source_app, '') NOT IN ('Nike Run Club', 'Strava'))",
    _greedy("pk", "pre", _HUB_KEY), "sto AS (SELECT * FROM pre WHERE source_id IN (SELECT source_id FROM pk))", _greedy("ik", "inc", _HUB_KEY), *_resolve_ctes("ik", "sto", _HUB_KEY),
)


@query("""SELECT user_id, event_date, metric AS what, CAST(value AS DOUBLE) AS value FROM (SELECT user_id, event_date, metric, coalesce(b.value, a.value) AS value FROM ru a LEFT JOIN r2 b USING (user_id, event_date, metric))
 UNION ALL SELECT user_id, event_date, source_id, duration_min FROM wk WHERE source_id IN (SELECT source_id FROM sto) AND source_id NOT IN (SELECT unnest(gone) FROM st WHERE ins) OR source_id IN (SELECT source_id FROM st WHERE ins)
 UNION ALL SELECT 'log', CAST('2024-01-01' AS DATE), 'last batch', 1.0""", "value", _PUSHED)
def str_ingest(spark, sf):
    """STR-01, STR-02, STR-04, SNK-02, SNK-07: two batches in one commit each, biometrics sent again and sessions replaced by better ones; then the second number once more with other contents, which changes nothing. As in the SQL, starts count by whole seconds but for those of the second batch against stored ones."""
    from ..sinks.store import Store
    from ..streaming import ingest

    store = Store(spark, scratch(spark, "pulseframe-ingest"), buckets=16)
    better = F.coalesce(_by(5, "Nike Run Club", "Fitbit", "Strava", None, "Apple Watch").isin("Nike Run Club", "Strava"), F.lit(False))
    every, third = F.lit(True), F.col("event_id") % 3 == 0
    for batch, metrics, runs in ((0, every, ~better), (1, third, better), (1, ~third, every)):
        ingest.apply_payloads(store, _pushed(spark, sf, metrics, runs), stream="query", batch=batch, grain="second")
    store.vacuum(keep=1, hours=0)
    last = spark.range(1).select(F.lit("log").alias("user_id"), F.to_date(F.lit("2024-01-01")).alias("event_date"), F.lit("last batch").alias("what"), F.lit(float(store.applied("query"))).alias("value"))
    bio = store.read("biometrics").select("user_id", "event_date", F.col("metric").alias("what"), "value")
    return bio.unionByName(store.read("cardio_events").select("user_id", "event_date", F.col("source_id").alias("what"), F.col("duration_min").alias("value"))).unionByName(last)


@query("SELECT user_id, source_id, duration_min FROM cardio WHERE user_id = '3' AND activity_type <> 'limit 600' ORDER BY CAST(source_id AS BIGINT) LIMIT 500", "duration_min", (T.CARDIO,))
def sql_tenant_select(spark, sf):
    """SQL-01, SQL-03: a checked statement over one user's rows; its limit is lowered to 500, its literals stay."""
    from . import bounded_sql

    text = "SELECT user_id, source_id, duration_min FROM cardio_events WHERE user_id = '3' AND activity_type <> 'limit 600' ORDER BY CAST(source_id AS BIGINT) LIMIT 9999"
    return bounded_sql.run(spark, text, {"cardio_events": T.cardio(spark, sf)}, "3")


_GAPS = "gs AS (SELECT ride_id, i * 3 AS s, watts FROM series WHERE i % 4 <> 1)"


@query("SELECT g.ride_id, CAST(g.t AS BIGINT) AS i, CASE WHEN g.t - gs.s <= 2 THEN gs.watts END AS watts FROM (SELECT ride_id, unnest(generate_series(CAST(0 AS BIGINT), max(s))) AS t FROM gs GROUP BY 1) g ASOF JOIN gs ON gs.ride_id = g.ride_id AND gs.s <= g.t", "watts", (T.SERIES, _GAPS))
def win_resample(spark, sf):
    """WIN-15: a value every three seconds, some missing, as one a second held for two."""
    s = T.series(spark, sf).where("i % 4 <> 1").select("ride_id", F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 3).alias("ts"), "watts")
    return power.resample(s)


@query("""SELECT user_id, week_start, coalesce(n, 0) AS strength_sessions, coalesce(running_km, 0) AS running_km, coalesce(m, 0) AS cardio_minutes FROM (SELECT user_id, CAST(date_trunc('week', event_date + 9002) AS DATE) AS week_start, count(DISTINCT event_date) AS n FROM sets GROUP BY 1, 2) FULL JOIN (SELECT user_id, CAST(date_trunc('week', event_date) AS DATE) AS week_start, sum(duration_min) AS m FROM cardio GROUP BY 1, 2) USING (user_id, week_start) FULL JOIN (SELECT user_id, CAST(date_trunc('week', d) AS DATE) AS week_start, sum(km) AS running_km FROM (SELECT user_id, session_date AS d, distance_km AS km FROM running UNION ALL SELECT user_id, event_date, distance_miles * 1.609344 FROM cardio WHERE mode = 'running' AND NOT coalesce(pace < 210, FALSE)) GROUP BY 1, 2) USING (user_id, week_start)""", "running_km cardio_minutes", (T.CARDIO, T.RUNNING, T.SETS))
def agg_weekly_summary(spark, sf):
    """AGG-15, AGG-24."""
    from ..operators import goals

    s = T.sets(spark, sf).withColumn("event_date", F.date_add("event_date", 9002))
    return goals.weekly_summary(s, T.running(spark, sf), T.cardio(spark, sf)).select("user_id", "week_start", "strength_sessions", "running_km", "cardio_minutes")


@query("""SELECT user_id, d AS detected_date, metric, 'statistical' AS anomaly_type, CASE WHEN abs((value - m) / s) >= 3 THEN 'alert' ELSE 'warning' END AS severity FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM lg WINDOW w AS (PARTITION BY user_id, metric ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAYS PRECEDING)) WHERE metric <> 'steps' AND metric <> 'resting_hr' AND n >= 5 AND s > 0 AND abs((value - m) / s) > 2""", "", (T.METRICS, _LONG))
def sco_anomaly_rows(spark, sf):
    """SCO-13."""
    lg = stats.to_long(T.metrics(spark, sf), _L[:2])
    none = stats.iqr_outliers(lg.limit(0), AS_OF)
    return stats.anomaly_rows(stats.z_scores(lg, least=5), none).select("user_id", "detected_date", "metric", "anomaly_type", "severity")


@query("""SELECT CAST(conv_id AS VARCHAR) AS user_id, 'llm_pattern_' || turn AS metric, left(role || ': ' || text, 500) AS description FROM conversations WHERE turn < 3 AND trim(text, ' ') <> ''""")
def sco_llm_patterns(spark, sf):
    """SCO-14, ARR-01."""
    c = T.table(spark, sf, "conversations").where("turn < 3")
    p = c.groupBy(F.col("conv_id").cast("string").alias("user_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("title"), x["text"].alias("description"))).alias("patterns"))
    return stats.llm_pattern_rows(p.withColumn("detected_date", F.lit(AS_OF).cast("date"))).select("user_id", "metric", "description")


@query("""SELECT user_id, week_start, km / 1.609344 AS this_week_mi, prev / 1.609344 AS last_week_mi FROM (SELECT s.user_id, s.week_start, coalesce(running_km, 0) AS km, coalesce(lag(coalesce(running_km, 0)) OVER (PARTITION BY s.user_id ORDER BY s.week_start), 0) AS prev FROM (SELECT user_id, CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAYS)) AS DATE) AS week_start FROM rw GROUP BY 1) s LEFT JOIN rw USING (user_id, week_start))""", "this_week_mi last_week_mi", (T.CARDIO, T.RUNNING, _RUN_WEEKS))
def prj_mileage(spark, sf):
    """PRJ-29."""
    ramp = pace.mileage_ramp(pace.running_weeks(T.running(spark, sf), T.cardio(spark, sf)))
    d = ramp.select("user_id", "week_start", S.mileage_in_miles(F.struct("this_week_km", "last_week_km", "change_pct", "flag")).alias("m"))
    return d.select("user_id", "week_start", "m.this_week_mi", "m.last_week_mi")
