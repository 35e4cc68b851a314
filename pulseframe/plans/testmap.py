"""The domain's tables as views of the driver's: Spark frames, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

ACTIVITIES = {"view": "Outdoor Run", "click": "Ride", "purchase": "Outdoor Walk", "signup": "Traditional Strength Training", "error": "Rowing"}
SOURCES = ("apple_health", "strava", "wahoo_fit", "strava_export")
APPS = ("Nike Run Club", "Fitbit", "Strava", None, "Apple Watch")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(n, values):
    out = None
    for i, v in enumerate(values):
        out = F.when(n == i, F.lit(v)) if out is None else out.when(n == i, F.lit(v))
    return out.cast("string")


def cardio(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = None
    for k, v in ACTIVITIES.items():
        kind = F.when(F.col("event_type") == k, v) if kind is None else kind.when(F.col("event_type") == k, v)
    rpe = F.col("event_id") % 10
    d = e.select(
        F.col("user_id").cast("string").alias("user_id"), _pick(F.col("event_id") % 4, SOURCES).alias("source"), F.col("event_id").cast("string").alias("source_id"), F.col("ts").cast("date").alias("event_date"), kind.alias("activity_type"), F.col("value").alias("duration_min"),
        (F.get_json_object("props", "$.k").cast("double") / 10).alias("distance_miles"), F.col("ts").cast("timestamp").alias("started_at"), _pick(F.col("event_id") % 5, APPS).alias("source_app"), F.when(rpe > 0, rpe.cast("double")).alias("session_rpe"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("avg_watts"),
    )
    return schemas.conform(d, "cardio_events")


CARDIO = """cardio AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CASE event_id % 4 WHEN 0 THEN 'apple_health' WHEN 1 THEN 'strava' WHEN 2 THEN 'wahoo_fit' ELSE 'strava_export' END AS source, CAST(event_id AS VARCHAR) AS source_id,
 CAST(ts AS DATE) AS event_date, CASE event_type WHEN 'view' THEN 'Outdoor Run' WHEN 'click' THEN 'Ride' WHEN 'purchase' THEN 'Outdoor Walk' WHEN 'signup' THEN 'Traditional Strength Training' WHEN 'error' THEN 'Rowing' END AS activity_type,
 CASE event_type WHEN 'view' THEN 'run' WHEN 'click' THEN 'ride' WHEN 'purchase' THEN 'walk' WHEN 'signup' THEN 'strength' WHEN 'error' THEN 'row' END AS family, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'cycling' ELSE 'other' END AS mode,
 value AS duration_min, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS distance_miles, ts AS started_at, CASE event_id % 5 WHEN 0 THEN 'Nike Run Club' WHEN 1 THEN 'Fitbit' WHEN 2 THEN 'Strava' WHEN 3 THEN NULL ELSE 'Apple Watch' END AS source_app,
 CASE WHEN event_id % 10 > 0 THEN CAST(event_id % 10 AS DOUBLE) END AS session_rpe, CASE WHEN event_id % 3 = 0 THEN value END AS avg_watts,
 CASE WHEN event_type = 'view' AND value > 0 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN value * 60 / (CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10) END AS pace FROM events)"""
#: Cardio rows that count as load, without resolving copies.
LOAD = "load AS (SELECT * FROM cardio WHERE family <> 'strength' AND NOT (family = 'walk' AND source_app IS NOT NULL AND source_app = 'Fitbit'))"


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    of = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    d = e.groupBy(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("date").alias("metric_date")).agg((4 + of("view") / 100).alias("sleep_hours"), of("click").alias("hrv_rmssd"), of("purchase").alias("x"), F.count("*").alias("n"), (0.5 + of("signup") / 400).alias("sleep_deep_hrs"), (0.8 + of("error") / 400).alias("sleep_rem_hrs"))
    d = d.withColumns({"resting_hr": F.lit(50) + F.col("n").cast("int"), "steps": (F.col("n") * 1000).cast("int")}).drop("x", "n")
    return schemas.conform(d, "daily_health_metrics")


METRICS = """metrics AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS metric_date, 4 + avg(value) FILTER (event_type = 'view') / 100 AS sleep_hours, avg(value) FILTER (event_type = 'click') AS hrv_rmssd,
 50 + count(*) AS resting_hr, count(*) * 1000 AS steps, 0.5 + avg(value) FILTER (event_type = 'signup') / 400 AS sleep_deep_hrs, 0.8 + avg(value) FILTER (event_type = 'error') / 400 AS sleep_rem_hrs FROM events GROUP BY 1, 2)"""


def sets(spark: SparkSession, sf: str) -> DataFrame:
    li, o, p = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "N", "working").when(F.col("l_returnflag") == "A", "warmup").otherwise("dropset")
    d = j.select((F.col("o_custkey") % 25).cast("string").alias("user_id"), F.lit("hevy").alias("source"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("source_id"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("p_type").alias("exercise_name"), F.col("l_linenumber").alias("set_number"), F.col("l_quantity").cast("int").alias("reps"), F.col("p_retailprice").alias("weight_lbs"), F.when(F.col("l_linestatus") != "F", F.col("l_discount") * 100).alias("rpe"), kind.alias("set_type"))
    return schemas.conform(d, "strength_events")


SETS = """sets AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS user_id, CAST(o_orderdate AS DATE) AS event_date, p_type AS exercise_name, CAST(l_quantity AS INT) AS reps, p_retailprice AS weight_lbs,
 CASE WHEN l_linestatus <> 'F' THEN l_discount * 100 END AS rpe, l_returnflag = 'N' AS hard FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def running(spark: SparkSession, sf: str) -> DataFrame:
    d = cardio(spark, sf).where("activity_type = 'Rowing'").select("user_id", "source", "source_id", F.col("event_date").alias("session_date"), F.lit("run").alias("run_type"), (F.col("distance_miles") * 2).alias("distance_km"), "duration_min")
    return schemas.conform(d, "running_sessions")


RUNNING = "running AS (SELECT user_id, event_date AS session_date, distance_miles * 2 AS distance_km FROM cardio WHERE activity_type = 'Rowing')"

PHASES_ROWS = [("base", "2024-01-01", "2024-01-12", True), ("build", "2024-01-10", "2024-01-21", None), ("peak", "2024-01-20", "2024-01-25", False), ("taper", "2024-01-24", "2024-02-11", True)]


def phases(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.createDataFrame([(n, a, b, x) for n, a, b, x in PHASES_ROWS], "name string, a string, b string, x boolean")
    u = cardio(spark, sf).select("user_id").distinct()
    return u.join(F.broadcast(p)).select("user_id", F.col("name").alias("id"), F.col("name").alias("phase_type"), "name", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"), F.col("x").alias("is_active"))


PHASES = "phases AS (SELECT user_id, name, CAST(a AS DATE) AS start_date, CAST(b AS DATE) AS end_date, x AS is_active FROM (SELECT DISTINCT user_id FROM cardio), (VALUES ('base', '2024-01-01', '2024-01-12', TRUE), ('build', '2024-01-10', '2024-01-21', NULL), ('peak', '2024-01-20', '2024-01-25', FALSE), ('taper', '2024-01-24', '2024-02-11', TRUE)) t(name, a, b, x))"


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as rides of one value a second."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("ride_id"), F.posexplode("embedding").alias("i", "v")).select("ride_id", "i", (F.abs(F.col("v").cast("double")) * 1000).alias("watts"))


SERIES = "series AS (SELECT vec_id AS ride_id, unnest(range(len(embedding))) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) * 1000 AS watts FROM embeddings)"
