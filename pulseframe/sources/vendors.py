"""Vendor JSON to rows, schema on read: explicit schemas, bad nodes are skipped, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features

_SET = "struct<index:int,type:string,weight_kg:double,reps:int,distance_meters:double,duration_seconds:int,rpe:double>"
STRENGTH_PAGE = f"page int, page_count int, workouts array<struct<id:string,title:string,start_time:string,end_time:string,exercises:array<struct<index:int,title:string,notes:string,superset_id:string,sets:array<{_SET}>>>>>"
CARDIO = "array<struct<id:string,name:string,distance:double,moving_time:double,total_elevation_gain:double,type:string,sport_type:string,start_date:string,start_date_local:string,average_heartrate:double,max_heartrate:double,calories:double,kilojoules:double,average_watts:double,max_watts:double,device_watts:boolean>>"
_SAMPLE = "struct<qty:double,value:double,date:string,units:string,totalSleep:double,asleep:double,deep:double,rem:double,Avg:double>"
METRICS = f"data struct<metrics:array<struct<name:string,units:string,data:array<{_SAMPLE}>>>>"
_Q = "struct<qty:double,units:string>"
_QS = "array<struct<qty:double,units:string,date:string,source:string>>"
WORKOUTS = f"data struct<workouts:array<struct<id:string,name:string,start:string,end:string,duration:double,distance:{_Q},elevationUp:{_Q},avgHeartRate:{_Q},maxHeartRate:{_Q},activeEnergyBurned:{_Q},activeEnergy:{_QS},heartRate:string>>>, workouts array<string>"
ENVELOPE = "event_date string, eventDate string, source string, metrics array<struct<metric:string,name:string,value:double,qty:double,unit:string,units:string>>"

#: Vendor metric names and the stored ones (fixed values).
METRIC_NAMES = {
    "active_energy": "active_cal", "active_energy_burned": "active_cal", "step_count": "steps", "resting_heart_rate": "resting_hr",
    "heart_rate_variability": "hrv_rmssd", "heart_rate_variability_sdnn": "hrv_rmssd", "heart_rate_variability_rmssd": "hrv_rmssd", "heartratevariability": "hrv_rmssd", "heartratevariabilitysdnn": "hrv_rmssd", "hrv": "hrv_rmssd", "hrv_sdnn": "hrv_rmssd", "hrv_rmssd": "hrv_rmssd", "sdnn": "hrv_rmssd",
    "oxygen_saturation": "spo2_pct", "respiratory_rate": "respiratory_rate", "vo2_max": "vo2_max", "body_mass": "body_weight_lbs", "weight_body_mass": "body_weight_lbs", "body_fat_percentage": "body_fat_pct", "lean_body_mass": "muscle_mass_lbs",
    "sleep_analysis": "sleep_hours", "sleepanalysis": "sleep_hours", "sleep_deep": "sleep_deep_hrs", "deep_sleep": "sleep_deep_hrs", "sleep_rem": "sleep_rem_hrs", "rem_sleep": "sleep_rem_hrs",
}


def canonical_metric(name) -> Column:
    """SRC-07: a stored metric's name, null for others."""
    n = F.regexp_replace(F.translate(F.lower(F.trim(S._c(name))), " -", "__"), "^hkquantitytypeidentifier", "")
    table = F.create_map(*[F.lit(x) for kv in METRIC_NAMES.items() for x in kv])
    return F.try_element_at(table, n)


def strength_sets(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """SRC-01: (user_id, raw JSON page) to rows of strength_events; workouts, exercises and sets that can't be read are skipped."""
    # explode_outer, as the filter that Spark infers for explode would parse the texts again
    p = pages.select("user_id", F.explode_outer(F.from_json(raw, STRENGTH_PAGE)["workouts"]).alias("w"))
    # an exercise carries what it needs of its workout, not the workout with all its exercises; the date is read once a workout
    p = p.select("user_id", F.col("w.id").alias("id"), S.as_date("w.start_time").alias("date"), F.col("w.exercises").alias("es")).where("id is not null and date is not null")
    p = p.select("user_id", "id", "date", F.explode_outer("es").alias("e")).where("e.title is not null").select("user_id", "id", "date", "e", F.posexplode_outer("e.sets").alias("i", "s"))
    index = F.coalesce("s.index", "i")
    return p.where("s is not null").select(
        "user_id", F.lit("hevy").alias("source"), F.concat_ws(":", "id", F.coalesce("e.index", F.lit(0)).cast("string"), index.cast("string")).alias("source_id"), F.col("date").alias("event_date"), F.col("e.title").alias("exercise_name"),
        F.lit(None).cast("string").alias("muscle_group"), F.lit(None).cast("string").alias("movement_type"), F.col("e.superset_id").alias("superset_id"), (index + 1).alias("set_number"), F.col("s.reps").alias("reps"),
        F.round(F.col("s.weight_kg") * S.LB_PER_KG, 4).alias("weight_lbs"), F.col("s.rpe").alias("rpe"), S.set_type("s.type").alias("set_type"), F.col("e.notes").alias("notes"),
    )


def cardio_sessions(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """SRC-04: (user_id, raw JSON array) to cardio rows; without id, date, type or moving time a row goes."""
    a = pages.select("user_id", F.explode(F.from_json(raw, CARDIO)).alias("a"))
    good = lambda c: F.when(F.col(c) >= 0, F.col(c))
    miles = F.round(good("a.distance") / S.M_PER_MILE, 4)
    kind = F.coalesce("a.sport_type", "a.type")
    date = F.coalesce(S.as_date("a.start_date_local"), S.as_date("a.start_date"))
    keep = F.col("a.id").isNotNull() & date.isNotNull() & (F.trim(kind) != "") & (F.col("a.moving_time") >= 0)
    hr = lambda c: F.bround(good(c)).cast("int")
    return a.where(keep).select(
        "user_id", F.lit("strava").alias("source"), F.concat(F.lit("strava:"), "a.id").alias("source_id"), date.alias("event_date"), kind.alias("activity_type"), F.round(F.col("a.moving_time") / 60, 4).alias("duration_min"), miles.alias("distance_miles"),
        F.round(good("a.total_elevation_gain") * S.FT_PER_M, 2).alias("elevation_ft"), hr("a.average_heartrate").alias("avg_hr"), hr("a.max_heartrate").alias("max_hr"), S.pace_seconds("a.moving_time", miles).alias("avg_pace_sec_mi"),
        F.coalesce(good("a.calories"), good("a.kilojoules") * S.KCAL_PER_KJ).alias("calories"), F.col("a.name").alias("notes"), S.instant("a.start_date").alias("started_at"), F.col("a.average_watts").alias("avg_watts"), F.col("a.max_watts").alias("max_watts"), F.col("a.device_watts").alias("device_watts"),
    )


def health_samples(raw: DataFrame, col: str = "raw") -> DataFrame:
    """SRC-06, SRC-08: export payloads to samples (user_id, source, event_date, metric, value, unit, seq)."""
    text = F.regexp_replace(col, r'"Qty"\s*:', '"qty":')  # both spellings occur
    m = raw.select("user_id", F.explode(F.from_json(text, METRICS)["data"]["metrics"]).alias("m")).select("user_id", canonical_metric("m.name").alias("metric"), F.col("m.units").alias("unit"), F.posexplode("m.data").alias("seq", "s"))
    qty = F.coalesce("s.qty", "s.value", "s.Avg")
    out = lambda name, v, u: F.struct(name.alias("metric"), v.cast("double").alias("value"), u.alias("unit"))
    mass = F.col("metric").isin("body_weight_lbs", "muscle_mass_lbs")
    unit = F.coalesce("unit", "s.units")
    rows = F.when(F.col("metric") == "sleep_hours", F.array(
        out(F.lit("sleep_hours"), F.coalesce(S.sleep_hours("s.totalSleep", "s.asleep"), S.sleep_hours(qty, qty)), F.lit("hours")), out(F.lit("sleep_deep_hrs"), S.stage_hours("s.deep", unit), F.lit("hours")), out(F.lit("sleep_rem_hrs"), S.stage_hours("s.rem", unit), F.lit("hours")),
    )).otherwise(F.array(out(F.col("metric"), F.when(mass, S.mass_to_lb(qty, unit)).otherwise(qty), F.when(mass, F.lit("lb")).otherwise(unit))))
    m = m.where("metric is not null").select("user_id", F.lit("apple_health").alias("source"), S.as_date("s.date").alias("event_date"), "seq", F.inline(rows))
    return m.where("value is not null and event_date is not null")


def health_metrics(raw: DataFrame, col: str = "raw") -> DataFrame:
    """SRC-06: rows of biometrics, a day and metric each."""
    return features.rollup_samples(health_samples(raw, col))


def daily_envelope(raw: DataFrame, col: str = "raw") -> DataFrame:
    """SRC-09: `{event_date, metrics: [...]}` to samples; other metrics than the stored ones go."""
    e = raw.select("user_id", F.from_json(col, ENVELOPE).alias("e"))
    e = e.select("user_id", F.coalesce("e.source", F.lit("apple_health")).alias("source"), S.as_date(F.coalesce("e.event_date", "e.eventDate")).alias("event_date"), F.posexplode("e.metrics").alias("seq", "m"))
    name = F.lower(F.coalesce("m.metric", "m.name"))
    from ..schemas import CANONICAL_METRICS

    metric = F.when(name.isin(CANONICAL_METRICS), name).otherwise(canonical_metric(name))
    return e.select("user_id", "source", "event_date", "seq", metric.alias("metric"), F.coalesce("m.value", "m.qty").alias("value"), F.coalesce("m.unit", "m.units").alias("unit")).where("metric is not null and value is not null and event_date is not null")


def health_payloads(raw: DataFrame, col: str = "raw") -> DataFrame:
    """SRC-10: any payload: a list of payloads, an export or an envelope."""
    items = raw.select("user_id", F.explode(F.coalesce(F.from_json(col, "array<string>"), F.array(col))).alias(col))
    return features.rollup_samples(health_samples(items, col).select("user_id", "source", "event_date", "metric", "value", "unit", "seq").unionByName(daily_envelope(items, col)))


def workouts(raw: DataFrame, col: str = "raw") -> DataFrame:
    """SRC-11, SRC-12: workouts with a duration, or start and end; without a positive one they go. Ids are made from the start where none is given."""
    w = raw.select("user_id", F.from_json(col, WORKOUTS).alias("p"))
    one = WORKOUTS[WORKOUTS.index("array<struct<id") : WORKOUTS.rindex(">, workouts")]
    top = F.transform("p.workouts", lambda x: F.from_json(x, one[len("array<") : -1].replace("struct<", "struct<", 1)))
    # explode_outer, as the filter that Spark infers for explode would parse the texts again; rows without a workout have no duration
    w = w.select("user_id", F.explode_outer(F.coalesce("p.data.workouts", top)).alias("w"))
    start, end = S.instant("w.start"), S.instant("w.end")
    seconds = F.coalesce("w.duration", F.unix_timestamp(end) - F.unix_timestamp(start))
    miles = F.round(S.quantity_to_miles("w.distance.qty", "w.distance.units"), 4)
    chains = F.array_distinct(F.concat(F.coalesce(F.transform("w.activeEnergy", lambda x: x["source"]), F.array().cast("array<string>")), F.coalesce(F.transform(F.from_json("w.heartRate", _QS), lambda x: x["source"]), F.array().cast("array<string>"))))
    energy = F.aggregate("w.activeEnergy", F.lit(0.0), lambda a, x: a + F.coalesce(S.kilocalories(x["qty"], x["units"]), F.lit(0.0)))
    avg_hr, max_hr = S.heart_rate("w.heartRate", "w.avgHeartRate.qty", "w.maxHeartRate.qty")
    made = S.stable_id("hae:", "w.start", "w.name", seconds.cast("string"))
    rows = w.select(
        "user_id", F.lit("apple_health").alias("source"), F.coalesce("w.id", made).alias("source_id"), S.as_date("w.start").alias("event_date"), F.left(F.coalesce("w.name", F.lit("Workout")), F.lit(200)).alias("activity_type"), (seconds / 60).alias("duration_min"), miles.alias("distance_miles"),
        S.quantity_to_feet("w.elevationUp.qty", "w.elevationUp.units").alias("elevation_ft"), avg_hr.alias("avg_hr"), max_hr.alias("max_hr"), S.pace_seconds(seconds, miles).alias("avg_pace_sec_mi"),
        F.coalesce(S.kilocalories("w.activeEnergyBurned.qty", "w.activeEnergyBurned.units"), energy).alias("calories"), S.best_app(F.array_compact(chains)).alias("source_app"), start.alias("started_at"),
    )
    return rows.where("duration_min > 0 and event_date is not null").withColumn("quality_flags", _flags())


def _flags() -> Column:
    from ..functions import predicates as P

    return P.pace_flags()


def calendar_blocks(events: DataFrame) -> DataFrame:
    """SRC-13: (user_id, title, start, end) to interventions; a blank title is Busy, a later end is named."""
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.trim("title")).otherwise("Busy")
    a, b = S.as_date("start"), S.as_date("end")
    text = F.when(b != a, F.concat(title, F.lit(" ("), a.cast("string"), F.lit(" – "), b.cast("string"), F.lit(")"))).otherwise(title)
    return events.where(a.isNotNull()).select("user_id", a.alias("event_date"), F.lit("calendar").alias("category"), F.left(text, F.lit(500)).alias("description"), F.lit(False).alias("is_ongoing"), F.when(b != a, b).alias("end_date"), F.lit("source=caldav").alias("notes"))


def named_calendars(calendars: DataFrame, wanted: list[str]) -> DataFrame:
    """SRC-14: calendars whose name is, or holds, one of the wanted names, in any case."""
    n = F.lower("name")
    ok = F.lit(not wanted)
    for w in wanted:
        ok = ok | n.contains(w.lower())
    return calendars.where(ok)
