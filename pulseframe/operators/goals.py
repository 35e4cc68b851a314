"""Goal status, today's focus, weekly summaries and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import scores
from . import joins, pace, strength

STRENGTH_GOAL = "strength_sessions"
LEGACY_GOALS = ("running_easy", "running_tempo", "running_long", "running_interval")
ON_TRACK = "On track — no urgent sessions flagged for today."


def goal_status(goals: DataFrame, sets: DataFrame, exceptions: DataFrame, day) -> DataFrame:
    """SCO-10, FLT-09: of each user's strength goal in effect the days done this week, target, status and schedule note."""
    d = F.lit(day).cast("date")
    g = goals.where(P.in_effect("is_active", "effective_from", "effective_until", d) & ~F.col("goal_type").isin(*LEGACY_GOALS))
    g = joins.blocked_goals(g.where(F.col("goal_type") == STRENGTH_GOAL), exceptions, day)
    done = sets.where((F.col("event_date") >= S.week_start(d)) & (F.col("event_date") <= F.date_add(S.week_start(d), 6))).groupBy("user_id").agg(F.count_distinct("event_date").alias("completed"))
    g = g.join(done, "user_id", "left").fillna(0, ["completed"])
    status = F.when(F.col("schedule_note").isNotNull(), "skipped").otherwise(scores.goal_pace("completed", "target_min", d, S.week_start(d)))
    return g.select("user_id", "goal_type", "completed", S.target_label("target_label", "target_min", "target_max").alias("target"), status.alias("status"), "schedule_note")


def todays_focus(status: DataFrame, exceptions: DataFrame, interventions: DataFrame, day) -> DataFrame:
    """SCO-11: user_id, todays_focus: the goal's text, the first busy block of the day (80 characters), override hints."""
    d = F.lit(day).cast("date")
    want = F.when(F.col("status").isin("behind", "urgent", "not_yet"), F.concat(F.lit("Strength"), F.when(F.col("status") == "urgent", " needed").otherwise(" session"), F.lit(" — "), F.col("completed").cast("string"), F.lit(" of "), F.col("target"), F.lit(" done")))
    a = status.select("user_id", want.alias("goal"))
    busy = interventions.where((F.col("event_date") == d) & (F.col("category") == "calendar")).groupBy("user_id").agg(F.concat(F.lit("Busy: "), F.left(F.min("description"), F.lit(80))).alias("busy"))
    hints = exceptions.where(P.covers("start_date", "end_date", d) & F.col("override_hint").isNotNull()).groupBy("user_id").agg(F.array_sort(F.collect_set("override_hint")).alias("hints"), F.lit(True).alias("any_x"))
    users = a.select("user_id").union(busy.select("user_id")).union(hints.select("user_id")).distinct()
    j = users.join(a, "user_id", "left").join(busy, "user_id", "left").join(hints, "user_id", "left")
    parts = F.concat(F.array_compact(F.array("goal", F.when(F.col("goal").isNotNull() | F.col("any_x"), F.col("busy")))), F.coalesce("hints", F.array().cast("array<string>")))
    return j.select("user_id", F.when(F.size(parts) > 0, F.concat_ws(" · ", parts)).otherwise(ON_TRACK).alias("todays_focus"))


def weekly_summary(sets: DataFrame, sessions: DataFrame, cardio: DataFrame) -> DataFrame:
    """AGG-24: user_id, week_start, strength_sessions, running_km, cardio_minutes, summary_json of every week with data."""
    k = ["user_id", "week_start"]
    s = strength.week_volume(sets).withColumnsRenamed({"sessions": "strength_sessions"})
    change = strength.weekly_rollups(sets).select(*k, "change_pct")
    focus = strength.weekly_focus(sets).select(*k, "upper_volume_lbs", "lower_volume_lbs")
    c = pace.cardio_week_load(cardio).select(*k, F.col("minutes").alias("cardio_minutes"))
    r = pace.running_weeks(sessions, cardio)
    j = s.join(c, k, "full").join(r, k, "full").join(change, k, "left").join(focus, k, "left")
    doc = F.to_json(F.struct(F.col("short_tons").alias("strength_short_tons"), F.col("hard_sets").alias("strength_hard_sets"), F.col("volume_lbs").alias("strength_volume_lbs"), F.col("change_pct").alias("strength_volume_wow_change_pct"), "upper_volume_lbs", "lower_volume_lbs"))
    return j.fillna(0, ["strength_sessions", "cardio_minutes", "running_km"]).select(*k, "strength_sessions", "running_km", "cardio_minutes", doc.alias("summary_json"))


def goal_snapshot(goals: DataFrame, sets: DataFrame, sessions: DataFrame, cardio: DataFrame, exceptions: DataFrame, interventions: DataFrame, day) -> DataFrame:
    """SCO-12: a row a user: goals_status, mileage_check and todays_focus of the day."""
    status = goal_status(goals, sets, exceptions, day)
    focus = todays_focus(status, exceptions, interventions, day)
    week = S.week_start(F.lit(day).cast("date"))
    miles = pace.mileage_ramp(pace.running_weeks(sessions, cardio)).where(F.col("week_start") == week)
    a = status.select("user_id", F.to_json(F.struct("completed", "target", "status", "schedule_note")).alias("goals_status"))
    b = miles.select("user_id", F.to_json(F.struct("this_week_km", "last_week_km", "change_pct", "flag")).alias("mileage_check"))
    j = a.join(b, "user_id", "full").join(focus, "user_id", "left")
    return j.select("user_id", F.lit(day).cast("date").alias("snapshot_date"), "goals_status", "mileage_check", F.coalesce("todays_focus", F.lit(ON_TRACK)).alias("todays_focus"))


def glance(sets: DataFrame, sessions: DataFrame, cardio: DataFrame) -> DataFrame:
    """AGG-23: of each week lifting, run days, minutes by mode."""
    from . import calendar

    k = ["user_id", "week_start"]
    s = strength.week_volume(sets).select(*k, F.col("sessions").alias("lifting_days"), "hard_sets", "volume_lbs")
    return s.join(calendar.run_days(sessions, cardio), k, "full").join(pace.cardio_week_load(cardio).select(*k, "minutes", "running_miles", "cycling_miles"), k, "full").fillna(0)
