"""Workout calendar: days, streaks, month grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S


def day_map(sets: DataFrame, cardio: DataFrame) -> DataFrame:
    """AGG-21: user_id, d, lifting, cardio, fitbit, kind, activity_types, sources (both sorted).

    Strength-like cardio goes where there are sets that day, else it marks a lifting day.
    """
    a = sets.select("user_id", F.col("event_date").alias("d"), F.lit(True).alias("sets"), F.lit(True).alias("lifting"), F.lit(False).alias("cardio"), F.lit(False).alias("fitbit"), F.lit(None).cast("string").alias("label"), F.array(F.lit("hevy")).alias("src")).distinct()
    like, bridge = P.strength_like("activity_type"), S.is_bridge("source_app")
    label = F.trim("activity_type")
    src = F.when(bridge, F.array(F.lit("fitbit"))).otherwise(F.array_compact(F.array(F.when(F.trim("source") != "", F.lower(F.trim("source"))), F.when(F.trim("source_app") != "", F.trim("source_app")))))
    b = cardio.select("user_id", F.col("event_date").alias("d"), F.lit(False).alias("sets"), like.alias("lifting"), (~like).alias("cardio"), bridge.alias("fitbit"), F.when(label != "", label).alias("label"), src.alias("src"))
    lifted = F.max("sets").over(Window.partitionBy("user_id", "d"))
    rows = a.union(b).where("d is not null").withColumn("l", lifted).where(F.col("sets") | ~F.col("l") | F.col("cardio"))
    g = rows.groupBy("user_id", "d").agg(F.bool_or("lifting").alias("lifting"), F.bool_or("cardio").alias("cardio"), F.bool_or("fitbit").alias("fitbit"), F.array_sort(F.collect_set("label")).alias("activity_types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("src")))).alias("sources"))
    return g.withColumn("kind", F.when(F.col("lifting") & F.col("cardio"), "both").when(F.col("lifting"), "lifting").otherwise("cardio"))


def streaks(days: DataFrame, as_of, step: int = 1, date_col: str = "d") -> DataFrame:
    """WIN-11: of each user the current streak (one step's grace), the longest, the number, over dates up to as_of.

    step is 1 for days, 7 for weeks (dates are then weeks' Mondays). Streaks are islands of date minus position.
    """
    day = F.lit(as_of).cast("date")
    end = day if step == 1 else S.week_start(day)
    d = days.where(F.col(date_col) <= day).select("user_id", (F.col(date_col) if step == 1 else S.week_start(date_col)).alias("d")).distinct()
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("d"))
    isles = d.withColumn("isle", F.date_sub("d", at * step)).groupBy("user_id", "isle").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    now = F.max(F.when(F.col("last") >= F.date_sub(end, step), F.col("n")))
    return isles.groupBy("user_id").agg(F.coalesce(now, F.lit(0)).alias("current_streak"), F.max("n").alias("longest_streak"), F.sum("n").alias("days_count"))


def week_streaks(days: DataFrame, as_of) -> DataFrame:
    """WIN-11: streaks of weeks with any workout, and the current ones of lifting and cardio."""
    any_ = streaks(days, as_of, 7).withColumnsRenamed({"current_streak": "current_week_streak", "longest_streak": "longest_week_streak", "days_count": "workout_weeks_count"})
    one = lambda c: streaks(days.where(c), as_of, 7).select("user_id", F.col("current_streak").alias(f"{c}_week_streak"))
    return any_.join(one("lifting"), "user_id", "left").join(one("cardio"), "user_id", "left").fillna(0)


def month_grid(days: DataFrame, month) -> DataFrame:
    """JOIN-14, SCO-18: every date of the Monday-to-Sunday weeks that touch the month, with that day's flags."""
    first = F.trunc(F.lit(month).cast("date"), "MM")
    start = S.week_start(first)
    end = F.date_add(S.week_start(F.last_day(first)), 6)
    grid = days.select("user_id").distinct().select("user_id", F.explode(F.sequence(start, end)).alias("d"))
    g = grid.join(days.select("user_id", "d", "lifting", "cardio", "fitbit", "kind"), ["user_id", "d"], "left").fillna(False, ["lifting", "cardio", "fitbit"])
    inside = F.trunc("d", "MM") == first
    return g.withColumns({"in_month": inside, "week_start": S.week_start("d"), "status": S.calendar_status(inside, "lifting", "cardio", "fitbit")})


def workout_calendar(sets: DataFrame, cardio: DataFrame, as_of) -> DataFrame:
    """SCO-18: one row a user: streaks of days and weeks, the grids of this and the last month, the ordered days."""
    days = day_map(sets, cardio).where(F.col("d") <= F.lit(as_of).cast("date"))
    grid = lambda m, n: month_grid(days, m).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "status", "in_month"))).alias(n))
    from datetime import date, timedelta

    now = as_of if isinstance(as_of, date) else date.fromisoformat(str(as_of))
    before = now.replace(day=1) - timedelta(days=1)
    out = streaks(days, as_of).join(week_streaks(days, as_of), "user_id").join(grid(now.isoformat(), "this_month"), "user_id").join(grid(before.isoformat(), "last_month"), "user_id")
    return out.join(days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "kind", "activity_types"))).alias("days")), "user_id")


def run_days(sessions: DataFrame, cardio: DataFrame) -> DataFrame:
    """AGG-22: of each week the distinct days with a running session or a cardio run."""
    a = sessions.select("user_id", F.col("session_date").alias("d"))
    b = cardio.where(S.cardio_mode("activity_type") == "running").select("user_id", F.col("event_date").alias("d"))
    return a.union(b).groupBy("user_id", S.week_start("d").alias("week_start")).agg(F.count_distinct("d").alias("run_days"))
