"""Strength training: weeks, sessions, exercises, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .spine import spine

LB_PER_TON = 2000.0


def _volume() -> Column:
    return F.coalesce(F.col("reps") * F.col("weight_lbs"), F.lit(0.0))


def _name() -> Column:
    n = F.trim(F.coalesce(F.col("exercise_name"), F.lit("")))
    return F.when(n == "", "Unknown").otherwise(n)


def _change(now, before) -> Column:
    return F.when(F.col(before) > 0, (F.col(now) - F.col(before)) / F.col(before) * 100)


def week_volume(sets: DataFrame) -> DataFrame:
    """AGG-04, AGG-17: user_id, week_start, session days (any set), hard sets, pounds and short tons of each week with sets."""
    hard = S.is_hard_set("set_type")
    v = F.coalesce(F.sum(F.when(hard, _volume())), F.lit(0.0))
    return sets.groupBy("user_id", S.week_start("event_date").alias("week_start")).agg(F.count_distinct("event_date").alias("sessions"), F.count_if(hard).alias("hard_sets"), v.alias("volume_lbs"), (v / LB_PER_TON).alias("short_tons"))


def weekly_rollups(sets: DataFrame, as_of=None, weeks: int | None = None) -> DataFrame:
    """WIN-01: every week of each user from the first (or of the last `weeks` before as_of), volume and change to the week before in percent; the first week's change is null."""
    w = week_volume(sets)
    if as_of is None:
        dense = spine(w, ["user_id"], "week_start", "week", out="week_start")
    else:
        end = S.week_start(F.lit(as_of).cast("date"))
        dense = w.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("interval 1 week"))).alias("week_start"))
    d = dense.join(w.select("user_id", "week_start", "volume_lbs"), ["user_id", "week_start"], "left").fillna(0.0, ["volume_lbs"])
    d = d.withColumn("prev", F.lag("volume_lbs").over(Window.partitionBy("user_id").orderBy("week_start")))
    return d.select("user_id", "week_start", "volume_lbs", (F.col("volume_lbs") / LB_PER_TON).alias("volume_short_tons"), _change("volume_lbs", "prev").alias("change_pct"))


def session_days(sets: DataFrame) -> DataFrame:
    """AGG-18: of each day with hard sets the volume, dominant focus (55 % of it, else full or other), number of exercises."""
    d = sets.where(S.is_hard_set("set_type")).withColumns({"v": _volume(), "f": S.session_focus(_name()), "x": _name()})
    part = lambda k: F.coalesce(F.sum(F.when(F.col("f") == k, F.col("v"))), F.lit(0.0)).alias(k)
    g = d.groupBy("user_id", "event_date").agg(F.sum("v").alias("volume_lbs"), *[part(k) for k in ("upper", "lower", "mixed", "other")], F.count_distinct("x").alias("exercise_count"))
    return g.withColumn("session_focus", dominant_focus()).select("user_id", "event_date", "volume_lbs", "session_focus", "exercise_count")


def dominant_focus() -> Column:
    """upper or lower with at least 55 % of the volume, full where both (or mixed) matter, other, unknown without volume."""
    total = F.col("upper") + F.col("lower") + F.col("mixed") + F.col("other")
    return S.first_match([(total <= 0, "unknown"), (F.col("upper") / total >= 0.55, "upper"), (F.col("lower") / total >= 0.55, "lower"), (F.col("upper") + F.col("lower") + F.col("mixed") > 0, "full")], "other")


def weekly_focus(sets: DataFrame) -> DataFrame:
    """AGG-19: weeks' volume by their days' dominant focus; unknown counts as other; change of upper in percent."""
    s = session_days(sets).withColumn("week_start", S.week_start("event_date"))
    part = lambda *k: F.coalesce(F.sum(F.when(F.col("session_focus").isin(*k), F.col("volume_lbs"))), F.lit(0.0))
    g = s.groupBy("user_id", "week_start").agg(part("upper").alias("upper_volume_lbs"), part("lower").alias("lower_volume_lbs"), part("full").alias("full_volume_lbs"), part("other", "unknown").alias("other_volume_lbs"))
    d = spine(g, ["user_id"], "week_start", "week", out="week_start").join(g, ["user_id", "week_start"], "left").fillna(0.0)
    d = d.withColumn("prev", F.lag("upper_volume_lbs").over(Window.partitionBy("user_id").orderBy("week_start")))
    return d.withColumn("upper_change_pct", _change("upper_volume_lbs", "prev")).drop("prev")


def exercise_sessions(sets: DataFrame) -> DataFrame:
    """AGG-20: of each exercise and day the top weight (at least 0), volume, hard sets."""
    d = sets.where(S.is_hard_set("set_type"))
    return d.groupBy("user_id", _name().alias("exercise_name"), "event_date").agg(F.greatest(F.lit(0.0), F.coalesce(F.max("weight_lbs"), F.lit(0.0))).alias("top_weight_lbs"), F.sum(_volume()).alias("volume_lbs"), F.count("*").alias("hard_sets"))


def top_exercises(sets: DataFrame, limit: int = 12) -> DataFrame:
    """WIN-12, SRT-03: each user's most frequent exercises with the last session's change to the one before."""
    s = exercise_sessions(sets)
    w = Window.partitionBy("user_id", "exercise_name").orderBy("event_date")
    s = s.withColumns({"pw": F.lag("top_weight_lbs").over(w), "pv": F.lag("volume_lbs").over(w)})
    last = F.max_by(F.struct("event_date", "top_weight_lbs", "volume_lbs", "pw", "pv"), "event_date")
    g = s.groupBy("user_id", "exercise_name").agg(F.count("*").alias("session_count"), last.alias("l"))
    g = g.select("user_id", "exercise_name", "session_count", F.col("l.event_date").alias("latest_date"), F.col("l.top_weight_lbs").alias("latest_top_weight_lbs"), F.col("l.volume_lbs").alias("latest_volume_lbs"), (F.col("l.top_weight_lbs") - F.col("l.pw")).alias("weight_delta_vs_prior"), F.when(F.col("l.pv") > 0, (F.col("l.volume_lbs") - F.col("l.pv")) / F.col("l.pv") * 100).alias("volume_change_pct_vs_prior"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("session_count"), F.lower("exercise_name"), "exercise_name"))
    return g.withColumn("rank", rank).where(F.col("rank") <= limit)


def progress_flags(weekly: DataFrame, rapid: float = 12.0, weeks: int = 3, band: float = 5.0) -> DataFrame:
    """WIN-13: user_id, code of a jump in the last week, and of a plateau over the last weeks with volume."""
    w = Window.partitionBy("user_id").orderBy(F.desc("week_start"))
    last = weekly.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (F.col("change_pct") >= rapid)).select("user_id", F.lit("STRENGTH_VOLUME_SPIKE").alias("code"))
    some = weekly.where("volume_lbs > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= weeks)
    g = some.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("volume_lbs").alias("m"), F.min("volume_lbs").alias("lo"), F.max("volume_lbs").alias("hi"))
    flat = g.where((F.col("n") >= weeks) & (F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")) / F.col("m") * 100 <= band)).select("user_id", F.lit("STRENGTH_VOLUME_PLATEAU").alias("code"))
    return last.union(flat)


def progress_summary(sets: DataFrame, as_of, weeks: int = 8) -> DataFrame:
    """SCO-16: one row a user: the last weeks, focus weeks, exercises, flags, this and last week's volume."""
    weekly = weekly_rollups(sets, as_of, weeks)
    lists = lambda df, name, order: df.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in ("user_id", order)]))).alias(name))
    end = S.week_start(F.lit(as_of).cast("date"))
    focus = weekly_focus(sets).where((F.col("week_start") <= end) & (F.col("week_start") > F.date_sub(end, 7 * weeks)))
    out = lists(weekly, "weekly_rollups", "week_start").join(lists(focus, "focus_weekly", "week_start"), "user_id", "left").join(lists(top_exercises(sets), "top_exercises", "rank"), "user_id", "left")
    out = out.join(progress_flags(weekly).groupBy("user_id").agg(F.sort_array(F.collect_list("code")).alias("progress_flags")), "user_id", "left")
    at = lambda i: F.element_at("weekly_rollups", i)
    return out.withColumns({"this_week_volume_lbs": at(-1)["volume_lbs"], "last_week_volume_lbs": F.try_element_at("weekly_rollups", F.lit(-2))["volume_lbs"], "week_over_week_change_pct": at(-1)["change_pct"]})
