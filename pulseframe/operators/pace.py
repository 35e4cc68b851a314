"""Cardio totals, running mileage and training pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import scores
from . import cardio_dedup
from .spine import spine


def breakdown(cardio: DataFrame, as_of, days: int = 7) -> DataFrame:
    """AGG-11: sessions and minutes by date, source, app and type."""
    d = cardio.where(P.trailing("event_date", F.lit(as_of).cast("date"), days))
    return d.groupBy("user_id", "event_date", "source", F.coalesce("source_app", F.lit("(unknown)")).alias("source_app"), "activity_type").agg(F.count("*").alias("sessions"), F.sum("duration_min").alias("minutes"))


def _miles() -> Column:
    """Miles without those of runs that are too fast to be true."""
    return F.when(~P.over_recorded(), F.coalesce(F.col("distance_miles"), F.lit(0.0))).otherwise(0.0)


def totals_by_mode(cardio: DataFrame) -> DataFrame:
    """AGG-12: sessions, minutes and miles of each user's running, cycling and other; all three always."""
    modes = F.explode(F.array(*[F.lit(m) for m in ("running", "cycling", "other")]))
    every = cardio.select("user_id").distinct().select("user_id", modes.alias("mode"))
    g = cardio.groupBy("user_id", S.cardio_mode("activity_type").alias("mode")).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("duration_min"), F.lit(0.0)).alias("minutes"), F.sum(_miles()).alias("miles"))
    return every.join(g, ["user_id", "mode"], "left").fillna(0)


def running_weeks(sessions: DataFrame, cardio: DataFrame) -> DataFrame:
    """AGG-13: user_id, week_start, km of running sessions and of cardio rows that are runs."""
    a = sessions.select("user_id", F.col("session_date").alias("d"), F.coalesce("distance_km", F.lit(0.0)).alias("km"))
    b = cardio.where((S.cardio_mode("activity_type") == "running") & ~P.over_recorded()).select("user_id", F.col("event_date").alias("d"), F.coalesce(S.miles_to_km("distance_miles"), F.lit(0.0)).alias("km"))
    return a.union(b).groupBy("user_id", S.week_start("d").alias("week_start")).agg(F.sum("km").alias("running_km"))


def mileage_ramp(weeks: DataFrame, limit: float = 15.0) -> DataFrame:
    """AGG-14: every week beside the one before, change in percent, flag `mileage_spike` over the limit."""
    d = spine(weeks, ["user_id"], "week_start", "week", out="week_start").join(weeks, ["user_id", "week_start"], "left").fillna(0.0, ["running_km"])
    d = d.withColumn("last_week_km", F.coalesce(F.lag("running_km").over(Window.partitionBy("user_id").orderBy("week_start")), F.lit(0.0)))
    d = d.withColumn("change_pct", F.when(F.col("last_week_km") > 0, (F.col("running_km") - F.col("last_week_km")) / F.col("last_week_km") * 100))
    return d.select("user_id", "week_start", F.col("running_km").alias("this_week_km"), "last_week_km", "change_pct", F.when(F.col("change_pct") > limit, "mileage_spike").alias("flag"))


def cardio_week_load(cardio: DataFrame) -> DataFrame:
    """AGG-16, AGG-15: of each week minutes, miles of runs and rides, and days with a duration."""
    mode = S.cardio_mode("activity_type")
    return cardio.groupBy("user_id", S.week_start("event_date").alias("week_start")).agg(
        F.coalesce(F.sum("duration_min"), F.lit(0.0)).alias("minutes"), F.coalesce(F.sum(F.when(mode == "running", _miles())), F.lit(0.0)).alias("running_miles"), F.coalesce(F.sum(F.when(mode == "cycling", _miles())), F.lit(0.0)).alias("cycling_miles"),
        F.count_distinct(F.when(F.col("duration_min") > 0, F.col("event_date"))).alias("sessions"),
    )


def weekly_enrich(weeks: DataFrame, load: str) -> DataFrame:
    """WIN-02: of every week the change to the one before, the mean of the four before (from the fifth on, null if all are 0), the ratio and difference to it."""
    d = spine(weeks, ["user_id"], "week_start", "week", out="week_start").join(weeks.select("user_id", "week_start", F.col(load).alias("load")), ["user_id", "week_start"], "left").fillna(0.0, ["load"])
    w = Window.partitionBy("user_id").orderBy("week_start")
    four = w.rowsBetween(-4, -1)
    prev = F.lag("load").over(w)
    mean = F.when((F.count("load").over(four) == 4) & (F.max("load").over(four) > 0), F.avg("load").over(four))
    d = d.withColumns({"prev": prev, "four_week_avg_load": mean})
    over = F.when(F.col("four_week_avg_load") > 0, F.col("load") / F.col("four_week_avg_load"))
    return d.select("user_id", "week_start", "load", F.when(F.col("prev") > 0, (F.col("load") - F.col("prev")) / F.col("prev") * 100).alias("wow_change_pct"), "four_week_avg_load", over.alias("acwr"), ((over - 1) * 100).alias("vs_monthly_avg_pct"))


def rolling_pace(days: DataFrame, load: str, date_col: str = "event_date") -> DataFrame:
    """WIN-03: on each day with a row, the last 7 days' load against the four 7-day windows before.

    Without load in the window before, any load counts as a change of 100 %; the four windows' mean is null if all are 0.
    """
    d = days.withColumn("n", F.datediff(date_col, F.lit("1970-01-01")))
    w = lambda k: Window.partitionBy("user_id").orderBy("n").rangeBetween(-6 - 7 * k, -7 * k)
    d = d.withColumns({f"w{k}": F.coalesce(F.sum(load).over(w(k)), F.lit(0.0)) for k in range(5)})
    mean = F.when(F.greatest("w1", "w2", "w3", "w4") > 0, (F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")) / 4)
    d = d.withColumn("four_week_avg_load", mean)
    wow = F.when(F.col("w1") > 0, (F.col("w0") - F.col("w1")) / F.col("w1") * 100).when(F.col("w0") > 0, 100.0)
    ratio = F.col("w0") / F.col("four_week_avg_load")
    return d.select("user_id", date_col, F.col("w0").alias("acute_load"), F.col("w1").alias("prior_7d_load"), "four_week_avg_load", wow.alias("wow_change_pct"), ratio.alias("acwr"), ((ratio - 1) * 100).alias("vs_monthly_avg_pct"))


def pace_lights(days: DataFrame, load: str, domain: str, date_col: str = "event_date") -> DataFrame:
    """SCO-05, SCO-06: rolling pace with status, direction and label."""
    p = rolling_pace(days, load, date_col)
    return p.withColumn("s", scores.pace_status("acwr", "wow_change_pct", "vs_monthly_avg_pct", domain)).select("*", "s.*").drop("s")


def pace_summary(sets: DataFrame, cardio: DataFrame, as_of, apply_dedup: bool = True) -> DataFrame:
    """SCO-06: of each user on one day the lifting (pounds) and cardio (minutes) blocks and a one-line message."""
    from .features import cardio_days, strength_days

    day = F.lit(as_of).cast("date")

    def block(days, load, domain, name):
        base = days.select("user_id", "event_date", F.col(load).alias("load"))
        here = base.select("user_id").distinct().select("user_id", day.alias("event_date"), F.lit(0.0).alias("load"))
        p = pace_lights(base.union(here).groupBy("user_id", "event_date").agg(F.sum("load").alias("load")), "load", domain).where(F.col("event_date") == day)
        return p.select("user_id", F.struct(*[c for c in p.columns if c not in ("user_id", "event_date")]).alias(name))

    lift = block(strength_days(sets), "volume_lb", "strength", "lifting")
    run = block(cardio_days(cardio, apply_dedup), "minutes", "cardio", "cardio")
    weeks = cardio_week_load(cardio_dedup.training_load_sessions(cardio, apply_dedup))
    series = lambda c: weeks.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("week_start", F.col(c).alias("miles")))).alias(c))
    out = lift.join(run, "user_id", "full").join(series("running_miles"), "user_id", "left").join(series("cycling_miles"), "user_id", "left")
    return out.withColumn("message", pace_message(F.col("lifting.label"), F.col("cardio.label")))


def pace_message(lifting, cardio) -> Column:
    return F.concat_ws(" · ", F.array_compact(F.array(F.concat(F.lit("Lifting: "), lifting), F.concat(F.lit("Cardio: "), cardio))))
