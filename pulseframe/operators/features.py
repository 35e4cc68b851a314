"""Daily features of all users: windows of 7, 14 and 28 days over one row a user and day.

Each event table is first summed to days (partial aggregation before its shuffle); all windows then share one
partitioning by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import scores
from . import cardio_dedup
from .spine import spine

LB_PER_TON = 2000.0
MIN_PER_TON = 90.0
MIN_PER_SET = 3.0


def _days(n: int, until: int = 0):
    """A frame of the last n days by day number."""
    return Window.partitionBy("user_id").orderBy("n").rangeBetween(-(n - 1) + until, until)


def strength_days(sets: DataFrame) -> DataFrame:
    """user_id, event_date, any_sets, hard_sets, volume_lb, strength_au (AGG-03, AGG-07 by day)."""
    hard = S.is_hard_set("set_type")
    d = sets.groupBy("user_id", "event_date").agg(
        F.count("*").alias("any_sets"), F.count_if(hard).alias("hard_sets"), F.coalesce(F.sum(F.when(hard, F.col("reps") * F.col("weight_lbs"))), F.lit(0.0)).alias("volume_lb"),
        F.avg(F.when(hard, F.col("rpe"))).alias("rpe"),
    )
    return d.withColumn("strength_au", F.col("rpe") * F.col("hard_sets") * MIN_PER_SET).drop("rpe")


def cardio_days(cardio: DataFrame, apply_dedup: bool = True) -> DataFrame:
    """user_id, event_date, sessions, minutes (AGG-05 by day, after DED-03)."""
    d = cardio_dedup.training_load_sessions(cardio, apply_dedup)
    return d.groupBy("user_id", "event_date").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("duration_min"), F.lit(0.0)).alias("minutes"))


def cardio_quality_days(cardio: DataFrame, low: float = P.PACE_MIN, high: float = P.PACE_MAX) -> DataFrame:
    """user_id, event_date, suspect, cardio_au (AGG-06, AGG-08 by day, on all rows)."""
    au = F.when(~P.strength_like("activity_type") & (F.col("duration_min") > 0), F.col("session_rpe") * F.col("duration_min"))
    return cardio.groupBy("user_id", "event_date").agg(F.count_if(P.suspect_distance(P.pace_flags(low=low, high=high))).alias("suspect"), F.sum(au).alias("cardio_au"))


def acwr(acute: Column, chronic28: Column) -> Column:
    """The coupled ratio: 7 days over a quarter of 28."""
    return F.when(chronic28 > 0, acute / (chronic28 / 4))


def cardio_load(days: DataFrame) -> DataFrame:
    """AGG-05 over the history: user_id, event_date, sessions and minutes of 7, 14, 28 days, acwr."""
    d = days.withColumn("n", F.datediff("event_date", F.lit("1970-01-01")))
    m7, m28 = F.sum("minutes").over(_days(7)), F.sum("minutes").over(_days(28))
    return d.select("user_id", "event_date", F.count("*").over(_days(7)).alias("cardio_sessions_7d"), m7.alias("cardio_minutes_7d"), F.sum("minutes").over(_days(14)).alias("cardio_minutes_14d"), m28.alias("cardio_minutes_28d"), acwr(m7, m28).alias("acute_chronic_ratio"))


def daily_features(strength: DataFrame, cardio: DataFrame, metrics: DataFrame, dates: DataFrame | None = None, target_sleep: float = 8.0, suppressed_ratio: float = 0.85, most_acwr: float = 1.5, apply_dedup: bool = True) -> DataFrame:
    """AGG-03 to AGG-10 and SCO-02: a row for each (user_id, feature_date) of `dates`, by default every day from the first to the last with data.

    Values aren't rounded. metrics has one row a user and metric_date.
    """
    k = ["user_id", "d"]
    named = lambda df, c: df.withColumnRenamed(c, "d")
    parts = [named(strength_days(strength), "event_date"), named(cardio_days(cardio, apply_dedup), "event_date"), named(cardio_quality_days(cardio), "event_date"), metrics.select("user_id", F.col("metric_date").alias("d"), F.col("sleep_hours").alias("sleep"), F.col("hrv_rmssd").alias("hrv"))]
    seen = parts[0].select(*k)
    for p in parts[1:]:
        seen = seen.union(p.select(*k))
    wanted = spine(seen, ["user_id"], "d") if dates is None else dates.select("user_id", F.col("feature_date").alias("d"))
    # one row a key in each part: stacked and grouped once, where five outer joins would each deal the days anew
    parts.append(wanted.withColumn("wanted", F.lit(True)))
    values = [c for p in parts for c in p.columns if c not in k]
    kinds = {c: t for p in parts for c, t in p.dtypes}
    stacked = None
    for p in parts:
        p = p.select(*k, *[F.col(c) if c in p.columns else F.lit(None).cast(kinds[c]).alias(c) for c in values])
        stacked = p if stacked is None else stacked.union(p)
    days = stacked.groupBy(*k).agg(*[F.max(c).alias(c) for c in values]).withColumn("n", F.datediff("d", F.lit("1970-01-01")))
    tot = lambda c, n: F.coalesce(F.sum(c).over(_days(n)), F.lit(0.0))
    cnt = lambda c, n: F.count(F.when(F.col(c) > 0, 1)).over(_days(n)).cast("int")
    whole = lambda c, n: F.coalesce(F.sum(c).over(_days(n)), F.lit(0)).cast("int")
    hrv = F.collect_list("hrv").over(_days(7))
    mean = F.aggregate(hrv, F.lit(0.0), lambda a, x: a + x) / F.size(hrv)
    m7, m28, t7, t28 = tot("minutes", 7), tot("minutes", 28), tot("volume_lb", 7) / LB_PER_TON, tot("volume_lb", 28) / LB_PER_TON
    both = lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    au = lambda c, n: F.sum(c).over(_days(n))
    ca = lambda n: F.when(au("cardio_au", n) > 0, au("cardio_au", n))
    sleep_days = F.count("sleep").over(_days(7)).cast("int")
    out = days.select(
        "wanted", "user_id", F.col("d").alias("feature_date"), cnt("any_sets", 7).alias("strength_sessions_7d"), whole("hard_sets", 7).alias("strength_hard_sets_7d"), t7.alias("strength_tonnage_7d"),
        t7.alias("training_load_strength_short_tons_7d"), t28.alias("training_load_strength_short_tons_28d"), whole("hard_sets", 28).alias("training_load_strength_hard_sets_28d"), cnt("any_sets", 28).alias("training_load_strength_sessions_28d"),
        cnt("sessions", 7).alias("cardio_sessions_7d"), m7.alias("cardio_minutes_7d"), tot("minutes", 14).alias("cardio_minutes_14d"), acwr(m7, m28).alias("acute_chronic_ratio"), m7.alias("training_load_cardio_minutes_7d"), m28.alias("training_load_cardio_minutes_28d"),
        whole("suspect", 7).alias("cardio_distance_suspect_7d"), (m7 + t7 * MIN_PER_TON).alias("effort_unified_index_7d"), (m28 + t28 * MIN_PER_TON).alias("effort_unified_index_28d"),
        ca(7).alias("effort_foster_cardio_au_7d"), au("strength_au", 7).alias("effort_foster_strength_au_7d"), both(ca(7), au("strength_au", 7)).alias("effort_foster_au_7d"),
        ca(28).alias("effort_foster_cardio_au_28d"), au("strength_au", 28).alias("effort_foster_strength_au_28d"), both(ca(28), au("strength_au", 28)).alias("effort_foster_au_28d"),
        sleep_days.alias("recovery_sleep_days_7d"), F.count("hrv").over(_days(7)).cast("int").alias("recovery_hrv_days_7d"), F.when(sleep_days > 0, F.sum(F.greatest(F.lit(0.0), target_sleep - F.col("sleep"))).over(_days(7))).alias("sleep_debt_7d"),
        F.size(F.filter(hrv, lambda x: x < mean * suppressed_ratio)).alias("hrv_suppressed_days"),
    ).where("wanted").drop("wanted")
    return out.withColumn("overall_readiness_score", scores.readiness(most=most_acwr))


def recovery(metrics: DataFrame, target_sleep: float = 8.0, suppressed_ratio: float = 0.85) -> DataFrame:
    """AGG-10 on every day with a metrics row: coverage, sleep debt, suppressed days of the last 7 days."""
    d = metrics.withColumn("n", F.datediff("metric_date", F.lit("1970-01-01")))
    hrv = F.collect_list("hrv_rmssd").over(_days(7))
    mean = F.aggregate(hrv, F.lit(0.0), lambda a, x: a + x) / F.size(hrv)
    sleep_days = F.count("sleep_hours").over(_days(7))
    return d.select("user_id", "metric_date", sleep_days.alias("recovery_sleep_days_7d"), F.count("hrv_rmssd").over(_days(7)).alias("recovery_hrv_days_7d"), F.when(sleep_days > 0, F.sum(F.greatest(F.lit(0.0), target_sleep - F.col("sleep_hours"))).over(_days(7))).alias("sleep_debt_7d"), F.size(F.filter(hrv, lambda x: x < mean * suppressed_ratio)).cast("long").alias("hrv_suppressed_days"))


def pivot_metrics(long: DataFrame, metrics: list[str], order: list[str], whole: tuple[str, ...] = ()) -> DataFrame:
    """AGG-02: one row a user and day; of several values of a metric the last by `order` counts; `whole` ones become integers."""
    value = F.max_by(F.when(~F.isnan("value"), F.col("value")), F.struct(*order))
    wide = long.where(F.col("metric").isin(metrics) & F.col("value").isNotNull()).groupBy("user_id", "event_date").pivot("metric", metrics).agg(value)
    return wide.select("user_id", F.col("event_date").alias("metric_date"), *[(F.bround(c).cast("int") if c in whole else F.col(c)).alias(c) for c in metrics])


def rollup_samples(samples: DataFrame) -> DataFrame:
    """AGG-01: samples of a day and metric as one value: sums of steps and active_cal, the largest of sleep (at least 0), else the mean; the first unit by time."""
    v = F.col("value")
    one = F.when(F.col("metric").isin("steps", "active_cal"), F.sum(v)).when(F.col("metric").startswith("sleep"), F.greatest(F.lit(0.0), F.max(v))).otherwise(F.avg(v))
    return samples.where("value is not null").groupBy("user_id", "source", "event_date", "metric").agg(F.sum("value").alias("_s"), one.alias("value"), F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("seq"))).alias("unit")).drop("_s")
