"""Statistics over all history from monthly parts that add up, so that a day's signals don't read the days again.

A month of a user's metric is kept as moments (count, mean, squared deviations) and as exact counts of its values. The
months before the current one are merged, the current month's days are read; both give the same anomalies as
stats.z_scores and stats.iqr_outliers over every day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats

TOLD_APART = 1e-9  # scores nearer than this to the limit are settled
METRICS = tuple(dict.fromkeys(stats.Z_METRICS + stats.IQR_METRICS))


def moments(long: DataFrame) -> DataFrame:
    """user_id, metric, month, n, mean, m2 (the sum of squared deviations) of a long frame."""
    g = long.groupBy("user_id", "metric", F.trunc("d", "month").alias("month"))
    return g.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.coalesce(F.var_pop("value"), F.lit(0.0)) * F.count("value")).alias("m2"))


def counts(long: DataFrame) -> DataFrame:
    """user_id, metric, month, value, n."""
    return long.groupBy("user_id", "metric", F.trunc("d", "month").alias("month"), "value").agg(F.count("*").alias("n"))


def merged(parts: DataFrame) -> DataFrame:
    """user_id, metric, n, mean, m2 of several months' moments; deviations are taken from the merged mean, not from 0."""
    w = Window.partitionBy("user_id", "metric")
    p = parts.withColumns({"all_n": F.sum("n").over(w), "all_mean": F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)})
    return p.groupBy("user_id", "metric").agg(F.first("all_n").alias("n"), F.first("all_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all_mean"), F.lit(2.0))).alias("m2"))


def z_scores(before: DataFrame, month: DataFrame, least: int = stats.MIN_DAYS, limit: float = stats.Z_LIMIT) -> DataFrame:
    """WIN-07 for the days of one month: before has the merged moments of all earlier months, month its long rows."""
    w = Window.partitionBy("user_id", "metric").orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    d = month.withColumns({"k": F.count("value").over(w), "a": F.coalesce(F.avg("value").over(w), F.lit(0.0)), "v": F.coalesce(F.var_pop("value").over(w), F.lit(0.0))})
    d = d.join(before.select("user_id", "metric", F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("m2").alias("m20")), ["user_id", "metric"], "left").na.fill(0, ["n0", "mean0", "m20"])
    n = F.col("n0") + F.col("k")
    both = F.try_divide(F.pow(F.col("a") - F.col("mean0"), F.lit(2.0)) * F.col("n0") * F.col("k"), n)
    d = d.withColumns({"n": n, "mean": F.try_divide(F.col("n0") * F.col("mean0") + F.col("k") * F.col("a"), n), "sd": F.sqrt(F.try_divide(F.col("m20") + F.col("v") * F.col("k") + both, n - 1))})
    # moments of equal values that were merged differ by rounding alone
    d = d.where((F.col("n") >= least) & (F.col("sd") > F.abs("mean") * 1e-12)).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))
    return d.where(F.abs("z") > limit).select("user_id", F.col("d").alias("metric_date"), "metric", "value", F.col("n").alias("sample_n"), "z", F.when(F.col("z") > 0, "above_baseline").otherwise("below_baseline").alias("direction"))


def settled(found: DataFrame, days: DataFrame, limit: float = stats.Z_LIMIT) -> DataFrame:
    """z_scores() found with `limit - TOLD_APART`, those at the limit judged by all of their days before (long rows).

    A score of two deviations to the last bit falls on either side, by the order of its sums. There the deviations are
    summed from day to day, as over rows in a window. Only scores at the limit are joined with days.
    """
    key = ["user_id", "metric", "metric_date"]
    near = found.where(F.abs(F.abs("z") - limit) <= TOLD_APART).select(*key, F.col("value").alias("v"))
    h = near.join(days.where("value is not null").select("user_id", "metric", "d", F.col("value").cast("double").alias("x")), ["user_id", "metric"]).where("d < metric_date")
    h = h.groupBy(*key).agg(F.first("v").alias("v"), F.avg("x").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda r: r["x"]).alias("xs"))
    state = lambda n, mean, m2: F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    def step(a, x):
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return state(a["n"] + 1, mean, a["m2"] + (x - mean) * (x - a["mean"]))

    end = F.aggregate("xs", state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda a: F.sqrt(a["m2"] / (a["n"] - 1)))
    s = h.select(*key, ((F.col("v") - F.col("mean")) / end).alias("_z"))
    d = found.join(s, key, "left").withColumn("z", F.coalesce("_z", "z"))
    return d.where(F.abs("z") > limit).select(*found.columns)


def quartiles(found: DataFrame) -> DataFrame:
    """user_id, metric, n, q1, q3 (linear between neighbours) from counts of values."""
    each = found.groupBy("user_id", "metric", "value").agg(F.sum("n").alias("k"))
    w = Window.partitionBy("user_id", "metric")
    d = each.withColumns({"n": F.sum("k").over(w), "upto": F.sum("k").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))})

    def at(rank):
        """The value at this place (from 0) of the sorted values."""
        return F.min(F.when(F.col("upto") > rank, F.col("value")))

    def q(share):
        r = (F.col("n") - 1) * share
        low, high = at(F.floor(r)), at(F.ceil(r))
        return low + (high - low) * F.first(r - F.floor(r))

    return d.groupBy("user_id", "metric").agg(F.first("n").alias("n"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def iqr_outliers(before: DataFrame, month: DataFrame, as_of, least: int = stats.MIN_DAYS, fence: float = 1.5) -> DataFrame:
    """WIN-08: before has the counts of all months before as_of's, month the long rows of that month."""
    day = F.lit(as_of).cast("date")
    g = quartiles(before.select("user_id", "metric", "value", "n").unionByName(month.where(F.col("d") < day).select("user_id", "metric", "value", F.lit(1).cast("long").alias("n"))))
    g = g.where((F.col("n") >= least) & (F.col("q3") > F.col("q1")))
    iqr = F.col("q3") - F.col("q1")
    d = month.where(F.col("d") == day).join(g, ["user_id", "metric"])
    kind = F.when(F.col("value") > F.col("q3") + fence * iqr, "above_baseline").when(F.col("value") < F.col("q1") - fence * iqr, "below_baseline")
    return d.withColumn("direction", kind).where("direction is not null").select("user_id", F.col("d").alias("metric_date"), "metric", "value", "q1", "q3", "direction")
