"""Sleep scores with each user's own baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def trailing_baseline(metric: str, days: int = 28, least: int = 2, date_col: str = "metric_date") -> Column:
    """AGG-28: the mean of the `days` days before, with at least `least` values."""
    w = Window.partitionBy("user_id").orderBy(F.datediff(date_col, F.lit("1970-01-01"))).rangeBetween(-days, -1)
    v = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))
    return F.when(F.count(v).over(w) >= least, F.avg(v).over(w))


def fill_scores(metrics: DataFrame, need: float = 8.0) -> DataFrame:
    """WIN-14: metrics with sleep_score where it was null, from that row and the days before it."""
    d = metrics.withColumns({"_hb": trailing_baseline("hrv_rmssd"), "_rb": trailing_baseline("resting_hr")})
    score = scores.sleep_score(need=need, hrv_baseline="_hb", resting_hr_baseline="_rb")
    return d.withColumn("sleep_score", F.coalesce("sleep_score", score)).drop("_hb", "_rb")


def trailing_rows(value: str, n: int = 7, date_col: str = "metric_date") -> Column:
    """WIN-04, WIN-05: the mean of the values in the last n rows (not days)."""
    return F.avg(value).over(Window.partitionBy("user_id").orderBy(date_col).rowsBetween(-(n - 1), 0))


def latest_and_delta(df: DataFrame, value: str, date_col: str = "metric_date", back: int = 7) -> DataFrame:
    """AGG-29: of each user the latest value and its difference to the one `back` values (or as many as there are) before."""
    g = df.where(F.col(value).isNotNull()).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(date_col, F.col(value).alias("v")))).alias("s"))
    last = F.element_at("s", -1)["v"]
    return g.select("user_id", last.alias("latest"), F.when(F.size("s") > 1, last - F.element_at("s", -F.least(F.lit(back + 1), F.size("s")))["v"]).alias("delta"))


def stage_hours(metrics: DataFrame) -> DataFrame:
    """ARR-10: deep, REM and the remaining light sleep as rows; parts of 0.01 hours or less go."""
    light = F.greatest(F.col("sleep_hours") - F.coalesce("sleep_deep_hrs", F.lit(0.0)) - F.coalesce("sleep_rem_hrs", F.lit(0.0)), F.lit(0.0))
    w = metrics.select("user_id", "metric_date", F.col("sleep_deep_hrs").alias("deep"), F.col("sleep_rem_hrs").alias("rem"), light.alias("light"))
    return w.unpivot(["user_id", "metric_date"], ["deep", "rem", "light"], "stage", "hours").where("hours > 0.01")


def domain_bounds(long: DataFrame, pad: float = 0.05, ratio: bool = False) -> DataFrame:
    """AGG-31: a chart's bounds around all series' values; of the load ratio at least 0 to 1.8."""
    g = long.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    if ratio:
        return g.select("user_id", F.greatest(F.lit(0.0), F.col("lo") - 0.2).alias("low"), F.greatest(F.lit(1.8), F.col("hi") + 0.2).alias("high"))
    p = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * pad).otherwise(1.0)
    return g.select("user_id", (F.col("lo") - p).alias("low"), (F.col("hi") + p).alias("high"))
