"""Baselines, anomalies and correlations of daily metrics, for all users and days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASELINE_WINDOWS = (7, 28, 90)
BASELINE_METRICS = ("hrv_rmssd", "sleep_hours", "resting_hr", "steps", "active_cal", "body_weight_lbs")
Z_METRICS, IQR_METRICS, EWMA_METRICS = ("hrv_rmssd", "sleep_hours", "resting_hr"), ("steps", "active_cal"), ("sleep_hours", "hrv_rmssd")
MIN_DAYS, Z_LIMIT, Z_ALERT, ALPHA, DRIFT = 14, 2.0, 3.0, 0.3, 0.15
LAGS, MIN_R, TOP, LOOKBACK = (0, 1, 2), 0.45, 12, 60
WITHIN = (("sleep_hours", "hrv_rmssd"), ("sleep_hours", "resting_hr"), ("steps", "active_cal"))
CROSS = (("sleep_hours", "cardio_minutes_7d"), ("sleep_hours", "strength_tonnage_7d"), ("sleep_hours", "overall_readiness_score"), ("sleep_hours", "effort_unified_index_7d"), ("hrv_rmssd", "overall_readiness_score"))


def to_long(wide: DataFrame, metrics, date_col: str = "metric_date") -> DataFrame:
    """ARR-09: user_id, d, metric, value; nulls and values that aren't finite go."""
    some = wide.select("user_id", F.col(date_col).alias("d"), *[F.col(m).cast("double") for m in metrics])
    return some.unpivot(["user_id", "d"], list(metrics), "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def _n() -> Column:
    return F.datediff("d", F.lit("1970-01-01"))


def baselines(long: DataFrame, windows=BASELINE_WINDOWS, least: int = 2) -> DataFrame:
    """WIN-06: of every user, metric and day the mean and sample deviation of the days before, by window."""
    base = Window.partitionBy("user_id", "metric").orderBy(_n())
    cols = {}
    for w in windows:
        over = base.rangeBetween(-w, -1)
        cols |= {f"m{w}": F.avg("value").over(over), f"s{w}": F.stddev_samp("value").over(over), f"n{w}": F.count("value").over(over)}
    each = [F.struct(F.lit(w).alias("window_days"), F.col(f"m{w}").alias("mean_value"), F.col(f"s{w}").alias("stdev_value"), F.col(f"n{w}").alias("sample_n")) for w in windows]
    return long.withColumns(cols).select("user_id", F.col("d").alias("metric_date"), "metric", F.inline(F.array(*each))).where(F.col("sample_n") >= least)


def z_scores(long: DataFrame, least: int = MIN_DAYS, limit: float = Z_LIMIT) -> DataFrame:
    """WIN-07: days over `limit` deviations from the mean of all days before, of which there are at least `least`."""
    w = Window.partitionBy("user_id", "metric").orderBy(_n()).rangeBetween(Window.unboundedPreceding, -1)
    d = long.withColumns({"n": F.count("value").over(w), "mean": F.avg("value").over(w), "sd": F.stddev_samp("value").over(w)})
    d = d.where((F.col("n") >= least) & (F.col("sd") > 0)).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))
    return d.where(F.abs("z") > limit).select("user_id", F.col("d").alias("metric_date"), "metric", "value", F.col("n").alias("sample_n"), "z", F.when(F.col("z") > 0, "above_baseline").otherwise("below_baseline").alias("direction"))


def iqr_outliers(long: DataFrame, as_of, least: int = MIN_DAYS, fence: float = 1.5) -> DataFrame:
    """WIN-08: the as_of day's values outside the fence of all earlier days' linear quartiles."""
    day = F.lit(as_of).cast("date")
    g = long.where(F.col("d") < day).groupBy("user_id", "metric").agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    g = g.select("user_id", "metric", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).where((F.col("n") >= least) & (F.col("q3") > F.col("q1")))
    iqr = F.col("q3") - F.col("q1")
    d = long.where(F.col("d") == day).join(g, ["user_id", "metric"])
    kind = F.when(F.col("value") > F.col("q3") + fence * iqr, "above_baseline").when(F.col("value") < F.col("q1") - fence * iqr, "below_baseline")
    return d.withColumn("direction", kind).where("direction is not null").select("user_id", F.col("d").alias("metric_date"), "metric", "value", "q1", "q3", "direction")


def ewma_drift(long: DataFrame, alpha: float = ALPHA, least: int = MIN_DAYS, drift: float = DRIFT) -> DataFrame:
    """WIN-09: series whose exponential average's later half differs from the earlier by at least `drift` of it."""
    # a value's share in the sum of the averages e_1 .. e_h is 1 - b ** (h - j + 1), of the first one (1 - b ** h) / alpha
    w, beta = Window.partitionBy("user_id", "metric"), 1 - alpha
    j, h, n = F.col("j"), F.floor(F.col("n") / 2), F.col("n")
    share = lambda m: F.when(j > m, 0.0).when(j == 1, (1 - F.pow(F.lit(beta), m)) / alpha).otherwise(1 - F.pow(F.lit(beta), m - j + 1))
    d = long.withColumns({"j": F.row_number().over(w.orderBy("d", "value")), "n": F.count("*").over(w)}).where(n >= least)
    g = d.groupBy("user_id", "metric", "n").agg(F.sum(F.col("value") * share(h)).alias("early"), F.sum(F.col("value") * share(n)).alias("all_"))
    g = g.withColumns({"prior": F.col("early") / h, "recent": (F.col("all_") - F.col("early")) / (n - h)})
    g = g.withColumn("rel", F.try_divide(F.col("recent") - F.col("prior"), F.abs("prior"))).where(F.abs("rel") >= drift)
    return g.select("user_id", "metric", F.col("n").cast("int").alias("sample_n"), "rel", F.when(F.col("rel") > 0, "rising").otherwise("declining").alias("direction"))


def lagged_correlations(long: DataFrame, pairs, lags=LAGS, least: int = MIN_DAYS, min_r: float = MIN_R) -> DataFrame:
    """WIN-10, JOIN-01, JOIN-02: Pearson's r of metric a on a day with metric b `lag` days later; constant series give none."""
    spark = long.sparkSession
    plan = F.broadcast(spark.createDataFrame([(a, b, lag) for a, b in pairs for lag in lags], "metric_a string, metric_b string, lag_days int"))  # a handful of rows
    a = long.select("user_id", F.col("metric").alias("metric_a"), F.col("d").alias("da"), F.col("value").alias("x")).join(plan, "metric_a")
    a = a.withColumn("db", F.date_add("da", F.col("lag_days")))
    b = long.select("user_id", F.col("metric").alias("metric_b"), F.col("d").alias("db"), F.col("value").alias("y"))
    g = a.join(b, ["user_id", "metric_b", "db"]).groupBy("user_id", "metric_a", "metric_b", "lag_days").agg(F.count("*").alias("sample_n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    g = g.where((F.col("sample_n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)).withColumn("correlation", F.col("c") / (F.col("sx") * F.col("sy")))
    return g.where(F.abs("correlation") >= min_r).drop("c", "sx", "sy")


def top_patterns(patterns: DataFrame, top: int = TOP) -> DataFrame:
    """SRT-02, DED-05: each user's strongest, a pair and lag once."""
    once = Window.partitionBy("user_id", "metric_a", "metric_b", "lag_days").orderBy(F.desc(F.abs("correlation")))
    rank = Window.partitionBy("user_id").orderBy(F.desc(F.abs("correlation")), "metric_a", "metric_b", "lag_days")
    return patterns.withColumn("_o", F.row_number().over(once)).where("_o = 1").drop("_o").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def all_patterns(metrics: DataFrame, features: DataFrame, as_of, days: int = LOOKBACK) -> DataFrame:
    """Within metrics and across to features, over the `days` before as_of."""
    day = F.lit(as_of).cast("date")
    recent = lambda d: d.where((F.col("d") >= F.date_sub(day, days)) & (F.col("d") < day))
    m = recent(to_long(metrics, sorted({x for p in WITHIN for x in p} | {a for a, _ in CROSS})))
    f = recent(to_long(features, sorted({b for _, b in CROSS}), "feature_date"))
    within, cross = top_patterns(lagged_correlations(m, WITHIN)), top_patterns(lagged_correlations(m.union(f), CROSS))
    return top_patterns(within.drop("rank").union(cross.drop("rank"))).withColumn("status", F.lit("active"))


def anomaly_rows(z: DataFrame, iqr: DataFrame) -> DataFrame:
    """SCO-13: rows of the anomaly table; a z of 3 or more is an alert, a fence only information."""
    a = z.select("user_id", F.col("metric_date").alias("detected_date"), "metric", F.lit("statistical").alias("anomaly_type"), F.left(F.format_string("%s is %s (z=%+.2f)", "metric", "direction", "z"), F.lit(500)).alias("description"), F.when(F.abs("z") >= Z_ALERT, "alert").otherwise("warning").alias("severity"), F.to_json(F.struct("value", "z", "sample_n")).alias("context_json"))
    b = iqr.select("user_id", F.col("metric_date").alias("detected_date"), "metric", F.lit("statistical").alias("anomaly_type"), F.left(F.format_string("%s is %s (outside the quartile fence)", "metric", "direction"), F.lit(500)).alias("description"), F.lit("info").alias("severity"), F.to_json(F.struct("value", "q1", "q3")).alias("context_json"))
    return a.union(b)


def llm_pattern_rows(found: DataFrame) -> DataFrame:
    """SCO-14: (user_id, detected_date, patterns array<struct<title, description>>) as rows of the anomaly table, in order."""
    x = found.select("user_id", "detected_date", F.posexplode("patterns").alias("ordinal", "p"))
    text = F.concat_ws(": ", F.col("p.title"), F.col("p.description"))
    return x.where(F.trim(F.coalesce(F.col("p.description"), F.lit(""))) != "").select("user_id", "detected_date", F.concat(F.lit("llm_pattern_"), F.col("ordinal").cast("string")).alias("metric"), F.lit("llm_pattern").alias("anomaly_type"), F.left(text, F.lit(500)).alias("description"), F.lit("info").alias("severity"), F.to_json(F.struct("ordinal")).alias("context_json"))
