"""Rule flags with per-user thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default thresholds (fixed values).
DEFAULTS = {"target_sleep_hours": 8.0, "min_sleep_hours": 6.0, "max_sleep_debt_7d": 5.0, "hrv_suppressed_ratio": 0.85, "max_hrv_suppressed_days": 2.0, "max_acute_chronic_ratio": 1.5, "min_readiness_score": 60.0, "run_pace_min_sec_mi": 210.0, "run_pace_max_sec_mi": 1080.0}
SEVERITY = {"alert": 3, "warning": 2, "info": 1}


def thresholds(users: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """SCO-04: user_id and every threshold: the user's override where there is a number, else the default. Unknown names are ignored."""
    base = users.select("user_id").distinct()
    if overrides is None:
        return base.select("user_id", *[F.lit(v).alias(k) for k, v in DEFAULTS.items()])
    wide = overrides.groupBy("user_id").pivot("name", list(DEFAULTS)).agg(F.max(F.col("value").try_cast("double")))
    return base.join(wide, "user_id", "left").select("user_id", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def flags(features: DataFrame, metrics: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """SCO-03, SRT-01: user_id, feature_date, code, severity, message, rank, ordered worst first by `rank`.

    metrics has the same day's sleep_hours. Weekly recovery flags need coverage, unless coverage isn't known at all.
    """
    f = features
    if metrics is not None:
        f = f.join(metrics.select("user_id", F.col("metric_date").alias("feature_date"), F.col("sleep_hours").alias("last_sleep")), ["user_id", "feature_date"], "left")
    else:
        f = f.withColumn("last_sleep", F.lit(None).cast("double"))
    f = f.join(limits, "user_id", "left") if limits is not None else f
    t = {k: (F.coalesce(F.col(k), F.lit(v)) if limits is not None else F.lit(v)) for k, v in DEFAULTS.items()}
    has = lambda c: F.col(c) if c in features.columns else F.lit(None).cast("double")
    sleep, hrv = has("recovery_sleep_days_7d"), has("recovery_hrv_days_7d")
    seen = lambda c: c.isNull() | (c > 0)
    fmt = lambda s, *c: F.format_string(s, *[x.cast("double") for x in c])
    rules = [
        ("SPARSE_RECOVERY_DATA", "info", (sleep == 0) & (hrv == 0), F.lit("No sleep or HRV in the last 7 days: recovery is unknown.")),
        ("LOW_SLEEP", "warning", F.col("last_sleep") < t["min_sleep_hours"], fmt("Slept %.1f h, under the %.0f h floor.", F.col("last_sleep"), t["min_sleep_hours"])),
        ("HIGH_SLEEP_DEBT", "warning", (has("sleep_debt_7d") > t["max_sleep_debt_7d"]) & seen(sleep), fmt("Sleep debt of 7 days is %.1f h, over %.0f h.", has("sleep_debt_7d"), t["max_sleep_debt_7d"])),
        ("LOW_HRV", "alert", (has("hrv_suppressed_days") > t["max_hrv_suppressed_days"]) & seen(hrv), fmt("HRV was suppressed on %.0f of 7 days.", has("hrv_suppressed_days"))),
        ("HIGH_TRAINING_LOAD", "alert", has("acute_chronic_ratio") > t["max_acute_chronic_ratio"], fmt("Acute to chronic load is %.2f, over %.1f.", has("acute_chronic_ratio"), t["max_acute_chronic_ratio"])),
        ("LOW_READINESS", "warning", has("overall_readiness_score") < t["min_readiness_score"], fmt("Readiness is %.0f of 100, under %.0f.", has("overall_readiness_score"), t["min_readiness_score"])),
        ("DATA_QUALITY_CARDIO_DISTANCE", "info", has("cardio_distance_suspect_7d") > 0, fmt("%.0f runs of the last 7 days have an implausible pace.", has("cardio_distance_suspect_7d"))),
    ]
    all_ = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), m.alias("message"), F.lit(-SEVERITY[sev] * 100 + i).alias("rank"))) for i, (code, sev, c, m) in enumerate(rules)]))
    return f.select("user_id", "feature_date", F.inline(all_))
