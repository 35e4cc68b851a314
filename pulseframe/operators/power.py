"""Cycling power: resampling, mean-maximal power, normalized power, threshold estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

DURATIONS = (5, 15, 30, 60, 180, 300, 720, 1200, 1800, 3600)
CP_DURATIONS = (300, 720, 1200, 1800)


def _effort(watts: str) -> Column:
    """Watts with null and NaN as 0."""
    return F.coalesce(F.nanvl(F.col(watts).cast("double"), F.lit(0.0)), F.lit(0.0))


def resample(samples: DataFrame, ride: str = "ride_id", at: str = "ts", watts: str = "watts", hold: int = 2) -> DataFrame:
    """WIN-15: ride, i (second from the start), watts: one row a second, the last value of a second, held for up to `hold` seconds."""
    s = samples.where(F.col(at).isNotNull()).select(ride, F.unix_timestamp(at).alias("sec"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), watts)
    s = s.groupBy(ride, "sec").agg(F.max_by(watts, F.when(F.col(watts).isNotNull(), F.col("us"))).alias("w"))
    span = s.groupBy(ride).agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    grid = span.select(ride, "lo", F.explode(F.sequence("lo", "hi")).alias("sec")).join(s, [ride, "sec"], "left")
    w = Window.partitionBy(ride).orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    near = F.col("sec") - F.max(F.when(F.col("w").isNotNull(), F.col("sec"))).over(w) <= hold
    return grid.select(ride, (F.col("sec") - F.col("lo")).alias("i"), F.when(near, F.last("w", True).over(w)).alias("watts"))


def mean_maximal(series: DataFrame, ride: str = "ride_id", durations=DURATIONS) -> DataFrame:
    """WIN-16, ARR-04: ride, duration, watts: the best mean over each duration no longer than the ride; null and NaN count as 0."""
    w = Window.partitionBy(ride).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # one running sum; each duration is a difference of two of its values
    d = series.withColumns({"sum_": F.sum(_effort("watts")).over(upto), "n_": F.row_number().over(w)})
    d = d.withColumns({f"d{k}": F.when(F.col("n_") >= k, (F.col("sum_") - F.lag("sum_", k, 0.0).over(w)) / k) for k in durations})
    g = d.groupBy(ride).agg(*[F.max(f"d{k}").alias(str(k)) for k in durations])
    return g.unpivot([ride], [str(k) for k in durations], "duration", "watts").where("watts is not null").withColumn("duration", F.col("duration").cast("int"))


def normalized(series: DataFrame, ride: str = "ride_id", window: int = 30) -> DataFrame:
    """WIN-17: the fourth root of the mean fourth power of the 30-second means; null, NaN and negative watts count as 0; null for shorter rides."""
    w = Window.partitionBy(ride).orderBy("i").rowsBetween(-(window - 1), 0)
    v = F.greatest(_effort("watts"), F.lit(0.0))
    d = series.withColumn("m", F.when(F.count("i").over(w) == window, F.avg(v).over(w)))
    return d.groupBy(ride).agg(F.pow(F.avg(F.pow("m", F.lit(4.0))), F.lit(0.25)).alias("normalized_power"))


def totals(series: DataFrame, ride: str = "ride_id") -> DataFrame:
    """AGG-26: mean and largest of the values there are, work in kJ."""
    return series.groupBy(ride).agg(F.avg("watts").alias("avg_watts"), F.max("watts").alias("max_watts"), (F.sum(F.greatest("watts", F.lit(0.0))) / 1000).alias("work_kj"))


def track_totals(points: DataFrame, ride: str = "ride_id", order: str = "i") -> DataFrame:
    """AGG-27: mean and largest heart rate, and the climb of all rises."""
    rise = F.greatest(F.col("altitude") - F.lag("altitude").over(Window.partitionBy(ride).orderBy(order)), F.lit(0.0))
    return points.withColumn("rise", rise).groupBy(ride).agg(F.avg("hr").alias("avg_hr"), F.max("hr").alias("max_hr"), F.coalesce(F.sum("rise"), F.lit(0.0)).alias("gain_m"))


def best_curve(rides: DataFrame, mmp: str = "power_mmp_json") -> DataFrame:
    """AGG-25, ARR-06, ARR-07: of each user the best of all rides by duration; keys that are no durations and values that aren't finite and positive go."""
    e = rides.where(F.col(mmp).isNotNull()).select("user_id", F.explode(mmp).alias("k", "v"))
    e = e.select("user_id", S.duration_key("k").alias("duration"), S.number("v").alias("watts")).where("duration is not null and watts > 0")
    return e.groupBy("user_id", "duration").agg(F.max("watts").alias("watts"))


def monotone(curve: DataFrame) -> DataFrame:
    """WIN-18: no longer duration above a shorter one."""
    w = Window.partitionBy("user_id").orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("watts", F.min("watts").over(w))


def coggan(m5: Column, m20: Column) -> tuple[Column, Column]:
    """SCO-08: 90 % of 20 minutes unless those are under 85 % of 5, and the confidence."""
    ratio = F.try_divide(m20, m5)
    ok = (m20 > 0) & F.coalesce(~((m5 > 0) & (ratio < 0.85)), F.lit(True))
    conf = F.when(m5 > 0, 0.50 + 0.30 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - 0.85) / 0.1))).otherwise(0.45)
    return F.when(ok, m20 * 0.90), F.when(ok, F.least(F.lit(0.85), conf))


def critical_power(curve: DataFrame) -> DataFrame:
    """SCO-09: P = CP + W'/t by least squares over at least three of the durations."""
    x = (F.lit(1.0) / F.col("duration")).alias("x")
    p = curve.where(F.col("duration").isin(*CP_DURATIONS) & (F.col("watts") > 0)).select("user_id", x, F.col("watts").alias("y"))
    g = p.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_intercept("y", "x").alias("cp"), F.regr_slope("y", "x").alias("w_prime"), F.regr_r2("y", "x").alias("r2"))
    return g.where("n >= 3 and cp > 0").select("user_id", "cp", "w_prime", F.least(F.lit(0.85), 0.35 + 0.45 * F.coalesce("r2", F.lit(1.0))).alias("cp_confidence"))


def threshold(best: DataFrame) -> DataFrame:
    """SCO-07: user_id, ftp_watts, ftp_method, ftp_confidence from the best curve.

    The best hour, if it looks maximal beside 30 and 20 minutes; after a soft hour and soft 30 minutes the 20-minute
    rule; else 95 % of 30 minutes; else 95 % of critical power; else the 20-minute rule.
    """
    c = monotone(best)
    m = c.groupBy("user_id").agg(*[F.max(F.when(F.col("duration") == d, F.col("watts"))).alias(n) for n, d in (("m5", 300), ("m20", 1200), ("m30", 1800), ("m60", 3600))])
    m = m.join(critical_power(c), "user_id", "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    m5, m20, m30, m60 = map(F.col, ("m5", "m20", "m30", "m60"))
    soft = m60.isNotNull() & (yes(m60 < m30 * 0.88) | yes(m60 < m20 * 0.70))
    soft30 = yes(m30 < m20 * 0.88)
    cw, cc = coggan(m5, m20)
    pick = lambda a, b, c: F.struct(a.cast("double").alias("ftp_watts"), F.lit(b).alias("ftp_method"), c.cast("double").alias("ftp_confidence"))
    est = S.first_match([
        (m60.isNotNull() & ~soft, pick(m60, "mmp_60", F.lit(0.92))), (soft & soft30 & cw.isNotNull(), pick(cw, "coggan_20min", cc)), (m30.isNotNull(), pick(m30 * 0.95, "mmp_30", F.lit(0.80))),
        (F.col("cp").isNotNull(), pick(F.col("cp") * 0.95, "critical_power", F.col("cp_confidence"))), (cw.isNotNull(), pick(cw, "coggan_20min", cc)),
    ], pick(F.lit(None), "insufficient_data", F.lit(0.0)))
    return m.select("user_id", est.alias("e")).select("user_id", "e.*")
