"""Dense calendars: a row for each day or week of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spine(df: DataFrame, by: list[str], date_col: str, step: str = "day", start=None, end=None, out: str = "d") -> DataFrame:
    """by + `out`: every day or week (Monday) from each group's first date to its last, or between given dates."""
    lo, hi = F.min(date_col), F.max(date_col)
    g = df.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))
    a = F.col("lo") if start is None else F.lit(start).cast("date")
    b = F.col("hi") if end is None else F.lit(end).cast("date")
    if step == "week":
        a, b = F.date_trunc("week", a).cast("date"), F.date_trunc("week", b).cast("date")
    return g.where(a <= b).select(*by, F.explode(F.sequence(a, b, F.expr(f"interval 1 {step}"))).alias(out))
