"""Bounded reads of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import joins

MOST_ROWS, MOST_DAYS = 500, 370
WEEKLY_KEYS = ("strength_volume_lbs", "strength_short_tons", "upper_volume_lbs", "lower_volume_lbs")
HISTORY = {"daily_health_metrics": "metric_date", "daily_features": "feature_date", "weekly_activity_summary": "week_start", "strength_events": "event_date", "cardio_events": "event_date"}


def recent(df: DataFrame, date_col: str, as_of, days: int) -> DataFrame:
    """SCAN-01 to 04, 07, 10, 20, 21, 34: rows of the last days."""
    return df.where(P.trailing(date_col, F.lit(as_of).cast("date"), days))


def top_rows(df: DataFrame, n: int, *order, by: str = "user_id") -> DataFrame:
    """SCAN-06, 08, 18, 19, 23, 25, SRT-05: each user's first n rows."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def latest(df: DataFrame, date_col: str, as_of) -> DataFrame:
    """SCAN-13 to 17"""
    return joins.latest_row(df, date_col, as_of)


def active_patterns(df: DataFrame, n: int = 12, by_strength: bool = False) -> DataFrame:
    """SCAN-08, SCAN-19"""
    order = [F.desc_nulls_last(F.abs("correlation"))] if by_strength else [F.desc_nulls_last("last_confirmed_at")]
    return top_rows(df.where("status = 'active'"), n, *order, "metric_a", "metric_b", "lag_days")


def journal(df: DataFrame, n: int = 40) -> DataFrame:
    """SCAN-06, SCAN-23, PRJ-37: the newest entries, dates as text."""
    return top_rows(df, n, F.desc("entry_date"), F.desc_nulls_last("created_at")).withColumn("entry_date", F.date_format("entry_date", "yyyy-MM-dd"))


def exceptions_from(df: DataFrame, as_of, days: int = 14) -> DataFrame:
    """SCAN-11"""
    return df.where(F.col("end_date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def around(df: DataFrame, as_of, days: int = 7) -> DataFrame:
    """SCAN-12"""
    return df.where(F.abs(F.datediff("event_date", F.lit(as_of).cast("date"))) <= days)


def power_rides(df: DataFrame, n: int = 50) -> DataFrame:
    """SCAN-25: the newest rides with power, at most 1 to 500."""
    return top_rows(df.where("avg_watts is not null"), max(1, min(500, n)), F.desc_nulls_last("started_at"), "source_id")


def history(df: DataFrame, table: str, columns: list[str], as_of, days: int) -> DataFrame:
    """SCAN-26 to 30: allowed columns over 1 to 370 days, oldest first; of more than 500 rows a user the newest stay."""
    date_col = HISTORY[table]
    if odd := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{table} has no columns {odd}")
    d = recent(df, date_col, as_of, max(1, min(MOST_DAYS, days)))
    return top_rows(d, MOST_ROWS, F.desc(date_col)).select("user_id", *columns).orderBy("user_id", date_col)


def weekly_summaries(df: DataFrame, as_of, weeks: int = 12) -> DataFrame:
    """SCAN-29: weekly rows from `weeks` weeks before as_of on, with the volumes of their JSON as columns."""
    day = F.lit(as_of).cast("date")
    d = df.where((F.col("week_start") >= F.date_sub(day, max(1, min(MOST_DAYS, 7 * weeks)))) & (F.col("week_start") <= day))
    d = d.withColumns({k: F.get_json_object("summary_json", f"$.{k}").try_cast("double") for k in WEEKLY_KEYS})
    return top_rows(d, MOST_ROWS, F.desc("week_start")).drop("rank").orderBy("user_id", "week_start")


def hub_rows(df: DataFrame, since=None, source: str = "apple_health") -> DataFrame:
    """SCAN-37, SCAN-38: the hub's cardio rows, all or from a date on, newest first."""
    d = df.where(F.col("source") == source)
    d = d if since is None else d.where(F.col("event_date") >= F.lit(since).cast("date"))
    return d.orderBy(F.desc("event_date"), "source_id")


def chart_rows(df: DataFrame, date_col: str) -> DataFrame:
    """ARR-11: rows with a readable date, oldest first, every other column as a number (null where it isn't one)."""
    d = df.select(S.as_date(date_col).alias(date_col), *[(F.col(c).cast("string")).try_cast("double").alias(c) for c in df.columns if c != date_col])
    return d.where(F.col(date_col).isNotNull()).orderBy(date_col)


def chat_tail(df: DataFrame, n: int = 12) -> DataFrame:
    """SCAN-35, SRT-06: the newest messages, in order."""
    return top_rows(df, n, F.desc("created_at")).orderBy("user_id", F.desc("rank"))


def on_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """SCAN-31 to 33: rows of these (user_id, event_date)."""
    return df.join(days.select("user_id", "event_date").distinct(), ["user_id", "event_date"], "left_semi")


def corpus_block(df: DataFrame) -> DataFrame:
    """PRJ-37: labelled guideline files of a user as one text."""
    part = F.concat(F.lit("## "), F.col("label"), F.lit("\n"), F.col("text"))
    return df.where(F.trim("text") != "").groupBy("user_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("label", part.alias("p")))), lambda x: x["p"])).alias("guidelines"))


__all__ = ["HISTORY", "MOST_DAYS", "MOST_ROWS", "WEEKLY_KEYS", "active_patterns", "around", "chart_rows", "chat_tail", "corpus_block", "exceptions_from", "history", "hub_rows", "journal", "latest", "on_days", "power_rides", "recent", "top_rows", "weekly_summaries"]
