"""What the daily job loads: twelve bounded scans, each of all users at once.

`read` is Store.read or anything like it: (table, since, until) -> the table's rows of those days; it may prune, the scan
filters again. Tables without a day are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

#: Days that events are read back, and metrics and features (fixed values).
EVENT_DAYS, WINDOW_DAYS = 35, 28


@dataclass(frozen=True)
class Scan:
    """Columns of a table (none named: all) over the days from `before` days before a day to `after` days after it."""

    table: str
    columns: str = ""
    day: str = ""
    before: int | None = None
    after: int = 0
    where: Callable[[], Column] | None = None
    first: tuple[int, Callable[[], list[Column]]] | None = None  # so many rows of each user in this order

    def of(self, read: Callable[..., DataFrame], as_of: date) -> DataFrame:
        since = as_of - timedelta(days=self.before) if self.before is not None else None
        until = as_of + timedelta(days=self.after) if self.day else None
        d = read(self.table, since, until) if self.day else read(self.table)
        if since:
            d = d.where(F.col(self.day) >= F.lit(since))
        if until:
            d = d.where(F.col(self.day) <= F.lit(until))
        if self.where:
            d = d.where(self.where())
        if self.first:
            n, order = self.first
            d = scans.top_rows(d, n, *order()).drop("rank")
        return d.select("user_id", *self.columns.split()) if self.columns else d


SCANS = {
    "biometrics_today": Scan("biometrics", "metric value", "event_date", 0),
    "daily_metrics_window": Scan("daily_health_metrics", "", "metric_date", WINDOW_DAYS - 1),
    "daily_features_window": Scan("daily_features", "", "feature_date", WINDOW_DAYS - 1),
    "strength_events": Scan("strength_events", "event_date exercise_name set_type reps weight_lbs rpe", "event_date", EVENT_DAYS - 1),
    "cardio_events": Scan("cardio_events", "event_date activity_type distance_miles duration_min session_rpe", "event_date", EVENT_DAYS - 1),
    "running_sessions": Scan("running_sessions", "session_date run_type distance_km duration_min source", "session_date", EVENT_DAYS - 1),
    "interventions": Scan("interventions", "event_date category description", "event_date", 7, 7),
    "active_patterns": Scan("metric_patterns", "metric_a metric_b lag_days correlation sample_n status description", where=lambda: F.col("status") == "active", first=(12, lambda: [F.desc_nulls_last("last_confirmed_at"), F.col("metric_a"), F.col("metric_b"), F.col("lag_days")])),
    "goals": Scan("goals", "goal_type target_min target_max target_label period is_active effective_from effective_until", where=lambda: F.col("is_active")),
    "training_phases": Scan("training_phases", "id name phase_type start_date end_date is_active"),
    "journal_entries": Scan("athlete_journal_entries", "entry_date category body created_at", "entry_date", first=(40, lambda: [F.desc("entry_date"), F.desc_nulls_last("created_at"), F.col("body")])),
}


def loaders(read: Callable[..., DataFrame], as_of: date) -> dict[str, DataFrame]:
    """SRC-28, SCAN-01 to 12: name -> frame; nothing runs until a frame is used."""
    found = {name: s.of(read, as_of) for name, s in SCANS.items()}
    ends = scans.exceptions_from(read("schedule_exceptions"), as_of)
    return found | {"schedule_exceptions": ends.select("user_id", "start_date", "end_date", "affected_goal_types", "override_hint", "reason")}


def cardio_window(cardio: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """SCAN-24: sessions of the last days (at least one), each user's newest first; those of a day by id."""
    d = scans.recent(cardio, "event_date", as_of, max(1, days))
    d = d.select("user_id", "event_date", "activity_type", "distance_miles", "duration_min", "source", "source_id", "source_app", "started_at", "avg_watts", "normalized_power", "max_watts")
    return d.orderBy("user_id", F.desc("event_date"), "source_id")
