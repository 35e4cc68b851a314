"""Column types of the stored tables, their conflict keys, and shaping of frames to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRENGTH = "user_id string, source string, source_id string, event_date date, exercise_name string, muscle_group string, movement_type string, superset_id string, set_number int, reps int, weight_lbs double, rpe double, set_type string, notes string"
_CARDIO = "user_id string, source string, source_id string, event_date date, activity_type string, duration_min double, distance_miles double, elevation_ft double, avg_hr int, max_hr int, avg_pace_sec_mi int, calories double, effort_zone string, notes string, session_rpe double, source_app string, started_at timestamp, quality_flags array<string>, avg_watts double, max_watts double, normalized_power double, work_kj double, device_watts boolean, power_mmp_json map<string,double>"
_METRICS = "hrv_rmssd double, resting_hr int, spo2_pct double, respiratory_rate double, sleep_hours double, sleep_deep_hrs double, sleep_rem_hrs double, sleep_score double, steps int, active_cal int, vo2_max double, body_weight_lbs double, body_fat_pct double, muscle_mass_lbs double"
_FEATURES = "strength_sessions_7d int, strength_hard_sets_7d int, strength_tonnage_7d double, training_load_strength_short_tons_7d double, training_load_strength_short_tons_28d double, training_load_strength_hard_sets_28d int, training_load_strength_sessions_28d int, cardio_sessions_7d int, cardio_minutes_7d double, cardio_minutes_14d double, acute_chronic_ratio double, training_load_cardio_minutes_7d double, training_load_cardio_minutes_28d double, cardio_distance_suspect_7d int, effort_unified_index_7d double, effort_unified_index_28d double, effort_foster_cardio_au_7d double, effort_foster_strength_au_7d double, effort_foster_au_7d double, effort_foster_cardio_au_28d double, effort_foster_strength_au_28d double, effort_foster_au_28d double, recovery_sleep_days_7d int, recovery_hrv_days_7d int, sleep_debt_7d double, hrv_suppressed_days int, overall_readiness_score double, cardio_trimp_7d double, upper_body_sets_7d int, lower_body_sets_7d int, push_sets_7d int, pull_sets_7d int"

#: DDL of each table.
TABLES = {
    "user_settings": "user_id string, email string, timezone string, briefing_time string",
    "strength_events": _STRENGTH,
    "cardio_events": _CARDIO,
    "biometrics": "user_id string, source string, event_date date, metric string, value double, unit string, raw_key string",
    "daily_health_metrics": f"user_id string, metric_date date, {_METRICS}, hrv_7d_avg double, hrv_30d_avg double, hrv_baseline_ratio double, sleep_7d_avg double, weight_30d_trend double, ftp_watts double, ftp_method string, ftp_confidence double, updated_at timestamp",
    "daily_features": f"user_id string, feature_date date, {_FEATURES}, updated_at timestamp",
    "interventions": "user_id string, event_date date, category string, description string, is_ongoing boolean, end_date date, notes string",
    "daily_briefings": "user_id string, briefing_date date, flags array<string>, recommendations string, features_json string, anomalies string, coaching_note string, model_used string",
    "anomaly_events": "user_id string, detected_date date, metric string, anomaly_type string, description string, severity string, context_json string",
    "metric_baselines": "user_id string, metric_date date, metric string, window_days int, mean_value double, stdev_value double, sample_n int, updated_at timestamp",
    "metric_moments": "user_id string, metric string, month date, n bigint, mean double, m2 double",
    "metric_counts": "user_id string, metric string, month date, value double, n bigint",
    "metric_patterns": "user_id string, metric_a string, metric_b string, lag_days int, correlation double, sample_n int, status string, description string, last_confirmed_at timestamp",
    "goals": "user_id string, goal_type string, target_min double, target_max double, target_label string, period string, is_active boolean, effective_from date, effective_until date, updated_at timestamp",
    "running_sessions": "user_id string, source string, source_id string, session_date date, run_type string, distance_km double, duration_min double",
    "weekly_activity_summary": "user_id string, week_start date, strength_sessions int, running_km double, cardio_minutes double, summary_json string, updated_at timestamp",
    "daily_goal_snapshot": "user_id string, snapshot_date date, goals_status string, mileage_check string, todays_focus string",
    "schedule_exceptions": "user_id string, start_date date, end_date date, affected_goal_types array<string>, override_hint string, reason string",
    "provider_connections": "user_id string, provider string, status string, last_sync_at timestamp, last_error string, updated_at timestamp",
    "coaching_chat_messages": "user_id string, role string, content string, created_at timestamp",
    "training_phases": "user_id string, id string, phase_type string, name string, start_date date, end_date date, is_active boolean, updated_at timestamp",
    "athlete_journal_entries": "user_id string, entry_date date, category string, body string, created_at timestamp",
}

#: The columns that identify a row, for tables that are merged into.
KEYS = {
    "user_settings": ["user_id"], "strength_events": ["user_id", "source_id"], "cardio_events": ["user_id", "source_id"], "biometrics": ["user_id", "source", "event_date", "metric"],
    "daily_health_metrics": ["user_id", "metric_date"], "daily_features": ["user_id", "feature_date"], "daily_briefings": ["user_id", "briefing_date"],
    "metric_baselines": ["user_id", "metric_date", "metric", "window_days"], "metric_moments": ["user_id", "metric", "month"], "metric_counts": ["user_id", "metric", "month", "value"], "metric_patterns": ["user_id", "metric_a", "metric_b", "lag_days"], "goals": ["user_id", "goal_type"],
    "running_sessions": ["user_id", "source", "source_id"], "weekly_activity_summary": ["user_id", "week_start"], "daily_goal_snapshot": ["user_id", "snapshot_date"], "provider_connections": ["user_id", "provider"],
}

CANONICAL_METRICS = [c.split()[0] for c in _METRICS.split(", ")]
INTEGER_METRICS = ["resting_hr", "steps", "active_cal"]


def columns(table: str) -> dict[str, str]:
    """Column names and types of a table."""
    depth, out, word = 0, [], ""
    for ch in TABLES[table] + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    return dict(x.split(" ", 1) for x in out)


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with all of the table's columns, missing ones null; unknown columns are an error."""
    want = columns(table)
    if odd := [c for c in df.columns if c not in want]:
        raise ValueError(f"{table} has no columns {odd}")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in want.items()])
