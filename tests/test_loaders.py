"""The daily scans over a store, and the predicates on names that they feed."""

import random
from datetime import date, datetime, timedelta
from types import SimpleNamespace

import pytest

from pulseframe import schemas
from pulseframe.functions import scalars as S
from pulseframe.operators import cardio_dedup, stats
from pulseframe.plans import jobs
from pulseframe.sinks.store import Store
from pulseframe.sources import loaders

DAY = date(2024, 6, 8)


def ago(n):
    return DAY - timedelta(days=n)


def rows(spark, table, values, shape):
    return schemas.conform(spark.createDataFrame(values, shape), table)


def test_scans_of_an_empty_store(spark, tmp_path):
    found = loaders.loaders(Store(spark, str(tmp_path)).read, DAY)
    assert set(found) == {*loaders.SCANS, "schedule_exceptions"} and len(found) == 12
    assert not any(d.count() for d in found.values())


def test_windows_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with store.transaction() as t:
        t.upsert("cardio_events", rows(spark, "cardio_events", [("u", "strava", f"c{n}", ago(n), "Run", 30.0) for n in (-1, 0, 34, 35)], "user_id string, source string, source_id string, event_date date, activity_type string, duration_min double"))
        t.upsert("daily_health_metrics", rows(spark, "daily_health_metrics", [("u", ago(n), 7.0) for n in (-1, 0, 27, 28)], "user_id string, metric_date date, sleep_hours double"))
        t.upsert("biometrics", rows(spark, "biometrics", [("u", "s", ago(n), "steps", float(n)) for n in (0, 1)], "user_id string, source string, event_date date, metric string, value double"))
        t.replace("interventions", rows(spark, "interventions", [("u", ago(n), "calendar", f"i{n}") for n in (-8, -7, 7, 8)], "user_id string, event_date date, category string, description string"))
        t.replace("schedule_exceptions", rows(spark, "schedule_exceptions", [("u", ago(30), ago(n), ["x"], f"e{n}") for n in (14, 15)], "user_id string, start_date date, end_date date, affected_goal_types array<string>, override_hint string"))
        t.replace("goals", rows(spark, "goals", [("u", "a", True), ("u", "b", False), ("u", "c", None)], "user_id string, goal_type string, is_active boolean"))
        t.replace("athlete_journal_entries", rows(spark, "athlete_journal_entries", [("u", ago(n), str(n)) for n in range(-2, 60)] + [("v", ago(99), "old")], "user_id string, entry_date date, body string"))
    found = loaders.loaders(store.read, DAY)
    values = lambda name, c: sorted(r[0] for r in found[name].select(c).collect())
    assert values("cardio_events", "event_date") == [ago(34), DAY]
    assert values("daily_metrics_window", "metric_date") == [ago(27), DAY]
    assert values("biometrics_today", "value") == [0.0]
    assert values("interventions", "description") == ["i-7", "i7"]
    assert values("schedule_exceptions", "override_hint") == ["e14"]
    assert values("goals", "goal_type") == ["a"]
    assert values("journal_entries", "body") == sorted([*map(str, range(40)), "old"])
    assert found["cardio_events"].columns == ["user_id", "event_date", "activity_type", "distance_miles", "duration_min", "session_rpe"]
    window = loaders.cardio_window(store.read("cardio_events"), DAY, 0)
    assert [r.source_id for r in window.collect()] == ["c0"]


NAMES = ["Outdoor Walk", "Walk then run", "sidewalk", "Hiking", "  ", "", None, "dog-walking", "Jogging walk", "Weights", "Strength  Circuit", "Kite\tSurfing", "rowing", "crow"]


@pytest.mark.parametrize("family", list(dict.fromkeys(v for _, v in S.FAMILIES)))
def test_in_family_is_the_family(spark, family):
    d = spark.createDataFrame([(n,) for n in NAMES], "a string")
    assert not d.where(S.in_family("a", family) != (S.activity_family("a") == family)).count()


def test_families_and_bridges_by_name(spark):
    d = spark.createDataFrame([(n,) for n in NAMES], "a string").select(S.activity_family("a"))
    assert [r[0] for r in d.collect()] == ["walk", "run", "sidewalk", "hike", "workout", "workout", "workout", "walk", "run", "strength", "strength", "kite surfing", "row", "crow"]
    apps = [("Health \t Sync", True), ("my FITBIT", True), ("Google Fit", True), ("healthsync", False), ("Strava", False), (None, False)]
    got = spark.createDataFrame(apps, "a string, want boolean").select(S.is_bridge("a"), "want").collect()
    assert all(a == b for a, b in got)


def test_load_keeps_what_no_pass_may_judge(spark):
    """Rows of other sources, without a source, or of the power sources without a start remove nothing and stay."""
    at = lambda n: datetime(2024, 6, 8, 10, n)
    v = [("a", "apple_health", "Run", 30.0, at(0)), ("b", "apple_health", "Run", 31.0, at(5)), ("c", "strava", "Run", 30.0, at(3)), ("d", "strava", "Run", 30.0, None), ("e", "manual", "Run", 30.0, at(1)), ("f", None, "Run", 30.0, at(1)), ("g", "wahoo_fit", "Run", 30.0, at(30)), ("h", "strava", "Strength training", 30.0, at(1)), ("i", "strava", "Traditional Strength Training", 30.0, at(1))]
    d = rows(spark, "cardio_events", [("u", s, i, DAY, a, m, t) for i, s, a, m, t in v], "user_id string, source string, source_id string, event_date date, activity_type string, duration_min double, started_at timestamp")
    kept = {r.source_id for r in cardio_dedup.training_load_sessions(d).collect()}
    assert kept == {"c", "d", "e", "f", "g", "h"}
    assert cardio_dedup.training_load_sessions(d).columns == d.columns


def test_weekly_patterns_read_their_days_only(spark, tmp_path):
    """Months outside the window aren't read, and the patterns are those of the whole tables."""
    store, r = Store(spark, str(tmp_path)), random.Random(3)
    days = [(ago(n), r.gauss(50, 9)) for n in range(-20, 150)]
    m = rows(spark, "daily_health_metrics", [("u", d, 4 + x / 20, x, 70 - x / 4 if d >= ago(60) else x) for d, x in days], "user_id string, metric_date date, sleep_hours double, hrv_rmssd double, resting_hr double")
    f = rows(spark, "daily_features", [("u", d, x / 3, 100 - x) for d, x in days], "user_id string, feature_date date, cardio_minutes_7d double, overall_readiness_score double")
    with store.transaction() as t:
        t.upsert("daily_health_metrics", m)
        t.upsert("daily_features", f)
    jobs.run_weekly(store, DAY)
    key = lambda d: {(x.metric_a, x.metric_b, x.lag_days, round(x.correlation, 9)) for x in d.collect()}
    got = key(store.read("metric_patterns").where("status = 'active'"))
    assert got and got == key(stats.all_patterns(m, f, DAY.isoformat()))
    read = []
    spied = SimpleNamespace(read=lambda table, *span: (read.append((table, *span)), store.read(table, *span))[1], replace=lambda *_: None)
    jobs.run_weekly(spied, DAY)
    assert ("daily_health_metrics", ago(60), ago(1)) in read and ("daily_features", ago(60), ago(1)) in read


def test_lists_and_maps_pass_the_resolution_as_text(spark):
    """Spark's batches for Python go over a list or map as often as they have rows; its contents come back whole."""
    flags, curve = [None, [], ["a", None, 'b"c']], [None, {}, {"5": 0.1, "60": None, "300": float("inf")}]
    v = [("u", "strava", f"{i}{j}", DAY, "Run", 30.0, datetime(2024, 6, 8, 6 + 3 * i + j, 0), f, c) for i, f in enumerate(flags) for j, c in enumerate(curve)]
    d = rows(spark, "cardio_events", v, "user_id string, source string, source_id string, event_date date, activity_type string, duration_min double, started_at timestamp, quality_flags array<string>, power_mmp_json map<string,double>")
    assert not [c for c, t in cardio_dedup._dealt(d).dtypes if t.startswith(("array", "map"))]
    for got in (cardio_dedup.training_load_sessions(d), cardio_dedup.dedupe_power(d)):
        assert got.dtypes == d.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, d.collect()))
