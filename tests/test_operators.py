"""Worked cases of the domain's operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pulseframe import schemas
from pulseframe.functions import predicates as P
from pulseframe.functions import scalars as S
from pulseframe.functions import scores
from pulseframe.operators import calendar, cardio_dedup, features, goals, joins, pace, power, rules, sleep, stats, strength

D = dt.date
AS_OF = D(2024, 6, 8)


def days_ago(n):
    return AS_OF - dt.timedelta(days=n)


def sets(spark, rows):
    d = [("u", "hevy", str(i), day, "Bench Press", reps, float(w), rpe, kind) for i, (day, reps, w, kind, rpe) in enumerate(rows)]
    return schemas.conform(spark.createDataFrame(d, "user_id string, source string, source_id string, event_date date, exercise_name string, reps int, weight_lbs double, rpe double, set_type string"), "strength_events")


def cardio(spark, rows):
    d = [("u", r.get("source", "strava"), str(r.get("id", i)), r["day"], r.get("type", "Run"), float(r["min"]), r.get("mi"), r.get("rpe"), r.get("app"), r.get("start"), r.get("hr")) for i, r in enumerate(rows)]
    return schemas.conform(spark.createDataFrame(d, "user_id string, source string, source_id string, event_date date, activity_type string, duration_min double, distance_miles double, session_rpe double, source_app string, started_at timestamp, avg_hr int"), "cardio_events")


def metrics(spark, rows):
    return schemas.conform(spark.createDataFrame([("u", d, s, h) for d, s, h in rows], "user_id string, metric_date date, sleep_hours double, hrv_rmssd double"), "daily_health_metrics")


def one_day(spark):
    return spark.createDataFrame([("u", AS_OF)], "user_id string, feature_date date")


def test_features_of_a_worked_day(spark):
    s = sets(spark, [(AS_OF, 5, 100, "working", None)] * 2 + [(AS_OF, 10, 45, "warmup", None), (days_ago(2), 8, 50, "working", None)])
    c = cardio(spark, [{"day": AS_OF, "min": 30}, {"day": days_ago(3), "min": 40}, {"day": days_ago(20), "min": 60}])
    m = metrics(spark, [(days_ago(i), 7.0, 30.0 if i == 0 else 50.0) for i in range(7)])
    r = features.daily_features(s, c, m, one_day(spark)).first()
    assert round(r.strength_tonnage_7d, 3) == 0.7 and r.strength_hard_sets_7d == 3 and r.strength_sessions_7d == 2
    assert r.cardio_minutes_7d == 70 and r.training_load_cardio_minutes_28d == 130 and round(r.acute_chronic_ratio, 3) == 2.154
    assert r.sleep_debt_7d == 7.0 and r.hrv_suppressed_days == 1 and round(r.effort_unified_index_7d, 2) == 133.0 and round(r.overall_readiness_score, 1) == 44.0
    assert round(features.daily_features(s, c, m, one_day(spark), most_acwr=3.0).first().overall_readiness_score, 1) == 64.0
    got = {x.code for x in rules.flags(features.daily_features(s, c, m, one_day(spark)), m).collect()}
    assert got == {"HIGH_SLEEP_DEBT", "HIGH_TRAINING_LOAD", "LOW_READINESS"}


def test_features_of_nothing(spark):
    r = features.daily_features(sets(spark, []), cardio(spark, []), metrics(spark, []), one_day(spark)).first()
    assert r.cardio_minutes_7d == 0 and r.acute_chronic_ratio is None and r.sleep_debt_7d is None and r.overall_readiness_score is None


def test_strength_like_cardio_and_foster(spark):
    c = cardio(spark, [{"day": AS_OF, "min": 30}, {"day": AS_OF, "min": 50, "type": "Traditional Strength Training"}, {"day": days_ago(20), "min": 60}])
    r = features.daily_features(sets(spark, []), c, metrics(spark, []), one_day(spark)).first()
    assert (r.cardio_minutes_7d, r.training_load_cardio_minutes_28d, r.cardio_sessions_7d) == (30, 90, 1)
    r = features.daily_features(sets(spark, [(AS_OF, 5, 100, "working", 8.0)] * 2), cardio(spark, [{"day": AS_OF, "min": 20, "rpe": 5.0}]), metrics(spark, []), one_day(spark)).first()
    assert (r.effort_foster_strength_au_7d, r.effort_foster_cardio_au_7d, r.effort_foster_au_7d) == (48.0, 100.0, 148.0)


def greedy(rows, key, near):
    kept = []
    for r in sorted(rows, key=key, reverse=True):
        if not any(near(r, k) for k in kept):
            kept.append(r)
    return {r["id"] for r in kept}


def test_hub_dedup_is_greedy(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 6, 8, 8)
    rows = [{"id": f"{i:03d}", "source": "apple_health", "day": AS_OF, "min": 30, "mi": rng.choice([None, 3.0]), "app": rng.choice(["Strava", "Fitbit", "Nike Run Club", None]), "start": t0 + dt.timedelta(minutes=rng.randrange(0, 300)), "hr": rng.choice([None, 140])} for i in range(60)]
    rank = {"Strava": 30, "Fitbit": 10, "Nike Run Club": 40, None: 15}
    want = greedy(rows, lambda r: (rank[r["app"]], 1, 2 * (r["mi"] is not None) + (r["hr"] is not None), r["id"]), lambda a, b: abs((a["start"] - b["start"]).total_seconds()) <= 900)
    got = cardio_dedup.dedupe_hub(cardio(spark, rows))
    assert {r.source_id for r in got.collect()} == want and set(got.columns) == set(schemas.columns("cardio_events"))


def test_resolution_against_stored(spark):
    t = dt.datetime(2024, 6, 8, 8)
    new = cardio(spark, [{"id": "n1", "source": "apple_health", "day": AS_OF, "min": 30, "app": "Nike Run Club", "start": t}, {"id": "n2", "source": "apple_health", "day": AS_OF, "min": 30, "app": "Fitbit", "start": t + dt.timedelta(hours=5)}])
    old = cardio(spark, [{"id": "o1", "source": "apple_health", "day": AS_OF, "min": 30, "app": "Fitbit", "start": t}, {"id": "o2", "source": "apple_health", "day": AS_OF, "min": 30, "app": "Strava", "start": t + dt.timedelta(hours=5)}])
    ins, gone = cardio_dedup.resolve(new, old)
    assert [r.source_id for r in ins.collect()] == ["n1"] and [r.source_id for r in gone.collect()] == ["o1"]
    ins, gone = cardio_dedup.resolve(new, old, allow_supersede=False)
    assert ins.count() == 0 and gone.count() == 0


def test_pace_quality(spark):
    d = spark.createDataFrame([(35.8333, 0.8642), (5.0, 3.0), (30.0, 3.0)], "duration_min double, distance_miles double").withColumn("activity_type", F.lit("Outdoor Run"))
    r = d.select(F.size(P.pace_flags()).alias("n"), P.over_recorded().alias("o")).collect()
    assert [(x.n, x.o) for x in r] == [(1, False), (1, True), (0, False)]


def test_power(spark):
    rows = [("u", i, float(w)) for i, w in enumerate([100] * 10 + [300] * 5 + [100] * 10)]
    s = spark.createDataFrame(rows, "ride_id string, i int, watts double")
    assert {r.duration: r.watts for r in power.mean_maximal(s, durations=(5, 10, 60)).collect()} == {5: 300.0, 10: 200.0}
    assert power.normalized(s).first().normalized_power is None
    odd = spark.createDataFrame([("r", i, w) for i, w in enumerate([-50.0, None, float("nan")] * 20)], "ride_id string, i int, watts double")
    assert power.normalized(odd).first().normalized_power == 0.0 and {r.duration: r.watts for r in power.mean_maximal(odd, durations=(5,)).collect()} == {5: -10.0}

    def ftp(curve):
        r = power.threshold(spark.createDataFrame([("u", k, float(v)) for k, v in curve.items()], "user_id string, duration int, watts double")).first()
        return r.ftp_method, round(r.ftp_watts, 1) if r.ftp_watts is not None else None

    assert ftp({300: 300, 720: 270, 1200: 258, 1800: 210, 3600: 190}) == ("mmp_60", 190.0)
    assert ftp({300: 269, 720: 257, 1200: 251.8, 1800: 217.8, 3600: 140.6}) == ("coggan_20min", round(251.8 * 0.9, 1))
    assert ftp({300: 269, 1200: 251.8, 3600: 140.6}) == ("coggan_20min", round(251.8 * 0.9, 1))
    assert ftp({300: 300, 720: 270, 1200: 260, 1800: 200}) == ("mmp_30", 190.0)
    assert ftp({5: 900}) == ("insufficient_data", None)
    cp = power.critical_power(spark.createDataFrame([("u", t, 250 + 15000 / t) for t in (300, 720, 1200)], "user_id string, duration int, watts double")).first()
    assert abs(cp.cp - 250) < 1e-6 and abs(cp.w_prime - 15000) < 1e-3
    ride = spark.createDataFrame([("r", dt.datetime(2024, 1, 1, 0, 0, s), w) for s, w in ((0, 10.0), (1, None), (5, 20.0), (5, 30.0))], "ride_id string, ts timestamp, watts double")
    assert [r.watts for r in power.resample(ride).orderBy("i").collect()] == [10.0, 10.0, 10.0, None, None, 30.0]


def test_sleep_score(spark):
    one = spark.range(1)
    v = lambda h, **k: one.select(scores.sleep_score(F.lit(h).cast("double"), *[F.lit(k.get(n)).cast("double") for n in ("deep", "rem", "rhr", "hrv")], resting_hr_baseline=F.lit(k.get("rb")).cast("double"))).first()[0]
    assert v(8.0) == 100 and v(None) is None and v(0.0) is None
    assert 77 <= v(6.9167, deep=1.0167, rem=1.6667, rhr=58.0, rb=58.0) <= 81
    m = spark.createDataFrame([("u", D(2024, 1, 1), 50.0), ("u", D(2024, 1, 2), 60.0), ("u", D(2024, 1, 3), 999.0)], "user_id string, metric_date date, x double")
    assert [r[0] for r in m.select(sleep.trailing_baseline("x")).collect()] == [None, None, 55.0]


def test_streaks(spark):
    d = spark.createDataFrame([("u", D(2024, 7, x)) for x in (8, 9, 10, 12, 13, 14)], "user_id string, d date")
    assert tuple(calendar.streaks(d, "2024-07-14").first())[1:] == (3, 3, 6)
    assert calendar.streaks(d, "2024-07-15").first().current_streak == 3 and calendar.streaks(d, "2024-07-16").first().current_streak == 0


def test_anomalies_and_correlation(spark):
    day = D(2024, 1, 1)
    hist = [("u", day + dt.timedelta(i), "hrv_rmssd", 50 + (i % 5) * 0.35) for i in range(20)] + [("u", day + dt.timedelta(20), "hrv_rmssd", 28.0)]
    z = stats.z_scores(spark.createDataFrame(hist, "user_id string, d date, metric string, value double")).collect()
    assert len(z) == 1 and z[0].direction == "below_baseline" and z[0].z < -2
    steps = [("u", day + dt.timedelta(i), "steps", 8000.0 + (i % 4) * 100) for i in range(20)] + [("u", day + dt.timedelta(20), "steps", 25000.0)]
    q = stats.iqr_outliers(spark.createDataFrame(steps, "user_id string, d date, metric string, value double"), "2024-01-21").first()
    assert q.direction == "above_baseline"
    down = spark.createDataFrame([("u", day + dt.timedelta(i), "sleep_hours", 8 - 0.08 * i) for i in range(30)], "user_id string, d date, metric string, value double")
    assert stats.ewma_drift(down).first().direction == "declining"
    pair = spark.createDataFrame([("u", day + dt.timedelta(i), m, x) for i in range(20) for m, x in (("a", 6 + (i % 5) * 0.3), ("b", 2 + 1.5 * (6 + (i % 5) * 0.3)), ("c", 1.0))], "user_id string, d date, metric string, value double")
    r = stats.lagged_correlations(pair, (("a", "b"), ("a", "c")), lags=(0,)).collect()
    assert len(r) == 1 and r[0].correlation > 0.99


def test_ramp_goals_and_phases(spark):
    w = spark.createDataFrame([("u", D(2024, 6, 3), 10.0), ("u", D(2024, 6, 10), 20.0)], "user_id string, week_start date, running_km double")
    r = {x.week_start: x for x in pace.mileage_ramp(w).collect()}[D(2024, 6, 10)]
    assert r.flag == "mileage_spike" and r.change_pct == 100.0
    p = spark.createDataFrame([("u", "a", "base", "A", D(2024, 6, 1), D(2024, 6, 30), True), ("u", "b", "build", "B", D(2024, 6, 5), D(2024, 6, 20), None), ("u", "c", "peak", "C", D(2024, 6, 6), D(2024, 6, 20), False), ("u", "d", "x", "N", D(2024, 7, 1), D(2024, 7, 9), True)], "user_id string, id string, phase_type string, name string, start_date date, end_date date, is_active boolean")
    c = joins.phase_context(p, "2024-06-08").first()
    assert c.active.name == "B" and [u.name for u in c.upcoming] == ["N"] and len(c.phases) == 3
    g = spark.createDataFrame([("u", "strength_sessions", 3.0, 4.0, None, True, None, None)], "user_id string, goal_type string, target_min double, target_max double, target_label string, is_active boolean, effective_from date, effective_until date")
    none = spark.createDataFrame([], "user_id string, start_date date, end_date date, affected_goal_types array<string>, override_hint string, reason string")
    s = sets(spark, [(D(2024, 6, 3), 5, 100, "working", None)])
    st = goals.goal_status(g, s, none, "2024-06-09").first()
    assert (st.completed, st.target, st.status) == (1, "3-4x", "urgent")
    off = spark.createDataFrame([("u", D(2024, 6, 8), D(2024, 6, 10), ["strength_sessions"], "Travel", None)], none.schema)
    assert goals.goal_status(g, s, off, "2024-06-09").first().status == "skipped"
    snap = goals.goal_snapshot(g, s, spark.createDataFrame([], "user_id string, source string, source_id string, session_date date, run_type string, distance_km double, duration_min double"), cardio(spark, []), none, spark.createDataFrame([], "user_id string, event_date date, category string, description string"), "2024-06-09").first()
    assert snap.todays_focus.startswith("Strength needed")


def test_summaries_have_a_row_for_each_user(spark):
    s = sets(spark, [(days_ago(i), 5, 100 + i, "working", None) for i in range(0, 40, 2)])
    c = cardio(spark, [{"day": days_ago(i), "min": 30, "mi": 3.0} for i in range(0, 40, 3)])
    assert strength.progress_summary(s, AS_OF.isoformat()).count() == 1
    p = pace.pace_summary(s, c, AS_OF.isoformat()).first()
    assert p.lifting.status in ("green", "yellow", "red") and p.message.startswith("Lifting")
    assert calendar.workout_calendar(s, c, AS_OF).first().current_week_streak >= 5


def test_provenance(spark):
    cases = [
        (["Strava|Fitbit"], "Fitbit"), (["Nike Run Club", "Strava|Health Sync"], "Nike Run Club"), (["Apple Watch", "iPhone"], "Apple Watch"), (["Mason's Apple Watch"], "Mason's Apple Watch"), (["iPhone"], "iPhone"),
        (["SuperPhone"], None), (["Unknown App", "Fitbit"], "Fitbit"), (["SuperPhone|Health Sync|Nike Run Club"], "Health Sync"), ([None, " ", "Strava"], "Strava"), ([], None), (["Strava", "strava"], "Strava"), (["Google Fit", "Fitbit"], "Google Fit"), (["Strava " + "x" * 300], ("Strava " + "x" * 300)[:200]),
    ]
    d = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<string>").orderBy("i")
    assert [r[0] for r in d.select(S.best_app(F.col("c"))).collect()] == [w for _, w in cases]
    r = spark.createDataFrame([("Nike  Run   Club",), (" HEALTH\tsync ",), ("x",), (None,)], "a string").select(S.app_rank("a"), S.is_bridge("a")).collect()
    assert [tuple(x) for x in r] == [(40, False), (10, True), (15, False), (15, False)]


def test_heart_rate_and_briefing_text(spark):
    rows = [('{"Avg": {"qty": 140.4}, "Max": 171}', 1.0, 2.0), ('{"avg": 120, "max": {"qty": 150}}', 1.0, 2.0), ('[{"qty": 3}]', 99.6, 180.0), (None, None, 155.0)]
    d = spark.createDataFrame(rows, "b string, a double, m double")
    assert [tuple(r) for r in d.select(*S.heart_rate("b", "a", "m")).collect()] == [(140, 171), (120, 150), (100, 180), (None, 155)]
    notes = ["All good. How are you?", "One.\n\nReally? Yes?", "Why?", "Fine.", "Do it. Now! Or later?\n"]
    n = spark.createDataFrame([(x,) for x in notes], "n string")
    assert [r[0] for r in n.select(S.without_last_question("n")).collect()] == ["All good.", "One.", "Why?", "Fine.", "Do it. Now!"]
    t = n.limit(1).select(S.briefing_text(F.lit("# Hello\n\nRun today."), F.lit("2025-03-09").cast("date"), F.lit("## At a Glance")).alias("a"), S.briefing_text(F.lit("Morning Check-In\nRest."), F.lit("2025-03-09").cast("date")).alias("b")).first()
    assert t.a == "# Morning Check-In · Sunday, March 9\n\n## At a Glance\n\nRun today." and t.b == "# Morning Check-In · Sunday, March 9\n\nRest."


def test_resolution_with_null_ids(spark):
    from pulseframe import schemas
    from pulseframe.operators import cardio_dedup

    def rows(xs):
        return schemas.conform(spark.createDataFrame(xs, "user_id string, source string, source_id string, event_date string, activity_type string, duration_min double, started_at string, source_app string").withColumns({"event_date": F.col("event_date").cast("date"), "started_at": F.col("started_at").cast("timestamp")}), "cardio_events")

    new = rows([("u", "apple_health", None, "2024-01-01", "Run", 30.0, "2024-01-01 08:00:00", "Fitbit"), ("u", "apple_health", None, "2024-01-01", "Ride", 60.0, "2024-01-01 12:00:00", "Fitbit")])
    old = rows([("u", "apple_health", "s1", "2024-01-01", "Run", 30.0, "2024-01-01 08:05:00", "Strava")])
    ins, gone = cardio_dedup.resolve(new, old)
    assert [r.activity_type for r in ins.collect()] == ["Ride"] and gone.count() == 0
    ins, gone = cardio_dedup.resolve(old, new.withColumn("source_id", F.col("activity_type")))
    assert [r.source_id for r in ins.collect()] == ["s1"] and [r.source_id for r in gone.collect()] == ["Run"]


def test_scalar_functions(spark):
    t = spark.createDataFrame([("2024-01-02 03:04:05 +0200", "2024-01-02T01:04:05Z", "nonsense", "2024-01-02")], "a string, b string, c string, d string")
    r = t.select(*[S.instant(c).alias(c) for c in "abcd"]).first()
    assert r.a == r.b and r.c is None and r.d is not None
    u = spark.range(1).select(S.quantity_to_miles(F.lit(5.0), F.lit("km")).alias("km"), S.quantity_to_miles(F.lit(-1.0), F.lit("mi")).alias("neg"), S.stage_hours(F.lit(5400.0), F.lit(None).cast("string")).alias("s"), S.stage_hours(F.lit(90.0), F.lit("min")).alias("m"), S.sleep_hours(F.lit(28800.0), F.lit(None)).alias("h")).first()
    assert abs(u.km - 3.10685596) < 1e-6 and u.neg is None and u.s == 1.5 and u.m == 1.5 and u.h == 8.0
    f = spark.createDataFrame([("Throwing",), ("Outdoor Run",), ("  Indoor   CYCLING ",), (None,)], "x string").select(S.activity_family("x")).collect()
    assert [x[0] for x in f] == ["throwing", "run", "ride", "workout"]
    q = spark.createDataFrame([("Sure:\n```sql\nSELECT 1;\n```",)], "x string").select(S.fenced("x")).first()[0]
    assert q == "SELECT 1"


def sessions(rng, n, sources, hours=24):
    """Sessions of some users and days: with and without start, distance and id, equal rows, near ones."""
    t0 = dt.datetime(2024, 6, 1)
    out = []
    for i in range(n):
        day = rng.randrange(3)
        start = t0 + dt.timedelta(days=day, minutes=rng.randrange(hours * 60)) if rng.random() < 0.8 else None
        out.append({"user": rng.choice(["a", "b", None]), "source": rng.choice(sources), "id": rng.choice([None, f"{rng.randrange(n)}"]), "day": (t0 + dt.timedelta(days=day)).date(), "type": rng.choice(["Run", "Ride"]), "min": rng.choice([None, 20.0, 24.0, 31.0, 60.0]), "mi": rng.choice([None, 3.0, 3.1, 5.0]), "app": rng.choice(["Strava", "Fitbit", None]), "start": start, "w": rng.choice([None, 200.0])})
        if rng.random() < 0.1:
            out.append(dict(out[-1]))
    return out


def frame(spark, rows):
    d = [(r["user"], r["source"], r["id"], r["day"], r["type"], r["min"], r["mi"], r["app"], r["start"], r["w"]) for r in rows]
    return schemas.conform(spark.createDataFrame(d, "user_id string, source string, source_id string, event_date date, activity_type string, duration_min double, distance_miles double, source_app string, started_at timestamp, avg_watts double"), "cardio_events").repartition(5)


def close(a, b, power):
    minutes = abs((a["min"] or 0) - (b["min"] or 0)) <= 5
    if power:
        if a["source"] == b["source"] and a["id"] is not None and a["id"] == b["id"]:
            return True
    else:
        minutes = minutes and (a["mi"] is None or b["mi"] is None or abs(a["mi"] - b["mi"]) <= 0.15)
    if a["start"] and b["start"]:
        return abs((a["start"] - b["start"]).total_seconds()) <= 900
    return minutes


def rank_of(r, power):
    if power:
        return ({"wahoo_fit": 50, "strava_export": 40, "strava": 25}[r["source"]], 2 * (r["mi"] is not None) + 5 * (r["w"] is not None), r["id"] or "")
    pace = r["type"] == "Run" and r["min"] and r["mi"] and r["min"] * 60 / r["mi"]
    return ({"Strava": 30, "Fitbit": 10, None: 15}[r["app"]], 0 if pace and not 210 <= pace <= 1080 else 1, 2 * (r["mi"] is not None), r["id"] or "")


def test_greedy_resolution_without_starts_distances_and_ids(spark):
    """Both kinds against a plain fold; keys of equal rank are told apart by ids, equal rows once."""
    for power, sources in ((False, ["apple_health"]), (True, ["wahoo_fit", "strava_export", "strava"])):
        rng = random.Random(7 + power)
        rows = [r for r in sessions(rng, 400, sources) if r["id"] is not None or rng.random() < 0.2]
        groups = {}
        for r in rows:
            groups.setdefault((r["user"], r["day"], r["type"]), []).append(r)
        got = (cardio_dedup.dedupe_power if power else cardio_dedup.dedupe_hub)(frame(spark, rows)).collect()
        left = {}
        for r in got:
            left.setdefault((r.user_id, r.event_date, r.activity_type), []).append({"source": r.source, "id": r.source_id, "min": r.duration_min, "mi": r.distance_miles, "app": r.source_app, "start": r.started_at, "w": r.avg_watts, "type": r.activity_type})
        assert set(left) == set(groups) and len(got) < len(rows)
        for g, members in groups.items():
            # a greedy result: no two near, and whatever is missing is near to one kept of at least its rank
            stay = left[g]
            assert not any(close(a, b, power) for i, a in enumerate(stay) for b in stay[:i])
            for r in members:
                me = {k: v for k, v in r.items() if k not in ("user", "day")}
                assert me in stay or any(close(r, k, power) and rank_of(k, power) >= rank_of(r, power) for k in stay), (g, r)


def test_greedy_resolution_of_a_large_group(spark):
    """A hundred thousand sessions of one user and day, in one pass that holds only those kept."""
    df = spark.range(100_000).select(F.lit("u").alias("user_id"), F.lit("apple_health").alias("source"), F.format_string("%06d", "id").alias("source_id"), F.lit("2024-06-01").cast("date").alias("event_date"), F.lit("Run").alias("activity_type"), F.lit(30.0).alias("duration_min"), F.timestamp_seconds(1717200000 + F.pmod(F.xxhash64("id"), F.lit(86400))).alias("started_at"))
    at = [(r.source_id, int(r.started_at.timestamp())) for r in df.select("source_id", "started_at").collect()]
    kept = []
    for i, t in sorted(at, reverse=True):
        if all(abs(t - x) > 900 for _, x in kept):
            kept.append((i, t))
    assert {r.source_id for r in cardio_dedup.dedupe_hub(schemas.conform(df, "cardio_events")).collect()} == {i for i, _ in kept}


def test_equal_incoming_rows_stay_two(spark):
    """JOIN-06, JOIN-07: rows of sources that aren't resolved are all inserted, equal ones too."""
    c = frame(spark, [{"user": "u", "source": "other", "id": None, "day": AS_OF, "type": "Run", "min": 30.0, "mi": None, "app": None, "start": None, "w": None}] * 2)
    for power in (False, True):
        new, gone = cardio_dedup.resolve(c, c.limit(0), power=power)
        assert new.count() == 2 and gone.count() == 0 and new.columns == c.columns
