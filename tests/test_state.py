"""State that is carried on: monthly statistics, and sessions resolved as a stream."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from pulseframe import schemas
from pulseframe.operators import cardio_dedup, running, stats
from pulseframe.sinks.store import Store
from pulseframe.streaming import resolve

D = dt.date
LONG = "user_id string, d date, metric string, value double"


def test_only_changed_months_are_made_again(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame([("u", *x) for x in r], "user_id string, metric_date date, sleep_hours double")
    s.upsert("daily_health_metrics", rows(*[(D(2024, m, d), float(d % 5)) for m in (1, 2, 3) for d in range(1, 20)]))

    def derive(before):
        with s.transaction() as t:
            return t.derive("metric_moments", "daily_health_metrics", lambda d: running.moments(stats.to_long(d, ["sleep_hours"])), before)

    got = lambda: {(r.month.month): (r.n, round(r.mean, 6)) for r in s.read("metric_moments").collect()}
    assert derive("2024-03") == {"2024-01", "2024-02"} and derive("2024-03") == set()
    assert got() == {1: (19, round(sum(d % 5 for d in range(1, 20)) / 19, 6)), 2: (19, round(sum(d % 5 for d in range(1, 20)) / 19, 6))}
    s.upsert("daily_health_metrics", rows((D(2024, 1, 31), 50.0)))  # a late correction
    assert derive("2024-03") == {"2024-01"} and got()[1][0] == 20 and derive("2024-04") == {"2024-03"}
    s.replace("daily_health_metrics", rows((D(2024, 2, 1), 1.0)))
    assert derive("2024-04") == {"2024-01", "2024-02", "2024-03"} and got() == {2: (1, 1.0)}


def test_merged_months_equal_all_days(spark):
    rng = random.Random(5)
    rows = [(u, D(2023, 11, 1) + dt.timedelta(i), m, float(rng.choice([50, 51, 52, 90, 1e6]) if m == "hrv_rmssd" else rng.randrange(6))) for u in "ab" for m in ("hrv_rmssd", "steps") for i in range(150) if rng.random() < 0.8]
    long = spark.createDataFrame(rows, LONG).cache()
    key = lambda r: (r.user_id, r.metric_date, r.metric, r.sample_n if "sample_n" in r else None, r.direction)
    for first in (D(2023, 11, 1), D(2024, 1, 1), D(2024, 3, 1)):
        month, before = long.where((F.col("d") >= F.lit(first)) & (F.trunc("d", "month") == F.lit(first))), long.where(F.col("d") < F.lit(first))
        want = {key(r): r.z for r in stats.z_scores(long).where(F.trunc("metric_date", "month") == F.lit(first)).collect()}
        got = {key(r): r.z for r in running.z_scores(running.merged(running.moments(before)), month).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        day = (first + dt.timedelta(days=13)).isoformat()
        want = sorted(tuple(r) for r in stats.iqr_outliers(long, day).collect())
        assert sorted(tuple(r) for r in running.iqr_outliers(running.counts(before), month, day).collect()) == want


CARDIO = "user_id string, source string, source_id string, event_date date, activity_type string, duration_min double, source_app string, started_at timestamp"


def test_late_and_corrected_sessions_change_sides(spark, tmp_path):
    day = D(2024, 6, 1)
    at = lambda m, d=day: dt.datetime(d.year, d.month, d.day, 8, m)
    s = lambda i, app, m, minutes=30.0, d=day, **k: ("u", "apple_health", i, d, "Run", minutes, app, at(m, d) if m is not None else None)
    batches = [
        [s("a", "Fitbit", 0), s("b", "Fitbit", 40)],
        [s("a", "Fitbit", 0), s("c", "Nike Run Club", 10)],  # a once more, a better one beside it
        [s("c", "Nike Run Club", 30), s("d", None, None), s(None, "Strava", 55)],  # c moves to b
        [s("z", "Fitbit", 0, d=D(2024, 9, 1))],  # the watermark passes
        [s("y", "Fitbit", 0, d=D(2024, 9, 1))],
        [s("e", "Nike Run Club", 0)],  # too late for its day
    ]
    for k, rows in enumerate(batches):
        schemas.conform(spark.createDataFrame(rows, CARDIO), "cardio_events").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        f = next((tmp_path / f"in/{k}").glob("*.parquet"))
        import os

        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/0")).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    said = {}

    def note(df, n):
        said[n] = {(r.source_id, r.kept) for r in df.collect()}
        df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))

    resolve.resolve_stream(stream, late_days=7).writeStream.foreachBatch(note).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert said[0] == {("a", True), ("b", True)}
    assert said[1] == {("a", False), ("c", True)}
    assert said[2] == {("a", True), ("b", False), (None, True)} or said[2] >= {("a", True), ("b", False)}
    assert all(("e", True) not in x for x in said.values())
    kept = {r.source_id for r in resolve.current(spark.read.schema(f"{resolve.CHANGES}, batch long").parquet(str(tmp_path / "out"))).where(F.col("event_date") == F.lit(day)).collect()}
    final = [s("a", "Fitbit", 0), s("b", "Fitbit", 40), *batches[2]]
    assert kept == {r.source_id for r in cardio_dedup.dedupe_hub(schemas.conform(spark.createDataFrame(final, CARDIO), "cardio_events")).collect()}


def test_scores_at_the_limit_are_settled_day_by_day(spark):
    rng, rows = random.Random(3), []
    want, near = set(), 0
    for u in range(4000):
        xs = [float(rng.choice([51, 52, 53])) for _ in range(rng.randrange(5, 15))] + [float(rng.choice([50, 54, 55]))]
        n = mean = m2 = 0.0
        for x in xs[:-1]:
            n, was = n + 1, mean
            mean += (x - was) / n
            m2 += (x - mean) * (x - was)
        if m2 > 0:
            z = (xs[-1] - sum(xs[:-1]) / n) / math.sqrt(m2 / (n - 1))
            near += abs(abs(z) - 2) < 1e-9
            want |= {str(u)} if abs(z) > 2 else set()
        rows += [(str(u), D(2024, 1, 31) - dt.timedelta(i), "resting_hr", x) for i, x in enumerate(xs[-2::-1])] + [(str(u), D(2024, 2, 1), "resting_hr", xs[-1])]
    long = spark.createDataFrame(rows, LONG).cache()
    month, before = long.where("d >= '2024-02-01'"), running.merged(running.moments(long.where("d < '2024-02-01'")))
    found = running.z_scores(before, month, least=5, limit=2.0 - running.TOLD_APART)
    assert near > 10 and {r.user_id for r in running.settled(found, long, 2.0).collect()} == want


def test_state_lies_in_shards_not_in_a_value_for_each_group(spark, tmp_path):
    rng = random.Random(9)
    row = lambda u, j: (f"u{u}", "apple_health", f"{u}-{j}" if rng.random() < 0.9 else None, D(2024, 6, 1), rng.choice(["Run", "Ride", 'a "b"']), rng.choice([30.0, 33.0, float("nan"), None]), rng.choice(["Fitbit", "Strava", None]), dt.datetime(2024, 6, 1, 8, rng.randrange(60)) if rng.random() < 0.8 else None)
    rows = schemas.conform(spark.createDataFrame([row(u, j) for u in range(2000) for j in range(2)], CARDIO), "cardio_events").withColumn("part", F.pmod(F.xxhash64("user_id", "source_id", "duration_min"), F.lit(2)))
    rows.repartition("part").write.partitionBy("part").parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in")).drop("part")
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    keep = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
    q = resolve.resolve_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 1000
    named = lambda d: sorted((r.user_id, r.source_id) for r in d.where("source_id is not null").collect())
    assert named(resolve.current(spark.read.schema(f"{resolve.CHANGES}, batch long").parquet(str(tmp_path / "out")))) == named(cardio_dedup.dedupe_hub(stored))
