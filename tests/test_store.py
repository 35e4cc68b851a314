"""The commit log: several tables in one commit, batches once, crashes, buckets, upkeep."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.sinks import store as stores
from pulseframe.sinks.store import Store
from pulseframe.streaming import ingest

D = dt.date


def cardio(spark, rows):
    return spark.createDataFrame([(str(u), f"s{i}", D(2024, 1, 1 + i % 28), float(v)) for u, i, v in rows], "user_id string, source_id string, event_date date, duration_min double")


def export(spark, steps, *runs, user="u"):
    """steps on a day, runs as (id, app, minute)."""
    p = {"data": {"metrics": [{"name": "step_count", "data": [{"qty": steps, "date": "2024-06-01"}]}], "workouts": [{"id": i, "name": "Outdoor Run", "start": f"2024-06-01 08:{m:02d}:00 +0000", "duration": 1800, "heartRate": [{"qty": 1, "source": app}]} for i, app, m in runs]}}
    return spark.createDataFrame([(user, json.dumps(p))], "user_id string, raw string")


def state(s):
    return sorted((r.source_id, r.source_app) for r in s.read("cardio_events").collect()), sorted((r.metric, r.value) for r in s.read("biometrics").collect())


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), buckets=4)
    assert ingest.apply_payloads(s, export(spark, 10, ("a", "Fitbit", 0)), stream="x", batch=0)
    before = state(s)
    assert before == ([("a", "Fitbit")], [("steps", 10.0)])
    second = export(spark, 20, ("b", "Nike Run Club", 5), ("c", "Fitbit", 50))
    # an error after each of the writes in turn, and while the manifest is written or renamed
    calls = {"n": 0}
    real, publish = stores.Transaction._dealt, Store._publish

    def failing(at):
        def dealt(self, *a):
            out = real(self, *a)
            calls["n"] += 1
            if calls["n"] == at:
                raise OSError("lost")
            return out

        return dealt

    for at in (1, 2):
        calls["n"] = 0
        monkeypatch.setattr(stores.Transaction, "_dealt", failing(at))
        with pytest.raises(OSError):
            ingest.apply_payloads(s, second, stream="x", batch=1)
        assert calls["n"] == at and state(s) == before and s.applied("x") == 0
    monkeypatch.setattr(stores.Transaction, "_dealt", real)

    def half(self, was, manifest):  # the process dies while it writes the hidden file
        (tmp_path / stores.LOG / ".half.json").write_text("{")
        raise OSError("lost")

    monkeypatch.setattr(Store, "_publish", half)
    with pytest.raises(OSError):
        ingest.apply_payloads(s, second, stream="x", batch=1)
    monkeypatch.setattr(Store, "_publish", publish)
    assert state(s) == before
    assert ingest.apply_payloads(s, second, stream="x", batch=1)
    after = state(s)
    assert after == ([("b", "Nike Run Club"), ("c", "Fitbit")], [("steps", 20.0)])
    # the number decides, not the rows; another stream has its own
    assert not ingest.apply_payloads(s, export(spark, 99, ("z", "Fitbit", 30)), stream="x", batch=1) and state(s) == after
    assert ingest.apply_payloads(s, second, stream="y", batch=0) and state(s) == after
    assert (s.applied("x"), s.applied("y"), s.applied("none")) == (1, 0, None)
    assert not [p for t in ("cardio_events", "biometrics") for p in (tmp_path / t).iterdir() if p.name.startswith("staged-")]


def test_unauthenticated_batches_replace_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=4)
    ingest.apply_payloads(s, export(spark, 10, ("a", "Fitbit", 0)))
    ingest.apply_payloads(s, export(spark, 30, ("b", "Nike Run Club", 5), ("c", "Nike Run Club", 50)), authenticated=False)
    assert state(s) == ([("a", "Fitbit"), ("c", "Nike Run Club")], [("steps", 30.0)])


def test_merges_touch_their_buckets_only(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=32)
    rng = random.Random(1)
    rows = {(u, i): rng.random() for u in range(300) for i in range(rng.randint(1, 4))}
    s.upsert("cardio_events", cardio(spark, [(u, i, v) for (u, i), v in rows.items()]))
    parts = lambda: s._state()[1]["tables"]["cardio_events"]["parts"]
    old = parts()
    assert len(old) == 32
    ten = [(u, 0, -1.0) for u in range(0, 20, 2)]
    s.upsert("cardio_events", cardio(spark, ten))
    rows |= {(u, i): v for u, i, v in ten}
    assert 1 <= len([p for p in old if parts()[p] != old[p]]) <= 10
    was = parts()
    s.insert_new("cardio_events", cardio(spark, [(5, 0, 7.0), (1000, 1, 7.0)]))
    rows[1000, 1] = 7.0
    assert len([p for p in was if parts()[p] != was[p]]) <= 2
    was = parts()
    with s.transaction() as t:
        t.change("cardio_events", cardio(spark, [(2000, 3, 1.0)]), cardio(spark, [(5, 0, 0), (77, 9, 0)]))
        assert t.read("cardio_events").count() == len(rows)
    rows[2000, 3] = rows.pop((5, 0)) * 0 + 1.0
    assert len([p for p in was if parts()[p] != was[p]]) <= 3
    got = lambda **k: {(int(r.user_id), int(r.source_id[1:])): r.duration_min for r in s.read("cardio_events", **k).collect()}
    assert got() == rows
    some = spark.createDataFrame([("7",), ("2000",), ("none",)], "user_id string")
    assert got(users=some) == {k: v for k, v in rows.items() if k[0] in (7, 2000)}
    read = s.read("cardio_events", users=some).inputFiles()
    assert len({f.split("part=")[1].split("/")[0] for f in read}) <= 3
    assert got(since=D(2024, 1, 3), until=D(2024, 1, 3)) == {k: v for k, v in rows.items() if k[1] == 2}
    s.compact("cardio_events", buckets=5)
    assert got() == rows and len(parts()) == 5
    s.upsert("cardio_events", cardio(spark, [(5, 0, 3.0)]))
    assert got() == rows | {(5, 0): 3.0}


def test_old_versions_go_and_kept_ones_stay(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=4)
    for k in range(4):
        s.upsert("cardio_events", cardio(spark, [(u, 0, k) for u in range(20)]))
        s.upsert("goals", spark.createDataFrame([("u", f"g{k}")], "user_id string, goal_type string"))
    folders = lambda t: {p.name for p in (tmp_path / t).iterdir()}
    assert len(folders("cardio_events")) == 4 and s.vacuum(keep=1) == 0  # too young
    assert len(s._numbers()) == 1
    assert s.vacuum(keep=1, hours=0) == 6 and len(folders("cardio_events")) == 1 and len(folders("goals")) == 1
    assert {r.duration_min for r in s.read("cardio_events").collect()} == {3.0} and s.read("goals").count() == 4
    s.upsert("goals", spark.createDataFrame([("v", "g")], "user_id string, goal_type string"))
    assert s.read("goals").count() == 5


def test_of_two_writers_one_fails(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    goal = lambda u: spark.createDataFrame([(u, "g")], "user_id string, goal_type string")
    s.upsert("goals", goal("a"))
    with pytest.raises(RuntimeError, match="another writer"):
        with s.transaction() as t:
            t.upsert("goals", goal("b"))
            s.upsert("goals", goal("c"))
    assert {r.user_id for r in s.read("goals").collect()} == {"a", "c"}
    assert len([p for p in (tmp_path / "goals").iterdir() if p.name.startswith("v-")]) == 2
    with pytest.raises(Exception, match="already exists|AlreadyExists"):  # the rename itself doesn't overwrite
        real = s._numbers
        s._numbers = lambda: [0]
        try:
            s._publish(0, {"tables": {}, "batches": {}})
        finally:
            s._numbers = real
    assert s.read("goals").count() == 2


def test_scopes_by_month(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame([("u", D(2024, m, d), k, "hrv") for m, d, k in r], "user_id string, detected_date date, anomaly_type string, metric string")
    s.replace("anomaly_events", rows((1, 5, "statistical"), (2, 5, "statistical"), (2, 5, "llm"), (2, 6, "statistical")))
    old = s._state()[1]["tables"]["anomaly_events"]["parts"]
    scope = s.read("anomaly_events", D(2024, 2, 5), D(2024, 2, 5)).where("anomaly_type = 'statistical'")
    with s.transaction() as t:
        t.replace_matching("anomaly_events", rows((2, 5, "statistical"), (2, 5, "statistical")), scope, ["user_id", "detected_date", "anomaly_type"])
    new = s._state()[1]["tables"]["anomaly_events"]["parts"]
    assert new["2024-01"] == old["2024-01"] and new["2024-02"] != old["2024-02"]
    assert sorted((r.detected_date, r.anomaly_type) for r in s.read("anomaly_events").collect()) == [(D(2024, 1, 5), "statistical"), (D(2024, 2, 5), "llm"), (D(2024, 2, 5), "statistical"), (D(2024, 2, 5), "statistical"), (D(2024, 2, 6), "statistical")]
    with pytest.raises(ValueError, match="left their parts"):
        with s.transaction() as t:
            t.rewrite("anomaly_events", {"2024-01"}, lambda old: old.withColumn("detected_date", F.add_months("detected_date", 1)))
