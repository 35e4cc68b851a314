"""Sources, sinks, guarded SQL, jobs and streaming."""

import datetime as dt
import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from pulseframe import schemas
from pulseframe.plans import bounded_sql, jobs
from pulseframe.sinks import tables as sinks
from pulseframe.sinks.store import Store
from pulseframe.sources import files, vendors
from pulseframe.sources import fit as fit_files
from pulseframe.streaming import ingest

D = dt.date


def raw(spark, *payloads):
    return spark.createDataFrame([("u", p if isinstance(p, str) else json.dumps(p)) for p in payloads], "user_id string, raw string")


def test_strength_page(spark):
    page = {"page": 1, "page_count": 1, "workouts": [{"id": "w", "start_time": "2024-06-01T10:00:00Z", "exercises": [{"index": 0, "title": "Bench Press", "sets": [{"index": 0, "type": "warmup", "weight_kg": 60, "reps": 10}, {"index": 1, "type": "normal", "weight_kg": 90, "reps": 5}, None]}]}, {"id": None, "start_time": "x", "exercises": []}]}
    r = vendors.strength_sets(raw(spark, page, "not json")).orderBy("set_number").collect()
    assert [(x.set_number, x.set_type, x.weight_lbs) for x in r] == [(1, "warmup", 132.2774), (2, "working", 198.4160)]


def test_cardio_page(spark):
    a = [{"id": 7, "name": "Morning", "distance": 5000.0, "moving_time": 1500, "total_elevation_gain": 10, "type": "Run", "start_date": "2024-06-01T05:00:00Z", "start_date_local": "2024-06-01T07:00:00Z", "average_heartrate": 150.4, "kilojoules": 100}, {"id": 8, "type": "Run"}]
    r = vendors.cardio_sessions(raw(spark, a)).collect()
    assert len(r) == 1 and r[0].distance_miles == 3.1069 and r[0].duration_min == 25.0 and r[0].avg_hr == 150 and abs(r[0].calories - 23.9006) < 1e-6 and r[0].avg_pace_sec_mi == 483


def test_health_export(spark):
    p = {"data": {"metrics": [{"name": "step_count", "units": "count", "data": [{"qty": 100, "date": "2024-06-01 08:00:00 +0200"}, {"qty": 200, "date": "2024-06-01 09:00:00 +0200"}, {"qty": 150, "date": "2024-06-02 08:00:00 +0200"}]}, {"name": "sleep_analysis", "units": "hr", "data": [{"date": "2024-06-01", "totalSleep": 7.5, "deep": 1.6, "rem": 1.9}]}, {"name": "body mass", "units": "kg", "data": [{"qty": 70, "date": "2024-06-01"}]}, {"name": "unknown", "data": []}]}}
    e = {"event_date": "2024-06-03", "metrics": [{"metric": "resting_hr", "value": 52, "unit": "bpm"}, {"metric": "nope", "value": 1}]}
    got = {(str(r.event_date), r.metric): r.value for r in vendors.health_payloads(raw(spark, p, e)).collect()}
    assert got[("2024-06-01", "steps")] == 300 and got[("2024-06-02", "steps")] == 150 and got[("2024-06-01", "sleep_hours")] == 7.5 and got[("2024-06-01", "sleep_deep_hrs")] == 1.6
    assert got[("2024-06-01", "body_weight_lbs")] == 154.3236 and got[("2024-06-03", "resting_hr")] == 52 and len(got) == 7


def test_workouts(spark):
    p = {"data": {"workouts": [{"id": "a", "name": "Outdoor Run", "start": "2024-06-01 08:00:00 +0000", "end": "2024-06-01 08:30:00 +0000", "duration": 1800, "distance": {"qty": 5, "units": "km"}, "heartRate": [{"qty": 1, "source": "Apple Watch|Strava"}]}, {"name": "Walk", "start": "2024-06-02 08:00:00 +0000", "end": "2024-06-02 08:20:00 +0000"}, {"id": "z", "name": "Bad", "start": "2024-06-02 08:00:00 +0000", "end": "2024-06-02 08:00:00 +0000"}]}}
    r = {x.activity_type: x for x in vendors.workouts(raw(spark, p)).collect()}
    assert set(r) == {"Outdoor Run", "Walk"} and r["Outdoor Run"].duration_min == 30 and r["Outdoor Run"].distance_miles == 3.1069 and r["Outdoor Run"].source_app == "Strava"
    assert r["Walk"].duration_min == 20 and r["Walk"].source_id.startswith("hae:")


def test_calendar(spark):
    e = spark.createDataFrame([("u", "", "2024-06-01", "2024-06-03"), ("u", "Meet", "2024-06-01", "2024-06-01")], "user_id string, title string, start string, end string")
    assert {r.description for r in vendors.calendar_blocks(e).collect()} == {"Busy (2024-06-01 – 2024-06-03)", "Meet"}


def fit(seconds, watts):
    fields = bytes([253, 4, 0x86, 7, 2, 0x84])
    body = bytes([0x40, 0, 0]) + struct.pack("<HB", 20, 2) + fields
    for s, w in zip(seconds, watts):
        body += bytes([0]) + struct.pack("<IH", s, 0xFFFF if w is None else w)
    whole = struct.pack("<BBHI4sH", 14, 16, 2132, len(body), b".FIT", 0) + body
    return whole + struct.pack("<H", fit_files.crc16(whole))


TCX = b"""<?xml version="1.0"?><TrainingCenterDatabase xmlns="http://x"><Activities><Activity Sport="Biking"><Lap><Track>
<Trackpoint><Time>2024-06-01T08:00:00Z</Time><DistanceMeters>0</DistanceMeters><HeartRateBpm><Value>120</Value></HeartRateBpm><Extensions><TPX xmlns="y"><Watts>200</Watts></TPX></Extensions></Trackpoint>
<Trackpoint><Time>2024-06-01T08:00:01Z</Time><DistanceMeters>10</DistanceMeters><HeartRateBpm><Value>130</Value></HeartRateBpm></Trackpoint></Track></Lap></Activity></Activities></TrainingCenterDatabase>"""
GPX = b'<gpx xmlns="z"><trk><type>running</type><trkseg><trkpt lat="1" lon="2"><ele>10</ele><time>2024-06-01T08:00:00Z</time></trkpt><trkpt lat="1" lon="2"><ele>15</ele><time>2024-06-01T08:10:00Z</time></trkpt></trkseg></trk></gpx>'


def test_activity_files(spark, tmp_path):
    top = tmp_path / "activities"
    top.mkdir()
    (top / "a.fit").write_bytes(fit(range(1_100_000_000, 1_100_000_060), [200] * 30 + [None] + [210] * 29))
    (top / "b.tcx.gz").write_bytes(gzip.compress(TCX))
    (top / "c.gpx").write_bytes(GPX)
    (top / "d.fit").write_bytes(b"garbage")
    (top / "n.txt").write_text("no")
    (tmp_path / "activities.csv").write_text("Activity Name,Filename\nLunch,activities/b.tcx.gz\n")
    found = files.discover(spark, str(tmp_path))
    assert found.count() == 4
    points = files.track_points(found)
    assert points.where("i is null").count() == 1
    r = {x.path.rsplit("/", 1)[-1]: x for x in files.session_rows(points, "u").collect()}
    assert r["a.fit"].avg_watts > 200 and r["a.fit"].normalized_power is not None and r["a.fit"].power_mmp_json["5"] == 210.0 and r["a.fit"].event_date == D(2024, 11, 8)
    assert r["b.tcx.gz"].max_hr == 130 and r["b.tcx.gz"].activity_type == "Ride" and r["b.tcx.gz"].avg_watts == 200
    assert r["c.gpx"].quality_flags == ["no_power"] and r["c.gpx"].activity_type == "Run" and r["c.gpx"].distance_miles is None
    from pulseframe.operators import joins

    t = joins.titles(found.select("path"), files.activity_titles(spark, str(tmp_path / "activities.csv")))
    assert {x.title for x in t.collect()} == {"Lunch", None}
    e = files.envelopes(found, "wahoo").first()
    assert set(json.loads(e.raw)) == {"filename", "source", "sha256", "payload_base64"}


def test_corpus_and_webhook(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: \"T\"\nauthor: Me\n---\nBody")
    (tmp_path / "README.md").write_text("no")
    r = files.transcripts(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].title == "T" and r[0].author == "Me" and r[0].text == "Body"
    assert files.decode_webhook({"A": ["b"]}, b'\xef\xbb\xbf{"x": 1}') == ({"a": "b"}, {"x": 1})
    with pytest.raises(ValueError, match="invalid_json"):
        files.decode_webhook({}, "{")


def test_sinks(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    m = lambda **k: spark.createDataFrame([("u", D(2024, 1, 1), *k.values())], "user_id string, metric_date date, " + ", ".join(f"{c} double" for c in k))
    s.upsert("daily_health_metrics", m(sleep_hours=7.0, hrv_rmssd=50.0))
    s.upsert("daily_health_metrics", m(hrv_rmssd=60.0))
    s.upsert("daily_health_metrics", m(ftp_watts=200.0))
    r = s.read("daily_health_metrics").collect()
    assert len(r) == 1 and (r[0].sleep_hours, r[0].hrv_rmssd, r[0].ftp_watts) == (7.0, 60.0, 200.0)
    s.upsert("daily_health_metrics", m(sleep_hours=8.0).withColumn("user_id", F.lit("v")))
    again = {x.user_id: x.updated_at for x in s.read("daily_health_metrics").collect()}
    assert again["u"] == r[0].updated_at and again["v"] > again["u"]
    with pytest.raises(Exception, match="null in the key"):
        s.upsert("daily_health_metrics", m(sleep_hours=7.0).withColumn("metric_date", F.lit(None).cast("date")))
    with pytest.raises(ValueError):
        schemas.conform(m(odd=1.0), "daily_health_metrics")
    c = spark.createDataFrame([("u", "1"), ("u", "1"), ("u", "2")], "user_id string, source_id string")
    s.insert_new("cardio_events", c)
    s.insert_new("cardio_events", c.withColumn("notes", F.lit("later")))
    assert {(x.source_id, x.notes) for x in s.read("cardio_events").collect()} == {("1", None), ("2", None)}
    assert sinks.delete_ids(s.read("cardio_events"), c.where("source_id = '1'")).count() == 1
    a = spark.createDataFrame([("u", D(2024, 1, 1), "statistical"), ("u", D(2024, 1, 1), "llm_pattern")], "user_id string, detected_date date, anomaly_type string")
    assert sinks.replace_matching(a, a.limit(0), a.where("anomaly_type = 'statistical'"), ["user_id", "detected_date", "anomaly_type"]).count() == 1
    p = schemas.conform(spark.createDataFrame([("u", "a", "b", 0, "active"), ("u", "a", "c", 0, "inactive"), ("v", "a", "b", 0, "active")], "user_id string, metric_a string, metric_b string, lag_days int, status string"), "metric_patterns")
    new = p.where("user_id = 'u' and metric_b = 'c'").withColumn("status", F.lit("active"))
    assert {(x.user_id, x.metric_b, x.status) for x in sinks.replace_patterns(p, new).collect()} == {("u", "c", "active"), ("v", "b", "active")}
    with pytest.raises(ValueError):
        sinks.phase_row("u", "1", "base", "n", D(2024, 2, 1), D(2024, 1, 1))
    assert sinks.to_html("# A\n- **b**\n- c\nd") == "<h1>A</h1>\n<ul>\n<li><strong>b</strong></li>\n<li>c</li>\n</ul>\n<p>d</p>"


def test_merges_touch_their_months_only(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame([("u", *x) for x in r], "user_id string, metric_date date, sleep_hours double")
    s.upsert("daily_health_metrics", rows((D(2024, 1, 31), 1.0), (D(2024, 2, 1), 2.0)))
    old = s._state()[1]["tables"]["daily_health_metrics"]["parts"]
    s.upsert("daily_health_metrics", rows((D(2024, 2, 1), 3.0), (D(2024, 2, 2), 4.0), (D(2024, 3, 1), 5.0)))
    new = s._state()[1]["tables"]["daily_health_metrics"]["parts"]
    assert set(new) == {"2024-01", "2024-02", "2024-03"} and new["2024-01"] == old["2024-01"] and new["2024-02"] != old["2024-02"]
    got = lambda *a, **k: sorted((r.metric_date, r.sleep_hours) for r in s.read("daily_health_metrics", *a, **k).collect())
    assert got() == [(D(2024, 1, 31), 1.0), (D(2024, 2, 1), 3.0), (D(2024, 2, 2), 4.0), (D(2024, 3, 1), 5.0)]
    assert got(D(2024, 2, 2), D(2024, 2, 29)) == [(D(2024, 2, 2), 4.0)] and got(until=D(2024, 1, 31)) == [(D(2024, 1, 31), 1.0)]
    s.upsert("daily_health_metrics", rows().limit(0))
    s.insert_new("daily_health_metrics", rows((D(2024, 3, 1), 9.0), (D(2024, 3, 2), 6.0)))
    assert got(since=D(2024, 3, 1)) == [(D(2024, 3, 1), 5.0), (D(2024, 3, 2), 6.0)]
    s.replace("daily_health_metrics", rows().limit(0))
    assert got() == [] and not [p for p in (tmp_path / "daily_health_metrics").iterdir() if p.name.startswith("staged-")]
    s.upsert("daily_health_metrics", rows((D(2024, 3, 1), 7.0)))
    assert got() == [(D(2024, 3, 1), 7.0)]


GOOD = "SELECT metric_date, sleep_hours FROM daily_health_metrics WHERE user_id = 'u' AND sleep_hours > 6 ORDER BY metric_date"
BAD = [
    "SELECT * FROM daily_health_metrics", "SELECT * FROM daily_health_metrics WHERE user_id = 'x'", "SELECT * FROM daily_health_metrics WHERE NOT user_id = 'u'", "SELECT * FROM daily_health_metrics WHERE user_id = 'u' OR 1 = 1",
    "SELECT * FROM secrets WHERE user_id = 'u'", "SELECT 1; DROP TABLE x", "DELETE FROM goals WHERE user_id = 'u'", "SELECT * FROM goals a JOIN goals b ON a.user_id = b.user_id WHERE a.user_id = 'u'", "SELECT * FROM goals WHERE user_id = 'u' UNION SELECT * FROM goals WHERE user_id = 'u'",
    "WITH x AS (SELECT * FROM goals) SELECT * FROM x WHERE user_id = 'u'", "SELECT * FROM (SELECT * FROM goals) g WHERE user_id = 'u'", "SELECT * FROM goals WHERE user_id = 'u' AND goal_type IN (SELECT goal_type FROM goals)", "SELECT reflect('java.lang.System', 'exit', 1) FROM goals WHERE user_id = 'u'", "SELECT * FROM goals WHERE user_id = 'u' -- x", "INSERT INTO goals SELECT * FROM goals WHERE user_id = 'u'",
]


def test_bounded_sql(spark):
    assert bounded_sql.check(spark, GOOD, "u").endswith("LIMIT 500")
    assert bounded_sql.check(spark, GOOD + " LIMIT 9999", "u").endswith("LIMIT 500") and bounded_sql.check(spark, GOOD + " LIMIT 5;", "u").endswith("LIMIT 5")
    bounded_sql.check(spark, "SELECT count(*), avg(sleep_hours) OVER () FROM daily_health_metrics WHERE user_id = 'u' GROUP BY sleep_hours HAVING count(*) > 1", "u")
    for sql in BAD:
        with pytest.raises(bounded_sql.Refused):
            bounded_sql.check(spark, sql, "u")
    m = spark.createDataFrame([("u", 7.0), ("v", 8.0)], "user_id string, sleep_hours double")
    tables = {"daily_health_metrics": m}
    assert [r.sleep_hours for r in bounded_sql.run(spark, "SELECT sleep_hours FROM daily_health_metrics WHERE user_id = 'u'", tables, "u").collect()] == [7.0]
    said = bounded_sql.ask(spark, "?", tables, "u", lambda a, b: "```sql\nSELECT sleep_hours FROM daily_health_metrics WHERE user_id = 'u'\n```")
    assert said["ok"] and said["rows"] == [{"sleep_hours": 7.0}]
    assert not bounded_sql.ask(spark, "?", tables, "u", lambda a, b: "DROP TABLE x")["ok"]


def test_statements_have_a_time_limit_and_sessions_of_their_own(spark):
    import threading
    import time

    endless = spark.range(0, 1 << 60, 1, 4).select(F.lit("u").alias("user_id"), F.col("id").cast("double").alias("sleep_hours"))
    t = time.time()
    with pytest.raises(bounded_sql.TimeLimit):
        bounded_sql.fetch(spark, "SELECT sum(sleep_hours) FROM daily_health_metrics WHERE user_id = 'u'", {"daily_health_metrics": endless}, "u", seconds=2)
    assert time.time() - t < 20 and not spark.sparkContext.statusTracker().getActiveJobsIds()
    said = bounded_sql.ask(spark, "?", {"daily_health_metrics": endless}, "u", lambda a, b: "SELECT sum(sleep_hours) FROM daily_health_metrics WHERE user_id = 'u'", seconds=1)
    assert not said["ok"] and "more than 1 seconds" in said["error"]
    m = spark.createDataFrame([(u, float(i)) for u in "abcd" for i in range(ord(u))], "user_id string, sleep_hours double")
    got = {}

    def one(u):
        got[u] = [bounded_sql.fetch(spark, f"SELECT user_id, count(*) AS n FROM daily_health_metrics WHERE user_id = '{u}' GROUP BY user_id", {"daily_health_metrics": m}, u)[0] for _ in range(3)]

    threads = [threading.Thread(target=one, args=(u,)) for u in "abcd"]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert {u: {(r.user_id, r.n) for r in rows} for u, rows in got.items()} == {u: {(u, ord(u))} for u in "abcd"}
    assert not [x for x in spark.catalog.listTables() if x.name == "daily_health_metrics"]


def seeded(spark, root):
    s = Store(spark, str(root))
    s.replace("user_settings", spark.createDataFrame([("u",), ("v",)], "user_id string"))
    day = D(2024, 1, 20)
    bio = [("u", "a", day - dt.timedelta(i), m, v, "k") for i in range(20) for m, v in (("sleep_hours", 5.0), ("hrv_rmssd", 50.0 - (i == 0) * 30 + i % 3), ("steps", 8000.0 + i))]
    s.replace("biometrics", spark.createDataFrame(bio, "user_id string, source string, event_date date, metric string, value double, raw_key string"))
    return s, day


def test_daily_job(spark, tmp_path):
    s, day = seeded(spark, tmp_path)
    box = tmp_path / "box"
    box.mkdir()

    def send(message):
        import uuid

        (box / uuid.uuid4().hex).write_text("|".join(message))

    rep = jobs.run_daily(s, day, send=send)
    assert rep.ok and [x[0] for x in rep] == ["rollup_metrics", "compute_features", "evaluate_rules", "goal_snapshot", "compute_stat_signals", "generate_briefing", "deliver"], rep
    f = {r.user_id: r for r in s.read("daily_features").collect()}
    assert set(f) == {"u", "v"} and f["u"].sleep_debt_7d == 3.0 and f["v"].overall_readiness_score is None
    b = {r.user_id: r for r in s.read("daily_briefings").collect()}
    assert "LOW_SLEEP" in b["u"].flags and sorted(p.read_text().split("|")[0] for p in box.iterdir()) == ["Daily briefing 2024-01-20"] * 2 and "SPARSE_RECOVERY_DATA" in b["v"].flags
    again = jobs.run_daily(s, day, llm=lambda t: (_ for _ in ()).throw(RuntimeError("down")), send=send)
    assert not again.ok and again[-1][0] == "generate_briefing" and s.read("daily_features").count() == 2
    assert jobs.run_daily(s, day, llm=lambda t: f"said {len(t)}", send=send).ok
    assert {(r.model_used, r.coaching_note[:5]) for r in s.read("daily_briefings").collect()} == {("llm", "said ")}

    def refuse(message):
        raise OSError("no line")

    assert sinks.deliver(s.read("daily_briefings"), refuse) == (0, 2)


def test_push_ingest_streams(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    w = lambda i, app, mins: {"id": i, "name": "Outdoor Run", "start": f"2024-06-01 08:{mins:02d}:00 +0000", "end": "2024-06-01 09:00:00 +0000", "duration": 1800, "heartRate": [{"qty": 1, "source": app}]}
    first = {"data": {"metrics": [{"name": "step_count", "data": [{"qty": 10, "date": "2024-06-01"}]}], "workouts": [w("a", "Fitbit", 0)]}}
    second = {"data": {"metrics": [{"name": "step_count", "data": [{"qty": 30, "date": "2024-06-01"}]}], "workouts": [w("b", "Nike Run Club", 5)]}}
    for p in (first, second, second):
        rows = raw(spark, p).withColumns({"source": F.lit("apple"), "day": F.lit("2024-06-01")})
        files.land(rows, str(tmp_path / "land"))
        ingest.stream_payloads(spark, str(tmp_path / "land/raw"), s, str(tmp_path / "cp")).awaitTermination()
    assert [r.source_id for r in s.read("cardio_events").collect()] == ["b"]
    assert [r.value for r in s.read("biometrics").where("metric = 'steps'").collect()] == [30.0]


def test_streaming_windows(spark, tmp_path):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1), "u", "view", 1.0), (1, dt.datetime(2024, 1, 1, 1), "u", "view", 1.0), (2, dt.datetime(2024, 1, 2, 1), "u", "view", 2.0)], "event_id long, ts timestamp, user_id string, event_type string, value double")
    e.write.parquet(str(tmp_path / "in"))
    q = ingest.daily_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("w").collect()) == [(1, 1.0), (1, 2.0)]


def test_entry_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "pulseframe", tmp_path / "pulseframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
