"""FIT files by columns against a plain reader, TCX and GPX by Spark, landing and replays."""

import datetime as dt
import gzip
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.sources import files, fit, vendors


def crc(data):
    c = 0
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0xA001 if c & 1 else 0)
    return c


def wrap(body):
    whole = struct.pack("<BBHI4sH", 14, 16, 2132, len(body), b".FIT", 0) + body
    return whole + struct.pack("<H", crc(whole))


def define(local, message, fields, big=False, developer=()):
    o = ">" if big else "<"
    head = 0x40 | local | (0x20 if developer else 0)
    out = bytes([head, 0, int(big)]) + struct.pack(f"{o}HB", message, len(fields)) + b"".join(bytes(f) for f in fields)
    return out + (bytes([len(developer)]) + b"".join(bytes(f) for f in developer) if developer else b"")


def test_checksums_of_all_lengths():
    rng = random.Random(0)
    assert fit.crc16(b"123456789") == 0xBB3D
    for n in (0, 1, 2, 3, 15, 16, 17, 63, 64, 255, 1000, 4097):
        d = bytes(rng.randrange(256) for _ in range(n))
        assert fit.crc16(d) == crc(d), n


def test_messages_of_changing_definitions():
    t = 1_100_000_000
    body = define(0, 20, [(253, 4, 0x86), (7, 2, 0x84), (3, 1, 2), (2, 2, 0x84)])
    rows = []

    def put(local, sec, watts, hr, alt):
        nonlocal body
        body += bytes([local]) + struct.pack("<IHBH", sec, 0xFFFF if watts is None else watts, 0xFF if hr is None else hr, 0xFFFF if alt is None else int((alt + 500) * 5))
        rows.append((sec + fit.EPOCH, watts, hr, None, alt))

    for k in range(300):
        put(0, t + k, None if k % 7 == 0 else 100 + k, None if k % 5 == 0 else 90, float(k))
    # another kind in between, with a text field and developer data, in the other byte order
    body += define(1, 18, [(253, 4, 0x86), (5, 1, 0), (8, 6, 7)], big=True, developer=[(0, 3, 0)])
    body += bytes([1]) + struct.pack(">IB", t + 300, 2) + b"ride\0\0" + b"dev"
    put(0, t + 301, 5, 60, None)
    # the definition changes: altitude in the larger field, distance
    body += define(0, 20, [(253, 4, 0x86), (78, 4, 0x86), (5, 4, 0x86), (7, 2, 0x84)], big=True)
    for k in range(50):
        body += bytes([0]) + struct.pack(">IIIH", t + 400 + k, 5 * (20 + 500), 100 * k, 7)
        rows.append((t + 400 + k + fit.EPOCH, 7, None, float(k), 20.0))
    # five bits of time, turning over, for type 2; then one with its own time
    body += define(2, 20, [(7, 2, 0x84)])
    last = t + 449
    for k in range(1, 70):
        last += 1 + k % 3
        body += bytes([0x80 | 2 << 5 | last & 31]) + struct.pack("<H", k)
        rows.append((last + fit.EPOCH, k, None, None, None))
    # records without a time don't count
    got = fit.decode(wrap(body))
    assert got["sport"] == "cycling" and len(got["sec"]) == len(rows)
    for k, col in enumerate(("sec", "watts", "hr", "distance_m", "altitude")):
        assert [None if v != v else float(v) for v in got[col].tolist()] == [None if r[k] is None else pytest.approx(float(r[k])) for r in rows], col
    untimed = fit.decode(wrap(define(2, 20, [(7, 2, 0x84)]) + bytes([2, 1, 0])))
    assert len(untimed["sec"]) == 0 and untimed["sport"] is None
    assert len(fit.decode(wrap(b""))["sec"]) == 0


def test_damaged_files():
    body = define(0, 20, [(253, 4, 0x86), (7, 2, 0x84)]) + b"".join(bytes([0]) + struct.pack("<IH", 1_100_000_000 + k, 200) for k in range(60))
    good = wrap(body)
    assert len(fit.decode(good)["sec"]) == 60
    bad = [good[:-1], good[:-40], good[:50] + bytes([good[50] ^ 1]) + good[51:], good[:12] + b"\1\0" + good[14:], b"", b"garbage", wrap(bytes([5, 0, 0])), wrap(body + bytes([0, 1])), wrap(body + bytes([0x41, 0]))]
    for data in bad:
        with pytest.raises(fit.Damaged):
            fit.decode(data)


TCX = """<?xml version="1.0" encoding="UTF-8"?><TrainingCenterDatabase xmlns="http://x" xmlns:n="y"><Activities><Activity Sport="Biking"><Id>1</Id>
<Lap StartTime="a"><Track><Trackpoint><Time>2024-06-01T08:00:00Z</Time><AltitudeMeters>1.5</AltitudeMeters><DistanceMeters>0</DistanceMeters><HeartRateBpm><Value>120</Value></HeartRateBpm><Extensions><n:TPX><n:Speed>3</n:Speed><n:Watts>200</n:Watts></n:TPX></Extensions></Trackpoint>
<Trackpoint><DistanceMeters>5</DistanceMeters></Trackpoint></Track><Track><Trackpoint><Time> 2024-06-01T10:00:01+02:00 </Time><DistanceMeters>x</DistanceMeters></Trackpoint></Track></Lap>
<Lap StartTime="b"><Track><Trackpoint><Time>2024-06-01T08:00:02.500Z</Time><DistanceMeters>20</DistanceMeters></Trackpoint></Track></Lap></Activity></Activities></TrainingCenterDatabase>"""
GPX = """<gpx xmlns="z" xmlns:g="q"><trk><name>n</name><type>running</type><trkseg><trkpt lat="1" lon="2"><ele>10</ele><time>2024-06-01T08:00:00Z</time><extensions><power>150</power><g:TrackPointExtension><g:hr>99</g:hr></g:TrackPointExtension></extensions></trkpt></trkseg>
<trkseg><trkpt lat="1" lon="2"><time>never</time></trkpt><trkpt lat="1" lon="2"><ele>15</ele><time>2024-06-01T08:10:00</time></trkpt></trkseg></trk></gpx>"""


def test_xml_points(spark):
    ride = wrap(define(0, 20, [(253, 4, 0x86), (7, 2, 0x84)]) + bytes([0]) + struct.pack("<IH", 1_100_000_000, 200))
    content = {"a.tcx": TCX.encode("utf-8-sig"), "b.gz": gzip.compress(GPX.encode()), "c.fit.gz": gzip.compress(ride), "d.tcx": TCX.encode()[:-30], "e.gpx": b"<gpx></gpx>", "f": b"", "g.fit": b"garbage", "h.gz": b"\x1f\x8bno", "i.gpx": b"\xff\xfe<gpx", "k": None, "l.tcx": TCX.replace("</Track>", "</Trick>", 1).encode(), "m.gpx": GPX.replace("</trkpt>", "", 1).encode()}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in content.items()], "path string, content binary").repartition(3)
    got = {}
    for r in files.track_points(df).collect():
        got.setdefault(r.path, []).append((r.i, r.ts and r.ts.replace(tzinfo=None), r.watts, r.hr, r.distance_m, r.altitude, r.sport))
    at = lambda *a: dt.datetime(2024, 6, 1, 8, *a)
    assert sorted(got.pop("a.tcx")) == [(0, at(0, 0), 200.0, 120.0, 0.0, 1.5, "Biking"), (1, at(0, 1), None, None, None, None, "Biking"), (2, at(0, 2, 500000), None, None, 20.0, None, "Biking")]
    assert sorted(got.pop("b.gz")) == [(0, at(0, 0), 150.0, 99.0, None, 10.0, "running"), (1, at(10, 0), None, None, None, 15.0, "running")]
    assert [(x[0], x[2]) for x in got.pop("c.fit.gz")] == [(0, 200.0)]
    assert got == {k: [(None,) * 7] for k in ("d.tcx", "f", "g.fit", "h.gz", "i.gpx", "k", "l.tcx", "m.gpx")}


def test_replays_take_the_last_payload(spark, tmp_path):
    import json

    w = lambda i, mins: json.dumps({"data": {"workouts": [{"id": i, "name": "Run", "start": "2024-06-01 08:00:00 +0000", "duration": mins * 60}]}})
    rows = [("u", w("a", 10), "p1"), ("u", w("a", 30), "p3"), ("u", w("a", 20), "p2"), ("u", w("b", 5), "p0"), ("v", w("a", 7), "p9"), ("u", "no json", "p9")]
    raw = spark.createDataFrame(rows, "user_id string, raw string, path string").repartition(4)
    got = {(r.user_id, r.source_id): r.duration_min for r in files.replay(raw, vendors.workouts).collect()}
    assert got == {("u", "a"): 30.0, ("u", "b"): 5.0, ("v", "a"): 7.0}
    back = files.replay(raw.withColumn("k", -F.substring("path", 2, 1).cast("int")), vendors.workouts, ("k",))
    assert {(r.user_id, r.source_id): r.duration_min for r in back.collect()}[("u", "a")] == 10.0
    files.land(raw.select("user_id", "raw").withColumns({"source": F.lit("s"), "day": F.lit("2024-06-01")}), str(tmp_path))
    assert files.landed(spark, str(tmp_path)).where("path is not null").count() == 6


def test_a_landing_has_few_files_and_whole_payloads(spark, tmp_path):
    rows = [(f"u{k}", "s", "2024-06-01", f'{{"k":\n{k}}}') for k in range(400)]
    files.land(spark.createDataFrame(rows, "user_id string, source string, day string, raw string").repartition(3), str(tmp_path))
    assert len(list(tmp_path.rglob("*.parquet"))) <= 3
    assert sorted((r.user_id, r.source, r.day, r.raw) for r in files.landed(spark, str(tmp_path)).collect()) == sorted(rows)


def test_pages_are_parsed_once(spark):
    from pulseframe.sources import vendors

    plan = vendors.strength_sets(spark.range(1).selectExpr("'u' user_id", "string(id) raw"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_titles_take_one_join(spark):
    from pulseframe.operators import joins

    found = spark.createDataFrame([("/d/A.fit.gz",), ("/d/A.fit.gz",), ("b.FIT",), ("c.fit.fit.gz",), ("c.gz",), ("none.gpx",), (None,)], "path string")
    table = spark.createDataFrame([("x/a.FIT", "a2"), ("a.fit.gz", "a1"), ("b", "b"), ("c.fit.tcx", "c"), (None, "n"), ("none.tcx", None)], "filename string, title string")
    t = joins.titles(found, table)
    assert t._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(((r.path or ""), r.title) for r in t.collect()) == [("", None), ("/d/A.fit.gz", "a1"), ("/d/A.fit.gz", "a1"), ("b.FIT", "b"), ("c.fit.fit.gz", "c"), ("c.gz", None), ("none.gpx", None)]
