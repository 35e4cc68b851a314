"""Queries over pages and activity files that Spark makes from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import paged
from . import testmap as T
from .catalog import _LONG, _REC, TIE, _queries, _sql, query
from .catalog_more import _greedy, _HUB, _HUB_KEY, _UNIT, scratch

ITEM = "struct<o_orderkey:long,o_custkey:long,o_orderstatus:string,o_totalprice:double>"


BUNDLE = 40  # pages of one folder: what a task of the stream takes at a time


def _pages(spark, sf) -> str:
    """The orders as JSON pages in folders; some hundred orders a page, dealt by hash."""
    o = T.table(spark, sf, "orders")
    n = max(2, o.count() // 100)
    item = F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "string"), ("o_totalprice", "double"))])
    p = o.withColumn("page", F.pmod(F.xxhash64("o_orderkey"), F.lit(n)) + 1).withColumn("pages", F.floor((F.col("page") - 1) / BUNDLE))
    # one shuffle deals the rows to the folders' tasks, which put the pages together
    p = p.repartition("pages").groupBy("pages", "page").agg(F.collect_list(item).alias("items"))
    at = scratch(spark, "pulseframe-pages")
    p.select("pages", F.to_json(F.struct("page", F.lit(n).alias("page_count"), "items")).alias("value")).write.partitionBy("pages").text(at)
    return at


def _items(pages):
    # explode_outer, as the filter that Spark infers for explode would parse the texts again
    return pages.select("page", F.explode_outer(F.from_json("raw", f"items array<{ITEM}>")["items"]).alias("o")).where("o is not null").select("o.*")


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders"


@query(_ORDERS, "o_totalprice")
def src_numbered_pages(spark, sf):
    """SRC-03: pages with a count, in partitions of some pages each, complete or an error."""
    paged.register(spark)
    n = spark.read.format("paged").option("client", "pulseframe.sources.paged:FolderPages").option("root", _pages(spark, sf)).option("bundle", BUNDLE).option("most", 1_000_000).load()
    return _items(n)


@query(_ORDERS, "o_totalprice")
def src_cursor_pages(spark, sf):
    """SRC-23: a stream whose offset is the cursor, by micro-batches of some pages in each of many tasks, into a table."""
    paged.register(spark)
    at, out = _pages(spark, sf), scratch(spark, "pulseframe-cursor")
    s = spark.readStream.format("paged_cursor").option("client", "pulseframe.sources.paged:FolderPages").option("root", at).option("bundle", BUNDLE).option("batch_pages", 10 * BUNDLE).option("tasks", 128).load()
    q = s.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return _items(spark.read.schema(paged.SCHEMA).parquet(f"{out}/rows"))


# --- activity files

RIDE = 32  # vectors of one ride, a value a second


def _fit_bytes(batches):
    """(ride_id, watts of each second) as FIT files: time, power, heart rate, distance, altitude; every third one gzipped."""
    import gzip
    import struct

    import numpy as np
    import pandas as pd

    kind = np.dtype([("head", "u1"), ("sec", "<u4"), ("watts", "<u2"), ("hr", "u1"), ("dist", "<u4"), ("alt", "<u2")])
    define = bytes([0x40, 0, 0]) + struct.pack("<HB", 20, 5) + bytes([253, 4, 0x86, 7, 2, 0x84, 3, 1, 2, 5, 4, 0x86, 2, 2, 0x84])
    sport = bytes([0x41, 0, 0]) + struct.pack("<HB", 12, 1) + bytes([0, 1, 0]) + bytes([1, 2])
    from ..sources import fit

    for b in batches:
        out = []
        for ride, watts in zip(b["ride_id"], b["watts"]):
            i = np.arange(len(watts))
            rows = np.zeros(len(watts), kind)
            rows["sec"], rows["watts"], rows["hr"], rows["dist"], rows["alt"] = 1_073_000_000 + i, watts, 60 + i % 100, i * 500, (i % 50 + 500) * 5
            body = sport + define + rows.tobytes()
            whole = struct.pack("<BBHI4sH", 14, 16, 2132, len(body), b".FIT", 0) + body
            whole += struct.pack("<H", fit.crc16(whole))
            out.append((f"rides/{ride}", gzip.compress(whole) if ride % 3 == 0 else whole))
        yield pd.DataFrame(out, columns=["path", "content"])


def _rides(spark, sf):
    from ..session import ship
    from ..sources import files

    ship(spark)
    e = T.table(spark, sf, "embeddings").select((F.col("vec_id") / RIDE).cast("long").alias("ride_id"), "vec_id", "embedding")
    g = e.groupBy("ride_id").agg(F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])), lambda v: F.round(F.abs(v.cast("double")) * 1000).cast("int")).alias("watts"))
    built = g.mapInPandas(_fit_bytes, "path string, content binary")
    return files.session_rows(files.track_points(built), "u")


_FIT = (f"v AS (SELECT vec_id // {RIDE} AS ride_id, vec_id, unnest(range(len(embedding))) AS j, round(abs(CAST(unnest(embedding) AS DOUBLE)) * 1000) AS watts FROM embeddings)", "pt AS (SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY vec_id, j) - 1 AS i, watts FROM v)")


@query("""SELECT CAST(ride_id AS BIGINT) AS ride_id, CAST('2023-12-31' AS DATE) AS event_date, 'Ride' AS activity_type, (n - 1) / 60.0 AS duration_min, (n - 1) * 5 / 1609.344 AS distance_miles, gain * 3.280839895 AS elevation_ft, CAST(round_even(hr, 0) AS INTEGER) AS avg_hr, CAST(top_hr AS INTEGER) AS max_hr, avg_watts, max_watts, work_kj, np FROM
 (SELECT ride_id, count(*) AS n, avg(60 + i % 100) AS hr, max(60 + i % 100) AS top_hr, sum(CASE WHEN i > 0 AND i % 50 > 0 THEN 1 ELSE 0 END) AS gain, avg(watts) AS avg_watts, max(watts) AS max_watts, sum(watts) / 1000 AS work_kj FROM pt GROUP BY 1)
 JOIN (SELECT ride_id, pow(avg(pow(m, 4)), 0.25) AS np FROM (SELECT ride_id, CASE WHEN count(*) OVER w = 30 THEN avg(watts) OVER w END AS m FROM pt WINDOW w AS (PARTITION BY ride_id ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) GROUP BY 1) USING (ride_id)""", "duration_min distance_miles elevation_ft avg_watts max_watts work_kj np", _FIT)
def src_fit_rides(spark, sf):
    """SRC-15, SRC-18, SRC-19, PRJ-39: rides of the embeddings as FIT files, some gzipped, decoded to one row each."""
    r = _rides(spark, sf)
    return r.select(F.substring_index("path", "/", -1).cast("long").alias("ride_id"), "event_date", "activity_type", "duration_min", "distance_miles", "elevation_ft", "avg_hr", "max_hr", "avg_watts", "max_watts", "work_kj", F.col("normalized_power").alias("np"))


@query(" UNION ALL ".join(f"SELECT ride_id, {k} AS duration, max(m) AS watts FROM (SELECT ride_id, CASE WHEN count(*) OVER w = {k} THEN avg(watts) OVER w END AS m FROM pt WINDOW w AS (PARTITION BY ride_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) GROUP BY 1 HAVING max(m) IS NOT NULL" for k in (5, 15, 30, 60, 180, 300, 720, 1200, 1800, 3600)), "watts", _FIT)
def win_ride_curves(spark, sf):
    """WIN-16, ARR-04, ARR-06, ARR-07: the best mean of each duration up to half an hour and more, as stored with the decoded rides."""
    r = _rides(spark, sf).select(F.substring_index("path", "/", -1).cast("long").alias("ride_id"), F.explode("power_mmp_json").alias("k", "watts"))
    from ..functions import scalars as S

    return r.select("ride_id", S.duration_key("k").alias("duration"), "watts")


def _texts(spark, sf):
    """A TCX text for each even user of the events, a GPX text for each odd one."""
    e = T.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    n = lambda c: F.col(c).cast("string")
    watts, hr = F.col("event_id") % 300, F.col("event_id") % 100 + 60
    t = F.concat(F.lit("<Trackpoint><Time>"), time, F.lit("</Time><AltitudeMeters>"), "k", F.lit("</AltitudeMeters><DistanceMeters>"), n("value"), F.lit("</DistanceMeters><HeartRateBpm><Value>"), hr.cast("string"), F.lit("</Value></HeartRateBpm>"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("<Extensions><x:TPX><x:Watts>"), watts.cast("string"), F.lit("</x:Watts></x:TPX></Extensions>"))).otherwise(""), F.lit("</Trackpoint>"))
    g = F.concat(F.lit('<trkpt lat="1" lon="2"><ele>'), "k", F.lit("</ele><time>"), time, F.lit("</time><extensions>"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("<power>"), watts.cast("string"), F.lit("</power>"))).otherwise(""), F.lit("<g:TrackPointExtension><g:hr>"), hr.cast("string"), F.lit("</g:hr></g:TrackPointExtension></extensions></trkpt>"))
    even = F.col("user_id") % 2 == 0
    one = e.groupBy("user_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.when(even, t).otherwise(g).alias("x")))), lambda x: x["x"])).alias("x"))
    text = F.when(even, F.concat(F.lit('<?xml version="1.0"?><TrainingCenterDatabase xmlns="a" xmlns:x="b"><Activities><Activity Sport="Biking"><Lap><Track>'), "x", F.lit("</Track></Lap></Activity></Activities></TrainingCenterDatabase>")))
    text = text.otherwise(F.concat(F.lit('<gpx xmlns="a" xmlns:g="b"><trk><type>running</type><trkseg>'), "x", F.lit("</trkseg></trk></gpx>")))
    return one.select(F.col("user_id").cast("string").alias("path"), text.cast("binary").alias("content"))


@query("""SELECT CAST(user_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i, epoch_us(ts) AS us, CAST(CASE WHEN event_id % 4 > 0 THEN event_id % 300 END AS DOUBLE) AS watts, CAST(event_id % 100 + 60 AS DOUBLE) AS hr, CASE WHEN user_id % 2 = 0 THEN value END AS distance_m,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS altitude, CASE WHEN user_id % 2 = 0 THEN 'Biking' ELSE 'running' END AS sport FROM events""", "distance_m altitude")
def src_xml_tracks(spark, sf):
    """SRC-16, SRC-17, SRC-18: TCX and GPX texts of the events, kinds known by content, points read by Spark."""
    from ..sources import files

    p = files.track_points(_texts(spark, sf))
    return p.select("path", "i", F.unix_micros("ts").alias("us"), "watts", "hr", "distance_m", "altitude", "sport")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS source_id, value + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS duration_min FROM events WHERE value > 0 OR event_id % 2 = 0 AND value > -1", "duration_min")
def src_replay(spark, sf):
    """SRC-24, SRC-26: payloads landed under two days, replayed; the later day's version of a session counts."""
    from ..sources import files, vendors

    e = T.table(spark, sf, "events").withColumn("user_id", F.col("user_id").cast("string"))

    def payloads(rows, day, more):
        w = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("Run").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss' +0000'").alias("start"), ((F.col("value") + more) * 60).alias("duration"))
        return rows.groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.collect_list(w).alias("workouts")).alias("data"))).alias("raw")).withColumns({"source": F.lit("apple"), "day": F.lit(day)})

    at = scratch(spark, "pulseframe-landing")
    files.land(payloads(e.where("event_id % 2 = 0"), "2024-01-02", 1), at)
    files.land(payloads(e, "2024-01-01", 0), at)
    return files.replay(files.landed(spark, at), vendors.workouts, ("day", "path")).select("user_id", "source_id", "duration_min")


# --- streams

def _replayed(spark, sf, files: int = 6) -> str:
    """The hub's sessions in several files, shuffled, a third of them once more."""
    c = T.cardio(spark, sf).where("source = 'apple_health'")
    more = c.where(F.pmod(F.xxhash64("source_id"), F.lit(3)) == 0).withColumn("again", F.lit(1))
    d = c.withColumn("again", F.lit(0)).unionByName(more).withColumn("part", F.pmod(F.xxhash64("source_id", "again", F.lit(7)), F.lit(files)))
    at = scratch(spark, "pulseframe-replay")
    d.drop("again").repartition("part").write.partitionBy("part").parquet(at)
    return at


@query("SELECT user_id, source_id FROM cardio WHERE source_id IN (SELECT source_id FROM hubk)", "", (T.CARDIO, _HUB, _greedy("hubk", "hub", _HUB_KEY)))
def str_resolution(spark, sf):
    """STR-06, DED-01: the hub's sessions as a stream of shuffled files with repeats, resolved in state; the last state of each."""
    from ..streaming import resolve

    c = T.cardio(spark, sf)
    at, out = _replayed(spark, sf), scratch(spark, "pulseframe-resolution")
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(at)

    def keep(df, n):
        df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{out}/changes")

    q = resolve.resolve_stream(s, late_days=3650).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    changes = spark.read.schema(f"{resolve.CHANGES}, batch long").parquet(f"{out}/changes")
    return resolve.current(changes).select("user_id", "source_id")


# --- statistics kept by months

_WIDE = "lw AS (SELECT user_id, CAST(DATE '2024-01-01' + CAST(5 * (d - DATE '2024-01-01') AS INTEGER) AS DATE) AS d, metric, value FROM lg)"


@query("""SELECT user_id, d AS metric_date, metric, value, n AS sample_n, (value - m) / s AS score, 'z' AS kind FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM lw WINDOW w AS (PARTITION BY user_id, metric ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAYS PRECEDING)) WHERE metric <> 'steps' AND n >= 5 AND s > 0 AND abs((value - m) / s) > 2
 UNION ALL SELECT l.user_id, l.d, l.metric, l.value, q.n, CASE WHEN value > q3 THEN q3 ELSE q1 END, 'iqr' FROM lw l JOIN (SELECT a.d AS day, b.user_id, b.metric, count(*) AS n, quantile_cont(b.value, 0.25) AS q1, quantile_cont(b.value, 0.75) AS q3 FROM (SELECT max(d) AS d FROM lw GROUP BY date_trunc('month', d)) a JOIN lw b ON b.d < a.d GROUP BY 1, 2, 3) q ON q.user_id = l.user_id AND q.metric = l.metric AND q.day = l.d WHERE n >= 5 AND q3 > q1 AND (value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1))""", "value score", (T.METRICS, _LONG, _WIDE))
def win_monthly_state(spark, sf):
    """WIN-07, WIN-08 from moments and counts kept by months: of every day the z-scores, of each month's last day the fences. Days lie five apart, to have several months."""
    import datetime as dt

    from ..operators import running, stats
    from ..sinks.store import Store

    m = T.metrics(spark, sf)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.datediff("metric_date", F.lit("2024-01-01").cast("date")) * 5)
    store, zs, out = Store(spark, scratch(spark, "pulseframe-state")), None, None
    store.replace("daily_health_metrics", m.withColumn("metric_date", day))
    ends = sorted(r[0] for r in store.read("daily_health_metrics").groupBy(F.trunc("metric_date", "month")).agg(F.max("metric_date").alias("d")).select("d").collect())
    z_of, iqr_of = ("hrv_rmssd", "sleep_hours", "resting_hr"), ("hrv_rmssd", "sleep_hours", "resting_hr", "steps")
    for end in ends:  # one month after the other, as the daily job goes
        first = end.replace(day=1)
        with store.transaction() as t:
            t.derive("metric_moments", "daily_health_metrics", lambda d: running.moments(stats.to_long(d, z_of)), f"{end:%Y-%m}")
            t.derive("metric_counts", "daily_health_metrics", lambda d: running.counts(stats.to_long(d, iqr_of)), f"{end:%Y-%m}")
        month, until = store.read("daily_health_metrics", first, end), first - dt.timedelta(days=1)
        z = running.z_scores(running.merged(store.read("metric_moments", until=until)), stats.to_long(month, z_of), least=5, limit=stats.Z_LIMIT - running.TOLD_APART)
        q = running.quartiles(store.read("metric_counts", until=until).select("user_id", "metric", "value", "n").unionByName(stats.to_long(month, iqr_of).where(F.col("d") < F.lit(end)).select("user_id", "metric", "value", F.lit(1).cast("long").alias("n"))))
        i = running.iqr_outliers(store.read("metric_counts", until=until), stats.to_long(month, iqr_of), end.isoformat(), least=5).join(q.select("user_id", "metric", F.col("n").alias("sample_n")), ["user_id", "metric"])
        i = i.select("user_id", "metric_date", "metric", "value", "sample_n", F.when(F.col("value") > F.col("q3"), F.col("q3")).otherwise(F.col("q1")).alias("score"), F.lit("iqr").alias("kind"))
        zs, out = z if zs is None else zs.unionByName(z), i if out is None else out.unionByName(i)
    at = scratch(spark, "pulseframe-scores")
    zs.write.parquet(at)  # read twice
    z = running.settled(spark.read.schema(zs.schema).parquet(at), stats.to_long(store.read("daily_health_metrics"), z_of))
    return z.select("user_id", "metric_date", "metric", "value", "sample_n", F.col("z").alias("score"), F.lit("z").alias("kind")).unionByName(out)


# --- functions of SQL

def sql_units(spark, sf):
    """PRJ-07 to PRJ-12, PRJ-36 through spark.sql: the rows of prj_units."""
    from ..functions import registry

    own = spark.newSession()
    registry.register(own)
    own.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    unit = _UNIT.replace("'Meters' END", "'Meters' END AS u")
    return own.sql(f"""SELECT event_id, round(quantity_to_miles(value, u), 6) + 0.0 AS miles, round(quantity_to_feet(value, u), 6) + 0.0 AS feet, round(mass_to_lb(value, if(event_id % 2 = 0, 'KG', 'lb')), 6) + 0.0 AS lb, round(sleep_hours_of(value * 10, NULL), 6) + 0.0 AS sleep,
 round(stage_hours(value * 40, CASE event_id % 4 WHEN 0 THEN 'min' WHEN 1 THEN 'seconds' WHEN 2 THEN 'hr' END), 6) + 0.0 AS stage, round(kilocalories(value, if(event_id % 2 = 0, 'kJ', 'kcal')), 6) + 0.0 AS kcal, pace_seconds(value * 60, CAST(event_id % 20 AS DOUBLE)) AS pace, round(km_to_miles(value), 6) + 0.0 AS km_miles
 FROM (SELECT *, {unit} FROM events)""")


# the SQL of prj_units, without what settles its exact halves
_queries["sql_units"], _sql["sql_units"] = sql_units, _sql["prj_units"].replace(f" + {TIE}", "")


@query("SELECT user_id, metric_date, CASE WHEN recovery_sleep_days_7d > 0 OR recovery_hrv_days_7d > 0 THEN greatest(0, least(100, 100 - least(40, coalesce(sleep_debt_7d * 4, 0)) - least(40, hrv_suppressed_days * 8))) END AS readiness, CAST(date_trunc('week', metric_date) AS DATE) AS week FROM re", "readiness", (T.METRICS, _REC))
def sql_readiness(spark, sf):
    """SCO-02, PRJ-05 through spark.sql, with a table function as the calendar."""
    from ..functions import registry
    from ..operators import features

    own = spark.newSession()  # so that the caller's session keeps its functions and views
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    registry.register(own)
    features.recovery(T.metrics(own, sf)).createOrReplaceTempView("recovery")
    return own.sql("""SELECT user_id, metric_date, readiness(sleep_debt_7d, CAST(hrv_suppressed_days AS INT), NULL, CAST(recovery_sleep_days_7d AS INT), CAST(recovery_hrv_days_7d AS INT)) AS readiness, c.week
 FROM recovery r JOIN day_spine(DATE '2023-01-01', DATE '2025-12-31') c ON c.day = r.metric_date""")
