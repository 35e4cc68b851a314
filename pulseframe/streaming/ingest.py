"""Push ingest as Structured Streaming: landed payloads are normalized and merged micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cardio_dedup
from ..sinks.store import Store
from ..sources import files, vendors
from .. import schemas


def apply_payloads(store: Store, raw: DataFrame, authenticated: bool = True, stream: str | None = None, batch: int | None = None, grain: str | None = None) -> bool:
    """STR-01 to 04: one batch of export payloads (user_id, raw), all of it in one commit; whether it was applied.

    Biometrics are upserted (the last write wins), workouts pass the strength and near-duplicate rules, replaced ones go.
    Only authenticated batches replace stored rows. A batch number of the stream that was applied before is left out,
    whatever it holds now; the same rows under another number change nothing. grain: of starts, see cardio_dedup.resolve.
    """
    if batch is not None and (last := store.applied(stream)) is not None and batch <= last:
        return False
    with store.transaction(stream, batch) as t:
        t.upsert("biometrics", vendors.health_payloads(raw))
        new = t.stage(schemas.conform(vendors.workouts(raw), "cardio_events"), "cardio_events")
        # only these users' buckets are read, and of those only the days that can hold near-duplicates
        users = new.select("user_id").distinct()
        rows = cardio_dedup.drop_strength_mirrors(new, t.read("strength_events", users=users))
        stored = t.read("cardio_events", users=users)
        fresh = rows.join(stored.select("user_id", "source_id"), ["user_id", "source_id"], "left_anti")
        near = stored.join(new.select("user_id", "event_date").distinct(), ["user_id", "event_date"], "left_semi").select(*stored.columns)
        t.change("cardio_events", *cardio_dedup.resolve(fresh.select(*stored.columns), near, allow_supersede=authenticated, grain=grain))
    return True


def stream_payloads(spark: SparkSession, landing: str, store: Store, checkpoint: str, authenticated: bool = True):
    """STR-01, STR-05: everything landed since the last run (as files.land writes it, under source=…/day=…), then stop.

    A micro-batch that failed after its commit comes again under its number and is left out: each is applied once.
    """
    raw = spark.readStream.schema(files.LANDED).parquet(landing)
    return raw.writeStream.foreachBatch(lambda df, n: apply_payloads(store, df, authenticated, checkpoint, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_windows(events: DataFrame, late: str = "2 days") -> DataFrame:
    """STR-07, an extension: tumbling days per user and type of a stream of (event_id, ts, user_id, event_type, value), repeats within the watermark dropped."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(F.window("ts", "1 day"), "user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "user_id", "event_type", "n", "total")
