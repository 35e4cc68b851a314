"""STR-06: greedy resolution of near-duplicate sessions as a stream, whatever the order of events.

The state of a group, which is a user, day and family, is its sessions by id, with whether each is kept. A batch's
sessions are put in (a repeated event changes nothing, a corrected one replaces its session), the group is resolved as a
whole, and those that are new or change sides are emitted: a late and better session takes out one that was kept before.
Each state value costs several calls from Python to the JVM, so that groups with a state each cost more in calls than in
work: the groups of a day lie together in a fixed number of shards of the users, with one value a shard and day, read and
written once a batch. A session comes as one text, as PySpark takes each value of a row for Python by itself. When the watermark has passed the day by the allowed lateness, a timer drops the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, time, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S
from ..operators import cardio_dedup
from ..session import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUP = ["event_date", "shard"]
#: Of the users; with more, a batch that touches a shard's day reads fewer other users' sessions, and more values.
SHARDS = 256
#: JSON: [user, family, {sid: [source, source_id, allowed, at, minutes, miles, p0, p1, p2, kept]}] a group.
STATE = "groups string"
CHANGES = "user_id string, event_date date, family string, source string, source_id string, kept boolean"


class Resolver(StatefulProcessor):
    def __init__(self, power: bool, late_days: int):
        self.power, self.late_days = power, late_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.groups = handle.getValueState("groups", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.groups.get()
        if state is None and key[0] is not None:
            end = datetime.combine(key[0] + timedelta(days=self.late_days + 1), time(), timezone.utc)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        groups = {(user, family): held for user, family, held in json.loads(state[0])} if state else {}
        before: dict = {}  # of the groups with changes, the sides
        for r in rows:
            user, family, sid, *new = json.loads(r.session).values()
            new[4:6] = [x if x is None else float(x) for x in new[4:6]]  # NaN comes as text
            group = (user, family)
            held = groups.setdefault(group, {})
            if held.get(sid, [])[:-1] != new:
                if group not in before:
                    before[group] = {k: v[-1] for k, v in held.items()}
                held[sid] = [*new, False]
        for group, was in before.items():
            for source, source_id, stays in self._resolved(groups[group], was):
                yield Row(user_id=group[0], event_date=key[0], family=group[1], source=source, source_id=source_id, kept=stays)
        if before:
            self.groups.update((json.dumps([[*g, held] for g, held in groups.items()]),))

    def _resolved(self, held: dict, was: dict) -> Iterator[tuple]:
        """Resolve a group's sessions, in place; those that change sides."""
        kept = cardio_dedup.Kept(self.power)
        for sid, v in sorted(held.items(), key=lambda x: (x[1][6:9], x[1][1] or "", x[0]), reverse=True):
            source, source_id, allowed, at, minutes, miles = v[:6]
            stays = not (allowed and kept.near(at, minutes, miles, source, source_id))
            if stays and allowed:
                kept.add(at, minutes, miles, source, source_id)
            v[-1] = stays
            if was.get(sid) != stays:
                yield source, source_id, stays

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.groups.clear()
        return iter(())

    def close(self) -> None:
        pass


def resolve_stream(cardio: DataFrame, power: bool = False, late_days: int = 30, shards: int = SHARDS) -> DataFrame:
    """A stream of cardio rows to CHANGES: each session when it is first decided, and again whenever it changes sides.

    The last row of a session is its state. Rows of days that the watermark has passed by late_days are dropped. The
    query that runs it needs a RocksDB state store, which is set for the session here.
    """
    spark = cardio.sparkSession
    ship(spark)
    spark.conf.set(STORE, ROCKS)
    key = cardio_dedup.power_key() if power else cardio_dedup.hub_key()
    allowed = F.col("source").isin(*cardio_dedup.POWER_SOURCES) if power else F.col("source") == "apple_health"
    plain = [c for c, t in cardio.dtypes if not t.startswith(("map", "variant"))]
    parts = ["rank", "rich"] if power else ["rank", "trusted", "rich"]
    d = cardio.withColumns({"family": S.activity_family("activity_type"), "k": key}).select(
        "user_id", "event_date", "family", F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int").alias("shard"), F.coalesce(F.concat_ws("|", F.lit("id"), "source", "source_id"), F.lit("")).alias("named"), F.xxhash64(*plain).cast("string").alias("content"), "source", "source_id", F.coalesce(allowed, F.lit(False)).alias("allowed"),
        F.unix_micros(F.col("started_at").cast("timestamp")).alias("at"), F.coalesce(F.col("duration_min").cast("double"), F.lit(0.0)).alias("minutes"), F.col("distance_miles").cast("double").alias("miles"),
        *[F.col(f"k.{p}").cast("long").alias(f"p{i}") for i, p in enumerate(parts)], *[F.lit(0).cast("long").alias(f"p{i}") for i in range(len(parts), 3)], F.col("event_date").cast("timestamp").alias("day"),
    )
    d = d.withColumn("sid", F.when(F.col("source_id").isNotNull(), F.col("named")).otherwise(F.concat(F.lit("row|"), "content"))).drop("named", "content")
    session = F.to_json(F.struct("user_id", "family", "sid", "source", "source_id", "allowed", "at", "minutes", "miles", "p0", "p1", "p2"), {"ignoreNullFields": "false"})
    d = d.select(*GROUP, session.alias("session"), "day").withWatermark("day", f"{late_days} days")
    return d.groupBy(*GROUP).transformWithState(Resolver(power, late_days), CHANGES, "Update", "EventTime")


def current(changes: DataFrame, order: str = "batch") -> DataFrame:
    """The last state of each session from stored CHANGES with the number of their batch."""
    g = changes.groupBy("user_id", "event_date", "family", "source", "source_id").agg(F.max_by("kept", order).alias("kept"))
    return g.where("kept").drop("kept")
