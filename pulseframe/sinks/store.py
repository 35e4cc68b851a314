"""Tables under one commit log.

The log is a folder of numbered manifests. A manifest names the folders of every table, by part, and the last batch of
each stream that has been applied. A transaction writes new folders beside the old ones and then one manifest: readers
see all of its tables changed or none, and a batch that comes again is known by its id. A manifest is written under a
hidden name and renamed without overwriting, so a crash at any time leaves the state before, and of two writers at once
one fails. (Renaming must be atomic, as on HDFS and local disks.)

Parts keep merges small: tables with a date are kept by months, sessions and sets (whose key has no date) in hash buckets of
the user. A merge reads and writes the parts of the incoming rows only, once, by their key's shuffle. Within a bucket,
rows are sorted by user and day, so that readers skip row groups. What no kept manifest names is removed by vacuum().
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import tables as T

LOG = "_log"
#: Tables without a date in their key that are kept by the months of one.
DATED = {"anomaly_events": "detected_date", "interventions": "event_date", "athlete_journal_entries": "entry_date"}
NO_PART = "all"


def day_of(table: str) -> str | None:
    """The date by whose months the table is kept, if it is."""
    kinds = schemas.columns(table)
    return next((k for k in schemas.KEYS.get(table, []) if kinds[k] == "date"), DATED.get(table))


def bucketed(table: str) -> bool:
    return day_of(table) is None and "source_id" in schemas.KEYS.get(table, [])


class Transaction:
    """Changes to several tables that become visible at once; use it in `with`, which commits unless there was an error."""

    def __init__(self, store: Store, stream: str | None = None, batch: int | None = None):
        self.store, self.spark = store, store.spark
        self.number, state = store._state()
        self.tables: dict = {k: {"buckets": v["buckets"], "parts": dict(v["parts"]), "from": dict(v["from"])} for k, v in state["tables"].items()}
        self.batches = state["batches"] | ({stream: batch} if stream is not None and batch is not None else {})
        self.made: list[str] = []
        self.changed = batch is not None

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self.commit()
        finally:
            # staged rows always go, new folders only if they didn't become part of the state
            for f in self.made:
                self.store._delete(f)

    def commit(self) -> None:
        if self.changed:
            self.store._publish(self.number, {"tables": self.tables, "batches": self.batches})
        self.made = [f for f in self.made if "/staged-" in f]

    # --- parts

    def _entry(self, table: str) -> dict:
        return self.tables.setdefault(table, {"buckets": self.store.buckets if bucketed(table) else None, "parts": {}, "from": {}})

    def _part(self, table: str) -> Column:
        if day := day_of(table):
            return F.date_format(day, "yyyy-MM")
        if n := self._entry(table)["buckets"]:
            return F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("string")
        return F.lit(NO_PART)

    def _folder(self, table: str, kind: str) -> str:
        out = f"{self.store.root}/{table}/{kind}-{uuid.uuid4().hex}"
        self.made.append(out)
        return out

    def _dealt(self, table: str, df: DataFrame, at: str) -> dict[str, str]:
        """Write df by parts; the folder of each part that has rows."""
        df = df.withColumn("part", self._part(table))
        if bucketed(table):
            # a large bucket may be split over tasks, many small ones share one
            df = df.hint("rebalance", "part").sortWithinPartitions("part", *[c for c in ("user_id", "event_date", "session_date") if c in df.columns])
        df.write.partitionBy("part").parquet(at)
        return {p.removeprefix("part="): f"{at.removeprefix(self.store.root + '/')}/{p}" for p in self.store._names(at) if p.startswith("part=")}

    def stage(self, df: DataFrame, table: str) -> DataFrame:
        """df written once beside the table and read back; removed at the end."""
        at = self._folder(table, "staged")
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _rows(self, table: str, parts) -> DataFrame:
        schema = ", ".join(f"`{k}` {v}" for k, v in schemas.columns(table).items())
        folders = [f"{self.store.root}/{f}" for p, f in sorted(self._entry(table)["parts"].items()) if p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- reading and writing

    def read(self, table: str, since: date | None = None, until: date | None = None, users: DataFrame | None = None) -> DataFrame:
        """The rows as this transaction sees them: of the days from `since` to `until`, of these users. An absent table is empty.

        Months outside the days aren't read; of bucketed tables only the users' buckets are.
        """
        entry, day = self._entry(table), day_of(table)
        parts = set(entry["parts"])
        if day:
            low, high = f"{since:%Y-%m}" if since else "", f"{until:%Y-%m}" if until else "9999-99"
            parts = {p for p in parts if low <= p <= high}
        elif users is not None and entry["buckets"]:
            parts &= self._parts_of(table, users)
        df, day = self._rows(table, parts), day or next((c for c in ("event_date", "session_date") if c in schemas.columns(table)), None)
        if (since or until) and day is None:
            raise ValueError(f"no date in {table}")
        df = df.where(F.col(day) >= F.lit(since)) if since else df
        df = df.where(F.col(day) <= F.lit(until)) if until else df
        return df.join(users.select("user_id").distinct(), "user_id", "left_semi") if users is not None else df

    def _parts_of(self, table: str, rows: DataFrame) -> set[str]:
        """At most as many as the table has buckets, or months."""
        return {r[0] for r in rows.select(self._part(table).alias("p")).distinct().collect()}

    def replace(self, table: str, df: DataFrame) -> None:
        """The rows of df become the table."""
        self._entry(table)["parts"] = self._dealt(table, schemas.conform(df, table), self._folder(table, "v"))
        self.changed = True

    def rewrite(self, table: str, parts: set[str], how: Callable[[DataFrame], DataFrame]) -> None:
        """how(rows of these parts) becomes their contents; its rows must not leave them."""
        if parts:
            made = self._dealt(table, schemas.conform(how(self._rows(table, parts)), table), self._folder(table, "v"))
            if odd := set(made) - parts:
                raise ValueError(f"rows of {table} left their parts: {sorted(odd)[:5]}")
            entry = self._entry(table)
            entry["parts"] = {p: f for p, f in entry["parts"].items() if p not in parts} | made
            self.changed = True

    def derive(self, table: str, source: str, make: Callable[[DataFrame], DataFrame], before: str = "~") -> set[str]:
        """Make the months of `table` again whose months of `source` changed since, as make(their rows); which ones.

        The log has the folder that each month was made from, so what is out of date is known without reading rows.
        """
        entry, parts = self._entry(table), self._entry(source)["parts"]
        stale = {p for p in {*parts, *entry["from"]} if p < before and parts.get(p) != entry["from"].get(p)}
        self.rewrite(table, stale, lambda _: make(self._rows(source, stale)))
        entry["from"] = {p: f for p, f in entry["from"].items() if p not in stale} | {p: parts[p] for p in stale if p in parts}
        return stale

    def _merge(self, table: str, rows: DataFrame, how) -> None:
        key = schemas.KEYS[table]
        new = self.stage(T.checked(rows, key), table)
        self.rewrite(table, self._parts_of(table, new), lambda old: how(old, new, key))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """SNK-01, SNK-03, SNK-05 as tables.upsert, in the rows' parts."""
        self._merge(table, rows, T.upsert)

    def insert_new(self, table: str, rows: DataFrame) -> None:
        """SNK-02 as tables.insert_if_absent, in the rows' parts."""
        self._merge(table, rows, T.insert_if_absent)

    def change(self, table: str, inserts: DataFrame, deletes: DataFrame) -> None:
        """SNK-07 with inserts: rows of these (user_id, source_id) go, the inserts come, in the parts of either."""
        new = self.stage(schemas.conform(inserts, table), table)
        gone = self.stage(deletes.select("user_id", "source_id"), table)
        parts = self._parts_of(table, new) | self._parts_of(table, gone)
        self.rewrite(table, parts, lambda old: T.delete_ids(old, gone).unionByName(new))

    def replace_matching(self, table: str, rows: DataFrame, scope: DataFrame, key: list[str]) -> None:
        """SNK-04, SNK-08: rows of the scope's keys go and the new ones come; the key must hold the date or user of the parts."""
        new, gone = self.stage(schemas.conform(rows, table), table), self.stage(scope.select(*key).distinct(), table)
        self.rewrite(table, self._parts_of(table, new) | self._parts_of(table, gone), lambda old: T.replace_matching(old, new, gone, key))


class Store:
    """Tables under a root that the cluster shares. buckets: of tables that are created from now on."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.root}/{LOG}") if n.endswith(".json") and n[0] != "."]

    def _state(self, number: int | None = None) -> tuple[int, dict]:
        """(number, manifest) of the newest, or the given, state; (0, empty) before the first."""
        number = number if number is not None else max(self._numbers(), default=0)
        if not number:
            return 0, {"tables": {}, "batches": {}}
        p, fs = self._fs(f"{self.root}/{LOG}/{number:012d}.json")
        stream = fs.open(p)
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, was: int, manifest: dict) -> None:
        """The manifest becomes the state after `was`, if nobody else's did."""
        jvm = self.spark._jvm
        p, fs = self._fs(f"{self.root}/{LOG}/.{uuid.uuid4().hex}.json")
        to, _ = self._fs(f"{self.root}/{LOG}/{was + 1:012d}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            if max(self._numbers(), default=0) != was:
                raise RuntimeError("another writer changed the tables meanwhile")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(p, to, none)
        except Exception:
            fs.delete(p, False)
            raise

    # --- transactions

    def transaction(self, stream: str | None = None, batch: int | None = None) -> Transaction:
        """Changes from the newest state; with a stream and batch, its commit records that the batch is applied."""
        return Transaction(self, stream, batch)

    def applied(self, stream: str) -> int | None:
        """The last batch of the stream that is part of the state."""
        return self._state()[1]["batches"].get(stream)

    def read(self, table: str, since: date | None = None, until: date | None = None, users: DataFrame | None = None) -> DataFrame:
        """The current rows; see Transaction.read."""
        return self.transaction().read(table, since, until, users)

    def replace(self, table: str, df: DataFrame) -> None:
        with self.transaction() as t:
            t.replace(table, df)

    def upsert(self, table: str, rows: DataFrame) -> None:
        with self.transaction() as t:
            t.upsert(table, rows)

    def insert_new(self, table: str, rows: DataFrame) -> None:
        with self.transaction() as t:
            t.insert_new(table, rows)

    # --- upkeep

    def compact(self, table: str, buckets: int | None = None) -> None:
        """Rewrite a table's folders whole, in as many buckets as given."""
        with self.transaction() as t:
            rows = t.read(table)
            if buckets and bucketed(table):
                t._entry(table)["buckets"] = buckets
            t.replace(table, rows)

    def vacuum(self, keep: int = 2, hours: float = 24) -> int:
        """Remove all but the newest `keep` manifests, and folders that no kept one names and that are older than `hours`; how many folders went.

        Writers whose transaction runs longer than that, and readers of older states, would lose their files.
        """
        numbers = sorted(self._numbers())
        kept = numbers[-max(1, keep) :]
        named = {f.split("/part=")[0] for n in kept for t in self._state(n)[1]["tables"].values() for f in t["parts"].values()}
        gone = 0
        for table in self._names(self.root):
            p, fs = self._fs(f"{self.root}/{table}")
            for f in fs.listStatus(p) if table != LOG and fs.isDirectory(p) else []:
                old = f.getModificationTime() <= (time.time() - hours * 3600) * 1000
                if old and f"{table}/{f.getPath().getName()}" not in named:
                    fs.delete(f.getPath(), True)
                    gone += 1
        for n in numbers[: -len(kept)]:
            self._delete(f"{self.root}/{LOG}/{n:012d}.json")
        return gone
