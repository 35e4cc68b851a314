"""As-of, interval, anti and enriching joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S


def latest_row(df: DataFrame, date_col: str, as_of, by: str = "user_id") -> DataFrame:
    """SCAN-13 to 17, JOIN-09: each user's newest row up to as_of."""
    d = df.where(F.col(date_col) <= F.lit(as_of).cast("date"))
    return d.groupBy(by).agg(F.max_by(F.struct(*[c for c in df.columns if c != by]), date_col).alias("r")).select(by, "r.*")


def as_of_join(left: DataFrame, right: DataFrame, left_date: str, right_date: str, by: str = "user_id") -> DataFrame:
    """JOIN-09 for many dates: left with the newest right row up to its date (columns prefixed r_), by one sort of both, without pairing them."""
    r_cols = [c for c in right.columns if c != by]
    r_type = right.select(F.struct(*r_cols).alias("r")).schema["r"].dataType
    l_type = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    a = right.select(F.col(by).alias("k"), F.col(right_date).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(l_type).alias("l"), F.struct(*r_cols).alias("r"))
    b = left.select(F.col(by).alias("k"), F.col(left_date).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).cast(r_type).alias("r"))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    j = a.union(b).withColumn("r", F.last("r", True).over(w)).where("side = 1")
    return j.select("l.*", *[F.col(f"r.{c}").alias(f"r_{c}") for c in r_cols])


def active_phase(dates: DataFrame, phases: DataFrame, date_col: str = "d") -> DataFrame:
    """JOIN-08: the phase that holds each date, the one that began last if several do."""
    p = phases.select(F.col("user_id").alias("pu"), "phase_type", "name", "start_date", "end_date", "is_active")
    j = dates.join(p, (F.col("user_id") == F.col("pu")) & P.covers("start_date", "end_date", date_col, "is_active"), "left")
    w = Window.partitionBy("user_id", date_col).orderBy(F.desc_nulls_last("start_date"), "name")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "pu", "is_active")


def upcoming_phases(phases: DataFrame, as_of, limit: int = 3) -> DataFrame:
    """SRT-04: each user's next phases by start."""
    d = phases.where(F.coalesce("is_active", F.lit(True)) & (F.col("start_date") > F.lit(as_of).cast("date")))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("start_date", "name"))).where(F.col("rank") <= limit)


def phase_progress(df: DataFrame, date_col: str = "d") -> DataFrame:
    """WIN-19: weeks of the phase in all, elapsed and remaining (begun weeks count), percent of its days."""
    total, done = F.datediff("end_date", "start_date") + 1, F.datediff(date_col, "start_date") + 1
    return df.withColumns({"weeks_total": F.ceil(total / 7), "weeks_elapsed": F.ceil(done / 7), "weeks_remaining": F.ceil((total - done) / 7), "progress_pct": F.try_divide(done, total) * 100})


def phase_context(phases: DataFrame, as_of) -> DataFrame:
    """SCO-17: one row a user: the active phase with progress, up to three upcoming, all that are active."""
    users = phases.select("user_id").distinct().withColumn("d", F.lit(as_of).cast("date"))
    now = phase_progress(active_phase(users, phases))
    now = now.select("user_id", F.when(F.col("start_date").isNotNull(), F.struct("phase_type", "name", "start_date", "end_date", "weeks_total", "weeks_elapsed", "weeks_remaining", "progress_pct")).alias("active"))
    up = upcoming_phases(phases, as_of).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "phase_type", "name", "start_date", "end_date"))).alias("upcoming"))
    every = phases.where(F.coalesce("is_active", F.lit(True))).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start_date", "end_date", "phase_type", "name"))).alias("phases"))
    return now.join(up, "user_id", "left").join(every, "user_id", "left")


def enrich(df: DataFrame, other: DataFrame, key: list[str], fill: list[str]) -> DataFrame:
    """JOIN-10: nulls of the `fill` columns from the row of `other` with that key."""
    o = other.dropDuplicates(key).select(*key, *[F.col(c).alias(f"_o_{c}") for c in fill])
    j = df.join(o, key, "left")
    return j.select(*[(F.coalesce(c, f"_o_{c}").alias(c) if c in fill else F.col(c)) for c in df.columns])


def missing(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """JOIN-11: rows whose key `other` lacks."""
    return df.join(other.select(*key).distinct(), key, "left_anti")


def titles(files: DataFrame, table: DataFrame) -> DataFrame:
    """JOIN-12, SRC-21: files (path) with the title their name or its stem has in the table (filename, title)."""
    name = lambda c: F.lower(F.regexp_extract(c, r"([^/]+)$", 1))
    stem = lambda c: F.regexp_replace(name(c), r"(\.gz)?$", "")
    bare = lambda c: F.regexp_replace(stem(c), r"\.(fit|tcx|gpx)$", "")
    # all three have one root, by which either side is dealt once
    root = lambda c: F.regexp_replace(c, r"(\.(gz|fit|tcx|gpx))+$", "")
    keys = table.select(F.explode(F.array_distinct(F.array(name("filename"), stem("filename"), bare("filename")))).alias("k"), "title").where("k is not null")
    keys = keys.withColumn("_root", root("k")).groupBy("_root", "k").agg(F.min("title").alias("t")).groupBy("_root").agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("_t"))
    f = files.withColumn("_root", root(name("path"))).join(keys, "_root", "left")
    return f.withColumn("title", F.coalesce(*[F.try_element_at("_t", k("path")) for k in (name, stem, bare)])).drop("_root", "_t")


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """JOIN-13: files whose SHA-256 isn't among the seen ones."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(seen.select("sha256").distinct(), "sha256", "left_anti")


def blocked_goals(goals: DataFrame, exceptions: DataFrame, as_of) -> DataFrame:
    """FLT-08, FLT-11: goals with the note of an exception that covers the day and names their type (the one that began last)."""
    day = F.lit(as_of).cast("date")
    x = exceptions.where(P.covers("start_date", "end_date", day)).select(F.col("user_id").alias("xu"), "affected_goal_types", "start_date", F.coalesce("override_hint", "reason", F.lit("Scheduled exception")).alias("note"))
    j = goals.join(x, (F.col("user_id") == F.col("xu")) & P.affects("affected_goal_types", "goal_type"), "left")
    return j.groupBy(*goals.columns).agg(F.max_by("note", F.struct("start_date", "note")).alias("schedule_note"))


def in_phase(rows: DataFrame, phases: DataFrame, date_col: str) -> DataFrame:
    """Rows with the phases of their user that hold their date: a range join within users."""
    p = phases.select(F.col("user_id").alias("pu"), "name", "start_date", "end_date")
    return rows.join(p, (F.col("user_id") == F.col("pu")) & P.covers("start_date", "end_date", date_col)).drop("pu")


