"""Keyed merges as functions of frames: (stored rows, incoming rows) to the rows that the table then has.

Rows are merged by their key's shuffle, never collected. `store` keeps tables and applies these to the parts they touch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import ship

def checked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a key are an error when the plan runs."""
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    return rows.withColumn(key[0], F.when(bad, F.raise_error(F.lit("null in the key"))).otherwise(F.col(key[0])))


def upsert(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """SNK-01, SNK-03, SNK-05: stored rows with the supplied columns of `rows` set, and its new keys added.

    Columns that `rows` lacks keep their values; supplied nulls are stored; updated_at, if stored has it, becomes the time
    of the merge for the rows that it writes. Of rows with one key the last by content wins.
    """
    if touch := "updated_at" in stored.columns:
        rows = rows.drop("updated_at")
    new = checked(rows, key)
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in rows.columns if c not in key and not dict(rows.dtypes)[c].startswith(("map", "variant"))] or [F.lit(0)])
    new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("_new", F.lit(True)).drop("_n")
    new = new.select(*key, "_new", *[F.col(c).alias(f"_n_{c}") for c in rows.columns if c not in key])
    j = stored.join(new, key, "full")
    cols = [F.col(c) if c in key or c not in rows.columns else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
    out = j.select("_new", *cols)
    return (out.withColumn("updated_at", F.when(F.col("_new"), F.current_timestamp()).otherwise(F.col("updated_at"))) if touch else out).drop("_new")


def insert_if_absent(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """SNK-02: stored rows and those of `rows` whose key isn't there yet, with the time of the merge as updated_at if stored has it."""
    new = checked(rows, key).dropDuplicates(key).join(stored.select(*key), key, "left_anti")
    new = new.withColumn("updated_at", F.current_timestamp()) if "updated_at" in stored.columns else new
    return stored.unionByName(new, allowMissingColumns=True)


def replace_matching(stored: DataFrame, rows: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    """SNK-04, SNK-08: stored rows outside the scope's keys, and the new rows. An empty `rows` still deletes."""
    return stored.join(scope.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_calendar(stored: DataFrame, rows: DataFrame, tag: str = "source=caldav") -> DataFrame:
    """SNK-08: tagged interventions of the touched dates; nothing happens without rows."""
    days = rows.select(F.col("user_id").alias("u"), F.col("event_date").alias("d")).distinct()
    gone = (F.col("user_id") == F.col("u")) & (F.col("event_date") == F.col("d")) & F.coalesce(F.contains("notes", F.lit(tag)), F.lit(False))
    return stored.join(days, gone, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_patterns(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK-06: the users' active patterns go, a key that comes back is active again."""
    key = schemas.KEYS["metric_patterns"]
    left = stored.where(F.coalesce(F.col("status") != "active", F.lit(True))).join(rows.select(*key), key, "left_anti")
    other = stored.where("status = 'active'").join(rows.select("user_id").distinct(), "user_id", "left_anti")
    return left.unionByName(other).unionByName(rows, allowMissingColumns=True)


def delete_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK-07: without the rows of these (user_id, source_id)."""
    return stored.join(ids.select("user_id", "source_id").distinct(), ["user_id", "source_id"], "left_anti")


def append(stored: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """SNK-09: checked plain inserts."""
    return schemas.conform(stored, table).unionByName(schemas.conform(rows, table))


def update_phase(stored: DataFrame, phase_id: str, **changes) -> DataFrame:
    """SNK-10: the phase with the changes; an end before its start is an error."""
    hit = F.col("id") == phase_id
    out = stored.withColumns({k: F.when(hit, F.lit(v).cast(stored.schema[k].dataType)).otherwise(F.col(k)) for k, v in changes.items()})
    out = out.withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))) if "updated_at" in stored.columns else out
    return out.withColumn("end_date", F.when(hit & (F.col("end_date") < F.col("start_date")), F.raise_error(F.lit("end before start"))).otherwise(F.col("end_date")))


def backfill_apps(stored: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-12: (winners enriched from raw, ids of losers): nulls filled by source_id, then hub copies resolved."""
    from ..operators import cardio_dedup, joins

    full = joins.enrich(stored, raw, ["user_id", "source_id"], ["source_app", "started_at"])
    kept = cardio_dedup.dedupe_hub(full)
    return kept, full.join(kept.select("user_id", "source_id"), ["user_id", "source_id"], "left_anti").select("user_id", "source_id")


def phase_row(user_id: str, phase_id: str, kind: str, name: str, start, end) -> dict:
    """PRJ-38: a checked row of training_phases."""
    if end < start:
        raise ValueError("end before start")
    return {"user_id": user_id, "id": phase_id, "phase_type": kind.strip().lower().replace(" ", "_"), "name": name.strip(), "start_date": start, "end_date": end, "is_active": True}


JOURNAL = ("note", "injury", "illness", "travel", "mood", "nutrition", "other")


def journal_row(user_id: str, day, category: str, body: str) -> dict:
    """PRJ-38: a checked row of athlete_journal_entries."""
    category = category.strip().lower()
    if category not in JOURNAL:
        raise ValueError(f"no such category: {category}")
    if not body.strip():
        raise ValueError("empty body")
    return {"user_id": user_id, "entry_date": day, "category": category, "body": body.strip()}


def run_row(user_id: str, source_id: str, day, km: float | None = None, miles: float | None = None, minutes: float | None = None, kind: str = "run") -> dict:
    """PRJ-38: a run given in kilometres or miles."""
    km = km if km is not None else miles * 1.609344 if miles is not None else None
    if km is None or km < 0:
        raise ValueError("no distance")
    return {"user_id": user_id, "source": "manual", "source_id": source_id, "session_date": day, "run_type": kind, "distance_km": km, "duration_min": minutes}


def goal_row(user_id: str, goal_type: str, low=None, high=None, active: bool = True) -> dict:
    """PRJ-38, §2.13: a checked goal."""
    if low is not None and high is not None and high < low:
        raise ValueError("target_max below target_min")
    return {"user_id": user_id, "goal_type": goal_type.strip().lower(), "target_min": low, "target_max": high, "is_active": active}


def to_html(note: str) -> str:
    """SNK-11: a note's headings, bullets, emphasis and paragraphs as HTML."""
    import html
    import re

    out, listed = [], False
    for line in note.splitlines():
        text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", html.escape(line.strip()))
        text = re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", text)
        bullet = re.match(r"[-*]\s+(.*)", text)
        if listed and not bullet:
            out.append("</ul>")
            listed = False
        if bullet:
            if not listed:
                out.append("<ul>")
                listed = True
            out.append(f"<li>{bullet[1]}</li>")
        elif head := re.match(r"(#{1,3})\s+(.*)", text):
            out.append(f"<h{len(head[1])}>{head[2]}</h{len(head[1])}>")
        elif text:
            out.append(f"<p>{text}</p>")
    return "\n".join(out + ["</ul>"] * listed)


def deliver(briefing: DataFrame, send=print) -> tuple[int, int]:
    """SNK-11: each user's one row as (subject, text, html) to an injected sender, called by the tasks; (sent, failed).

    The sender travels to the tasks, so it has to be picklable. A task that runs again sends its messages again; one
    that the sender refuses doesn't stop the others.
    """
    ship(briefing.sparkSession)

    def run(batches):
        for p in batches:
            ok = 0
            for day, note in zip(p["briefing_date"], p["coaching_note"]):
                try:
                    send((f"Daily briefing {day}", note, to_html(note or "")))
                    ok += 1
                except Exception:
                    continue
            yield pd.DataFrame({"sent": [ok], "failed": [len(p) - ok]})

    r = briefing.select("briefing_date", "coaching_note").mapInPandas(run, "sent long, failed long").agg(F.sum("sent"), F.sum("failed")).first()
    return r[0] or 0, r[1] or 0
