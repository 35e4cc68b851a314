"""The daily and weekly jobs: all users at once, step by step."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..session import ship
from ..operators import features, goals, joins, pace, power, rules, running, sleep, stats, strength
from ..sinks.store import Store
from ..sinks.tables import replace_patterns


def context_sections(parts: dict[str, DataFrame], as_of) -> DataFrame:
    """SCO-15: a row a user with a struct of each dated part's latest row, and a sorted list of each other part's rows."""
    out = None
    for name, df in parts.items():
        dated = next((c for c in ("metric_date", "feature_date", "snapshot_date", "week_start", "briefing_date") if c in df.columns), None)
        if dated:
            d = joins.latest_row(df, dated, as_of)
            d = d.select("user_id", F.struct(*[c for c in d.columns if c != "user_id"]).alias(name))
        else:
            # maps have no order, the other columns put the rows in one
            plain = [c for c, t in df.dtypes if c != "user_id" and "map<" not in t and "variant" not in t]
            row = F.struct(F.struct(*plain).alias("o"), F.struct(*[c for c in df.columns if c != "user_id"]).alias("r"))
            d = df.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias(name))
        out = d if out is None else out.join(d, "user_id", "full")
    return out


def context_document(parts: dict[str, DataFrame], as_of) -> DataFrame:
    """SCO-15: context_sections as one JSON text and, parsed once for typed paths, as a VARIANT; empty sections and null values are left out."""
    d = context_sections(parts, as_of).select("user_id", F.to_json(F.struct(*parts)).alias("document"))
    return d.withColumn("parsed", F.parse_json("document"))


def weekly_payload(metrics: DataFrame, feats: DataFrame, as_of, days: int = 60) -> DataFrame:
    """AGG-30: each user's last days as compact JSON, days without values left out."""
    day = F.lit(as_of).cast("date")
    j = metrics.select("user_id", F.col("metric_date").alias("d"), "sleep_hours", "hrv_rmssd", "resting_hr", "steps").join(feats.select("user_id", F.col("feature_date").alias("d"), "overall_readiness_score", "cardio_minutes_7d", "strength_tonnage_7d"), ["user_id", "d"], "full")
    n = F.datediff(day, F.col("d"))
    some = F.coalesce(*[F.col(c).cast("double") for c in j.columns[2:]]).isNotNull()
    return j.where((n >= 0) & (n <= days) & some).groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*j.columns[1:])))).alias("payload"))


def briefing(features_: DataFrame, flags: DataFrame, as_of, llm=None) -> DataFrame:
    """SNK-11: a note a user from a template; an injected `llm(text)` may word it instead (one call a user, made by the tasks)."""
    f = joins.latest_row(features_, "feature_date", as_of)
    lines = flags.where(F.col("feature_date") == F.lit(as_of).cast("date")).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]).alias("messages"), F.collect_list("code").alias("flags"))
    g = S.glance_block(S.glance_line("Readiness", "overall_readiness_score", "/100", digits=0), S.glance_line("Cardio 7 days", "cardio_minutes_7d", " min"), S.glance_line("Load ratio", "acute_chronic_ratio", digits=2), S.glance_line("Sleep debt", "sleep_debt_7d", " h"))
    j = f.join(lines, "user_id", "left")
    note = F.concat_ws("\n", F.lit("# Daily briefing"), g, F.concat_ws("\n", F.transform("messages", lambda m: F.concat(F.lit("- "), m))))
    out = j.select("user_id", F.lit(as_of).cast("date").alias("briefing_date"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), note.alias("coaching_note"), F.lit("template").alias("model_used"))
    if llm is None:
        return out

    def word(batches):
        for p in batches:
            yield p.assign(coaching_note=[llm(t) for t in p["coaching_note"]], model_used="llm")

    ship(out.sparkSession)
    return out.mapInPandas(word, out.schema)


class Report(list):
    """(step, ok, message) of each step."""

    @property
    def ok(self) -> bool:
        return all(x[1] for x in self)


def run_daily(store: Store, day: date, llm=None, send=None) -> Report:
    """§3.1: metrics, features, rules, goals, signals, briefing, delivery. A failed step stops the run, except for goals and delivery; each step's write is complete or absent, and a run again gives the same."""
    done, spark = Report(), store.spark
    made: dict[str, DataFrame] = {}

    def rollup():
        bio = store.read("biometrics", day, day)
        wide = features.pivot_metrics(bio, schemas.CANONICAL_METRICS, ["source", "raw_key"], tuple(schemas.INTEGER_METRICS))
        cols = [c for c in wide.columns if c != "sleep_score"]
        store.upsert("daily_health_metrics", wide.select(*cols))
        # a score's baseline is the 28 days before
        scored = sleep.fill_scores(store.read("daily_health_metrics", day - timedelta(days=28), day)).where(F.col("metric_date") == F.lit(day).cast("date"))
        store.upsert("daily_health_metrics", scored.select("user_id", "metric_date", "sleep_score"))

    def compute():
        users = store.read("user_settings").select("user_id").distinct().withColumn("feature_date", F.lit(day).cast("date"))
        # the longest window is 28 days
        from_, to = day - timedelta(days=27), day
        f = features.daily_features(store.read("strength_events", from_, to), store.read("cardio_events", from_, to), store.read("daily_health_metrics", from_, to), users)
        store.upsert("daily_features", f)

    def evaluate():
        today = store.read("daily_features", day, day)
        made["flags"] = rules.flags(today, store.read("daily_health_metrics", day, day))

    def snapshot():
        s = goals.goal_snapshot(store.read("goals"), store.read("strength_events"), store.read("running_sessions"), store.read("cardio_events"), store.read("schedule_exceptions"), store.read("interventions"), day.isoformat())
        store.upsert("daily_goal_snapshot", s)

    def signals():
        # earlier months as moments and counts, made again only where their days changed; the days of this month
        first, today = day.replace(day=1), F.lit(day).cast("date")
        with store.transaction() as t:
            t.derive("metric_moments", "daily_health_metrics", lambda d: running.moments(stats.to_long(d, stats.Z_METRICS)), f"{day:%Y-%m}")
            t.derive("metric_counts", "daily_health_metrics", lambda d: running.counts(stats.to_long(d, stats.IQR_METRICS)), f"{day:%Y-%m}")
        month = store.read("daily_health_metrics", first, day)
        last = store.read("daily_health_metrics", day - timedelta(days=max(stats.BASELINE_WINDOWS)), day)
        store.upsert("metric_baselines", stats.baselines(stats.to_long(last, stats.BASELINE_METRICS)).where(F.col("metric_date") == today))
        past = lambda table: store.read(table, until=first - timedelta(days=1))
        z = running.z_scores(running.merged(past("metric_moments")), stats.to_long(month, stats.Z_METRICS)).where(F.col("metric_date") == today)
        rows = stats.anomaly_rows(z, running.iqr_outliers(past("metric_counts"), stats.to_long(month, stats.IQR_METRICS), day.isoformat()))
        # of the day's month only
        scope = store.read("anomaly_events", day, day).where(F.col("anomaly_type") == "statistical")
        with store.transaction() as t:
            t.replace_matching("anomaly_events", rows, scope, ["user_id", "detected_date", "anomaly_type"])

    def write():
        made["briefing"] = briefing(store.read("daily_features", day, day), made["flags"], day.isoformat(), llm)
        store.upsert("daily_briefings", made["briefing"])

    def hand_over():
        from ..sinks.tables import deliver

        sent, failed = deliver(store.read("daily_briefings", day, day), send or print)
        if failed:
            raise RuntimeError(f"{failed} of {sent + failed} messages weren't taken")

    for name, step, fatal in (("rollup_metrics", rollup, True), ("compute_features", compute, True), ("evaluate_rules", evaluate, True), ("goal_snapshot", snapshot, False), ("compute_stat_signals", signals, True), ("generate_briefing", write, True), ("deliver", hand_over, False)):
        try:
            step()
            done.append((name, True, ""))
        except Exception as e:
            done.append((name, False, str(e)[:500]))
            if fatal:
                break
    spark.catalog.clearCache()
    return done


def run_weekly(store: Store, day: date) -> None:
    """§3.5: the patterns of the last 60 days replace the active ones."""
    from_, to = day - timedelta(days=stats.LOOKBACK), day - timedelta(days=1)
    p = stats.all_patterns(store.read("daily_health_metrics", from_, to), store.read("daily_features", from_, to), day.isoformat())
    rows = p.withColumns({"description": F.format_string("%s and %s (lag %d): r=%.2f", "metric_a", "metric_b", "lag_days", "correlation"), "last_confirmed_at": F.current_timestamp()}).drop("rank")
    store.replace("metric_patterns", replace_patterns(store.read("metric_patterns"), rows))


def refresh_ftp(store: Store, day: date, lookback: int = 90) -> None:
    """§3.2: each user's threshold from the best curve of the last days, into that day's metrics row (ftp columns only)."""
    rides = store.read("cardio_events", day - timedelta(days=lookback - 1), day)
    est = power.threshold(power.best_curve(rides))
    store.upsert("daily_health_metrics", est.withColumn("metric_date", F.lit(day).cast("date")))


def dashboard(sets: DataFrame, cardio: DataFrame, metrics: DataFrame, feats: DataFrame, phases: DataFrame, as_of) -> DataFrame:
    """SCO-15 composed: latest rows, strength progress, pace, phases, threshold."""
    return context_document({"metrics": metrics, "features": feats, "strength": strength.progress_summary(sets, as_of), "pace": pace.pace_summary(sets, cardio, as_of), "phases": joins.phase_context(phases, as_of)}, as_of)
