"""The library's projections and scores as functions of SQL, made from the same definitions.

A definition is called once with columns named as the parameters; the SQL text of the resolved expression becomes the
body of a temporary SQL function, which the optimizer inlines: no second copy of a formula and no Python per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import scalars as S
from . import scores

#: Name: (definition, parameters with their types).
SCALARS: dict[str, tuple[Callable[..., Column], str]] = {
    "as_day": (S.as_date, "x string"),
    "as_instant": (S.instant, "x string"),
    "week_start": (S.week_start, "d date"),
    "previous_month": (S.previous_month, "d date"),
    "km_to_miles": (S.km_to_miles, "km double"),
    "miles_to_km": (S.miles_to_km, "miles double"),
    "quantity_to_miles": (S.quantity_to_miles, "qty double, unit string"),
    "quantity_to_feet": (S.quantity_to_feet, "qty double, unit string"),
    "mass_to_lb": (S.mass_to_lb, "qty double, unit string"),
    "sleep_hours_of": (S.sleep_hours, "total double, asleep double"),
    "stage_hours": (S.stage_hours, "v double, unit string"),
    "kilocalories": (S.kilocalories, "qty double, unit string"),
    "pace_seconds": (S.pace_seconds, "seconds double, miles double"),
    "cardio_mode": (S.cardio_mode, "activity string"),
    "activity_family": (S.activity_family, "activity string"),
    "power_source_rank": (S.power_source_rank, "source string"),
    "session_focus": (S.session_focus, "name string"),
    "readiness_band": (S.readiness_band, "x double"),
    "readiness": (scores.readiness, "debt double, suppressed int, acwr double, sleep_days int, hrv_days int"),
    "goal_pace": (scores.goal_pace, "done double, target double, day date, week date"),
}

#: Table functions: parameters, columns, and the query, in which the scalars can stand.
TABLES: dict[str, tuple[str, str, str]] = {
    "day_spine": ("first date, last date", "day date, week date", "SELECT day, week_start(day) FROM (SELECT explode(sequence(day_spine.first, day_spine.last, INTERVAL 1 DAY)) AS day)"),
    "week_spine": ("first date, last date", "week date", "SELECT explode(sequence(CAST(date_trunc('week', week_spine.first) AS DATE), CAST(date_trunc('week', week_spine.last) AS DATE), INTERVAL 7 DAYS)) AS week"),
}


def body(spark: SparkSession, name: str) -> tuple[str, str]:
    """(type, SQL text) of a scalar's definition over its parameters."""
    define, params = SCALARS[name]
    names = [p.split()[0] for p in params.split(", ")]
    one = spark.createDataFrame([], params).select(define(*[F.col(p) for p in names]).alias("out"))
    resolved = one._jdf.queryExecution().analyzed().expressions().apply(0).child()
    return one.schema["out"].dataType.simpleString(), resolved.sql()


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, replacing those of these names; their names."""
    for name, (_, params) in SCALARS.items():
        kind, text = body(spark, name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {text}")
    for name, (params, columns, text) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({columns}) RETURN {text}")
    return [*SCALARS, *TABLES]
