"""SQL functions give what the column definitions give, and no Python runs in them."""

from pyspark.sql import functions as F

from pulseframe.functions import registry
from pulseframe.functions import scalars as S


def test_functions_of_sql(spark):
    own = spark.newSession()
    names = registry.register(own)
    assert set(names) == {*registry.SCALARS, *registry.TABLES} and registry.register(own) == names
    r = own.sql("SELECT km_to_miles(10), mass_to_lb(10, 'kg'), activity_family('Outdoor Run'), cardio_mode('Ride'), week_start(DATE '2024-01-24'), readiness(NULL, NULL, NULL, 0, 0), quantity_to_miles(NULL, 'km'), pace_seconds(600, 0)").first()
    want = spark.range(1).select(S.km_to_miles(F.lit(10.0)), S.mass_to_lb(F.lit(10.0), F.lit("kg")), S.activity_family(F.lit("Outdoor Run")), S.cardio_mode(F.lit("Ride")), S.week_start(F.to_date(F.lit("2024-01-24")))).first()
    assert tuple(r)[:5] == tuple(want) and tuple(r)[5:] == (None, None, None)
    assert [str(x.week) for x in own.sql("SELECT week FROM week_spine(DATE '2024-01-03', DATE '2024-01-15')").collect()] == ["2024-01-01", "2024-01-08", "2024-01-15"]
    assert own.sql("SELECT count(*) FROM day_spine(DATE '2024-02-01', DATE '2024-02-29') WHERE week = DATE '2024-02-05'").first()[0] == 7
    plan = own.sql("SELECT stage_hours(v, 'min') FROM VALUES (30.0D) t(v)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert not [f for f in spark.catalog.listFunctions() if f.name == "km_to_miles"]
