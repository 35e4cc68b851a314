"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pulseframe.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in res.fetchall())


def test_starts_a_quarter_of_an_hour_apart_but_for_a_fraction(spark, tmp_path):
    """str_ingest: by whole seconds within a batch, an incoming one against stored ones to the microsecond."""
    runs = [
        (1, 3, "01:50:21.062884"), (1, 20, "02:05:21.186853"),  # incoming 900.19 s after the stored second: both stay
        (2, 13, "01:50:21.900000"), (2, 30, "02:05:21.000000"),  # 900 s after it: replaced
        (3, 23, "02:05:21.900000"), (3, 40, "01:50:21.500000"),  # 899.5 s before it: replaced
        (4, 50, "03:00:00.100000"), (4, 62, "03:15:00.800000"),  # both incoming: one second's 900 s
        (5, 33, "04:00:00.100000"), (5, 43, "04:15:00.800000"),  # both stored
    ]
    c = duckdb.connect()
    rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-02 {at}', {u}::BIGINT, 'view', 30.0::DOUBLE, '{{\"k\": 30}}')" for u, i, at in runs)
    c.execute(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = {tuple(r) for r in catalog.queries()["str_ingest"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(catalog.oracle_sql()["str_ingest"]).fetchall())
    assert {r[2] for r in got if r[2].isdigit()} == {"3", "20", "30", "40", "50", "43"}
