"""Every query runs on the smallest tables, and equals its SQL where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from lexloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    columns = sorted(got.columns)
    frames = [x[columns].sort_values(columns).reset_index(drop=True) for x in (got, duck.sql(sql).df())]
    pd.testing.assert_frame_equal(*frames, check_dtype=False, rtol=1e-12)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
