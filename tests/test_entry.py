"""Driver contract and oracle parity (sf0.001) for every query that has SQL."""

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle import canon, duck


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "sensor_id" in df.columns and "trend_slope" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


DUCK_TYPES = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
              T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP",
              T.DateType: "DATE"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_parity(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    spark_types = {f.name: DUCK_TYPES.get(type(f.dataType), str(f.dataType)) for f in sdf.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    left = sdf.toPandas()
    right = rel.df()
    assert sorted(left.columns) == sorted(right.columns)
    assert len(left) == len(right)
    assert canon(left) == canon(right)
