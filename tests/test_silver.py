import math

from pyspark.sql import functions as F

from gaugeflow.operators import silver as silv
from gaugeflow.sources.tables import sensor_dimension
from gaugeflow.plans import checked
from tests.conftest import SF_CHECK

SCHEMA = "id BIGINT, sensor_id STRING, sensor_type STRING, value DOUBLE, unit STRING, timestamp TIMESTAMP, location STRING"


def _silver(spark, rows):
    df = spark.createDataFrame([(i, s, "t", v, "u", None, "l") for i, (s, v) in enumerate(rows)], SCHEMA)
    dim, n = sensor_dimension(spark)
    out = silv.silver_range(df, dim, dim_rows=n).orderBy("id").collect()
    return [(r["is_valid"], r["quality_score"], r["cleaned_value"]) for r in out]


def test_range_rules_edge_rows(spark):
    rows = [("TEMP_001", 20.0), ("TEMP_001", 38.0), ("TEMP_001", 37.5), ("TEMP_001", 50.1),
            ("TEMP_001", 3.5), ("VIB_001", -5.0), ("TEMP_001", 1500.0), ("X_999", -1500.0),
            ("X_999", 5.0), ("TEMP_001", float("nan"))]
    got = _silver(spark, rows)
    assert got[0] == (True, 1.0, 20.0)
    assert got[1] == (True, 0.5, 38.0)
    assert got[2] == (True, 1.0, 37.5)           # strict comparison at the boundary
    assert got[3] == (False, 0.05, 50.1)
    assert got[4] == (False, 0.05, 3.5)
    assert got[5] == (False, 0.05, -5.0)
    assert got[6] == (False, 1.0 * 0.5 * 0.1 * 0.7, 1500.0)   # bit-exact product, value unchanged
    assert got[7] == (True, 0.7, -1500.0)        # unknown sensor: only the magnitude rule
    assert got[8] == (True, 1.0, 5.0)
    assert got[9][0] is True and got[9][1] == 1.0 and math.isnan(got[9][2])


def test_sentinel_rules(spark):
    df = spark.createDataFrame([(0, 5.0), (1, None), (2, 999.0), (3, -999.0), (4, float("nan")), (5, 998.9)],
                               "id INT, value DOUBLE")
    out = silv.silver_sentinel(df).orderBy("id").collect()
    assert [(r.is_valid, r.cleaned_value, r.quality_score) for r in out] == [
        (True, 5.0, 1.0), (False, 0.0, 0.0), (False, 0.0, 0.0), (False, 0.0, 0.0), (False, 0.0, 0.0),
        (True, 998.9, 1.0)]


def test_quality_distribution_sf001(spark):
    s = checked.events_silver(spark, SF_CHECK)
    got = {(r.quality_score, r.is_valid): r.n for r in
           s.groupBy("quality_score", "is_valid").agg(F.count("*").alias("n")).collect()}
    assert got == {(1.0, True): 7611, (0.5, True): 1384, (0.05, False): 1005}


def test_dimension_lookup_is_broadcast(spark):
    s = checked.events_silver(spark, SF_CHECK)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_envelopes_split_oversized_batches(spark):
    from pyspark.sql import functions as F
    from gaugeflow.operators import bronze
    rows = [(i, f"s{i % 3}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id BIGINT, sensor_id STRING, value DOUBLE")
    batch = F.when(F.col("id") < 25, F.lit(0)).otherwise(F.lit(1 + F.col("id") % 3))  # batch 0: 25 rows
    env = bronze.nest_batches(df, batch, max_readings=10)
    sizes = {(r.batch_id, r.part): r.n for r in env.select("batch_id", "part", F.size("sensor_readings").alias("n")).collect()}
    assert sum(n for (b, _), n in sizes.items() if b == 0) == 25
    assert {p for (b, p) in sizes if b == 0} <= {0, 1, 2} and len([1 for (b, _) in sizes if b == 0]) >= 2
    assert all(p == 0 for (b, p) in sizes if b != 0)                  # ordinary batches stay whole
    assert env.select("id").distinct().count() == env.count()
    back = bronze.unnest_batches(env).select("id").collect()
    assert sorted(r.id for r in back) == list(range(40))              # every reading exactly once
