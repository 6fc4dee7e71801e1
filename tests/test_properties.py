"""Property tests of the distributed ranking machinery against plain references."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from attrition.operators.rank import _numbered, global_ntile, grouped_percentiles, grouped_running_sums

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_tied_third_is_split_over_partitions(spark):
    # a third of the rows share one value: the range partitioning on (value, id) spreads them
    df = spark.range(0, 3000).withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") * 1.0))
    numbered = _numbered(df, [F.col("v").asc(), F.col("id").asc()], 8)
    sizes = [r["count"] for r in numbered.groupBy("_pid").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 3000 / 3


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-5, 5)), min_size=1, max_size=60),
       st.sampled_from([0.01, 0.25, 0.5, 0.75, 0.99]))
def test_grouped_percentiles_match_numpy(spark, rows, p):
    df = spark.createDataFrame(rows, "g string, x long")
    got = {r["g"]: r["q"] for r in grouped_percentiles(df, ["g"], "x", [p], ["q"]).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([x for k, x in rows if k == g], dtype=float)
        assert got[g] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


@SETTINGS
@given(st.lists(st.integers(0, 4), min_size=1, max_size=50), st.integers(1, 7))
def test_ntile_matches_window(spark, values, k):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    ours = global_ntile(df, [F.col("v").desc(), F.col("id").asc()], k, "q", num_partitions=4)
    ref = df.withColumn("q2", F.ntile(k).over(Window.orderBy(F.col("v").desc(), "id")))
    assert all(r["q"] == r["q2"] for r in ours.join(ref, "id").collect())


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["m1", "m2"]), st.integers(0, 9), st.integers(0, 3)), min_size=1, max_size=40))
def test_grouped_running_sums_match_window(spark, rows):
    df = spark.createDataFrame(rows, "g string, k long, x long").groupBy("g", "k").agg(F.sum("x").alias("x"))
    ours = grouped_running_sums(df, ["g"], [F.col("k").desc()], ["x"])
    w = Window.partitionBy("g").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("x").over(w))
    joined = ours.join(ref, ["g", "k"]).collect()
    assert len(joined) == df.count() and all(r["x_cum"] == r["ref"] for r in joined)
