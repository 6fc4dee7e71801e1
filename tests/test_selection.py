"""Multi-rank selection, snapshots by interval join, p-values, distinct counts, segment totals and the model layer."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from attrition.functions.timeutil import erfc, two_sided_p
from attrition.operators import labels, metrics, models, quality, segments
from attrition.operators.features import FEATURES
from attrition.operators.rank import multi_ntile
from attrition.plans import model_store
from attrition.sources import io

from conftest import SF_SMALL


@pytest.mark.parametrize("n,final", [(0, 8), (1, 8), (3, 8), (7, 2), (1000, 8), (5000, 64), (5000, 4096)])
def test_multi_ntile_equals_window_ntile(spark, n, final):
    df = spark.range(n).select("id", (F.col("id") * 7919 % 13).alias("a"), F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 40).alias("b"),
                               (F.xxhash64("id") / 1e12).cast("decimal(20,2)").alias("c"))
    orders = {"ta": F.col("a"), "tb": -F.col("b"), "tc": F.col("c")}
    ours = multi_ntile(df, orders, 5, "id", final=final, sample=64, splitters=8)
    want = df.select("id", F.ntile(5).over(Window.orderBy("a", "id")).alias("ta"), F.ntile(5).over(Window.orderBy(F.desc("b"), "id")).alias("tb"),
                     F.ntile(5).over(Window.orderBy("c", "id")).alias("tc"))
    assert ours.columns == ["id", "a", "b", "c", "ta", "tb", "tc"]
    assert sorted(map(tuple, ours.select("id", "ta", "tb", "tc").collect())) == sorted(map(tuple, want.collect()))


def test_snapshots_by_interval_equal_the_flags(spark, make_tx):
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=k) for k in range(0, 200, 3)]
    rows = []
    for cust in range(1, 25):
        for k in range(cust % 5 + 1):
            at = dt.datetime(2001, 1, 1) + dt.timedelta(days=(cust * 37 + k * 41) % 210, seconds=(0, 1, 86399, 43200)[(cust + k) % 4])
            rows.append((f"{cust}-{k}", "A", 1, at.strftime("%Y-%m-%d %H:%M:%S"), 2.0, cust, "X"))
    tx = make_tx(rows)
    flags = labels.is_churned_at(tx, days)
    found = labels.is_churned_range(tx, days)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, flags.collect())) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for window, history in ((1, 0), (7, 30)):
        assert sorted(map(tuple, labels.is_churned_range(tx, days, window, history).collect())) == sorted(map(tuple, labels.is_churned_at(tx, days, window, history).collect()))
    assert labels.is_churned_range(tx, []).collect() == [] and labels.is_churned_range(tx.limit(0), days).collect() == []


def test_daily_snapshots_make_each_row_once(spark, make_tx):
    """No purchase day is expanded to the dates it is active for: rows of a date and a customer are neither joined nor aggregated."""
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=k) for k in range(150)]
    at = ("2000-11-02 00:00:00", "2000-11-02 09:30:00", "2001-01-01 00:00:00", "2001-03-05 23:59:59", "2001-03-05 23:59:59", "2001-08-01 00:00:01")
    tx = make_tx([(str(k), "A", 1, t, 2.0, cust, "X") for cust in (1, 2, 3) for k, t in enumerate(at[cust - 1::2])])
    tx = tx.unionByName(tx.limit(2).withColumn("invoice_ts", F.lit(None).cast("timestamp_ntz")))
    found = labels.is_churned_range(tx, days)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, labels.is_churned_at(tx, days).collect())) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert not [x for x in plan.splitlines() if ("Aggregate" in x or "Exchange hashpartitioning" in x) and "obs_date" in x], plan


def test_snapshots_equal_the_flags_on_the_table(spark, cal):
    from attrition.operators.clean import clean_transactions
    from attrition.sources.retail import retail_raw
    tx = clean_transactions(retail_raw(spark, SF_SMALL))
    days = [cal.observation - dt.timedelta(days=k) for k in range(0, 365, 28)]
    assert sorted(map(tuple, labels.is_churned_range(tx, days).collect())) == sorted(map(tuple, labels.is_churned_at(tx, days).collect()))


def test_erfc_and_p_values(spark):
    xs = [-3.0, -0.5, 0.0, 1e-9, 0.3, 1.0, 2.5, 6.0, 12.0, 25.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("e"), two_sided_p(F.col("x")).alias("p")).collect()
    for r in rows:
        assert math.isclose(r["e"], math.erfc(r["x"]), rel_tol=2e-7)
        assert math.isclose(r["p"], min(1.0, math.erfc(abs(r["x"]) / math.sqrt(2))), rel_tol=2e-7)
    assert spark.range(1).select(two_sided_p(F.lit(None).cast("double")).alias("p")).first()["p"] is None


@settings(max_examples=15, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([None, "", "a", "b"]), st.sampled_from([None, 0.0, -0.0, 1.5]), st.sampled_from([None, 1, 2, 10**15])), max_size=12))
def test_distinct_counts_equal_sql(spark, rows):
    df = spark.createDataFrame(rows, "s string, d double, n bigint")
    got = {r["column_name"]: (r["rows"], r["unique_values"]) for r in quality.distinct_counts(df, df.columns).collect()}
    want = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
    assert got == ({c: (len(rows), want[c]) for c in df.columns} if rows else {})
    assert "Expand" not in quality.cardinality(df)._jdf.queryExecution().executedPlan().toString()


def test_total_differs_from_customers_without_a_segment(spark):
    seg = spark.createDataFrame([("SAFE", 0), ("SAFE", 1), (None, 1), (None, 0), (None, 0), ("HIGH_RISK", 1)], "risk_segment string, actual_churned int")
    rows = [(r["risk_segment"], r["customers"], r["churned"], r["pct_of_base"]) for r in segments.segment_totals(seg).collect()]
    assert rows == [("HIGH_RISK", 1, 1, 16.67), ("SAFE", 2, 1, 33.33), (None, 3, 1, 50.0), ("TOTAL", 6, 3, 100.0)]
    assert segments.segment_totals(seg.limit(0)).collect() == []


def test_summary_stands_in_where_there_is_no_report(spark):
    r = segments.executive_summary(None, spark).first()
    assert (r["optimal_threshold"], r["roi"], r["net_benefit"], r["annual_benefit"]) == (0.35, 250.0, 15000.0, 60000.0)


def test_tied_models_are_chosen_by_name(spark):
    rows = [(m, i, p, y) for m in ("b", "a", "c") for i, (p, y) in enumerate([(0.9, 1), (0.4, 0), (0.6, 1 if m != "c" else 0)])]
    s = spark.createDataFrame(rows, "model string, customer_id bigint, churn_probability double, actual int")
    assert metrics.select_model(s).first()["model"] == "a"
    auc = {r["model"]: r["roc_auc"] for r in metrics.evaluate_scores(s).collect()}
    assert auc["a"] == auc["b"] == 1.0


@pytest.fixture(scope="module")
def held(spark):
    return model_store.store(spark, SF_SMALL)


def test_store_belongs_to_the_state_of_the_tables(spark, held, tmp_path):
    assert model_store.store(spark, SF_SMALL) is held
    for t in model_store.RETAIL_TABLES:
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    other = model_store.store(spark, str(tmp_path))
    assert other is not held and model_store.store(spark, str(tmp_path)) is other
    spark.read.parquet(f"{SF_SMALL}/nation.parquet").limit(3).write.mode("overwrite").parquet(str(tmp_path / "nation.parquet"))
    assert model_store.store(spark, str(tmp_path)) is not other


def test_saved_pipeline_carries_its_scaler(spark, held, tmp_path):
    model, test = held.model("logistic"), held.part("test")
    loaded = models.load_model(models.save_model(model, str(tmp_path / "m")))
    a, b = ({r["customer_id"]: r["churn_probability"] for r in models.score(m, test, "x").collect()} for m in (model, loaded))
    assert a == b and len(a) > 0
    stats = {r["feature"]: (r["mean"], r["std"] or 1.0) for r in models.standard_scaler(held.part("train")).collect()}
    row = loaded.stages[0].transform(test).first()
    for c in FEATURES:
        assert math.isclose(row[f"scaled_{c}"], (float(row[c]) - stats[c][0]) / stats[c][1], rel_tol=1e-12, abs_tol=1e-12)


def test_fallback_takes_only_absent_models(spark, held, tmp_path):
    model = held.model("logistic")
    folder = models.save_models({"first": model, "second": model}, str(tmp_path / "models"))
    assert models.resolve_model(spark, folder, ("first", "second"))[0] == "first"
    assert io.delete_path(spark, f"{folder}/first") and not io.delete_path(spark, f"{folder}/first")
    assert models.resolve_model(spark, folder, ("first", "second"))[0] == "second"
    (tmp_path / "models" / "first").mkdir()
    with pytest.raises(Exception) as e:
        models.resolve_model(spark, folder, ("first", "second"))
    assert not isinstance(e.value, FileNotFoundError)
    with pytest.raises(FileNotFoundError):
        models.resolve_model(spark, str(tmp_path / "none"))


def test_gradient_tells_an_optimum_from_other_points(spark, held):
    train = held.part("train")
    model = held.model("logistic")
    assert models.optimality_check(model, train).first()["at_optimum"]
    moved = models.train_logistic(train.withColumn("is_churned", F.when(F.col("customer_id") % 3 == 0, 1 - F.col("is_churned")).otherwise(F.col("is_churned"))))
    assert not models.optimality_check(moved, train).first()["at_optimum"]
    assert models.probability_check(model, held.part("test")).first()[1:] == (True, True)
    assert models.probability_check(model, held.part("test").limit(0)).first()[:] == (0, True, True)


def test_forest_keeps_the_rows_nodes(held):
    forest = held.model("random_forest").stages[-1]
    assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() >= 512
    assert (forest.getNumTrees, forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (200, 15, 5)


def _training_rows(spark, n=400):
    """Rows of all features: some repeat another one, nearly or to a factor, one is constant."""
    x = lambda k: F.pmod(F.xxhash64("customer_id", F.lit(k)), F.lit(1000)) / 100.0
    rows = spark.range(1, n + 1).select(F.col("id").alias("customer_id"))
    base = {0: F.lit(3.0), 2: x(1) + x(2) / 10_000, 3: x(1) * 7, 4: x(1) - x(2) / 1000, 5: x(2)}
    rows = rows.select("customer_id", *[base.get(i, x(i)).alias(c) for i, c in enumerate(FEATURES)])
    return rows.withColumn("is_churned", (F.col(FEATURES[1]) + x(99) > 11).cast("int"))


def _stages(spark, group, run):
    """What ``run`` returns, the jobs it took and the tasks of their stages."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    return out, len(jobs), [i.numTasks for i in map(tracker.getStageInfo, stages) if i]


def test_logistic_reaches_the_optimum_in_few_passes(spark):
    train = _training_rows(spark).localCheckpoint()
    model, jobs, _ = _stages(spark, "logistic", lambda: models.train_logistic(train))
    assert jobs < 100 and model.stages[-1].summary.totalIterations <= 1
    worst = models.objective_gradient(model, train).select(F.max(F.abs("gradient"))).first()[0]
    assert worst < 1e-7
    coefficients = model.stages[-1].coefficients.toArray()
    assert len(coefficients) == len(FEATURES) and abs(coefficients[0]) < 1e-9
    assert models.probability_check(model, train).first()[:] == (400, True, True)


def test_logistic_of_one_class_and_of_constant_features(spark):
    one = _training_rows(spark, 20).withColumn("is_churned", F.lit(1))
    assert {r["predicted"] for r in models.score(models.train_logistic(one), one, "x").collect()} == {1}
    flat = spark.range(12).select(F.col("id").alias("customer_id"), *[F.lit(2.0).alias(c) for c in FEATURES], (F.col("id") % 3 == 0).cast("int").alias("is_churned"))
    model = models.train_logistic(flat)
    assert set(model.stages[-1].coefficients.toArray()) == {0.0} and math.isclose(model.stages[-1].intercept, 0.0, abs_tol=1e-6)


def test_training_passes_have_tasks_by_rows_not_by_files(spark, monkeypatch):
    train = _training_rows(spark).repartition(64).localCheckpoint()
    model, _, tasks = _stages(spark, "boosted", lambda: models.train_boosted_trees(train, max_iter=2))
    assert model.stages[-1].getNumTrees == 2
    assert sum(tasks) < 500 and sum(n >= 64 for n in tasks) <= 2
    monkeypatch.setattr(models, "ROWS_A_TASK", 40)
    assert models._in_few_tasks(train, 400).rdd.getNumPartitions() == 10
    assert models._in_few_tasks(train, 0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
