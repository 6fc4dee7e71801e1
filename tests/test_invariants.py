"""Invariants on the test tables, the leakage property and plan shapes."""

import datetime as dt
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attrition.operators import churn, cost, features, labels, metrics
from attrition.operators.clean import clean_transactions, cleaning_waterfall
from attrition.operators.rank import global_ntile, global_rank
from attrition.operators.shapes import with_customer
from attrition.plans.registry import QUERIES
from attrition.sources.retail import retail_raw

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def raw(spark):
    return retail_raw(spark, SF_SMALL).cache()


@pytest.fixture(scope="module")
def tx(raw):
    return clean_transactions(raw).cache()


def test_buckets_cover_the_population(tx, cal):
    total = churn.churn_rate_overall(tx, cal).collect()[0]["total_customers"]
    for fn in (churn.churn_by_tenure, churn.churn_by_frequency, churn.churn_by_monetary_quintile):
        assert fn(tx, cal).agg(F.sum("customers")).collect()[0][0] == total


def test_waterfall_adds_up(raw, tx):
    wf = cleaning_waterfall(raw).orderBy("step").collect()
    assert wf[-1]["rows_after"] == tx.count()
    assert wf[0]["rows_input"] - sum(r["rows_removed"] for r in wf) == wf[-1]["rows_after"]


def test_confusion_counts_add_up(tx, cal):
    s = metrics.heuristic_scores(tx, cal)
    n = s.count()
    for r in cost.threshold_sweep(s).collect():
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == n


@pytest.mark.parametrize("n", [1, 4, 5, 7, 23])
def test_distributed_ntile_equals_window_ntile(spark, n):
    vals = [(i, float(i % 3)) for i in range(n)]  # heavy ties
    df = spark.createDataFrame(vals, "id bigint, v double")
    ours = global_ntile(df, [F.col("v").asc(), F.col("id").asc()], 5, "q", num_partitions=3)
    ref = df.withColumn("q2", F.ntile(5).over(Window.orderBy("v", "id")))
    joined = ours.join(ref, "id").collect()
    assert all(r["q"] == r["q2"] for r in joined) and len(joined) == n


def test_global_rank_is_a_permutation(spark):
    df = spark.range(0, 1000).withColumn("v", (F.col("id") * 7919) % 13)
    r = global_rank(df, [F.col("v").asc(), F.col("id").asc()], "pos", num_partitions=7)
    got = sorted(x["pos"] for x in r.select("pos").collect())
    assert got == list(range(1000))


def test_split_partitions_the_customers(tx, cal):
    s = labels.model_ready_split(tx, cal)
    assert s.count() == s.select("customer_id").distinct().count()
    sizes = dict((r["split"], r["count"]) for r in s.groupBy("split").count().collect())
    n = sum(sizes.values())
    assert abs(sizes["test"] - 0.2 * n) <= 2


def test_feature_matrix_key_unique(tx, cal):
    fm = features.feature_matrix(tx, cal)
    assert fm.count() == fm.select("customer_id").distinct().count()
    assert len(fm.columns) == 36


def _extra_lines(spark, tx, when: dt.datetime):
    ids = tx.select("customer_id").distinct().limit(20)
    return tx.unionByName(ids.select(F.lit("X1").alias("invoice"), F.lit("999").alias("stock_code"),
                                     F.lit("extra").alias("description"), F.lit(3.0).alias("quantity"),
                                     F.lit(when).cast("timestamp_ntz").alias("invoice_ts"),
                                     F.lit(9.99).alias("price"), "customer_id", F.lit("X").alias("country")))


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_features_ignore_lines_after_observation(spark, tx, cal):
    later = _extra_lines(spark, tx, dt.datetime(2001, 6, 2, 0, 0, 1))
    assert _same(features.feature_matrix(tx, cal), features.feature_matrix(later, cal))


def test_labels_ignore_lines_after_prediction_end(spark, tx, cal):
    later = _extra_lines(spark, tx, dt.datetime(2001, 8, 1, 0, 0, 1))
    assert _same(labels.churn_labels(tx, cal), labels.churn_labels(later, cal))


def _checks(tx, cal, feats, labs):
    return {r["check_name"]: r["passed"] for r in labels.leakage_checks(feats, labs, tx, cal).collect()}


def test_leakage_checks_pass(tx, cal):
    assert all(_checks(tx, cal, features.feature_matrix(tx, cal), labels.churn_labels(tx, cal)).values())


@pytest.mark.parametrize("broken,leak", [
    ("recency_not_negative", lambda f, lab: (f.withColumn("recency_days", F.col("recency_days") - 10_000), lab)),
    ("recency_recomputed", lambda f, lab: (f.withColumn("recency_days", F.col("recency_days") + 1), lab)),
    ("active_buy_in_label_period", lambda f, lab: (f, lab.withColumn("is_churned", F.lit(0)))),
    ("churned_do_not_buy", lambda f, lab: (f, lab.withColumn("is_churned", F.lit(1)))),
    ("labels_known_once", lambda f, lab: (f, lab.unionByName(lab.limit(1)))),
    ("labels_known_once", lambda f, lab: (f, lab.unionByName(lab.limit(1).withColumn("customer_id", F.lit(-5).cast("bigint"))))),
])
def test_leakage_checks_catch_planted_leaks(tx, cal, broken, leak):
    feats, labs = leak(features.features_recency(tx, cal), labels.churn_labels(tx, cal))
    assert not _checks(tx, cal, feats, labs)[broken]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["churn_by_monetary_quintile", "rfm_cells", "stratified_split"])
def test_no_global_window_ranking(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert not re.search(r"\bntile\(|\brow_number\(", plan)


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith((
    "train_", "model_comparison_ml", "score", "ml_", "save_load", "coefficient_ranking", "feature_importance", "resolve_model", "validation_log", "logistic_", "model_decisions"))))
def test_no_row_python_udf_or_cartesian(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # only pre-aggregated rows may be gathered in one task
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in lines[i + 1], lines[i + 1]


def test_layout_is_the_callers_choice(spark, make_tx, tmp_path):
    from attrition.plans.pipeline import largest_customer_share, materialize_transactions
    tx = make_tx([(str(i), "A", 1, f"2001-01-{i % 28 + 1:02d} 10:00:00", 2.0, 1 if i < 60 else i, "X") for i in range(100)])
    assert largest_customer_share(tx) == (60, 100)
    assert materialize_transactions(tx, str(tmp_path / "t")).count() == 100
    with pytest.raises(ValueError):
        materialize_transactions(tx, str(tmp_path / "u"), layout="bucketed")


def test_customer_join_spreads_a_dominant_customer(spark):
    """Half of the rows belong to one customer; no task of the join holds more than a few of its salts."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("customer_id"), F.col("id").alias("invoice"))
    per = rows.groupBy("customer_id").agg(F.max("invoice").alias("last"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(keep, ("16", "-1", "false"), strict=True):
            spark.conf.set(k, v)
        joined = with_customer(rows, per, "invoice").where("customer_id = -1").groupBy(F.spark_partition_id()).count().collect()
        plain = rows.join(per, "customer_id").where("customer_id = -1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(plain) == 1 and sum(r["count"] for r in joined) == 20_000
    assert len(joined) >= 6 and max(r["count"] for r in joined) < 20_000 / 3


def test_malformed_lines_go_to_quarantine_in_batch_and_stream(spark, tmp_path):
    from attrition.sources import io
    from attrition.streaming import stream_clean_transactions
    head = "invoice,stock_code,description,quantity,invoice_ts,price,customer_id,country"
    good = "1,A,x,2.0,2001-01-02 03:04:05.654321,1.5,7,X"
    bad = ["2,A,x,two,2001-01-02 03:04:05,1.5,7,X", "3,A,x,2.0,yesterday,1.5,7,X", "4,A,x,2.0,2001-01-02 03:04:05,1.5,seven,X"]
    src = tmp_path / "csv"
    src.mkdir()
    (src / "a.csv").write_text("\n".join([head, good, *bad, "5,A,x,1.0,2001-01-02 03:04:05,1.5,8,X"]) + "\n")
    read = io.read_transactions_csv(spark, str(src), quarantine=str(tmp_path / "q"))
    rows = {r["invoice"]: r for r in read.collect()}
    assert set(rows) == {"1", "5"} and rows["1"]["invoice_ts"].microsecond == 654321
    assert sorted(r["line"] for r in io.read_quarantine(spark, str(tmp_path / "q")).collect()) == bad
    back = io.read_transactions_csv(spark, io.write_transactions_csv(read, str(tmp_path / "w")), str(tmp_path / "q2"))
    assert {r["invoice_ts"].microsecond for r in back.collect()} == {654321, 0}
    stream_clean_transactions(spark, str(src), str(tmp_path / "s"), str(tmp_path / "sq"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert {(r["line"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "sq")).collect()} == {(x, "malformed") for x in bad}


def test_stream_split_survives_a_stop_between_its_writes(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    from attrition.streaming import stream_clean_transactions
    head = "invoice,stock_code,description,quantity,invoice_ts,price,customer_id,country"
    src, places = tmp_path / "csv", [str(tmp_path / x) for x in ("s", "q", "c")]
    src.mkdir()
    for k in range(3):
        lines = [f"{k}{i},A,x,{'two' if i == 3 else -1.0 if i == 4 else 2.0},2001-01-02 03:04:05,1.5,{'' if i == 5 else 7},X" for i in range(8)]
        (src / f"f{k}.csv").write_text("\n".join([head, *lines]) + "\n")

    def stop(number):
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        stream_clean_transactions(spark, str(src), *places, max_files_per_trigger=1, between=stop).awaitTermination()
    stream_clean_transactions(spark, str(src), *places, max_files_per_trigger=1).awaitTermination()
    clean, aside = spark.read.parquet(places[0]), spark.read.parquet(places[1])
    assert clean.count() == clean.select("invoice").distinct().count() == 15 and clean.select("batch").distinct().count() == 3
    assert {r["reason"]: r["count"] for r in aside.groupBy("reason").count().collect()} == {"malformed": 3, "positive_quantity": 3, "has_customer": 3}


def test_approximate_profiles_are_close_to_exact(raw):
    from attrition.operators.quality import cardinality, numeric_describe
    exact = {r["column_name"]: r["unique_values"] for r in cardinality(raw).collect()}
    approx = {r["column_name"]: r["unique_values"] for r in cardinality(raw, approx=True).collect()}
    for c, n in exact.items():
        assert abs(approx[c] - n) <= max(2, 0.05 * n)
    e = {r["column_name"]: r for r in numeric_describe(raw).collect()}
    a = {r["column_name"]: r for r in numeric_describe(raw, approx=True).collect()}
    for c in ("quantity", "price"):
        assert a[c]["count"] == e[c]["count"] and a[c]["min"] == e[c]["min"] and a[c]["max"] == e[c]["max"]
        spread = e[c]["p99"] - e[c]["p1"]
        assert abs(a[c]["p50"] - e[c]["p50"]) <= 0.05 * spread


def _stored_lines(make_tx, spark, path):
    """Two customers, orders over two days, a country change, a repeated product and a null one, read from ``path``."""
    rows = [("1", "a", 2, "2001-01-03 10:00:00", 3.5, 7, "X"), ("1", "a", 1, "2001-01-03 10:00:00", 3.5, 7, "X"),
            ("1", None, 1, "2001-01-03 10:00:05", 1.25, 7, "NATION_0"), ("2", "b", 4, "2001-05-20 09:00:00", 2.0, 7, "NATION_0"),
            ("3", "c", 1, "2001-02-02 00:00:00", 9.0, 8, None), ("4", "c", 1, "2001-07-02 00:00:00", 9.0, 8, "X")]
    make_tx(rows).write.parquet(path)
    return spark.read.parquet(path)


def test_feature_matrix_goes_through_the_lines_twice_at_most(make_tx, spark, cal, tmp_path):
    tx = _stored_lines(make_tx, spark, str(tmp_path / "lines"))
    fm = features.feature_matrix(tx, cal)
    plan = fm._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n")
    assert plan.count("invoice_ts") and plan.count("stock_code") <= 2, plan


def test_feature_matrix_over_stored_shapes_equals_the_groups(make_tx, spark, cal, tmp_path):
    tx = _stored_lines(make_tx, spark, str(tmp_path / "lines"))
    rows = {r["customer_id"]: r.asDict() for r in features.feature_matrix(tx, cal).collect()}
    assert sorted(rows) == [7, 8]
    for name, group in features.GROUP_FUNCS.items():
        for r in group(tx, cal).na.fill(0).collect():
            assert {k: rows[r["customer_id"]][k] for k in r.asDict()} == r.asDict(), name
    seven = rows[7]
    assert (seven["total_orders"], seven["total_line_items"], seven["avg_items_per_order"], seven["is_uk"]) == (2, 4, 1.0, 0)
    assert (seven["total_revenue"], seven["max_order_value"], seven["unique_products"]) == (19.75, 11.75, 3)
