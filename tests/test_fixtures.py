"""Hand-made micro fixtures for the semantic traps (expected values by hand).

Calendar of the test tables: obs 2001-06-02, prediction_end 2001-08-01,
eligibility (obs - 60d) 2001-04-03, dormant (obs - 61d) 2001-04-02,
acquisition (obs - 122d) 2001-01-31.
"""

import pytest
from pyspark.sql import functions as F

from attrition.functions.timeutil import frac_days, whole_days
from attrition.operators import activity, behavior, churn, cost, eda, features, labels, metrics, segments
from attrition.operators.clean import clean_transactions, cleaning_waterfall
from attrition.operators.quality import invalid_transactions, quality_report


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_fractional_vs_whole_days(spark):
    df = spark.createDataFrame([("2001-01-31 09:36:00", "2001-01-01 00:00:00"),
                                ("2001-01-01 00:00:00", "2001-01-02 12:00:00")], "a string, b string")
    df = df.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = df.select(frac_days("a", "b").alias("f"), whole_days("a", "b").alias("w")).collect()
    assert got[0]["f"] == pytest.approx(30.4) and got[0]["w"] == 30
    # floor, also for negative spans (-1.5 days -> -2)
    assert got[1]["f"] == pytest.approx(-1.5) and got[1]["w"] == -2


def test_tenure_bucket_uses_fractional_days(make_tx, cal):
    # 30.4 fractional days: '31-90 days' in the SQL analysis
    tx = make_tx([("1", "10", 1, "2001-01-01 00:00:00", 1.0, 1, "N"),
                  ("2", "10", 1, "2001-01-31 09:36:00", 1.0, 1, "N")])
    assert rows(churn.churn_by_tenure(tx, cal), "tenure_bucket", "customers") == [("31-90 days", 1)]


def test_velocity_hole_between_90_and_91_days(make_tx, cal):
    # orders at day 0, day 90.5 (in neither period) and day 200
    tx = make_tx([("1", "10", 1, "2000-06-01 00:00:00", 1.0, 7, "N"),
                  ("2", "10", 1, "2000-08-30 12:00:00", 1.0, 7, "N"),
                  ("3", "10", 1, "2000-12-18 00:00:00", 1.0, 7, "N")])
    r = behavior.velocity_change(tx, cal).collect()[0]
    assert (r["avg_orders_first_90d"], r["avg_orders_next_90d"], r["avg_velocity_change"]) == (1.0, 0.0, -1.0)


def test_midnight_boundaries_of_the_label_window(make_tx, cal):
    first = ("0", "10", 1, "2001-01-01 00:00:00", 1.0)
    tx = make_tx([
        first + (1, "N"), ("1", "10", 1, "2001-06-02 00:00:00", 1.0, 1, "N"),   # at obs: history -> churned
        first + (2, "N"), ("2", "10", 1, "2001-06-02 00:00:01", 1.0, 2, "N"),   # just after obs: active
        first + (3, "N"), ("3", "10", 1, "2001-08-01 00:00:00", 1.0, 3, "N"),   # at prediction end: active
        first + (4, "N"), ("4", "10", 1, "2001-08-01 12:00:00", 1.0, 4, "N"),   # after the window: churned
    ])
    got = dict(rows(labels.churn_labels(tx, cal), "customer_id", "is_churned"))
    assert got == {1: 1, 2: 0, 3: 0, 4: 1}


def test_single_date_customer_trend_is_declining(make_tx, cal):
    # first == last timestamp: every order is 'early', so the trends are -1
    tx = make_tx([("1", "10", 2, "2001-03-01 10:00:00", 5.0, 1, "N"),
                  ("2", "11", 1, "2001-03-01 10:00:00", 5.0, 1, "N")])
    r = features.features_trend(tx, cal).collect()[0]
    assert r["order_trend"] == -1.0 and r["is_declining"] == 1
    f = features.features_frequency(tx, cal).collect()[0]
    assert f["purchase_interval_std"] == 0.0 and f["active_days"] == 1
    m = features.features_monetary(tx, cal).collect()[0]
    assert m["order_value_std"] == pytest.approx(3.5355339) and m["order_value_cv"] == pytest.approx(0.471405)


def test_two_gaps_needed_for_interval_std(make_tx, cal):
    tx = make_tx([("1", "10", 1, "2001-01-01 00:00:00", 1.0, 1, "N"),
                  ("2", "10", 1, "2001-01-03 00:00:00", 1.0, 1, "N"),
                  ("3", "10", 1, "2001-01-08 00:00:00", 1.0, 2, "N"),
                  ("4", "10", 1, "2001-01-09 00:00:00", 1.0, 2, "N"),
                  ("5", "10", 1, "2001-01-13 00:00:00", 1.0, 2, "N")])
    got = dict(rows(features.features_frequency(tx, cal), "customer_id", "purchase_interval_std"))
    assert got[1] == 0.0                      # one gap -> undefined -> 0
    assert got[2] == pytest.approx(2.12132, abs=1e-5)  # gaps 1 and 4


def test_left_open_lifetime_cut_drops_zero_days(make_tx, cal):
    # two churned customers: one with a single day (lifetime 0), one with 10 days
    tx = make_tx([("1", "10", 1, "2001-01-01 00:00:00", 1.0, 1, "N"),
                  ("2", "10", 1, "2001-01-01 00:00:00", 1.0, 2, "N"),
                  ("3", "10", 1, "2001-01-11 00:00:00", 1.0, 2, "N")])
    got = rows(eda.lifetime_buckets_cut(tx, cal), "lifetime_bucket", "customers", "pct_of_churned")
    assert len(got) == 7 and sum(c for _, c, _ in got) == 1
    assert ("8-30d", 1, 50.0) in got


def test_string_minimum_invoice_is_the_first_order(make_tx, cal):
    # invoice '9' is earlier but '10' < '9' as strings
    tx = make_tx([("9", "A1", 1, "2001-01-01 00:00:00", 2.0, 1, "N"),
                  ("10", "B1", 1, "2001-02-01 00:00:00", 7.0, 1, "N"),
                  ("10", "B2", 1, "2001-02-01 00:00:00", 7.0, 1, "N")])
    r = behavior.first_order_quality(tx, cal).collect()[0]
    assert (r["avg_first_order_items"], r["avg_first_order_value"]) == (2.0, 14.0)


def test_first_country_is_by_time_not_row_order(make_tx, cal):
    tx = make_tx([("2", "10", 1, "2001-02-01 00:00:00", 1.0, 1, "ELSEWHERE"),
                  ("1", "10", 1, "2001-01-01 00:00:00", 1.0, 1, cal.home_country),
                  ("3", "10", 1, "2001-01-01 00:00:00", 1.0, 2, "ELSEWHERE"),
                  ("4", "10", 1, "2001-03-01 00:00:00", 1.0, 2, cal.home_country)])
    assert dict(rows(features.features_engagement(tx, cal), "customer_id", "is_uk")) == {1: 1, 2: 0}


def test_returns_only_visible_before_cleaning(make_tx, cal):
    raw = make_tx([("C1", "10", -2, "2001-01-01 00:00:00", 1.0, 1, "N"),
                   ("1", "10", 2, "2001-01-01 00:00:00", 1.0, 1, "N")])
    r = behavior.return_behavior(raw, cal).collect()[0]
    assert (r["avg_return_rate_pct"], r["customers_with_returns"]) == (50.0, 1)
    c = behavior.return_behavior(clean_transactions(raw), cal).collect()[0]
    assert c["customers_with_returns"] == 0


def test_empty_order_bucket_is_reported(make_tx, cal):
    tx = make_tx([("1", "10", 1, "2001-01-01 00:00:00", 1.0, 1, "N")])
    got = rows(eda.churn_by_order_bucket(tx, cal), "order_bucket", "customers", "churn_rate_pct")
    assert [g[0] for g in got] == ["1 order", "2-3 orders", "4-5 orders", "6-10 orders", "10+ orders"]
    assert ("4-5 orders", 0, None) in got


def test_last_three_orders_tie_break(make_tx, cal):
    # six orders; two share the latest timestamp: ties broken by invoice (desc)
    base = [(str(i), "10", 1, f"2001-01-0{i} 00:00:00", float(i), 1, "N") for i in range(1, 6)]
    tx = make_tx(base + [("6", "10", 1, "2001-01-05 00:00:00", 6.0, 1, "N")])
    r = activity.recent_vs_historical_order_value(tx, cal).collect()[0]
    # last three: invoices 6, 5 (same ts) and 4 -> (6+5+4)/3 = 5; rest (1+2+3)/3 = 2
    assert (r["avg_last_3_orders"], r["avg_historical_orders"], r["pct_change"]) == (5.0, 2.0, 150.0)


def test_second_purchase_on_the_same_timestamp(make_tx, cal):
    tx = make_tx([("1", "10", 1, "2001-01-01 00:00:00", 1.0, 1, "N"),
                  ("2", "10", 1, "2001-01-01 00:00:00", 1.0, 1, "N"),
                  ("3", "10", 1, "2001-01-05 00:00:00", 1.0, 2, "N")])
    got = dict(rows(churn.time_to_second_purchase(tx, cal), "time_to_second_bucket", "customers"))
    assert got == {"0-7 days": 1, "No second purchase": 1}


def test_multi_timestamp_invoice_is_one_order_two_baskets(make_tx, cal):
    tx = make_tx([("1", "10", 1, "2001-01-01 00:00:00", 3.0, 1, "N"),
                  ("1", "11", 1, "2001-01-01 08:00:00", 5.0, 1, "N")])
    assert features.features_frequency(tx, cal).collect()[0]["total_orders"] == 1
    assert behavior.basket_patterns(tx, cal).collect()[0]["avg_basket_value"] == 4.0


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(
        [("m", 1, 0.1, 0), ("m", 2, 0.4, 1), ("m", 3, 0.4, 0), ("m", 4, 0.8, 1)],
        "model string, customer_id bigint, churn_probability double, actual int")


def test_auc_and_average_precision_with_ties(scores):
    r = metrics.evaluate_scores(scores).collect()[0]
    assert r["roc_auc"] == 0.875 and r["pr_auc"] == pytest.approx(0.833333)


def test_auc_of_reversed_score(scores):
    rev = scores.withColumn("churn_probability", 1 - F.col("churn_probability"))
    a = metrics.evaluate_scores(scores).collect()[0]["roc_auc"]
    b = metrics.evaluate_scores(rev).collect()[0]["roc_auc"]
    assert a + b == pytest.approx(1.0)


def test_segment_edges(spark):
    df = spark.createDataFrame([(1, 0.7, 1), (2, 0.4, 0), (3, 0.2, 0), (4, 0.19999, 0)],
                               "customer_id bigint, churn_probability double, actual int")
    got = dict(rows(segments.customer_segments(df), "customer_id", "risk_segment"))
    assert got == {1: "HIGH_RISK", 2: "MEDIUM_RISK", 3: "LOW_RISK", 4: "SAFE"}


def test_sweep_threshold_is_the_floating_point_value(spark):
    # 0.35 < 0.35000000000000003, so p = 0.35 is not positive at that threshold
    df = spark.createDataFrame([("m", 1, 0.35, 1)], "model string, customer_id bigint, churn_probability double, actual int")
    got = {r["threshold"]: r["tp"] for r in cost.threshold_sweep(df).collect()}
    th = cost.SWEEP_THRESHOLDS
    assert th[6] == 0.35000000000000003
    assert got[th[5]] == 1 and got[th[6]] == 0


def test_no_positives_and_one_class_do_not_raise(spark):
    df = spark.createDataFrame([("m", 1, 0.1, 0), ("m", 2, 0.2, 0)],
                               "model string, customer_id bigint, churn_probability double, actual int")
    r = metrics.evaluate_scores(df).collect()[0]
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["roc_auc"] is None


def test_dirty_rows_profile_and_waterfall(make_tx):
    raw = make_tx([("C1", "10", -1, "2001-01-01 00:00:00", 1.0, 1, "N"),      # cancelled and negative
                   ("2", "M", 1, "2001-01-01 00:00:00", 1.0, 1, "N"),        # service code
                   ("3", "85123A", 1, "2001-01-01 00:00:00", 0.0, 1, "N"),   # zero price
                   ("4", "85123A", 1, "2001-01-01 00:00:00", 2.0, None, "N"),  # no customer
                   ("5", "85123A", 1, "2001-01-01 00:00:00", 2.0, 1, "N", None)])  # clean, no description
    inv = dict(rows(invalid_transactions(raw), "issue", "rows"))
    assert inv == {"cancellations": 1, "negative_quantity": 1, "non_positive_price": 1, "missing_customer": 1}
    wf = rows(cleaning_waterfall(raw).orderBy("step"), "rule", "rows_after")
    assert wf == [("has_customer", 4), ("not_cancelled", 3), ("positive_quantity", 3),
                  ("positive_price", 2), ("not_service_code", 1)]
    q = quality_report(clean_transactions(raw)).collect()[0]
    assert (q["transactions"], q["missing_cells"], q["duplicate_rows"]) == (1, 1, 0)


def test_day_arithmetic_ignores_session_time_zone(spark):
    # 2001-03-01 -> 2001-05-01 crosses a daylight-saving change in New York
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_ntz'2001-05-01 00:00:00' a, timestamp_ntz'2001-03-01 00:00:00' b")
        r = df.select(frac_days("a", "b").alias("f"), whole_days("a", "b").alias("w")).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (r["f"], r["w"]) == (61.0, 61)
