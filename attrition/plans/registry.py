"""Query registry: one entry per operator key, each ``(spark, sf_dir) -> DataFrame``.

Every entry reads the driver tables (through ``retail_raw`` and the cleaning
operator, or directly) so its work grows with the data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attrition.calendar import EVENTS_CALENDAR, TESTDATA_CALENDAR as CAL
from attrition.operators import activity, behavior, churn, cohorts, cost, eda, features, labels, metrics, quality, segments
from attrition.operators.clean import clean_transactions, cleaning_waterfall
from attrition.plans.model_store import store
from attrition.sources import io
from attrition.sources.retail import events_purchases, retail_raw

QueryFn = Callable[[SparkSession, str], DataFrame]


def raw_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail_raw(spark, sf_dir)


def clean_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_transactions(retail_raw(spark, sf_dir))


def _on_clean(fn, **kw) -> QueryFn:
    return lambda spark, sf_dir: fn(clean_tx(spark, sf_dir), CAL, **kw)


def _on_stored(fn, **kw) -> QueryFn:
    """For operators that go through the lines many times: they read the session's stored clean lines."""
    return lambda spark, sf_dir: fn(store(spark, sf_dir).clean(), CAL, **kw)


QUERIES: dict[str, QueryFn] = {}

# Observation dates of the multi-snapshot label query.
SNAPSHOTS = [CAL.observation - dt.timedelta(days=60), CAL.observation - dt.timedelta(days=30), CAL.observation]

# Every day of the year up to the observation date, for the interval join.
DAILY_SNAPSHOTS = [CAL.observation - dt.timedelta(days=k) for k in range(365)]


def _register_all() -> None:
    q = QUERIES
    # SQL-1.x / SQL-4.x churn rates
    for name in ("churn_rate_overall", "churn_by_tenure", "churn_by_frequency",
                 "churn_by_monetary_quintile", "churn_by_country", "lifetime_distribution",
                 "churn_by_customer_type", "churn_by_acquisition_season", "time_to_second_purchase"):
        q[name] = _on_clean(getattr(churn, name))
    q["cohort_retention"] = _on_clean(cohorts.cohort_retention)
    q["cohort_value"] = _on_clean(cohorts.cohort_value)
    # SQL-2.x activity decline
    for name in ("activity_windows_churned", "revenue_windows_churned", "purchase_gaps",
                 "recent_vs_historical_order_value", "product_diversity_shift"):
        q[name] = _on_clean(getattr(activity, name))
    # SQL-3.x behavioural patterns
    for name in ("rfm_cells", "purchase_time_patterns", "basket_patterns", "seasonality_q4",
                 "return_behavior", "first_order_quality", "velocity_change"):
        q[name] = _on_clean(getattr(behavior, name))
    # DQ-* profiles of the raw table, the report of the cleaned one
    for name in ("missing_values", "missing_severity", "cardinality", "numeric_describe", "date_range",
                 "daily_volume", "monthly_volume", "invalid_transactions", "cancel_negative_overlap",
                 "special_stock_codes", "sample_rows", "schema_report"):
        q[name] = (lambda fn: lambda spark, sf_dir: fn(raw_tx(spark, sf_dir)))(getattr(quality, name))
    q["out_of_range_dates"] = lambda spark, sf_dir: quality.out_of_range_dates(raw_tx(spark, sf_dir), CAL)
    q["cleaning_waterfall"] = lambda spark, sf_dir: cleaning_waterfall(raw_tx(spark, sf_dir))
    q["clean_transactions"] = clean_tx
    q["quality_report"] = lambda spark, sf_dir: quality.quality_report(clean_tx(spark, sf_dir))
    # EDA-* churned vs active
    for name in ("customer_summary", "churn_flag_last_purchase", "churn_by_order_bucket", "activity_windows",
                 "status_comparison", "mann_whitney_u", "time_to_churn", "lifetime_buckets_cut",
                 "observation_features", "target_correlation", "correlation_matrix", "eda_summary"):
        q[name] = _on_clean(getattr(eda, name))
    q["mann_whitney_p_values"] = _on_clean(eda.mann_whitney_p_values)
    for suffix, metric, upper, bins in eda.STATUS_HISTOGRAMS:
        q[f"histogram_{suffix}"] = _on_clean(eda.status_histogram, metric=metric, upper=upper, bins=bins)
    q["histogram_churned_lifetime"] = _on_clean(eda.churned_lifetime_histogram)
    # FE-* feature groups and matrix
    for g in features.GROUP_FUNCS:
        q[f"features_{g}"] = _on_clean(features.GROUP_FUNCS[g])
    q["feature_matrix"] = _on_stored(features.feature_matrix)
    q["feature_summary"] = _on_stored(features.feature_summary)
    # LB-* labels, leakage checks, model-ready table and split
    for name in ("future_active_customers", "eligible_customers", "churn_labels", "label_distribution"):
        q[name] = _on_clean(getattr(labels, name))
    for name in ("model_ready", "split_report"):
        q[name] = _on_stored(getattr(labels, name))
    q["stratified_split"] = _on_stored(labels.model_ready_split)
    q["is_churned_at"] = lambda spark, sf_dir: labels.is_churned_at(clean_tx(spark, sf_dir), SNAPSHOTS)
    q["churn_by_snapshot"] = lambda spark, sf_dir: labels.churn_by_snapshot(clean_tx(spark, sf_dir), DAILY_SNAPSHOTS)
    q["leakage_checks"] = _leakage_checks
    # ML-9..15, CS-*, SG-* on the deterministic heuristic score
    def scored(fn, **kw):
        return lambda spark, sf_dir: fn(metrics.heuristic_scores(clean_tx(spark, sf_dir), CAL), **kw)
    q["heuristic_scores"] = lambda spark, sf_dir: metrics.heuristic_scores(clean_tx(spark, sf_dir), CAL)
    for name in ("evaluate_scores", "majority_baseline", "confusion_matrix", "metric_targets"):
        q[name] = scored(getattr(metrics, name))
    # comparison, selection, curves and thresholds over several models at once, with tied scores and tied models
    def compared(fn):
        return lambda spark, sf_dir: fn(metrics.candidate_scores(clean_tx(spark, sf_dir), CAL))
    q["candidate_scores"] = lambda spark, sf_dir: metrics.candidate_scores(clean_tx(spark, sf_dir), CAL)
    q["model_comparison"] = compared(metrics.evaluate_scores)
    q["select_model"] = compared(metrics.select_model)
    q["roc_curve"] = compared(metrics.roc_curve)
    q["business_cost"] = scored(cost.business_cost, threshold=0.5)
    for name in ("threshold_sweep", "cost_breakdown", "retention_roi", "annual_impact", "cost_analysis"):
        q[name] = scored(getattr(cost, name))
    for name in ("optimal_threshold", "precision_recall_curve", "scenario_comparison"):
        q[name] = compared(getattr(cost, name))
    q["impact_scenario"] = scored(cost.observed_impact_scenario)
    for name in ("customer_segments", "segment_summary", "segment_budget", "budget_total"):
        q[name] = scored(getattr(segments, name))
    q["segment_profiles"] = lambda spark, sf_dir: _segment_profiles(clean_tx(spark, sf_dir))
    q["executive_summary"] = lambda spark, sf_dir: segments.executive_summary(
        cost.cost_analysis(metrics.heuristic_scores(clean_tx(spark, sf_dir), CAL)))
    q["histogram_segment_probability"] = lambda spark, sf_dir: eda.clipped_histogram(
        segments.customer_segments(metrics.heuristic_scores(clean_tx(spark, sf_dir), CAL)),
        "churn_probability", 20, "risk_segment")
    # second transaction view: purchase events with sub-second timestamps
    def on_events(fn):
        return lambda spark, sf_dir: fn(clean_transactions(events_purchases(spark, sf_dir)), EVENTS_CALENDAR)
    q["purchase_time_patterns_events"] = on_events(behavior.purchase_time_patterns)
    q["time_to_second_purchase_events"] = on_events(churn.time_to_second_purchase)
    q["churn_labels_events"] = on_events(labels.churn_labels)
    from attrition.plans.ml_queries import ML_QUERIES
    q.update(ML_QUERIES)
    # inventory names served by the operators above
    q["risk_segment"] = q["customer_segments"]
    q["clipped_histogram"] = q["histogram_orders"]
    q["return_behavior_raw"] = lambda spark, sf_dir: behavior.return_behavior(raw_tx(spark, sf_dir), CAL)


def _leakage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on stored feature and label tables."""
    tx = clean_tx(spark, sf_dir)
    stored = []
    for name, df in (("features", features.features_recency(tx, CAL)), ("labels", labels.churn_labels(tx, CAL))):
        path = io.scratch_path(spark, name)
        io.write_table(df, path)
        stored.append(io.read_table(spark, path))
    return labels.leakage_checks(*stored, tx, CAL)


def _segment_profiles(tx: DataFrame) -> DataFrame:
    feats = features.features_recency(tx, CAL).join(features.features_monetary(tx, CAL), "customer_id")
    return segments.segment_profiles(metrics.heuristic_scores(tx, CAL), feats)


_register_all()

# Flagship for the smoke check (sf0.001 has rows for it).
FLAGSHIP = "model_ready"
