"""Risk segmentation, per-segment retention budget and the executive summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.calendar import RISK_THRESHOLDS, SAFE_SEGMENT, SEGMENT_STRATEGIES, CostModel
from attrition.functions.timeutil import pct, round_half_up, round_stat
from attrition.operators.metrics import P, Y

SEGMENT_ORDER = [s for _, s in RISK_THRESHOLDS] + [SAFE_SEGMENT]


def risk_segment(p: Column) -> Column:
    seg = None
    for t, name in RISK_THRESHOLDS:
        seg = F.when(p >= F.lit(t), F.lit(name)) if seg is None else seg.when(p >= F.lit(t), F.lit(name))
    return seg.otherwise(F.lit(SAFE_SEGMENT))


def customer_segments(scores: DataFrame) -> DataFrame:
    return scores.select("customer_id", risk_segment(F.col(P)).alias("risk_segment"), P,
                         F.col(Y).alias("actual_churned"))


def _segment_order(c: Column) -> Column:
    o = None
    for i, s in enumerate(SEGMENT_ORDER):
        o = F.when(c == s, F.lit(i + 1)) if o is None else o.when(c == s, F.lit(i + 1))
    return o.otherwise(F.lit(len(SEGMENT_ORDER) + 1))


def segment_totals(seg: DataFrame, total: str = "TOTAL") -> DataFrame:
    """Customers, share of the base, churned and churn rate per segment and over all, by one rollup.

    ``grouping`` tells the total from customers without a segment, whose row keeps a null name.
    """
    g = seg.rollup("risk_segment").agg(F.grouping("risk_segment").alias("_all"), F.count(F.lit(1)).alias("customers"),
                                       F.sum("actual_churned").cast("bigint").alias("churned"))
    n = g.where(F.col("_all") == 1).select("customers").scalar()  # one row; its exchange is reused
    name = F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col("risk_segment"))
    return (g.select(name.alias("risk_segment"), "customers", pct("customers", n).alias("pct_of_base"), "churned",
                     pct("churned", "customers").alias("churn_rate_pct"), "_all")
             .orderBy("_all", _segment_order(F.col("risk_segment"))).drop("_all"))


def segment_summary(scores: DataFrame) -> DataFrame:
    """Totals of the risk segments of scored customers."""
    return segment_totals(customer_segments(scores))


def strategy_dim(spark) -> DataFrame:
    return spark.createDataFrame([(s.segment, s.action, s.cost_per_customer, s.expected_save_rate)
                                  for s in SEGMENT_STRATEGIES],
                                 "risk_segment string, action string, cost_per_customer double, expected_save_rate double")


def segment_budget(scores: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """Cost, customers saved, revenue saved, net benefit and ROI per segment
    present in the scores (segments without customers are not reported)."""
    seg = customer_segments(scores)
    g = seg.groupBy("risk_segment").agg(F.count(F.lit(1)).alias("customers"),
                                        F.sum("actual_churned").cast("bigint").alias("expected_churners"))
    # the strategy table has four fixed rows
    b = g.join(F.broadcast(strategy_dim(scores.sparkSession)), "risk_segment")
    total_cost = F.col("customers") * F.col("cost_per_customer")
    saved = F.col("expected_churners") * F.col("expected_save_rate")
    revenue = saved * costs.customer_lifetime_value
    net = revenue - total_cost
    return (b.select(F.col("risk_segment").alias("segment"), "customers", "expected_churners", "cost_per_customer",
                     total_cost.alias("total_cost"), "expected_save_rate", round_stat(saved).alias("customers_saved"),
                     round_stat(revenue).alias("revenue_saved"), round_stat(net).alias("net_benefit"),
                     round_stat(F.when(total_cost > 0, net / total_cost * 100).otherwise(0.0)).alias("roi"))
             .orderBy(_segment_order(F.col("segment"))))


def budget_total(scores: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    b = segment_budget(scores, costs)
    t = b.agg(F.sum("customers").alias("customers"), F.sum("total_cost").alias("total_cost"),
              F.sum("customers_saved").alias("customers_saved"), F.sum("net_benefit").alias("net_benefit"))
    return t.select("customers", "total_cost", round_stat("customers_saved").alias("customers_saved"),
                    round_stat("net_benefit").alias("net_benefit"),
                    round_stat(F.when(F.col("total_cost") > 0, F.col("net_benefit") / F.col("total_cost") * 100)
                               .otherwise(0.0)).alias("total_roi"))


# Profile features named by the original analysis; only those
# present in the feature table are used.
PROFILE_FEATURES = ("recency_days", "frequency_total", "monetary_total", "avg_order_value", "days_since_first_purchase")


def segment_profiles(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Mean of the key features per segment, one row per (feature, segment)."""
    cols = [c for c in PROFILE_FEATURES if c in features.columns]
    seg = customer_segments(scores).join(features.select("customer_id", *cols), "customer_id")
    g = seg.groupBy("risk_segment").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in cols])
    return g.select("risk_segment", F.inline(arr)).select("feature", "risk_segment", round_half_up("mean").alias("mean"))


# Fallbacks used when no cost analysis is available.
SUMMARY_DEFAULTS = {"optimal_threshold": 0.35, "roi": 250.0, "net_benefit": 15000.0}


def executive_summary(cost_analysis: DataFrame | None, spark=None, costs: CostModel = CostModel(),
                      group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Threshold, ROI, net benefit and annual benefit (net x runs per year);
    the published defaults stand in when no cost analysis exists."""
    if cost_analysis is None:
        d = SUMMARY_DEFAULTS
        cost_analysis = spark.createDataFrame([(d["optimal_threshold"], d["roi"], d["net_benefit"])],
                                              "optimal_threshold double, roi double, net_benefit double")
        group_cols = ()
    return cost_analysis.select(*group_cols, "optimal_threshold", "roi", "net_benefit",
                                (F.col("net_benefit") * costs.runs_per_year).alias("annual_benefit"))
