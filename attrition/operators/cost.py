"""Cost-sensitive threshold selection and retention ROI.

All sweeps are one pass over the scores: each score is mapped to the number
of sweep thresholds it reaches, counts per (bin, label) are taken (at most
2 x (thresholds + 1) rows per group), and each threshold's confusion counts
are suffix sums over that small table.  The arithmetic afterwards runs on a
handful of rows, still as column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.calendar import CostModel
from attrition.functions.timeutil import round_stat
from attrition.operators.metrics import P, Y, _div, confusion_counts
from attrition.operators.rank import grouped_running_sums

# The 18 sweep thresholds 0.05, 0.10, ..., 0.90 as produced by
# a floating-point range with start 0.05 and step 0.05 (e.g. 0.15000000000000002).
SWEEP_THRESHOLDS = tuple(float(x) for x in np.arange(0.05, 0.95, 0.05))


def _cost_cols(costs: CostModel):
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = (tn * costs.cost_tn + fp * costs.cost_fp + fn * costs.cost_fn + tp * costs.cost_tp)
    return [total.cast("double").alias("total_cost"), _div(tp, tp + fp).alias("precision"),
            _div(tp, tp + fn).alias("recall")]


def business_cost(scores: DataFrame, threshold: float, costs: CostModel = CostModel(),
                  group_cols: Sequence[str] = ("model",)) -> DataFrame:
    c = confusion_counts(scores, threshold, group_cols)
    return c.select(*group_cols, F.lit(float(threshold)).alias("threshold"), "tn", "fp", "fn", "tp", *_cost_cols(costs))


def threshold_sweep(scores: DataFrame, costs: CostModel = CostModel(), thresholds: Sequence[float] = SWEEP_THRESHOLDS,
                    group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion counts and cost at every threshold in one scan."""
    p = F.col(P)
    reached = sum((F.when(p >= F.lit(t), 1).otherwise(0) for t in thresholds), F.lit(0))
    bins = scores.groupBy(*group_cols, reached.alias("_bin")).agg(
        F.sum(Y).alias("_pos"), (F.count(F.lit(1)) - F.sum(Y)).alias("_neg"))
    th = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])
    per = bins.select("*", F.inline(th))
    pred = F.col("_bin") >= F.col("_i")
    c = per.groupBy(*group_cols, "threshold").agg(
        F.sum(F.when(~pred, F.col("_neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(pred, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(pred, F.col("_pos")).otherwise(0)).alias("tp"))
    return c.select(*group_cols, "threshold", *[F.col(x).cast("bigint").alias(x) for x in ("tn", "fp", "fn", "tp")],
                    *_cost_cols(costs)).orderBy(*group_cols, "threshold")


def optimal_threshold(scores: DataFrame, costs: CostModel = CostModel(), group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Lowest-cost threshold per group (the lowest threshold on ties)."""
    s = threshold_sweep(scores, costs, group_cols=group_cols)
    w = Window.partitionBy(*group_cols).orderBy("total_cost", "threshold")
    # one row per (group, threshold): 18 per model
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def precision_recall_curve(scores: DataFrame, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """precision and recall at every distinct score, plus the end point
    (recall 0, precision 1)."""
    per = scores.groupBy(*group_cols, P).agg(F.sum(Y).alias("pos"), (F.count(F.lit(1)) - F.sum(Y)).alias("neg"))
    cum = grouped_running_sums(per, list(group_cols), [F.col(P).desc()], ["pos", "neg"])
    tot = cum.groupBy(*group_cols).agg(F.sum("pos").alias("n1"))  # of the numbered copy
    pts = cum.join(tot, list(group_cols)).select(
        *group_cols, F.col(P).alias("threshold"),
        round_stat(_div(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum"))).alias("precision"),
        round_stat(F.when(F.col("n1") == 0, F.lit(1.0)).otherwise(F.col("pos_cum") / F.col("n1"))).alias("recall"))
    end = tot.select(*group_cols, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _default_and_optimal(scores: DataFrame, costs: CostModel, group_cols: Sequence[str], default: float = 0.5):
    d = business_cost(scores, default, costs, group_cols)
    o = optimal_threshold(scores, costs, group_cols)
    return d, o


def cost_breakdown(scores: DataFrame, costs: CostModel = CostModel(), group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """FN cost, FP cost and TP benefit at the default 0.5 and at the optimum."""
    d, o = _default_and_optimal(scores, costs, group_cols)
    both = (d.select(*group_cols, F.lit("default").alias("scenario"), "threshold", "fn", "fp", "tp")
             .unionByName(o.select(*group_cols, F.lit("optimal").alias("scenario"), "threshold", "fn", "fp", "tp")))
    arr = F.array(F.struct(F.lit("false_negatives").alias("category"), (F.col("fn") * costs.cost_fn).cast("double").alias("amount")),
                  F.struct(F.lit("false_positives").alias("category"), (F.col("fp") * costs.cost_fp).cast("double").alias("amount")),
                  F.struct(F.lit("true_positives").alias("category"), (F.col("tp") * abs(costs.cost_tp)).cast("double").alias("amount")))
    return both.select(*group_cols, "scenario", "threshold", F.inline(arr))


def scenario_comparison(scores: DataFrame, costs: CostModel = CostModel(), group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """No model (every churner lost) vs threshold 0.5 vs the optimal threshold.

    The churner count is tp + fn of any threshold row, so the no-model row
    and the savings come from the two threshold rows themselves; the
    default cost for 'savings vs default' is read with a window over the
    three rows of each group."""
    d, o = _default_and_optimal(scores, costs, group_cols)
    cols = lambda name: [*group_cols, F.lit(name).alias("scenario"), "threshold",
                         F.col("tp").alias("churners_caught"), F.col("fp").alias("false_alarms"), "total_cost",
                         ((F.col("tp") + F.col("fn")) * costs.cost_fn).cast("double").alias("_baseline")]
    none = d.select(*group_cols, F.lit("no_model").alias("scenario"), F.lit(None).cast("double").alias("threshold"),
                    F.lit(0).cast("bigint").alias("churners_caught"), F.lit(0).cast("bigint").alias("false_alarms"),
                    ((F.col("tp") + F.col("fn")) * costs.cost_fn).cast("double").alias("total_cost"),
                    ((F.col("tp") + F.col("fn")) * costs.cost_fn).cast("double").alias("_baseline"))
    rows = none.unionByName(d.select(*cols("default"))).unionByName(o.select(*cols("optimal")))
    # three rows per group
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    default_cost = F.max(F.when(F.col("scenario") == "default", F.col("total_cost"))).over(w)
    return (rows.withColumn("savings_vs_no_model", F.col("_baseline") - F.col("total_cost"))
                .withColumn("savings_vs_default", F.when(F.col("scenario") == "optimal", default_cost - F.col("total_cost")))
                .drop("_baseline"))


def _roi_cols(costs: CostModel):
    tp, fp = F.col("tp"), F.col("fp")
    saved = tp * costs.retention_success_rate
    revenue = saved * costs.customer_lifetime_value
    cost = (tp + fp) * costs.incentive_cost
    net = revenue - cost
    roi = F.when(cost > 0, net / cost * 100).otherwise(F.lit(0.0))
    return [tp.alias("churners_caught"), fp.alias("false_alarms"), saved.cast("double").alias("churners_saved"),
            revenue.cast("double").alias("revenue_saved"), cost.cast("double").alias("retention_cost"),
            net.cast("double").alias("net_benefit"), round_stat(roi).alias("roi")]


def retention_roi(scores: DataFrame, costs: CostModel = CostModel(), group_cols: Sequence[str] = ("model",)) -> DataFrame:
    o = optimal_threshold(scores, costs, group_cols)
    return o.select(*group_cols, "threshold", *_roi_cols(costs))


def annual_impact(scores: DataFrame, costs: CostModel = CostModel(), group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Two published annualisations of the net benefit: net x scale x runs
    per year, and net x runs per year."""
    r = retention_roi(scores, costs, group_cols)
    return r.select(*group_cols, "net_benefit",
                    (F.col("net_benefit") * costs.annual_scale_factor * costs.runs_per_year).alias("annual_benefit_scaled"),
                    (F.col("net_benefit") * costs.runs_per_year).alias("annual_benefit"))


def cost_analysis(scores: DataFrame, costs: CostModel = CostModel(), group_cols: Sequence[str] = ("model",)) -> DataFrame:
    o = optimal_threshold(scores, costs, group_cols)
    r = o.select(*group_cols, "threshold", "precision", "recall", "total_cost", *_roi_cols(costs))
    return r.select(*group_cols, F.col("threshold").alias("optimal_threshold"),
                    F.col("precision").alias("precision_at_optimal"), F.col("recall").alias("recall_at_optimal"),
                    F.col("total_cost").alias("total_cost_at_optimal"), "net_benefit", "roi",
                    F.lit(costs.cost_fn).alias("cost_fn"), F.lit(costs.cost_fp).alias("cost_fp"),
                    F.lit(costs.retention_success_rate).alias("retention_success_rate"))


def impact_scenario(params: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """What-if rows (customers, churn_rate, recall, false_alarms) -> churners
    caught and saved, revenue, intervention cost, net benefit."""
    churners = F.col("customers") * F.col("churn_rate")
    caught = churners * F.col("recall")
    saved = caught * costs.retention_success_rate
    revenue = saved * costs.customer_lifetime_value
    cost = (caught + F.col("false_alarms")) * costs.incentive_cost
    return params.select("*", round_stat(churners).alias("churners"), round_stat(caught).alias("churners_caught"),
                         round_stat(saved).alias("customers_saved"), round_stat(revenue).alias("revenue_retained"),
                         round_stat(cost).alias("intervention_cost"), round_stat(revenue - cost).alias("net_benefit"))


def observed_impact_scenario(scores: DataFrame, costs: CostModel = CostModel(),
                             group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """The what-if scenario with the scored population's own numbers: size,
    churn rate, and recall and false alarms at the optimal threshold (all
    read from the optimal threshold's confusion counts, so no join)."""
    o = optimal_threshold(scores, costs, group_cols)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    params = o.select(*group_cols, n.alias("customers"), ((F.col("tp") + F.col("fn")) / n).alias("churn_rate"),
                      "recall", F.col("fp").alias("false_alarms"))
    return impact_scenario(params, costs)
