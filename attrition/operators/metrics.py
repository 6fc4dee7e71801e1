"""Evaluation of churn scores: confusion counts, accuracy/precision/recall/F1,
ROC-AUC (mid-rank form) and average precision (step-wise, not interpolated),
ROC curve, majority baseline, target checks and model selection.

A score table has ``churn_probability`` (double), ``actual`` (0/1) and any
number of grouping columns (``model``, snapshot, ...), so many models are
evaluated in one job.  Curves and AUCs use counts per distinct score and a
distributed running sum, never a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import line_value, round_stat, ts_lit, whole_days
from attrition.operators.features import features_recency, history
from attrition.operators.labels import churn_labels
from attrition.operators.rank import grouped_running_sums

P, Y = "churn_probability", "actual"


def heuristic_scores(tx: DataFrame, cal: ChurnCalendar, model: str = "recency_heuristic") -> DataFrame:
    """Deterministic score recency / (recency + window) joined with the labels."""
    r = features_recency(tx, cal).select(
        "customer_id", (F.col("recency_days") / (F.col("recency_days") + F.lit(float(cal.churn_window_days)))).alias(P))
    # the model name is derived per row, so it behaves like data: a bare
    # literal would let Catalyst fold per-model joins into cross joins
    name = F.when(F.col("customer_id").isNotNull(), F.lit(model))
    return (r.join(churn_labels(tx, cal), "customer_id")
             .select(name.alias("model"), "customer_id", P, F.col("is_churned").alias(Y)))


def candidate_scores(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Scores of four deterministic models, from one history and one label table.

    ``recency_heuristic`` and ``recency_steep`` order customers alike (their AUCs tie), ``frequency_heuristic``
    has many tied scores, ``monetary_heuristic`` hardly any.
    """
    c = F.col
    past = history(tx, cal).groupBy("customer_id").agg(
        whole_days(ts_lit(cal.observation), F.max("invoice_ts")).alias("_days"), F.count_distinct("invoice").alias("_orders"),
        F.sum(line_value()).cast("double").alias("_spent"))
    recency = lambda days: c("_days") / (c("_days") + F.lit(float(days)))
    models = {"recency_heuristic": recency(cal.churn_window_days), "recency_steep": recency(cal.churn_window_days // 2),
              "frequency_heuristic": 1.0 / c("_orders"), "monetary_heuristic": 1000.0 / (1000.0 + c("_spent"))}
    rows = F.array(*[F.struct(F.lit(n).alias("model"), p.alias(P)) for n, p in models.items()])
    return (past.join(churn_labels(tx, cal), "customer_id").select("customer_id", F.inline(rows), c("is_churned").alias(Y))
                .select("model", "customer_id", P, Y))


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(scores: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    pred = F.col(P) >= F.lit(float(threshold))
    pos = F.col(Y) == 1
    return scores.groupBy(*group_cols).agg(
        F.count_if(~pos & ~pred).alias("tn"), F.count_if(~pos & pred).alias("fp"),
        F.count_if(pos & ~pred).alias("fn"), F.count_if(pos & pred).alias("tp"))


def confusion_matrix(scores: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    return confusion_counts(scores, threshold, group_cols)


def _evaluation_counts(scores: DataFrame, threshold: float, group_cols: Sequence[str]) -> DataFrame:
    """One row per group with confusion counts at ``threshold`` and the sums
    behind ROC-AUC / average precision, all from one aggregation over the
    per-score running sums (no join between per-group tables)."""
    per = scores.groupBy(*group_cols, P).agg(F.sum(Y).alias("pos"), (F.count(F.lit(1)) - F.sum(Y)).alias("neg"))
    cum = grouped_running_sums(per, list(group_cols), [F.col(P).desc()], ["pos", "neg"])
    above = F.col(P) >= F.lit(float(threshold))
    c = cum.groupBy(*group_cols).agg(
        F.sum("pos").alias("n1"), F.sum("neg").alias("n0"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.col("pos") * F.col("neg_cum")).alias("s1"), F.sum(F.col("pos") * F.col("neg")).alias("s2"),
        F.sum(F.col("pos") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("s3"))
    return c.select("*", (F.col("n1") - F.col("tp")).alias("fn"), (F.col("n0") - F.col("fp")).alias("tn"))


def _metric_cols():
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _div(2 * prec * rec, prec + rec)
    n1n0 = (F.col("n1") * F.col("n0")).cast("double")
    auc = F.try_divide(n1n0 - F.col("s1") + 0.5 * F.col("s2"), n1n0)
    ap = F.try_divide(F.col("s3"), F.col("n1").cast("double"))
    return [n.alias("n"), round_stat(_div(F.col("tp") + F.col("tn"), n)).alias("accuracy"),
            round_stat(prec).alias("precision"), round_stat(rec).alias("recall"),
            round_stat(f1).alias("f1"), round_stat(auc).alias("roc_auc"), round_stat(ap).alias("pr_auc")]


def evaluate_scores(scores: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    return _evaluation_counts(scores, threshold, group_cols).select(*group_cols, *_metric_cols())


def roc_curve(scores: DataFrame, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first, plus
    the (inf, 0, 0) start point; collinear points are kept."""
    per = scores.groupBy(*group_cols, P).agg(F.sum(Y).alias("pos"), (F.count(F.lit(1)) - F.sum(Y)).alias("neg"))
    cum = grouped_running_sums(per, list(group_cols), [F.col(P).desc()], ["pos", "neg"])
    tot = cum.groupBy(*group_cols).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))  # of the numbered copy
    pts = cum.join(tot, list(group_cols)).select(
        *group_cols, F.col(P).alias("threshold"),
        round_stat(F.try_divide(F.col("neg_cum").cast("double"), F.col("n0").cast("double"))).alias("fpr"),
        round_stat(F.try_divide(F.col("pos_cum").cast("double"), F.col("n1").cast("double"))).alias("tpr"))
    start = tot.select(*group_cols, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def majority_baseline(scores: DataFrame, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy of predicting 'no churn' for everyone = 1 - churn rate."""
    return scores.groupBy(*group_cols).agg(
        round_stat(1.0 - F.sum(Y).cast("double") / F.count(F.lit(1))).alias("baseline_accuracy"))


# Technical targets (at least) and business targets: cost per
# retained customer below 50, intervention ROI (revenue saved / cost) above 3x.
METRIC_TARGETS = (("recall", 0.75, ">="), ("precision", 0.50, ">="), ("roc_auc", 0.80, ">="), ("pr_auc", 0.60, ">="))
BUSINESS_TARGETS = (("cost_per_retained_customer", 50.0, "<"), ("intervention_roi", 3.0, ">"))


def metric_targets(scores: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = ("model",),
                   costs=None) -> DataFrame:
    """Evaluation at ``threshold`` against the success targets, one row per metric."""
    from attrition.calendar import CostModel
    costs = costs or CostModel()
    saved = F.col("tp") * costs.retention_success_rate
    spend = (F.col("tp") + F.col("fp")) * costs.incentive_cost
    m = _evaluation_counts(scores, threshold, group_cols).select(
        *group_cols, *_metric_cols(),
        round_stat(F.try_divide(spend, saved)).alias("cost_per_retained_customer"),
        round_stat(F.try_divide(saved * costs.customer_lifetime_value, spend)).alias("intervention_roi"))
    targets = METRIC_TARGETS + BUSINESS_TARGETS
    arr = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(t).alias("target"),
                             F.lit(d).alias("direction")) for n, t, d in targets])
    v, t = F.col("value"), F.col("target")
    ok = (F.when(F.col("direction") == ">=", v >= t).when(F.col("direction") == ">", v > t)
           .otherwise(v < t))
    return m.select(*group_cols, F.inline(arr)).withColumn("passed", F.coalesce(ok, F.lit(False)))


def select_model(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best validation ROC-AUC (ties: model name)."""
    return evaluate_scores(scores, threshold, ("model",)).orderBy(F.col("roc_auc").desc_nulls_last(), "model").limit(1)
