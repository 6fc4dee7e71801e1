"""Registered queries of the modelling and I/O layer.

The split and the models come from the session's model store
(``plans.model_store``): stored once per state of the input tables.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from attrition.calendar import TESTDATA_CALENDAR as CAL
from attrition.operators import cost, metrics, models, segments
from attrition.plans.model_store import store
from attrition.sources import io
from attrition.sources.retail import retail_raw


def _clean(spark, sf_dir):
    from attrition.plans.registry import clean_tx
    return clean_tx(spark, sf_dir)


def standard_scaler(spark, sf_dir):
    return models.scaler_report(store(spark, sf_dir).part("train"))


def class_weights(spark, sf_dir):
    return models.class_weights(store(spark, sf_dir).part("train"))


def train_logistic(spark, sf_dir):
    return models.coefficient_ranking(store(spark, sf_dir).model("logistic"), spark)


def train_random_forest(spark, sf_dir):
    return models.feature_importance(store(spark, sf_dir).model("random_forest"), spark)


def train_boosted_trees(spark, sf_dir):
    return models.feature_importance(store(spark, sf_dir).model("boosted_trees"), spark)


def model_comparison_ml(spark, sf_dir):
    """Validation metrics of the three classifiers and the heuristic score."""
    held = store(spark, sf_dir)
    parts = [held.scores(n, "validation").drop("predicted")
             for n in ("logistic", "random_forest", "boosted_trees")]
    heur = (metrics.heuristic_scores(_clean(spark, sf_dir), CAL)
            .join(held.part("validation").select("customer_id"), "customer_id"))
    allp = parts[0]
    for p in parts[1:] + [heur.select(*allp.columns)]:
        allp = allp.unionByName(p)
    return metrics.evaluate_scores(allp)


def score(spark, sf_dir):
    """Test-set scores of the final (boosted) model."""
    return store(spark, sf_dir).scores("boosted_trees", "test")


def ml_cost_analysis(spark, sf_dir):
    return cost.cost_analysis(store(spark, sf_dir).scores("boosted_trees", "test").drop("predicted"))


def save_load_model(spark, sf_dir):
    """The test split scored by the logistic pipeline (scaler included) and by its copy saved to and loaded from the shared folder."""
    held = store(spark, sf_dir)
    model, test = held.model("logistic"), held.part("test")
    loaded = models.load_model(models.save_model(model, io.scratch_path(spark, "model-logistic")))
    again = models.score(loaded, test, "logistic").select("customer_id", F.col("churn_probability").alias("_p"))
    return (models.score(model, test, "logistic").join(again, "customer_id")
            .select("customer_id", "actual", (F.col("churn_probability") == F.col("_p")).alias("same_probability")))


def resolve_model(spark, sf_dir):
    """All models saved, the final one deleted, the best of the rest loaded and scored: its name, the rows and the largest
    difference to the unsaved model's scores."""
    held = store(spark, sf_dir)
    fitted = {n: held.model(n) for n in ("logistic", *models.MODEL_PREFERENCE)}
    folder = models.save_models(fitted, io.scratch_path(spark, "models"))
    first, _ = models.resolve_model(spark, folder)
    io.delete_path(spark, f"{folder}/{first}")
    name, model = models.resolve_model(spark, folder)
    test = held.part("test")
    unsaved = models.score(fitted[name], test, name).select("customer_id", F.col("churn_probability").alias("_p"))
    return (models.score(model, test, name).join(unsaved, "customer_id").groupBy("model")
            .agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("churn_probability") - F.col("_p"))).alias("max_difference"))
            .select(F.lit(first).alias("absent_model"), "model", "rows", "max_difference"))


def model_decisions(spark, sf_dir):
    """The decision chain on the fitted final model: scored test customers, their segments, the segments' budget, and the
    optimal threshold against the default one."""
    scores = store(spark, sf_dir).scores("boosted_trees", "test").drop("predicted")
    seg = segments.customer_segments(scores).agg(F.count(F.lit(1)).alias("segmented"), F.sum("actual_churned").cast("bigint").alias("churners"))
    budget = segments.segment_budget(scores).agg(F.sum("customers").alias("c"), F.sum("expected_churners").alias("e"))
    default, best = cost.business_cost(scores, 0.5), cost.optimal_threshold(scores)
    gain = (default.select(F.sum("total_cost")).scalar() - best.select(F.sum("total_cost")).scalar()) >= 0
    return seg.select("segmented", "churners", budget.select("c").scalar().alias("budgeted"), budget.select("e").scalar().alias("budgeted_churners"),
                      gain.alias("optimum_not_worse"))


def validation_log(spark, sf_dir):
    """Validation log loss of the boosted trees after every round."""
    held = store(spark, sf_dir)
    return models.validation_log(held.model("boosted_trees"), held.part("validation"))


def validation_log_check(spark, sf_dir):
    held = store(spark, sf_dir)
    return models.validation_log_check(held.model("boosted_trees"), held.part("validation"))


def logistic_probability_check(spark, sf_dir):
    held = store(spark, sf_dir)
    return models.probability_check(held.model("logistic"), held.part("test"))


def logistic_optimality(spark, sf_dir):
    held = store(spark, sf_dir)
    return models.optimality_check(held.model("logistic"), held.part("train"))


def read_transactions_csv(spark, sf_dir):
    """CSV round trip of the raw transactions through the shared folder."""
    path = io.write_transactions_csv(retail_raw(spark, sf_dir), io.scratch_path(spark, "raw-csv"))
    return io.read_transactions_csv(spark, path, io.scratch_path(spark, "quarantine"))


def _broken_csv(spark, sf_dir):
    """Raw lines written as CSV with an unreadable quantity where the price is 0."""
    raw = retail_raw(spark, sf_dir)
    broken = raw.withColumn("quantity", F.when(F.col("price") == 0, F.lit("n/a")).otherwise(F.col("quantity").cast("string")))
    return io.write_transactions_csv(broken, io.scratch_path(spark, "broken-csv"))


def quarantined_rows(spark, sf_dir):
    """What the reader puts aside of a file with broken lines."""
    aside = io.scratch_path(spark, "quarantine")
    io.read_transactions_csv(spark, _broken_csv(spark, sf_dir), aside)
    return io.read_quarantine(spark, aside).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def stream_split(spark, sf_dir):
    """Broken lines streamed: the query fails between the two writes of its first batch and is started again; rows by where they
    went and why, which together are the raw rows."""
    from attrition.streaming import BATCH, stream_clean_transactions as run
    src = _broken_csv(spark, sf_dir)
    sink, aside, ck = (io.scratch_path(spark, f"stream-{x}") for x in ("sink", "quarantine", "ckpt"))

    def fail(number: int) -> None:
        raise RuntimeError(f"stopped between the writes of batch {number}")

    try:
        run(spark, src, sink, aside, ck, between=fail).awaitTermination()
    except StreamingQueryException:
        pass
    else:
        raise AssertionError("the first run was to fail")
    run(spark, src, sink, aside, ck).awaitTermination()
    clean = spark.read.parquet(sink).select(F.lit("clean").alias("reason"), BATCH)
    return clean.unionByName(spark.read.parquet(aside).select("reason", BATCH)).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def verify_round_trip(spark, sf_dir):
    return io.verify_round_trip(_clean(spark, sf_dir), io.scratch_path(spark, "clean-parquet"))


def read_or_default(spark, sf_dir):
    """The cost-analysis report written as CSV and read back, and the defaults where there is no report."""
    schema, defaults = "optimal_threshold double, roi double, net_benefit double", [(0.35, 250.0, 15000.0)]  # fixed values
    rep = cost.cost_analysis(metrics.heuristic_scores(_clean(spark, sf_dir), CAL))
    path = io.write_report_csv(rep.select("optimal_threshold", "roi", "net_benefit"), io.scratch_path(spark, "report"))
    found = io.read_or_default(spark, path, schema, defaults)
    absent = io.read_or_default(spark, io.scratch_path(spark, "no-report"), schema, defaults)
    return found.withColumn("report", F.lit("stored")).unionByName(absent.withColumn("report", F.lit("absent")))


ML_QUERIES = {
    "standard_scaler": standard_scaler,
    "class_weights": class_weights,
    "train_logistic": train_logistic,
    "train_random_forest": train_random_forest,
    "train_boosted_trees": train_boosted_trees,
    "model_comparison_ml": model_comparison_ml,
    "score": score,
    "ml_cost_analysis": ml_cost_analysis,
    "save_load_model": save_load_model,
    "resolve_model": resolve_model,
    "model_decisions": model_decisions,
    "validation_log": validation_log,
    "validation_log_check": validation_log_check,
    "logistic_probability_check": logistic_probability_check,
    "logistic_optimality": logistic_optimality,
    "read_transactions_csv": read_transactions_csv,
    "verify_round_trip": verify_round_trip,
    "read_or_default": read_or_default,
}


def stream_clean_transactions(spark, sf_dir):
    """Raw lines written as CSV files, ingested by the streaming cleaner, read back."""
    from attrition.streaming import BATCH, stream_clean_transactions as run
    src = io.write_transactions_csv(retail_raw(spark, sf_dir), io.scratch_path(spark, "stream-src"))
    sink, aside, ck = (io.scratch_path(spark, f"stream-{x}") for x in ("sink", "quarantine", "ckpt"))
    run(spark, src, sink, aside, ck, available_now=True).awaitTermination()
    return spark.read.parquet(sink).drop(BATCH)


ML_QUERIES["stream_split"] = stream_split
ML_QUERIES["stream_clean_transactions"] = stream_clean_transactions


def register_views(spark, sf_dir):
    """Spark SQL over a registered view of the cleaned table: buyers, orders and revenue by weekday."""
    io.register_views(spark, {"transactions_clean": _clean(spark, sf_dir)})
    return spark.sql("""
        FROM (SELECT weekday(invoice_ts) + 1 AS weekday, customer_id, invoice, hour(invoice_ts) BETWEEN 9 AND 16 AS daytime,
                     CAST(CAST(quantity AS DECIMAL(18,2)) * CAST(price AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS worth
              FROM transactions_clean)
        SELECT weekday, COUNT(DISTINCT customer_id) AS buyers, COUNT(DISTINCT invoice) AS orders,
               CAST(SUM(worth) AS DOUBLE) AS revenue, CAST(COALESCE(SUM(worth) FILTER (WHERE daytime), 0) AS DOUBLE) AS daytime_revenue
        GROUP BY weekday""")


ML_QUERIES["register_views"] = register_views
ML_QUERIES["quarantined_rows"] = quarantined_rows


def coefficient_ranking(spark, sf_dir):
    """Top-15 logistic coefficients by absolute value."""
    return models.coefficient_ranking(store(spark, sf_dir).model("logistic"), spark)


def feature_importance(spark, sf_dir):
    """Top-15 importances of the forest and of the boosted trees."""
    parts = [models.feature_importance(store(spark, sf_dir).model(n), spark).withColumn("model", F.lit(n))
             for n in ("random_forest", "boosted_trees")]
    return parts[0].unionByName(parts[1])


def write_table(spark, sf_dir):
    """The clean table written by the pipeline writer and read back."""
    from attrition.plans.pipeline import materialize_transactions
    return materialize_transactions(_clean(spark, sf_dir), io.scratch_path(spark, "transactions-clean"))


ML_QUERIES.update({"coefficient_ranking": coefficient_ranking, "feature_importance": feature_importance,
                   "write_table": write_table})
