"""Classifiers on Spark ML over the model-ready table.

The scaler uses the population standard deviation (Spark's StandardScaler
uses the sample one), computed as plain SQL aggregates and stored as a SQL
stage of the fitted pipeline, so a saved logistic model carries its scaler and
takes raw features.  Class weights are a ``weight`` column.  The logistic
model's L2 strength is mapped from "C = 1 with summed weighted loss" to Spark's
mean loss: regParam = 1 / sum(weights).  Its solver works on the principal axes of
the scaled features, where the same objective takes tens of passes instead of up to
a thousand.  Gradient-boosted trees replace the
original boosting library (not available here); its column subsampling is
per node in Spark.  Probabilities are read with ``vector_to_array``.

What a fitted model claims is checked by plain column expressions over the
whole table: the logistic probability from the stored coefficients, the gradient
of the penalised objective at them, and the log loss of the boosted scores.

A model folder holds one saved pipeline per model name; ``resolve_model`` takes
the first of the preferred names that is there.  Only an absent model is passed
over: a folder that cannot be read raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.functions.timeutil import round_stat
from attrition.operators import forest
from attrition.operators.features import FEATURES
from attrition.session import checkpoint_dir
from attrition.sources.io import path_exists

LABEL = "is_churned"


def standard_scaler(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Per-feature mean and population std of the training rows (one pass)."""
    wide = train.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                                F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c) for c in features])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in features])
    return wide.select(F.inline(arr)).select("feature", F.col("s.mean").alias("mean"), F.col("s.std").alias("std"))


def scaler_report(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    s = standard_scaler(train, features)
    return s.select("feature", round_stat("mean").alias("mean"), round_stat("std").alias("std"))


def scaler_stage(stats: DataFrame, features: Sequence[str] = FEATURES) -> SQLTransformer:
    """(x - mean) / std as columns ``scaled_<feature>``; std 0 -> 1.  The stats table has one row
    per feature, so it is read once into the stage's statement (bounded by the feature count)."""
    rows = {r["feature"]: (float(r["mean"]), float(r["std"] or 1.0)) for r in stats.collect()}
    scaled = [f"(CAST(`{c}` AS DOUBLE) - {rows[c][0]!r}D) / {rows[c][1]!r}D AS `scaled_{c}`" for c in features]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Printed ratio weights {0: 1, 1: (1-p)/p} and the 'balanced' weights n / (2 n_c)."""
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    n = train.select(F.count(F.lit(1))).scalar()
    p = train.select(F.avg(F.col(label).cast("double"))).scalar()
    return g.select(F.col(label).alias("class"), "count",
                    F.when(F.col(label) == 1, (1 - p) / p).otherwise(F.lit(1.0)).alias("ratio_weight"),
                    round_stat(n / (2.0 * F.col("count"))).alias("balanced_weight"))


def with_balanced_weight(df: DataFrame, label: str = LABEL, col: str = "weight") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.select(F.count(F.lit(1))).scalar()
    # two rows (one per class)
    return (df.join(F.broadcast(counts), label)
              .withColumn(col, (n / (2.0 * F.col("_nc"))).cast("double")).drop("_nc"))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features_vec", handleInvalid="keep")


#: Rows of one task of a training pass, once there are more of them than the cores can share.
ROWS_A_TASK = 500_000
#: Principal axes with a smaller share of the largest variance hold rounding only.
NO_VARIANCE = 1e-12


def _in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as there are cores, or rows call for: every task of a pass sends its sums, so their
    number must follow the rows and not the files that the table was written in."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def _optimum(rows: DataFrame, lr: LogisticRegression) -> tuple[list[float], float]:
    """Coefficients and intercept at which the penalised objective of ``lr`` is least.

    The features are turned to their principal axes.  A rotation keeps the squared norm of the coefficients, so the
    objective is the same one; but the columns are uncorrelated, and the solver, which divides each by its standard
    deviation, meets a well-conditioned problem.  On the features themselves, which repeat each other, its steps
    grow in number with the rows until ``maxIter`` ends them.  Axes without variance get no coefficient.
    """
    size = len(rows.first()["features_vec"])
    pca = PCA(k=size, inputCol="features_vec", outputCol="_axes").fit(rows)
    shares = pca.explainedVariance.toArray()
    kept = [i for i, v in enumerate(shares) if v > NO_VARIANCE * shares.max()]
    if not kept:
        return [0.0] * size, float(lr.fit(rows).intercept)
    turn = pca.pc.toArray()[:, kept]  # features x axes, bounded by the feature count
    axes = F.array(*[F.col("_a")[i] for i in kept])
    turned = pca.transform(rows).withColumn("_a", vector_to_array("_axes")).withColumn("_axes", array_to_vector(axes))
    fitted = lr.copy({lr.featuresCol: "_axes", lr.tol: 1e-12}).fit(turned)
    return (turn @ fitted.coefficients.toArray()).tolist(), float(fitted.intercept)


def train_logistic(train: DataFrame, features: Sequence[str] = FEATURES) -> PipelineModel:
    """Scaler, assembler and classifier as one model over the raw features.

    The classifier is fitted between bounds that meet at the optimum, which a rotated copy of the problem found.
    """
    scaler = scaler_stage(standard_scaler(train, features), features)
    assembler = _assembler([f"scaled_{c}" for c in features])
    w = with_balanced_weight(train)
    n, classes, total_w = w.agg(F.count(F.lit(1)), F.count_distinct(LABEL), F.sum("weight")).first()  # three numbers
    rows = _in_few_tasks(assembler.transform(scaler.transform(w)).select("features_vec", LABEL, "weight"), n).persist()
    try:
        lr = LogisticRegression(featuresCol="features_vec", labelCol=LABEL, weightCol="weight", maxIter=1000, tol=1e-9,
                                regParam=1.0 / float(total_w), elasticNetParam=0.0, standardization=False)
        if classes > 1:
            beta, intercept = _optimum(rows, lr)
            at, level = DenseMatrix(1, len(beta), beta), Vectors.dense([intercept])
            lr = lr.copy({lr.lowerBoundsOnCoefficients: at, lr.upperBoundsOnCoefficients: at,
                          lr.lowerBoundsOnIntercepts: level, lr.upperBoundsOnIntercepts: level})
        return PipelineModel([scaler, assembler, lr.fit(rows)])
    finally:
        rows.unpersist()


def train_random_forest(train: DataFrame, features: Sequence[str] = FEATURES, seed: int = 42) -> PipelineModel:
    """200 trees of depth 15.  Each row keeps its node of every tree, so a level does not walk all trees from the
    root, and a pass over the rows holds the statistics of up to 512 MB of nodes a task.  A forest that may get many
    nodes is fitted in parts (``operators.forest``); its parts share the cores, so each reads the rows in few tasks."""
    spark, n = train.sparkSession, train.count()
    checkpoint_dir(spark)
    w = with_balanced_weight(train)
    rf = RandomForestClassifier(featuresCol="features_vec", labelCol=LABEL, weightCol="weight", numTrees=200,
                                maxDepth=15, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed,
                                cacheNodeIds=True, maxMemoryInMB=512)
    trees = forest.trees_of_parts(rf, n)
    if len(trees) == 1:
        return Pipeline(stages=[_assembler(features), rf]).fit(w)
    tasks = max(-(-spark.sparkContext.defaultParallelism // forest.FITS_AT_ONCE), -(-n // ROWS_A_TASK))
    rows = _assembler(features).transform(w).select("features_vec", LABEL, "weight").coalesce(tasks).persist()
    try:
        return PipelineModel([_assembler(features), forest.fit_in_parts(rf, rows, trees)])
    finally:
        rows.unpersist()


def train_boosted_trees(train: DataFrame, features: Sequence[str] = FEATURES, seed: int = 42,
                        max_iter: int = 200) -> PipelineModel:
    """Positive rows weighted (1-p)/p (scale_pos_weight), 200 rounds of depth 6."""
    checkpoint_dir(train.sparkSession)
    n, p = train.select(F.count(F.lit(1)), F.avg(F.col(LABEL).cast("double"))).first()  # two numbers
    w = _in_few_tasks(train, n).withColumn("weight", F.when(F.col(LABEL) == 1, F.lit((1 - p) / p)).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(featuresCol="features_vec", labelCol=LABEL, weightCol="weight", maxIter=max_iter,
                        maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[_assembler(features), gbt]).fit(w)


def score(model: PipelineModel, df: DataFrame, model_name: str, threshold: float = 0.5) -> DataFrame:
    """Probability of churn and the label at ``threshold``."""
    s = model.transform(df).withColumn("churn_probability", vector_to_array("probability")[1])
    return s.select(F.lit(model_name).alias("model"), "customer_id", "churn_probability",
                    F.col(LABEL).alias("actual"),
                    (F.col("churn_probability") >= threshold).cast("int").alias("predicted"))


def linear_probability(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES, name: str = "probability_native") -> DataFrame:
    """``df`` with the logistic probability as one expression of the stored scaler, coefficients and intercept."""
    scaler, lr = model.stages[0], model.stages[-1]
    margin = F.lit(float(lr.intercept))
    for c, b in zip(features, lr.coefficients.toArray().tolist(), strict=True):
        margin = margin + F.lit(b) * F.col(f"scaled_{c}")
    return scaler.transform(df).withColumn(name, 1.0 / (1.0 + F.exp(-margin)))


#: Largest difference between the native probability and the model's own.
PROBABILITY_TOLERANCE = 1e-9
#: Largest component of the objective's gradient at an optimum (the convergence bound of the original's solver).
GRADIENT_TOLERANCE = 1e-4


def probability_check(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: rows compared, whether no probability differs by the tolerance, and whether all lie in [0, 1]."""
    theirs = vector_to_array("probability")[1]
    both = linear_probability(model, model.transform(df).drop(*[f"scaled_{c}" for c in features]), features).select(
        F.col("probability_native").alias("p"), F.abs(theirs - F.col("probability_native")).alias("gap"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("gap") < PROBABILITY_TOLERANCE, F.lit(True)).alias("within_tolerance"),
                    F.coalesce(F.bool_and(F.col("p").between(0.0, 1.0)), F.lit(True)).alias("in_unit_interval"))


def objective_gradient(model: PipelineModel, train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``component, gradient`` of the penalised objective at the fitted coefficients.

    The objective is the weighted mean log loss plus regParam / 2 times the squared
    coefficients (the intercept is free).  All components come from one aggregation over
    the training rows, whose size is the number of features.
    """
    lr = model.stages[-1]
    reg = lr.getRegParam()
    rows = with_balanced_weight(linear_probability(model, train, features))
    error = F.col("weight") * (F.col("probability_native") - F.col(LABEL))
    mean = lambda x: F.sum(x) / F.sum("weight")
    parts: list[tuple[str, Column]] = [("intercept", mean(error))]
    for c, b in zip(features, lr.coefficients.toArray().tolist(), strict=True):
        parts.append((c, mean(error * F.col(f"scaled_{c}")) + F.lit(reg * b)))
    wide = rows.agg(*[g.alias(f"g_{c}") for c, g in parts])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"g_{c}").alias("gradient")) for c, _ in parts])))


def optimality_check(model: PipelineModel, train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: components of the gradient and whether none exceeds the tolerance."""
    return objective_gradient(model, train, features).agg(
        F.count("gradient").alias("components"), (F.max(F.abs("gradient")) < GRADIENT_TOLERANCE).alias("at_optimum"))


def validation_log(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``round, log_loss`` of the boosted model after every round, on ``df``.

    Spark ML evaluates all rounds in one distributed pass (one number a round comes back).
    Its loss is 2 log(1 + exp(-2 y F)) with y in {-1, 1}: twice the log loss of the probability.
    """
    rows = df.withColumn("weight", F.lit(1.0))
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    losses = model.stages[-1].evaluateEachIteration(rows)
    return df.sparkSession.createDataFrame([(k + 1, float(x) / 2) for k, x in enumerate(losses)], "round int, log_loss double")


def log_loss(p: str = "churn_probability", y: str = "actual") -> Column:
    """Mean negative log likelihood as an aggregate expression."""
    return -F.avg(F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1.0 - F.col(p))))


def validation_log_check(model: PipelineModel, df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: rounds logged, and whether the last loss is that of the final scores."""
    log = validation_log(model, df)
    final = score(model, df, "final").agg(log_loss().alias("final_loss"))
    last = log.agg(F.count(F.lit(1)).alias("rounds"), F.max_by("log_loss", "round").alias("last_loss"))
    gap = F.abs(F.col("last_loss") - final.select("final_loss").scalar())
    return last.select("rounds", (gap < tolerance).alias("last_equals_scores"))


def coefficient_ranking(model: PipelineModel, spark, features: Sequence[str] = FEATURES, top: int = 15) -> DataFrame:
    coefs = model.stages[-1].coefficients.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(c) for c in coefs])), "feature string, coefficient double")
    return df.orderBy(F.abs("coefficient").desc(), "feature").limit(top)


def feature_importance(model: PipelineModel, spark, features: Sequence[str] = FEATURES, top: int = 15) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(c) for c in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top)


def save_model(model: PipelineModel, path: str) -> str:
    for stage in model.stages:
        # overwriting would delete the trees first
        if isinstance(stage, forest.ForestInParts) and f"{stage.folder}/".startswith(f"{path.rstrip('/')}/"):
            raise ValueError(f"the forest's parts lie below {path}")
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_models(fitted: dict[str, PipelineModel], folder: str) -> str:
    """One saved pipeline per name below ``folder``."""
    for name, model in fitted.items():
        save_model(model, f"{folder}/{name}")
    return folder


#: The final model first, then what stands in for it.
MODEL_PREFERENCE = ("boosted_trees", "random_forest")


def resolve_model(spark: SparkSession, folder: str, preference: Sequence[str] = MODEL_PREFERENCE) -> tuple[str, PipelineModel]:
    """Name and model of the first preferred model that the folder holds."""
    for name in preference:
        if path_exists(spark, f"{folder}/{name}"):
            return name, load_model(f"{folder}/{name}")
    raise FileNotFoundError(f"none of {', '.join(preference)} below {folder}")
