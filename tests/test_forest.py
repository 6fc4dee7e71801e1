"""Forests that are fitted, stored and scored in parts."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import functions as F

from attrition.operators import forest, models
from attrition.operators.features import FEATURES
from attrition.sources import io


@pytest.fixture(scope="module")
def train(spark):
    x = lambda k: F.pmod(F.xxhash64("customer_id", F.lit(k)), F.lit(1000)) / 100.0
    rows = spark.range(1, 401).select(F.col("id").alias("customer_id"))
    rows = rows.select("customer_id", *[x(i).alias(c) for i, c in enumerate(FEATURES)])
    return rows.withColumn("is_churned", (F.col(FEATURES[1]) + x(99) > 11).cast("int")).localCheckpoint()


def test_parts_hold_all_trees_and_few_nodes(spark):
    rf = RandomForestClassifier(numTrees=200, maxDepth=15, minInstancesPerNode=5)
    assert forest.trees_of_parts(rf, 0) == forest.trees_of_parts(rf, 10_000) == [200]
    for rows in (30_000, 100_000, 600_000, 4_000_000, 10**9):
        parts = forest.trees_of_parts(rf, rows)
        nodes = min(65_535, 2 * rows // 5 + 1)
        assert sum(parts) == 200 and len(parts) % forest.FITS_AT_ONCE == 0
        assert max(parts) * nodes * forest.FITS_AT_ONCE <= forest.NODES_AT_ONCE
    assert forest.trees_of_parts(rf.copy({rf.numTrees: 3, rf.maxDepth: 25}), 10**9) == [1, 1, 1]


def test_many_nodes_are_never_on_the_driver_at_one_time(spark, train, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 31_000)
    monkeypatch.setattr(forest, "NODES_A_SCORING", 3_000)
    model = models.train_random_forest(train)
    found = model.stages[-1]
    assert isinstance(found, forest.ForestInParts) and found.getNumTrees == 200
    assert [p["trees"] for p in found.parts] == [25] * 8
    assert all(sum(p["nodes"] for p in found.parts[k:k + 4]) <= 31_000 for k in (0, 4))
    rounds = list(found._rounds())
    assert len(rounds) > 1 and sum(rounds, []) == list(range(8))
    assert all(len(r) == 1 or sum(found.parts[i]["nodes"] for i in r) <= 3_000 for r in rounds)
    # parts of one seed would be the same trees
    assert len({tuple(p["importances"]) for p in found.parts}) == 8
    top = models.feature_importance(model, spark).collect()
    assert len(top) == 15 and top[0]["feature"] == FEATURES[1] and abs(found.featureImportances.toArray().sum() - 1) < 1e-12
    loaded = models.load_model(models.save_model(model, str(tmp_path / "m")))
    assert loaded.stages[-1].parts == found.parts and loaded.stages[-1].folder != found.folder
    a, b = ({r["customer_id"]: (r["churn_probability"], r["actual"]) for r in models.score(m, train, "x").collect()} for m in (model, loaded))
    assert a == b and len(a) == 400 and np.mean([(p >= 0.5) == y for p, y in a.values()]) > 0.9


def test_every_tree_of_every_part_has_one_vote(spark, train, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "NODES_A_SCORING", 30)
    assembler = models._assembler(FEATURES)
    rows = assembler.transform(train)
    rf = RandomForestClassifier(featuresCol="features_vec", labelCol="is_churned", numTrees=7, maxDepth=4, minInstancesPerNode=5, seed=1)
    found = forest.fit_in_parts(rf, rows, [4, 2, 1])
    saved = [RandomForestClassificationModel.load(forest._part(found.folder, i)) for i in range(3)]
    assert [m.getNumTrees for m in saved] == [4, 2, 1] and sum(m.totalNumNodes for m in saved) == found.totalNumNodes
    raw = [{r["customer_id"]: r["rawPrediction"].toArray() for r in m.transform(rows).collect()} for m in saved]
    scored = found.transform(rows).collect()
    assert len(scored) == 400 and {len(r["rawPrediction"]) for r in scored} == {2}
    for r in scored:
        votes = sum(x[r["customer_id"]] for x in raw)
        assert np.allclose(r["rawPrediction"].toArray(), votes, atol=1e-12) and np.allclose(r["probability"].toArray(), votes / 7, atol=1e-12)
        assert r["prediction"] == float(np.argmax(r["rawPrediction"].toArray()))
    mean = sum(m.featureImportances.toArray() * n for m, n in zip(saved, (4, 2, 1)))
    assert np.allclose(found.featureImportances.toArray(), mean / 7, atol=1e-12)
    path = models.save_model(PipelineModel([assembler, found]), str(tmp_path / "m"))
    with pytest.raises(ValueError, match="parts lie below"):
        models.save_model(models.load_model(path), path)
    assert models.load_model(path).transform(train).count() == 400
    assert found.transform(rows.limit(0)).collect() == []


def test_small_forest_is_one_model(train):
    model = models.train_random_forest(train.limit(60))
    assert isinstance(model.stages[-1], RandomForestClassificationModel) and model.stages[-1].getNumTrees == 200


def test_fallback_loads_a_forest_in_parts(spark, train, monkeypatch):
    """A forest of many nodes is saved, found after the preferred model is gone and scored as before, its trees never loaded together."""
    monkeypatch.setattr(forest, "NODES_A_SCORING", 30)
    assembler = models._assembler(FEATURES)
    rf = RandomForestClassifier(featuresCol="features_vec", labelCol="is_churned", numTrees=4, maxDepth=4, minInstancesPerNode=5, seed=1)
    found = PipelineModel([assembler, forest.fit_in_parts(rf, assembler.transform(train), [1, 1, 1, 1])])
    folder = models.save_models({"boosted_trees": found, "random_forest": found}, io.scratch_path(spark, "models"))
    assert models.resolve_model(spark, folder)[0] == "boosted_trees" and io.delete_path(spark, f"{folder}/boosted_trees")
    name, loaded = models.resolve_model(spark, folder)
    assert name == "random_forest" and loaded.stages[-1].folder.startswith(folder)
    assert len(list(loaded.stages[-1]._rounds())) > 1
    score = lambda m: sorted(map(tuple, models.score(m, train, "x").collect()))
    assert score(loaded) == score(found) != []


def test_later_parts_are_dealt_by_the_nodes_of_the_first(train, monkeypatch):
    """Each part reads all rows several times, so small trees make few parts."""
    assembler = models._assembler(FEATURES)
    rf = RandomForestClassifier(featuresCol="features_vec", labelCol="is_churned", numTrees=24, maxDepth=2, minInstancesPerNode=5, seed=1)
    found = forest.fit_in_parts(rf, assembler.transform(train), [1] * 24)
    assert [p["trees"] for p in found.parts] == [1] * 4 + [5] * 4 and found.getNumTrees == 24
    assert len({tuple(p["importances"]) for p in found.parts}) == 8
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 4)
    rf = rf.copy({rf.numTrees: 6})
    assert [p["trees"] for p in forest.fit_in_parts(rf, assembler.transform(train), [1] * 6).parts] == [1] * 6
