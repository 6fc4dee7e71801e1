"""A random forest whose trees are fitted, stored and scored in parts.

Spark ML grows all trees of a forest at once and holds every node of them on the
driver, while it fits, saves, loads and scores; the nodes grow with the rows.  The
trees of a forest do not depend on each other, so a forest that may get too many
nodes is fitted as several smaller ones, each with its own seed, a few of them side by
side.  Each is saved as soon as it is fitted.  What stays in the process is the
parts' folder, their numbers of trees and nodes and their importances; a part's
trees are loaded only to score.

A pass over the rows also gets cheaper: every task of it holds and sends the statistics
of all nodes that are grown, so few trees in few tasks, several fits side by side,
send less than all trees in as many tasks as there are cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.sources import io

#: Forests that are fitted side by side.
FITS_AT_ONCE = 4
#: Nodes that the forests fitted at one time may have in all.
NODES_AT_ONCE = 1 << 21
#: Nodes of the parts that one pass over the rows scores.
NODES_A_SCORING = 1 << 19
#: Distance of the parts' seeds: the rows' draws of a part are seeded by its seed and the number of a partition.
SEED_STEP = 1_000_003


def trees_of_parts(rf: RandomForestClassifier, rows: int) -> list[int]:
    """Trees of each part: the whole forest as one part if its nodes are few enough, else parts of equal size."""
    trees = rf.getNumTrees()
    # a leaf holds at least so many rows, and a tree has fewer than two nodes a leaf
    nodes = min(2 ** (rf.getMaxDepth() + 1) - 1, 2 * rows // rf.getMinInstancesPerNode() + 1)
    if trees * nodes <= NODES_AT_ONCE:
        return [trees]
    return _equal_parts(trees, nodes)


def _equal_parts(trees: int, nodes: int) -> list[int]:
    """Parts for trees of up to ``nodes`` nodes, as many in every wave of fits."""
    most = max(1, NODES_AT_ONCE // (FITS_AT_ONCE * nodes))
    waves = -(-trees // (most * FITS_AT_ONCE))
    parts = min(trees, waves * FITS_AT_ONCE)
    return [trees // parts + (i < trees % parts) for i in range(parts)]


def fit_in_parts(rf: RandomForestClassifier, rows: DataFrame, trees: list[int]) -> ForestInParts:
    """A forest of ``sum(trees)`` trees with the settings of ``rf``, fitted in parts of so many trees.

    Trees mostly have far fewer nodes than they may have.  Once the first parts are fitted, the other trees are dealt
    anew for twice the nodes that the first trees got, in fewer parts if these allow it: each part reads all rows.
    """
    spark, trees = rows.sparkSession, list(trees)
    folder = io.scratch_path(spark, "forest")

    def fit(i: int) -> dict:
        part = rf.copy({rf.numTrees: trees[i], rf.seed: rf.getSeed() + i * SEED_STEP}).fit(rows)
        part.write().save(_part(folder, i))
        return {"trees": trees[i], "grown": sum(t.numNodes > 1 for t in part.trees), "nodes": part.totalNumNodes,
                "classes": part.numClasses, "importances": part.featureImportances.toArray().tolist()}

    begun = min(FITS_AT_ONCE, len(trees))
    parts = _side_by_side(spark, fit, range(begun))
    rest = sum(trees[begun:])
    if rest:
        dealt = _equal_parts(rest, 2 * max(-(-p["nodes"] // p["trees"]) for p in parts))
        trees[begun:] = min(dealt, trees[begun:], key=len)
        parts += _side_by_side(spark, fit, range(begun, len(trees)))
    return ForestInParts(folder, parts, rf.getFeaturesCol())


def _side_by_side[T](spark: SparkSession, run: Callable[[int], T], numbers: Sequence[int]) -> list[T]:
    """Results of ``run`` for the parts' numbers, a few at one time."""
    with ThreadPool(min(FITS_AT_ONCE, len(numbers))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), numbers, chunksize=1)


def _part(folder: str, i: int) -> str:
    return f"{folder}/part-{i:04d}"


class ForestInParts(Model, MLWritable, MLReadable):
    """The trees of all parts as one classifier: every tree has one vote, as in Spark's own model."""

    def __init__(self, folder: str, parts: list[dict], features_col: str):
        super().__init__()
        self.folder, self.parts, self.features_col = folder, parts, features_col

    @property
    def getNumTrees(self) -> int:
        return sum(p["trees"] for p in self.parts)

    @property
    def totalNumNodes(self) -> int:
        return sum(p["nodes"] for p in self.parts)

    @property
    def featureImportances(self) -> DenseVector:
        """The mean of the trees' importances, each of which sums to 1 (a tree of one leaf has none)."""
        total = sum(p["grown"] * np.array(p["importances"]) for p in self.parts)
        return Vectors.dense(total / (total.sum() or 1.0))

    def _rounds(self) -> Iterator[list[int]]:
        """Numbers of the parts that are loaded together."""
        some, nodes = [], 0
        for i, p in enumerate(self.parts):
            if some and nodes + p["nodes"] > NODES_A_SCORING:
                yield some
                some, nodes = [], 0
            some.append(i)
            nodes += p["nodes"]
        yield some

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds rawPrediction, probability and prediction.  The rows with their votes so far are written between two rounds
        of parts, so that the trees of one round only are loaded and sent."""
        spark, classes = dataset.sparkSession, self.parts[0]["classes"]
        voted, before = dataset.withColumn("_votes", F.array(*[F.lit(0.0)] * classes)), None
        for some in self._rounds():
            for part in _side_by_side(spark, lambda i: RandomForestClassificationModel.load(_part(self.folder, i)), some):
                part = part.setFeaturesCol(self.features_col).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
                raw = vector_to_array("_raw")
                voted = part.transform(voted).withColumn("_votes", F.array(*[F.col("_votes")[k] + raw[k] for k in range(classes)])).drop("_raw")
            path = io.scratch_path(spark, "votes")
            voted.write.parquet(path)
            if before:
                io.delete_path(spark, before)
            voted, before = spark.read.schema(voted.schema).parquet(path), path
        votes = F.col("_votes")
        total = sum((votes[k] for k in range(classes)), F.lit(0.0))
        share = F.array(*[F.when(total != 0, votes[k] / total).otherwise(F.lit(0.0)) for k in range(classes)])
        return (voted.withColumn("rawPrediction", array_to_vector(votes)).withColumn("probability", array_to_vector(share))
                .withColumn("prediction", (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")).drop("_votes"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader[ForestInParts]:
        return _Reader()


class _Writer(MLWriter):
    """Metadata and a copy of every part's folder."""

    def __init__(self, instance: ForestInParts):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        forest = self.instance
        for i in range(len(forest.parts)):
            io.copy_path(self.sparkSession, _part(forest.folder, i), _part(path, i))
        DefaultParamsWriter.saveMetadata(forest, path, self.sparkSession,
                                         extraMetadata={"parts": forest.parts, "featuresCol": forest.features_col})


class _Reader(MLReader):
    """The forest of a saved folder, whose parts stay where they are."""

    def load(self, path: str) -> ForestInParts:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return ForestInParts(path, metadata["parts"], metadata["featuresCol"])._resetUid(metadata["uid"])
