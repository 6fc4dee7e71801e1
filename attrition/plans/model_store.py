"""The stored clean lines, split and fitted models of one set of input tables.

The clean lines are written once, so that the many shapes of the feature matrix
read one narrow table instead of joining the star schema once per shape.  The
labelled split is computed from them and written once, partitioned by split; every
model is fitted on the stored rows and saved beside them.  Reports on models read
both back, so a second report neither splits nor fits again.

Stores belong to a session and to the state of the input tables (sizes and
modification times): a new session or a rewritten table starts a new store.
Only folder names and loaded models are kept in the process, never data.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from attrition.calendar import TESTDATA_CALENDAR, ChurnCalendar
from attrition.operators import models
from attrition.operators.clean import clean_transactions
from attrition.plans.pipeline import materialize_model_ready, materialize_transactions
from attrition.sources import io
from attrition.sources.retail import RETAIL_TABLES, retail_raw

TRAINERS = {"logistic": models.train_logistic, "random_forest": models.train_random_forest, "boosted_trees": models.train_boosted_trees}
_STORES: WeakKeyDictionary[SparkSession, dict[tuple, ModelStore]] = WeakKeyDictionary()


class ModelStore:
    """Clean lines, split and models of one state of the tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, cal: ChurnCalendar = TESTDATA_CALENDAR):
        self.spark, self.sf_dir, self.cal = spark, sf_dir, cal
        self.folder = io.scratch_path(spark, "model-store")
        self._models: dict[str, PipelineModel] = {}
        self._clean: DataFrame | None = None
        self._split: DataFrame | None = None

    def clean(self) -> DataFrame:
        """The clean lines as a stored table."""
        if self._clean is None:
            tx = clean_transactions(retail_raw(self.spark, self.sf_dir))
            self._clean = materialize_transactions(tx, f"{self.folder}/transactions-clean")
        return self._clean

    def split(self) -> DataFrame:
        if self._split is None:
            self._split = materialize_model_ready(self.clean(), self.cal, f"{self.folder}/split")
        return self._split

    def part(self, name: str) -> DataFrame:
        """Rows of train, validation or test: a folder of the stored split."""
        return self.split().where(self.split()["split"] == name).drop("split")

    def model(self, name: str) -> PipelineModel:
        if name not in self._models:
            self._models[name] = TRAINERS[name](self.part("train"))
            models.save_model(self._models[name], f"{self.folder}/models/{name}")
        return self._models[name]

    def scores(self, name: str, part: str) -> DataFrame:
        return models.score(self.model(name), self.part(part), name)


def store(spark: SparkSession, sf_dir: str) -> ModelStore:
    """The session's store of the tables as they are now."""
    state = io.signature(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in RETAIL_TABLES])
    held = _STORES.setdefault(spark, {})
    if state not in held:
        held[state] = ModelStore(spark, sf_dir)
    return held[state]
