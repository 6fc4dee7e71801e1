"""Corpus pipeline: quality rules, near duplicates, secrets, mixing and packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes
it as Parquet below the shared checkpoint folder and gives the table that is
read back to the next stage.  All stages but the last return the columns of
``documents``.

Nulls, empty and long texts, equal rows and empty tables are treated as each
operator's docstring says.  Extra columns, whatever their names, pass through the
first four stages: a stage works on neutral names and puts theirs back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.binary_packing import binary_pieces
from attrition.llm.common import scratch_path, scratch_scope, table
from attrition.llm.mixing import MixPlan, mixed
from attrition.llm.ngram_join import similarity_join
from attrition.llm.quality_rules import quality_rules
from attrition.llm.secret_scan import redacted
from attrition.sources.io import delete_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No toxic text is wanted; low quality may be as much beside the clean text as by default.
MIX = MixPlan(weights={"clean": 0.95 / 0.99, "low": 0.04 / 0.99, "toxic": 0.0}, max_rate=1.0, unwanted=("toxic",))
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def neutral(stage: Stage) -> Stage:
    """The stage on a table whose extra columns have names that no operator uses."""
    @wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"_extra_{k}" for k, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]), sf_dir)
        back = {v: k for k, v in names.items()}
        return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns])
    return run_


@neutral
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality_rules(docs, keep=tuple(docs.columns)).filter("kept").select(*docs.columns)


@neutral
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return similarity_join(docs, keep=tuple(docs.columns)).filter("class_first").select(*docs.columns)


@neutral
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; a document's length follows its text."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@neutral
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays with the chance its domain rate gives.

    Rates are projected on [0, 1]: a rate above 1 would bring back the copies
    that an earlier stage removed.  Documents that are clean for certain have
    rate 1, documents that are more likely toxic than not have rate 0.
    """
    kept = mixed(docs, table(spark, sf_dir, "labels"), MIX)
    return kept.filter("copies > 0").select(*docs.columns)


@neutral
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document that is left, with checksums of their ids."""
    # the workers hold what the earlier stages took as well, so the batches and the memo of units are smaller here
    pieces = binary_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), units="words", batch_bytes=1 << 20, memo_units=300_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Secrets are confirmed by structure and rates are fitted iteratively, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's frame is written and read again.

    What a stage wrote on the way, and its input, are deleted when its own result is there.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
