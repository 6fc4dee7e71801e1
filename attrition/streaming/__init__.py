"""Incremental ingest of raw transaction files into the clean table.

The original analysis is batch only (real-time scoring is declared out of
scope), so no streaming analysis exists.  What does carry over is the
ingest path: raw CSV files -> the stateless cleaning filter -> the stored
clean table.  Expressed as Structured Streaming it keeps the clean table
current as files land, with exactly-once file tracking in the checkpoint
(which must live in the shared checkpoint folder of the cluster).

A line is either clean or quarantined with its reason, and one query writes
both under one checkpoint.  A micro-batch is written to folders named by its
number, which a repeated batch replaces: a failure between the two writes is
made good when the batch runs again, without a lost or doubled line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.operators.clean import clean_transactions, failed_rule
from attrition.sources.io import CORRUPT, RAW_SCHEMA, csv_options, with_corrupt

#: Folder column of the number of a micro-batch.
BATCH = "batch"


def raw_transaction_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw lines with the text of those that do not fit the schema in the corrupt column."""
    r = spark.readStream.schema(with_corrupt(RAW_SCHEMA)).options(**csv_options())
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.csv(source_dir)


def clean_part(lines: DataFrame) -> DataFrame:
    return clean_transactions(lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT))


def rejected_part(lines: DataFrame) -> DataFrame:
    """``line, reason, parsed``: lines that do not fit the schema, and rows that break a cleaning rule, by its name."""
    parsed = F.struct(*[c for c in lines.columns if c != CORRUPT])
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")).otherwise(failed_rule())
    return lines.select(F.col(CORRUPT).alias("line"), reason.alias("reason"), parsed.alias("parsed")).where(F.col("reason").isNotNull())


def stream_clean_transactions(spark: SparkSession, source_dir: str, sink_dir: str, quarantine_dir: str, checkpoint: str,
                              available_now: bool = True, max_files_per_trigger: int | None = None,
                              between: Callable[[int], None] | None = None):
    """Split every new raw CSV file into the clean table at ``sink_dir`` and the quarantine at ``quarantine_dir``.

    With ``available_now`` the query processes what is there and stops (a scheduled incremental batch); otherwise it
    keeps running.  Both tables have the batch number as a folder column.  ``between`` is called with the batch
    number between the two writes of a batch (tests make it fail there).
    """
    def split(lines: DataFrame, number: int) -> None:
        clean_part(lines).write.mode("overwrite").parquet(f"{sink_dir}/{BATCH}={number}")
        if between:
            between(number)
        rejected_part(lines).write.mode("overwrite").parquet(f"{quarantine_dir}/{BATCH}={number}")

    w = raw_transaction_stream(spark, source_dir, max_files_per_trigger).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
