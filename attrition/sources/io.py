"""Readers and writers: raw CSV, tables, reports, models, SQL views.

Scratch output of the registered round-trip checks goes under the shared
checkpoint folder of the session (never a machine-local folder).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType)

from attrition.session import checkpoint_dir

WRITE_TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
READ_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
#: Column that holds the text of a line that does not fit the schema.
CORRUPT = "_corrupt"

RAW_SCHEMA = StructType([
    StructField("invoice", StringType()), StructField("stock_code", StringType()),
    StructField("description", StringType()), StructField("quantity", DoubleType()),
    StructField("invoice_ts", TimestampNTZType()), StructField("price", DoubleType()),
    StructField("customer_id", LongType()), StructField("country", StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def csv_options(corrupt: str = CORRUPT) -> dict[str, str]:
    """Reader options shared by batch and streaming; a line that does not fit keeps its text in ``corrupt``."""
    return {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt,
            "timestampNTZFormat": READ_TIMESTAMP, "timestampFormat": READ_TIMESTAMP}


def with_corrupt(schema: StructType, corrupt: str = CORRUPT) -> StructType:
    return StructType([*schema.fields, StructField(corrupt, StringType())])


def read_transactions_csv(spark: SparkSession, path: str, quarantine: str, schema: StructType = RAW_SCHEMA) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data).

    A line with a field that does not parse is no transaction: it is left out
    of the result, and its text is written below ``quarantine``
    (``read_quarantine``), so that nothing disappears without a trace.
    """
    lines = spark.read.options(**csv_options()).schema(with_corrupt(schema)).csv(path)
    rejects(lines).write.mode("overwrite").parquet(quarantine)
    return lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejects(lines: DataFrame) -> DataFrame:
    """Text and reason of the lines that did not fit the schema."""
    # all columns are named so that the parser reads every field before it judges the line
    return lines.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.lit("malformed").alias("reason"),
                                                          F.struct(*[c for c in lines.columns if c != CORRUPT]).alias("parsed"))


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_transactions_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", "true").option("timestampNTZFormat", WRITE_TIMESTAMP)
       .option("timestampFormat", WRITE_TIMESTAMP).csv(path))
    return path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verify_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet, read it back; one row with both counts (taken
    in a single union aggregation) and whether they agree."""
    write_table(df, path)
    back = read_table(df.sparkSession, path)
    both = (df.select(F.lit(1).alias("_w"), F.lit(0).alias("_r"))
              .unionByName(back.select(F.lit(0).alias("_w"), F.lit(1).alias("_r"))))
    r = both.agg(F.sum("_w").cast("bigint").alias("rows_written"), F.sum("_r").cast("bigint").alias("rows_read"))
    return r.withColumn("passed", F.col("rows_written") == F.col("rows_read"))


def write_report_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def read_report_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder of the shared file system; false if it was absent."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def copy_path(spark: SparkSession, path: str, to: str) -> None:
    """Copy a folder of small files (a saved model) through the driver, byte by byte."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.Path(path), hadoop.Path(to)
    if not hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf):
        raise OSError(f"{path} could not be copied to {to}")


def signature(spark: SparkSession, paths: list[str]) -> tuple[tuple[str, int, int, int], ...]:
    """(path, bytes, files, modification time) of tables: differs when a table is written again."""
    out = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        summary = fs.getContentSummary(p)
        out.append((path, summary.getLength(), summary.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return tuple(out)


def read_or_default(spark: SparkSession, path: str, schema: StructType | str, defaults: list[tuple]) -> DataFrame:
    """The report at ``path`` if it exists, else a DataFrame of ``defaults``."""
    if path_exists(spark, path):
        return read_report_csv(spark, path, schema)
    return spark.createDataFrame(defaults, schema)


def register_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Expose DataFrames to ``spark.sql`` under the given names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
