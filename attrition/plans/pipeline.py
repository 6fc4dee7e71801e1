"""End-to-end plan: raw lines -> stored clean table -> labelled feature table.

The clean transactions are the one table every analysis reads, so they are
materialised once (writing them also cuts the lineage back to the raw
joins: a lost executor only re-reads files).

The layout is the caller's choice.  ``plain`` (the default) is Parquet sorted
by time inside files: map-side partial aggregation and salted joins spread a
customer of any size over all tasks.  ``bucketed`` stores the table by customer,
which makes the per-customer shapes shuffle-free, but one task reads a bucket:
use it where ``largest_customer_share`` reports no large customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.operators.labels import model_ready, stratified_split


def largest_customer_share(tx: DataFrame) -> tuple[int, int]:
    """(lines of the largest customer, all lines): advice for the layout; one row to the driver."""
    r = (tx.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max("n").alias("mx"), F.sum("n").alias("total")).first())
    return int(r["mx"] or 0), int(r["total"] or 0)


def materialize_transactions(tx: DataFrame, path: str, layout: str = "plain", num_buckets: int | None = None,
                             table: str | None = None) -> DataFrame:
    """Write the clean lines (``layout``: plain | bucketed, the latter as catalogue table ``table``) and read them back."""
    spark = tx.sparkSession
    if layout == "plain":
        tx.sortWithinPartitions("invoice_ts").write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    if layout != "bucketed" or not table:
        raise ValueError("layout is 'plain', or 'bucketed' with the name of its table")
    n = num_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (tx.repartition(n, "customer_id")
       .write.mode("overwrite").format("parquet").option("path", path)
       .bucketBy(n, "customer_id").sortBy("customer_id", "invoice_ts")
       .saveAsTable(table))
    return spark.table(table)


def materialize_model_ready(tx: DataFrame, cal: ChurnCalendar, path: str) -> DataFrame:
    """Labelled feature table with its split, partitioned by split."""
    df = stratified_split(model_ready(tx, cal))
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return tx.sparkSession.read.parquet(path)
