"""Shared intermediate shapes of the transaction table.

All of them are aggregations whose keys start with ``customer_id``; Spark
computes them with map-side partial aggregation, so a customer holding a
large share of the lines does not end up as one oversized task.  Unused
output columns are pruned by Catalyst, so callers can take what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.timeutil import line_value, ts_lit


def until(tx: DataFrame, cutoff) -> DataFrame:
    """Lines up to and including midnight of ``cutoff``."""
    return tx.where(F.col("invoice_ts") <= ts_lit(cutoff))


def customer_base(tx: DataFrame) -> DataFrame:
    """One row per customer: first/last purchase, orders, lines, revenue, quantity."""
    return tx.groupBy("customer_id").agg(
        F.min("invoice_ts").alias("first_ts"),
        F.max("invoice_ts").alias("last_ts"),
        F.count_distinct("invoice").alias("n_orders"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(line_value()).alias("revenue"),
        F.sum("quantity").alias("total_qty"),
    )


def orders_ts(tx: DataFrame) -> DataFrame:
    """(customer, invoice, timestamp) baskets: value, quantity, lines."""
    return tx.groupBy("customer_id", "invoice", "invoice_ts").agg(
        F.sum(line_value()).alias("order_value"),
        F.sum("quantity").alias("order_qty"),
        F.count(F.lit(1)).alias("order_lines"),
    )


def purchase_days(tx: DataFrame) -> DataFrame:
    """Distinct (customer, calendar day) pairs.  At most one row per day per
    customer, so per-customer windows over this shape stay small."""
    return tx.select("customer_id", F.to_date("invoice_ts").alias("order_date")).distinct()


#: Join keys that each customer's rows are spread over.
CUSTOMER_SALTS = 16


def with_customer(rows: DataFrame, per_customer: DataFrame, spread_by: str, salts: int = CUSTOMER_SALTS) -> DataFrame:
    """Join ``rows`` to one row per customer without gathering a customer's rows in one task.

    ``rows`` are salted by the hash of ``spread_by`` and the narrow per-customer
    table is copied to every salt.  The adaptive skew split does not help here:
    it needs two bare shuffles, and the per-customer side is an aggregate.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = per_customer.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["customer_id", "_salt"]).drop("_salt")


def day_gaps(dates_col: str) -> "F.Column":
    """Whole-day gaps between consecutive entries of a sorted date array."""
    d = F.col(dates_col)
    n = F.size(d)
    return F.when(n > 1, F.zip_with(F.slice(d, 2, n), F.slice(d, 1, n - 1),
                                    lambda a, b: F.datediff(a, b))).otherwise(F.array().cast("array<int>"))


def status_col(last_col: str, cutoff) -> "F.Column":
    return F.when(F.col(last_col) <= ts_lit(cutoff), F.lit("Churned")).otherwise(F.lit("Active"))


def churn_flag(last_col: str, cutoff) -> "F.Column":
    return F.when(F.col(last_col) <= ts_lit(cutoff), F.lit(1)).otherwise(F.lit(0))
