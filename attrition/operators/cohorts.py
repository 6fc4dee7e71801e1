"""Cohort analyses: monthly retention matrix and cohort value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import line_value, pct, round_half_up


def cohort_retention(tx: DataFrame, cal: ChurnCalendar | None = None, max_months: int = 12) -> DataFrame:
    """Cohort = month of first purchase; share of the cohort active in each of
    the following ``max_months`` months.

    Distinct (customer, month) rows come first, by hash aggregation; a customer's
    months (at most one per month of history) are collected from those; the cohort is the
    smallest of them, so no join of activity and cohorts is needed.
    """
    month = F.trunc(F.col("invoice_ts").cast("date"), "month")
    active = tx.select("customer_id", month.alias("month")).distinct()
    per = active.groupBy("customer_id").agg(F.collect_list("month").alias("months"))
    per = per.select(F.array_min("months").alias("cohort_month"), "months")
    months = ((F.year("activity_month") - F.year("cohort_month")) * 12
              + (F.month("activity_month") - F.month("cohort_month")))
    act = per.select("cohort_month", F.explode("months").alias("activity_month"))
    cr = (act.withColumn("months_since_join", months.cast("int"))
             .where(F.col("months_since_join") <= max_months)
             .groupBy("cohort_month", "activity_month", "months_since_join")
             .agg(F.count(F.lit(1)).alias("active_customers")))
    sizes = per.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    # sizes: one row per month of history -> small
    return (cr.join(F.broadcast(sizes), "cohort_month")
              .orderBy("cohort_month", "months_since_join")
              .select("cohort_month", "cohort_size", "months_since_join", "active_customers",
                      pct("active_customers", "cohort_size").alias("retention_rate_pct")))


def cohort_value(tx: DataFrame, cal: ChurnCalendar | None = None) -> DataFrame:
    month = F.trunc(F.col("invoice_ts").cast("date"), "month")
    cv = tx.groupBy("customer_id").agg(
        F.min(month).alias("cohort_month"),
        F.sum(line_value()).alias("total_revenue"),
        F.count_distinct("invoice").alias("total_orders"),
        F.count(F.lit(1)).alias("n_lines"),
    ).withColumn("avg_tx", F.col("total_revenue").cast("double") / F.col("n_lines"))
    g = cv.groupBy("cohort_month").agg(
        F.count(F.lit(1)).alias("cohort_size"),
        F.sum("total_revenue").alias("_rev"),
        F.sum("total_orders").alias("_orders"),
        F.avg("avg_tx").alias("_avg_tx"),
    )
    return g.orderBy("cohort_month").select(
        "cohort_month", "cohort_size",
        round_half_up(F.col("_rev").cast("double") / F.col("cohort_size")).alias("avg_customer_revenue"),
        round_half_up(F.col("_rev").cast("double")).alias("total_cohort_revenue"),
        round_half_up(F.col("_orders").cast("double") / F.col("cohort_size")).alias("avg_orders_per_customer"),
        round_half_up("_avg_tx").alias("avg_transaction_value"),
    )
