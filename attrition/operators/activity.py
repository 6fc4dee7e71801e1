"""Activity decline before churn: activity and revenue windows before the last
purchase, gaps between purchase days, recent vs historical order value,
product diversity shift.  Churn rule here: last purchase on/before obs
(all data), status 'Churned' / 'Active'."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import frac_days, line_value, round_half_up, ts_lit, upper_bucket
from attrition.operators.rank import grouped_median
from attrition.operators.shapes import day_gaps, orders_ts, status_col, with_customer
from attrition.session import checkpoint_dir


def _last_purchase(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id").agg(F.max("invoice_ts").alias("last_ts"))


def _churned_last(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    return _last_purchase(tx).where(F.col("last_ts") <= ts_lit(cal.observation))


# Borders and labels of the reported groups.
ACTIVITY_BOUNDS = (30, 60, 90, 120)
ACTIVITY_LABELS = ("Last 30 days", "31-60 days before", "61-90 days before",
                   "91-120 days before", "120+ days before")


def activity_windows_churned(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Churned customers' orders by time before their last purchase."""
    # baskets, not lines, meet the per-customer table: the join shuffle carries far fewer rows
    baskets = tx.select("customer_id", "invoice", "invoice_ts").distinct()
    lines = with_customer(baskets, _churned_last(tx, cal), "invoice")
    label, order = upper_bucket(frac_days("last_ts", "invoice_ts"), ACTIVITY_BOUNDS, ACTIVITY_LABELS)
    g = (lines.select(label.alias("time_window"), (-order).alias("_o"), "customer_id", "invoice")
              .groupBy("time_window", "_o")
              .agg(F.count_distinct("customer_id").alias("unique_customers"),
                   F.count_distinct("invoice").alias("total_orders")))
    return g.orderBy("_o").select(
        "time_window", "unique_customers", "total_orders",
        round_half_up(F.col("total_orders").cast("double") / F.col("unique_customers")).alias("orders_per_customer"))


# Borders and labels of the reported groups.
REVENUE_BOUNDS = (30, 60, 90)
REVENUE_LABELS = ("Last 30 days", "31-60 days before", "61-90 days before", "90+ days before")


def revenue_windows_churned(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Revenue per (customer, timestamp) of churned customers by window."""
    per_ts = tx.groupBy("customer_id", "invoice_ts").agg(F.sum(line_value()).alias("daily_revenue"))
    rw = with_customer(per_ts, _churned_last(tx, cal), "invoice_ts")
    label, order = upper_bucket(frac_days("last_ts", "invoice_ts"), REVENUE_BOUNDS, REVENUE_LABELS)
    checkpoint_dir(tx.sparkSession)
    w = rw.select(label.alias("time_window"), (-order).alias("_o"), "daily_revenue").checkpoint(eager=True)  # read by the median and the sums
    # money values have an unbounded domain: exact median without gathering a window's values in one task
    med = grouped_median(w, ["time_window", "_o"], "daily_revenue", "_med")
    g = (w.groupBy("time_window", "_o")
          .agg(F.count(F.lit(1)).alias("purchase_days"), F.sum("daily_revenue").alias("_sum"))
          .join(med, ["time_window", "_o"]))
    return g.orderBy("_o").select(
        "time_window", "purchase_days",
        round_half_up(F.col("_sum").cast("double")).alias("total_revenue"),
        round_half_up(F.col("_sum").cast("double") / F.col("purchase_days")).alias("avg_daily_revenue"),
        round_half_up("_med").alias("median_daily_revenue"))


def purchase_gaps(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Days between consecutive purchase days, by status.

    The lines are first reduced to one row per customer and day by hash
    aggregation; the days (bounded by the calendar) are collected from those.
    The gaps come from array functions on the sorted days, so there is no
    window and no join.
    """
    days = tx.groupBy("customer_id", F.to_date("invoice_ts").alias("day")).agg(F.max("invoice_ts").alias("day_last"))
    per = days.groupBy("customer_id").agg(F.array_sort(F.collect_list("day")).alias("days"), F.max("day_last").alias("last_ts"))
    gaps = per.select(status_col("last_ts", cal.observation).alias("status"),
                      F.explode(day_gaps("days")).alias("g")).select("status", F.col("g").cast("double").alias("gap"))
    g = gaps.groupBy("status").agg(
        F.sum("gap").alias("_sum"), F.count(F.lit(1)).alias("total_gaps"),
        F.median("gap").alias("_med"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))
    return g.select("status",
                    round_half_up(F.col("_sum") / F.col("total_gaps")).alias("avg_days_between_orders"),
                    round_half_up("_med").alias("median_days_between_orders"),
                    "min_gap", "max_gap", "total_gaps")


def recent_vs_historical_order_value(tx: DataFrame, cal: ChurnCalendar,
                                     last_n: int = 3, min_orders: int = 6) -> DataFrame:
    """Average value of the last ``last_n`` (invoice, timestamp) orders vs the
    rest, for customers with at least ``min_orders`` of them.

    Totals per customer come from a grouped aggregate and the last orders from
    a ranked top-n (planned as a partial WindowGroupLimit before the shuffle),
    so no task holds all orders of a large customer.
    """
    o = orders_ts(tx).select("customer_id", "invoice", "invoice_ts", "order_value")
    totals = o.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("order_value").alias("total"))
    w = Window.partitionBy("customer_id").orderBy(F.col("invoice_ts").desc(), F.col("invoice").desc())
    recent = (o.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last_n)
               .groupBy("customer_id").agg(F.sum("order_value").alias("recent_total"),
                                           F.count(F.lit(1)).alias("recent_n")))
    per = (totals.where(F.col("n") >= min_orders).join(recent, "customer_id")
                 .select("customer_id",
                         (F.col("recent_total").cast("double") / F.col("recent_n")).alias("a_last"),
                         ((F.col("total") - F.col("recent_total")).cast("double")
                          / (F.col("n") - F.col("recent_n"))).alias("a_hist")))
    status = _last_purchase(tx).select("customer_id", status_col("last_ts", cal.observation).alias("status"))
    g = per.join(status, "customer_id").groupBy("status").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("a_last").alias("_l"), F.avg("a_hist").alias("_h"))
    return g.select("status", "customers",
                    round_half_up("_l").alias("avg_last_3_orders"),
                    round_half_up("_h").alias("avg_historical_orders"),
                    round_half_up(F.try_divide(F.lit(100.0) * (F.col("_l") - F.col("_h")), F.col("_h")))
                    .alias("pct_change"))


def product_diversity_shift(tx: DataFrame, cal: ChurnCalendar, recent_days: int = 60) -> DataFrame:
    """Distinct products in the last ``recent_days`` before the last purchase
    vs before that, for churned customers.

    A product counts in the recent period when its latest purchase is within
    the window and in the historical period when its earliest is before it, so
    only the (customer, product) first/last purchase meets the per-customer
    table instead of every line.
    """
    prod = tx.groupBy("customer_id", "stock_code").agg(F.min("invoice_ts").alias("p_first"),
                                                       F.max("invoice_ts").alias("p_last"))
    j = with_customer(prod, _churned_last(tx, cal), "stock_code")
    per = j.groupBy("customer_id").agg(
        F.count_if(frac_days("last_ts", "p_last") <= recent_days).alias("recent"),
        F.count_if(frac_days("last_ts", "p_first") > recent_days).alias("historical"))
    arr = F.array(F.struct(F.lit("Last 60 days").alias("period"), F.col("recent").alias("unique_products")),
                  F.struct(F.lit("Historical").alias("period"), F.col("historical").alias("unique_products")))
    per = per.select(F.inline(arr)).where(F.col("unique_products") > 0)
    g = per.groupBy("period").agg(F.count(F.lit(1)).alias("customers"),
                                  F.sum("unique_products").alias("_s"),
                                  F.median(F.col("unique_products").cast("double")).alias("_m"))
    return g.select("period", "customers",
                    round_half_up(F.col("_s").cast("double") / F.col("customers")).alias("avg_unique_products"),
                    round_half_up("_m").alias("median_unique_products"))
