"""Behavioural patterns: RFM cells, purchase times, baskets, seasonality,
returns, first-order quality and order velocity.

Churn rule here: last purchase on/before the dormant cut-off (obs - 61d);
most analyses look only at lines up to obs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import frac_days, line_value, micros, pct, round_half_up, ts_lit
from attrition.operators.rank import grouped_median, multi_ntile
from attrition.operators.shapes import status_col, until, with_customer
from attrition.session import checkpoint_dir


def _ratio(num: str, den: str):
    return F.col(num).cast("double") / F.col(den)


def rfm_cells(tx: DataFrame, cal: ChurnCalendar, k: int = 5, min_customers: int = 20,
              top_k: int = 20) -> DataFrame:
    """Quintile scores of recency (desc), frequency and monetary value; the
    ``top_k`` cells with at least ``min_customers`` by churn rate.  Ties in
    the quintiles are broken by customer id, ties in the rate by R, F, M."""
    c = until(tx, cal.observation).groupBy("customer_id").agg(
        F.max("invoice_ts").alias("last_ts"), F.min("invoice_ts").alias("first_ts"),
        F.count_distinct("invoice").alias("frequency"), F.sum(line_value()).alias("monetary"))
    c = (c.where(F.col("first_ts") <= ts_lit(cal.dormant_cutoff))
          .select("customer_id", "frequency", "monetary", "last_ts",
                  frac_days(ts_lit(cal.observation), F.col("last_ts")).alias("recency_days")))
    c = c.withColumn("is_churned", F.when(F.col("recency_days") > 60, 1).otherwise(0))
    c = multi_ntile(c, {"R_score": micros("last_ts"), "F_score": F.col("frequency"), "M_score": F.col("monetary")}, k, "customer_id")
    g = (c.groupBy("R_score", "F_score", "M_score")
          .agg(F.count(F.lit(1)).alias("customers"), F.sum("is_churned").cast("bigint").alias("churned"))
          .where(F.col("customers") >= min_customers)
          .withColumn("churn_rate_pct", pct("churned", "customers")))
    return g.orderBy(F.col("churn_rate_pct").desc(), "R_score", "F_score", "M_score").limit(top_k)


def purchase_time_patterns(tx: DataFrame, cal: ChurnCalendar, noon: int = 12) -> DataFrame:
    per = until(tx, cal.observation).groupBy("customer_id").agg(
        F.avg(F.when(F.dayofweek("invoice_ts").isin(1, 7), 1).otherwise(0)).alias("weekend"),
        F.avg(F.hour("invoice_ts")).alias("hour"),
        F.avg(F.when(F.hour("invoice_ts") < noon, 1).otherwise(0)).alias("morning"),
        F.max("invoice_ts").alias("last_ts"))
    g = per.groupBy(status_col("last_ts", cal.dormant_cutoff).alias("status")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("weekend").alias("_w"),
        F.avg("hour").alias("_h"), F.avg("morning").alias("_m"))
    return g.select("status", "customers",
                    round_half_up(F.col("_w") * 100).alias("avg_weekend_pct"),
                    round_half_up("_h").alias("avg_purchase_hour"),
                    round_half_up(F.col("_m") * 100).alias("avg_morning_pct"))


def basket_patterns(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Baskets = (customer, invoice, timestamp); per customer means and the
    sample standard deviation of basket value (NULL for a single basket)."""
    # (basket, product) first, so that the distinct count is a count and the sums need no second copy of the rows
    items = until(tx, cal.observation).groupBy("customer_id", "invoice", "invoice_ts", "stock_code").agg(
        F.sum("quantity").alias("_q"), F.sum(line_value()).alias("_v"))
    b = items.groupBy("customer_id", "invoice", "invoice_ts").agg(
        F.count("stock_code").alias("unique_items"), F.sum("_q").alias("total_items"), F.sum("_v").alias("basket_value"))
    per = b.groupBy("customer_id").agg(
        F.avg("unique_items").alias("u"), F.avg("total_items").alias("t"),
        (F.sum("basket_value").cast("double") / F.count(F.lit(1))).alias("v"),
        F.stddev_samp(F.col("basket_value").cast("double")).alias("s"),
        F.max("invoice_ts").alias("last_ts"))
    g = per.groupBy(status_col("last_ts", cal.dormant_cutoff).alias("status")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("u").alias("_u"), F.avg("t").alias("_t"),
        F.avg("v").alias("_v"), F.avg("s").alias("_s"))
    return g.select("status", "customers",
                    round_half_up("_u").alias("avg_unique_items_per_basket"),
                    round_half_up("_t").alias("avg_total_items_per_basket"),
                    round_half_up("_v").alias("avg_basket_value"),
                    round_half_up("_s").alias("basket_value_consistency"))


def seasonality_q4(tx: DataFrame, cal: ChurnCalendar, months=(10, 11, 12)) -> DataFrame:
    """Share of a customer's monthly orders in Q4 months (calendar month, years merged)."""
    t = until(tx, cal.observation)
    per_month = t.groupBy("customer_id", F.month("invoice_ts").alias("m")).agg(
        F.count_distinct("invoice").alias("monthly_orders"), F.max("invoice_ts").alias("last_ts"))
    per = per_month.groupBy("customer_id").agg(
        (F.sum(F.when(F.col("m").isin(*months), F.col("monthly_orders")).otherwise(0)).cast("double")
         / F.sum("monthly_orders")).alias("q4"),
        F.count(F.lit(1)).alias("active_months"),
        F.max("last_ts").alias("last_ts"))
    g = per.groupBy(status_col("last_ts", cal.dormant_cutoff).alias("status")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("q4").alias("_q"),
        F.sum("active_months").alias("_am"))
    return g.select("status", "customers", round_half_up(F.col("_q") * 100).alias("avg_q4_concentration_pct"),
                    round_half_up(_ratio("_am", "customers")).alias("avg_active_months"))


def return_behavior(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Share of return lines (quantity < 0) per customer, on whatever table is
    passed (the cleaned table has none; the raw one has many)."""
    per = tx.groupBy("customer_id").agg(
        F.count_if(F.col("quantity") < 0).alias("ret"), F.count(F.lit(1)).alias("tot"),
        F.max("invoice_ts").alias("last_ts"))
    per = per.withColumn("rate", F.try_divide(F.col("ret").cast("double"), F.col("tot").cast("double")))
    g = per.groupBy(status_col("last_ts", cal.dormant_cutoff).alias("status")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("rate").alias("_r"),
        F.count_if(F.col("ret") > 0).alias("customers_with_returns"))
    return g.select("status", "customers", round_half_up(F.col("_r") * 100).alias("avg_return_rate_pct"),
                    "customers_with_returns", pct("customers_with_returns", "customers").alias("pct_with_returns"))


def first_order_quality(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """The first invoice is the string-smallest invoice number of the
    customer (not necessarily the earliest); its distinct products and value."""
    # one row per invoice first (hash aggregation): the string minimum needs sort-based aggregation
    invoices = tx.groupBy("customer_id", "invoice").agg(F.min("invoice_ts").alias("i_first"), F.max("invoice_ts").alias("i_last"))
    base = invoices.groupBy("customer_id").agg(
        F.min("i_first").alias("first_ts"), F.min("invoice").alias("invoice"), F.max("i_last").alias("last_ts"))
    base = base.where(F.col("first_ts") <= ts_lit(cal.dormant_cutoff))
    fo = (tx.select("customer_id", "invoice", "stock_code", line_value().alias("lv"))
            .join(base, ["customer_id", "invoice"])
            .groupBy("customer_id", "last_ts")
            .agg(F.count_distinct("stock_code").alias("items"), F.sum("lv").alias("value")))
    checkpoint_dir(tx.sparkSession)
    # one row per customer, read by the median and the sums
    fo = fo.select(status_col("last_ts", cal.dormant_cutoff).alias("status"), "items", "value").checkpoint(eager=True)
    med = grouped_median(fo, ["status"], "value", "_m")
    g = fo.groupBy("status").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("items").alias("_i"), F.sum("value").alias("_v")).join(med, "status")
    return g.select("status", "customers",
                    round_half_up(_ratio("_i", "customers")).alias("avg_first_order_items"),
                    round_half_up(_ratio("_v", "customers")).alias("avg_first_order_value"),
                    round_half_up("_m").alias("median_first_order_value"))


def velocity_change(tx: DataFrame, cal: ChurnCalendar, first_days: int = 90,
                    next_from: int = 91, next_to: int = 180, min_lifetime: int = 180) -> DataFrame:
    """Orders in the first 90 fractional days vs days 91-180 (the gap between
    90 and 91 is kept), for customers with a lifetime of at least 180 days."""
    t = until(tx, cal.observation)
    span = t.groupBy("customer_id").agg(F.min("invoice_ts").alias("first_ts"), F.max("invoice_ts").alias("last_ts"))
    span = span.where(frac_days("last_ts", "first_ts") >= min_lifetime)
    d = frac_days("invoice_ts", "first_ts")
    per_inv = (with_customer(t.select("customer_id", "invoice", "invoice_ts").distinct(), span, "invoice")
                .groupBy("customer_id", "invoice")
                .agg(F.max(F.when(d <= first_days, 1).otherwise(0)).alias("f"),
                     F.max(F.when(d.between(next_from, next_to), 1).otherwise(0)).alias("n"),
                     F.max("last_ts").alias("last_ts")))
    per = (per_inv.groupBy("customer_id")
                  .agg(F.sum("f").alias("o1"), F.sum("n").alias("o2"), F.max("last_ts").alias("last_ts"))
                  .withColumn("chg", F.col("o2") - F.col("o1")))
    g = per.groupBy(status_col("last_ts", cal.dormant_cutoff).alias("status")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("o1").alias("_a"), F.sum("o2").alias("_b"),
        F.sum("chg").alias("_c"), F.count_if(F.col("chg") < 0).alias("declining_velocity_count"))
    return g.select("status", "customers",
                    round_half_up(_ratio("_a", "customers")).alias("avg_orders_first_90d"),
                    round_half_up(_ratio("_b", "customers")).alias("avg_orders_next_90d"),
                    round_half_up(_ratio("_c", "customers")).alias("avg_velocity_change"),
                    "declining_velocity_count",
                    pct("declining_velocity_count", "customers").alias("pct_declining"))
