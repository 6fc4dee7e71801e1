"""Churn-rate analyses (rate overall, by tenure, frequency, monetary quintile,
country, customer type, acquisition season, time to second purchase,
lifetime distribution of churned customers).

Each function takes the cleaned transactions and a ``ChurnCalendar``.  The
churn rule differs between analyses on purpose; each one states its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import frac_days, pct, round_half_up, ts_lit, upper_bucket
from attrition.operators.rank import global_ntile
from attrition.operators.shapes import churn_flag, customer_base, with_customer


def _rate_aggs():
    return [F.count(F.lit(1)).alias("customers"),
            F.sum("is_churned").cast("bigint").alias("churned")]


def _avg(c: str):
    """Average as sum/count in double (order-independent for exact sums)."""
    return F.sum(c).cast("double") / F.count(c)


def churn_rate_overall(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Customers whose first purchase is on/before obs; churned = last purchase on/before obs."""
    b = (customer_base(tx).where(F.col("first_ts") <= ts_lit(cal.observation))
         .withColumn("is_churned", churn_flag("last_ts", cal.observation)))
    return b.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("is_churned").cast("bigint").alias("churned_customers"),
        _avg("n_orders").alias("avg_orders_per_customer"),
    ).select("total_customers", "churned_customers",
             pct("churned_customers", "total_customers").alias("churn_rate_pct"),
             "avg_orders_per_customer")


# Borders and labels of the reported groups.
TENURE_BOUNDS = (30, 90, 180, 365)
TENURE_LABELS = ("0-30 days", "31-90 days", "91-180 days", "181-365 days", "365+ days")


def churn_by_tenure(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    b = customer_base(tx).where(F.col("first_ts") <= ts_lit(cal.observation))
    label, order = upper_bucket(frac_days("last_ts", "first_ts"), TENURE_BOUNDS, TENURE_LABELS)
    b = b.select(label.alias("tenure_bucket"), order.alias("_o"),
                 churn_flag("last_ts", cal.observation).alias("is_churned"))
    return (b.groupBy("tenure_bucket", "_o").agg(*_rate_aggs())
             .orderBy("_o")
             .select("tenure_bucket", "customers", "churned",
                     pct("churned", "customers").alias("churn_rate_pct")))


# Borders and labels of the reported groups.
FREQ_BOUNDS = (1, 3, 5, 10)
FREQ_LABELS = ("1 order", "2-3 orders", "4-5 orders", "6-10 orders", "10+ orders")


def churn_by_frequency(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    b = customer_base(tx).where(F.col("first_ts") <= ts_lit(cal.observation))
    label, order = upper_bucket(F.col("n_orders"), FREQ_BOUNDS, FREQ_LABELS)
    b = b.select(label.alias("frequency_bucket"), order.alias("_o"), "n_orders",
                 churn_flag("last_ts", cal.observation).alias("is_churned"))
    return (b.groupBy("frequency_bucket", "_o")
             .agg(*_rate_aggs(), _avg("n_orders").alias("_avg"))
             .orderBy("_o")
             .select("frequency_bucket", "customers", "churned",
                     pct("churned", "customers").alias("churn_rate_pct"),
                     round_half_up("_avg").alias("avg_orders")))


def churn_by_monetary_quintile(tx: DataFrame, cal: ChurnCalendar, k: int = 5) -> DataFrame:
    """NTILE(k) of total revenue among eligible customers (ties: customer id)."""
    b = (customer_base(tx).where(F.col("first_ts") <= ts_lit(cal.observation))
         .select("customer_id", "revenue", churn_flag("last_ts", cal.observation).alias("is_churned")))
    q = global_ntile(b, [F.col("revenue").asc(), F.col("customer_id").asc()], k, "monetary_quintile")
    return (q.groupBy("monetary_quintile")
             .agg(*_rate_aggs(), F.sum("revenue").alias("_rev"))
             .orderBy("monetary_quintile")
             .select(F.concat(F.lit("Q"), F.col("monetary_quintile").cast("string")).alias("monetary_segment"),
                     "customers", "churned",
                     pct("churned", "customers").alias("churn_rate_pct"),
                     round_half_up(F.col("_rev").cast("double") / F.col("customers")).alias("avg_revenue")))


def churn_by_country(tx: DataFrame, cal: ChurnCalendar, min_customers: int = 50) -> DataFrame:
    """Grain (customer, country); countries with at least ``min_customers``."""
    cc = (tx.groupBy("customer_id", "country")
            .agg(F.min("invoice_ts").alias("first_ts"), F.max("invoice_ts").alias("last_ts"))
            .where(F.col("first_ts") <= ts_lit(cal.observation))
            .withColumn("is_churned", churn_flag("last_ts", cal.observation)))
    return (cc.groupBy(F.col("country").alias("Country")).agg(*_rate_aggs())
              .where(F.col("customers") >= min_customers)
              .withColumn("churn_rate_pct", pct("churned", "customers"))
              .orderBy(F.col("churn_rate_pct").desc(), F.col("Country"))
              .select("Country", "customers", "churned", "churn_rate_pct"))


# Borders and labels of the reported groups.
LIFETIME_BOUNDS = (7, 30, 60, 90, 180, 365)
LIFETIME_LABELS = ("0-7 days", "8-30 days", "31-60 days", "61-90 days", "91-180 days",
                   "181-365 days", "365+ days")


def lifetime_distribution(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Lifetime (last - first, fractional days) of customers whose last purchase
    is on/before obs; share of all of them."""
    b = customer_base(tx).where(F.col("last_ts") <= ts_lit(cal.observation))
    label, order = upper_bucket(frac_days("last_ts", "first_ts"), LIFETIME_BOUNDS, LIFETIME_LABELS)
    g = b.groupBy(label.alias("lifetime_bucket"), order.alias("_o")).agg(
        F.count(F.lit(1)).alias("total_customers"))
    # the total is taken over at most 7 aggregated rows
    total = F.sum("total_customers").over(Window.partitionBy())
    return (g.withColumn("pct_of_churned", pct(F.col("total_customers"), total))
             .orderBy("_o").select("lifetime_bucket", "total_customers", "pct_of_churned"))


# Borders and labels of the reported groups.
TYPE_BOUNDS = (1, 3, 5)
TYPE_LABELS = ("One-time", "Low-repeat (2-3)", "Medium-repeat (4-5)", "High-repeat (6+)")


def churn_by_customer_type(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """All customers by order count; churned = last purchase on/before obs - 61d."""
    b = customer_base(tx)
    label, order = upper_bucket(F.col("n_orders"), TYPE_BOUNDS, TYPE_LABELS)
    g = (b.select(label.alias("customer_type"), order.alias("_o"),
                  churn_flag("last_ts", cal.dormant_cutoff).alias("is_churned"))
          .groupBy("customer_type", "_o").agg(*_rate_aggs()))
    return (g.orderBy("_o").select("customer_type", "customers", "churned",
                                   (F.col("customers") - F.col("churned")).alias("active"),
                                   pct("churned", "customers").alias("churn_rate_pct")))


def churn_by_acquisition_season(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Season of the first purchase month; first purchase on/before obs - 122d."""
    b = customer_base(tx).where(F.col("first_ts") <= ts_lit(cal.acquisition_cutoff))
    m = F.month("first_ts")
    season = (F.when(m.isin(12, 1, 2), F.lit("Winter")).when(m.isin(3, 4, 5), F.lit("Spring"))
               .when(m.isin(6, 7, 8), F.lit("Summer")).otherwise(F.lit("Fall")))
    order = (F.when(m.isin(12, 1, 2), F.lit(1)).when(m.isin(3, 4, 5), F.lit(2))
              .when(m.isin(6, 7, 8), F.lit(3)).otherwise(F.lit(4)))
    g = (b.select(season.alias("acquisition_season"), order.alias("_o"), "n_orders",
                  churn_flag("last_ts", cal.dormant_cutoff).alias("is_churned"))
          .groupBy("acquisition_season", "_o")
          .agg(*_rate_aggs(), _avg("n_orders").alias("_avg")))
    return g.orderBy("_o").select("acquisition_season", "customers",
                                  round_half_up("_avg").alias("avg_orders"), "churned",
                                  pct("churned", "customers").alias("churn_rate_pct"))


# Borders and labels of the reported groups.
SECOND_BOUNDS = (7, 14, 30, 60)
SECOND_LABELS = ("0-7 days", "8-14 days", "15-30 days", "31-60 days", "60+ days")


def time_to_second_purchase(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Gap between the first and second (timestamp, invoice) purchase.

    Computed with two grouped minima instead of a per-customer window, so a
    customer with a very large share of the orders is still aggregated
    map-side.  The lines are reduced to distinct orders by hash aggregation
    before the minima of structs, which only sort-based aggregation supports.
    """
    key = F.struct(F.col("invoice_ts").alias("ts"), F.col("invoice").alias("inv"))
    orders = tx.select("customer_id", "invoice", "invoice_ts").distinct()
    first = orders.groupBy("customer_id").agg(F.min(key).alias("_first"), F.max("invoice_ts").alias("last_ts"))
    second = (with_customer(orders.select("customer_id", key.alias("_k")), first.select("customer_id", "_first"), "_k")
                .where(F.col("_k") > F.col("_first"))
                .groupBy("customer_id").agg(F.min("_k").alias("_second")))
    t = (first.join(second, "customer_id", "left")
              .where(F.col("_first.ts") <= ts_lit(cal.acquisition_cutoff)))
    gap = frac_days(F.col("_second.ts"), F.col("_first.ts"))
    label, order = upper_bucket(gap, SECOND_BOUNDS, SECOND_LABELS)
    label = F.when(F.col("_second").isNull(), F.lit("No second purchase")).otherwise(label)
    order = F.when(F.col("_second").isNull(), F.lit(6)).otherwise(order)
    g = (t.select(label.alias("time_to_second_bucket"), order.alias("_o"),
                  churn_flag("last_ts", cal.dormant_cutoff).alias("is_churned"))
          .groupBy("time_to_second_bucket", "_o").agg(*_rate_aggs()))
    return g.orderBy("_o").select("time_to_second_bucket", "customers", "churned",
                                  pct("churned", "customers").alias("churn_rate_pct"))
