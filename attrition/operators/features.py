"""Point-in-time customer features (35, in five groups) from lines up to obs.

All groups are aggregations keyed by ``customer_id`` over a few shared
shapes: lines, (customer, invoice, timestamp) baskets, (customer, invoice)
orders, (customer, day) and (customer, product).  Orders, days and home countries come from the baskets.  The
feature matrix stores the shapes that several groups read (``Shapes.stored``)
and joins the groups on the customer key (each side already hash-partitioned by
that key by its own aggregation).  Money is summed exactly as decimals; sample
standard deviations and coefficients of variation are rounded to 1e-6.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import line_value, micros, round_stat, ts_lit, whole_days
from attrition.operators.shapes import day_gaps, purchase_days, until, with_customer
from attrition.sources.io import read_table, scratch_path, write_table

RECENCY = ("recency_days", "tenure_days", "active_period_days", "recency_ratio", "is_recent_30d")
FREQUENCY = ("total_orders", "total_transactions", "active_days", "orders_per_month",
             "avg_days_between_orders", "purchase_interval_std", "is_single_order")
MONETARY = ("total_revenue", "avg_order_value", "max_order_value", "min_order_value", "order_value_std",
            "total_quantity", "avg_items_per_order", "revenue_per_active_day", "order_value_cv")
TREND = ("order_trend", "revenue_trend", "quantity_trend", "is_declining", "orders_last30",
         "revenue_last30", "recent_order_momentum", "recent_revenue_momentum")
ENGAGEMENT = ("unique_products", "unique_descriptions", "total_line_items", "avg_products_per_order",
              "product_concentration", "is_uk")
FEATURE_GROUPS = {"recency": RECENCY, "frequency": FREQUENCY, "monetary": MONETARY,
                  "trend": TREND, "engagement": ENGAGEMENT}
FEATURES = RECENCY + FREQUENCY + MONETARY + TREND + ENGAGEMENT


def history(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Lines visible at the observation date (midnight inclusive)."""
    return until(tx, cal.observation)


@dataclass(frozen=True)
class Shapes:
    """Lines up to the observation and what the groups take from them: baskets, orders, and products over all orders."""

    lines: DataFrame
    baskets: DataFrame
    orders: DataFrame
    items: DataFrame

    @classmethod
    def of(cls, hist: DataFrame) -> Shapes:
        baskets = _baskets(hist)
        return cls(hist, baskets, _orders(baskets), _items(hist))

    @classmethod
    def stored(cls, hist: DataFrame) -> Shapes:
        """The shapes written once below the session's scratch folder and read back by every group."""
        spark = hist.sparkSession
        keep = lambda df, name: read_table(spark, write_table(df, scratch_path(spark, name)))
        baskets = keep(_baskets(hist), "baskets")
        return cls(hist, baskets, keep(_orders(baskets), "orders"), keep(_items(hist), "items"))


def _baskets(hist: DataFrame) -> DataFrame:
    """(customer, invoice, timestamp, country) baskets: exact value, quantity and non-null lines."""
    return hist.groupBy("customer_id", "invoice", "invoice_ts", "country").agg(
        F.sum(line_value()).alias("v"), F.sum("quantity").alias("q"), F.count("invoice").alias("lines"))


def _orders(baskets: DataFrame) -> DataFrame:
    """(customer, invoice) orders: exact value, quantity, non-null lines and first/last timestamp."""
    return baskets.groupBy("customer_id", "invoice").agg(
        F.sum("v").alias("order_value"), F.sum("q").alias("order_qty"), F.sum("lines").alias("order_lines"),
        F.min("invoice_ts").alias("o_first"), F.max("invoice_ts").alias("o_last"))


def _items(hist: DataFrame) -> DataFrame:
    """Distinct products of each order, summed over a customer's orders."""
    return hist.select("customer_id", "invoice", "stock_code").distinct().groupBy("customer_id").agg(F.count("stock_code").alias("items"))


def _span(baskets: DataFrame) -> DataFrame:
    """First/last purchase per customer, from the basket shape."""
    return baskets.groupBy("customer_id").agg(F.min("invoice_ts").alias("first_ts"), F.max("invoice_ts").alias("last_ts"))


def _days(baskets: DataFrame) -> DataFrame:
    """Active days and the sample std of whole-day gaps between them, from
    each customer's distinct purchase days (bounded by the calendar).  The gaps' statistics are aggregated on the
    same customer partitioning, so no further shuffle happens."""
    per = purchase_days(baskets).groupBy("customer_id").agg(F.array_sort(F.collect_list("order_date")).alias("days"))
    gaps = per.select("customer_id", F.size("days").alias("active_days"),
                      F.explode_outer(day_gaps("days")).alias("gap"))
    return gaps.groupBy("customer_id").agg(F.max("active_days").cast("bigint").alias("active_days"),
                                           F.stddev_samp(F.col("gap").cast("double")).alias("interval_std"))


def features_recency(tx: DataFrame, cal: ChurnCalendar, shapes: Shapes | None = None) -> DataFrame:
    obs = ts_lit(cal.observation)
    s = _span((shapes or Shapes.of(history(tx, cal))).baskets)
    rec = whole_days(obs, F.col("last_ts"))
    ten = whole_days(obs, F.col("first_ts"))
    return s.select("customer_id", rec.alias("recency_days"), ten.alias("tenure_days"),
                    whole_days("last_ts", "first_ts").alias("active_period_days"),
                    (rec / F.greatest(ten, F.lit(1))).alias("recency_ratio"),
                    (rec <= 30).cast("int").alias("is_recent_30d"))


def features_frequency(tx: DataFrame, cal: ChurnCalendar, shapes: Shapes | None = None) -> DataFrame:
    shapes = shapes or Shapes.of(history(tx, cal))
    obs = ts_lit(cal.observation)
    c = shapes.orders.groupBy("customer_id").agg(
        F.count("invoice").alias("total_orders"), F.sum("order_lines").alias("total_transactions"),
        F.min("o_first").alias("first_ts"), F.max("o_last").alias("last_ts"))
    c = c.join(_days(shapes.baskets), "customer_id")
    tenure_months = F.greatest(whole_days(obs, F.col("first_ts")) / F.lit(30.0), F.lit(0.5))
    return c.select(
        "customer_id", "total_orders", "total_transactions", "active_days",
        (F.col("total_orders") / tenure_months).alias("orders_per_month"),
        (whole_days("last_ts", "first_ts") / F.greatest(F.col("total_orders") - 1, F.lit(1))).alias("avg_days_between_orders"),
        F.coalesce(round_stat("interval_std"), F.lit(0.0)).alias("purchase_interval_std"),
        (F.col("total_orders") == 1).cast("int").alias("is_single_order"))


def features_monetary(tx: DataFrame, cal: ChurnCalendar, shapes: Shapes | None = None) -> DataFrame:
    shapes = shapes or Shapes.of(history(tx, cal))
    o = shapes.orders.groupBy("customer_id").agg(
        F.sum("order_value").alias("_rev"), F.count(F.lit(1)).alias("_n"),
        F.max("order_value").alias("_max"), F.min("order_value").alias("_min"),
        F.stddev_samp(F.col("order_value").cast("double")).alias("_std"),
        F.sum("order_qty").alias("total_quantity"))
    avg = F.col("_rev").cast("double") / F.col("_n")
    return o.join(shapes.items, "customer_id").join(_days(shapes.baskets), "customer_id").select(
        "customer_id", F.col("_rev").cast("double").alias("total_revenue"), avg.alias("avg_order_value"),
        F.col("_max").cast("double").alias("max_order_value"), F.col("_min").cast("double").alias("min_order_value"),
        F.coalesce(round_stat("_std"), F.lit(0.0)).alias("order_value_std"), "total_quantity",
        (F.col("items") / F.col("_n")).alias("avg_items_per_order"),
        (F.col("_rev").cast("double") / F.col("active_days")).alias("revenue_per_active_day"),
        F.coalesce(round_stat(F.col("_std") / F.greatest(avg, F.lit(0.01))), F.lit(0.0)).alias("order_value_cv"))


def features_trend(tx: DataFrame, cal: ChurnCalendar, shapes: Shapes | None = None) -> DataFrame:
    """Early vs recent half of each customer's active period (early: at or
    before the midpoint of first and last purchase), and the last 30 days vs
    the 30 days before.  Baskets are pre-aggregated per (customer, invoice,
    timestamp) before meeting the per-customer span."""
    shapes = shapes or Shapes.of(history(tx, cal))
    b = with_customer(shapes.baskets, _span(shapes.baskets), "invoice")
    # 2 (ts - first) <= last - first  <=>  ts <= midpoint, in exact microseconds
    early = (F.lit(2) * (micros("invoice_ts") - micros("first_ts"))) <= (micros("last_ts") - micros("first_ts"))
    last30 = F.col("invoice_ts") > ts_lit(cal.recent_cutoff)
    prev30 = (F.col("invoice_ts") > ts_lit(cal.eligibility_cutoff)) & ~last30
    zero = F.lit(0).cast("decimal(18,2)")
    inv = b.groupBy("customer_id", "invoice").agg(
        F.max(early.cast("int")).alias("in_early"), F.max((~early).cast("int")).alias("in_recent"),
        F.sum(F.when(early, F.col("v")).otherwise(zero)).alias("rev_early"),
        F.sum(F.when(~early, F.col("v")).otherwise(zero)).alias("rev_recent"),
        F.sum(F.when(early, F.col("q")).otherwise(0.0)).alias("qty_early"),
        F.sum(F.when(~early, F.col("q")).otherwise(0.0)).alias("qty_recent"),
        F.max(last30.cast("int")).alias("in_last30"), F.max(prev30.cast("int")).alias("in_prev30"),
        F.sum(F.when(last30, F.col("v")).otherwise(zero)).alias("rev_last30"),
        F.sum(F.when(prev30, F.col("v")).otherwise(zero)).alias("rev_prev30"))
    c = inv.groupBy("customer_id").agg(*[F.sum(x).alias(x) for x in (
        "in_early", "in_recent", "rev_early", "rev_recent", "qty_early", "qty_recent",
        "in_last30", "in_prev30", "rev_last30", "rev_prev30")])
    d = F.col
    order_trend = (d("in_recent") - d("in_early")) / F.greatest(d("in_early"), F.lit(1))
    revenue_trend = ((d("rev_recent") - d("rev_early")).cast("double")
                     / F.greatest(d("rev_early").cast("double"), F.lit(1.0)))
    quantity_trend = (d("qty_recent") - d("qty_early")) / F.greatest(d("qty_early"), F.lit(1.0))
    return c.select(
        "customer_id", order_trend.alias("order_trend"), revenue_trend.alias("revenue_trend"),
        quantity_trend.alias("quantity_trend"), ((order_trend < 0) | (revenue_trend < 0)).cast("int").alias("is_declining"),
        d("in_last30").alias("orders_last30"), d("rev_last30").cast("double").alias("revenue_last30"),
        (d("in_last30") - d("in_prev30")).alias("recent_order_momentum"),
        (d("rev_last30") - d("rev_prev30")).cast("double").alias("recent_revenue_momentum"))


def features_engagement(tx: DataFrame, cal: ChurnCalendar, shapes: Shapes | None = None) -> DataFrame:
    shapes = shapes or Shapes.of(history(tx, cal))
    hist = shapes.lines
    # the string minimum is taken over distinct (country, order) rows: it needs sort-based aggregation
    home = shapes.baskets.where(F.col("country").isNotNull()).select("customer_id", "country", "invoice_ts", "invoice")
    home = home.groupBy("customer_id").agg(F.min_by("country", F.struct("invoice_ts", "invoice")).alias("_country"))
    c = hist.groupBy("customer_id").agg(F.count_distinct("description").alias("unique_descriptions")).join(home, "customer_id", "left")
    p = (hist.groupBy("customer_id", "stock_code").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("customer_id").agg(F.count(F.lit(1)).alias("unique_products"),
                                         F.max("n").alias("_max"), F.sum("n").alias("_sum")))
    o = shapes.orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("order_lines").alias("total_line_items"))
    o = o.join(shapes.items, "customer_id").withColumn("avg_products_per_order", F.col("items") / F.col("_n"))
    return (c.join(p, "customer_id").join(o, "customer_id")
             .select("customer_id", "unique_products", "unique_descriptions", "total_line_items",
                     "avg_products_per_order", (F.col("_max") / F.col("_sum")).alias("product_concentration"),
                     F.coalesce((F.col("_country") == cal.home_country).cast("int"), F.lit(0)).alias("is_uk")))


GROUP_FUNCS = {"recency": features_recency, "frequency": features_frequency, "monetary": features_monetary,
               "trend": features_trend, "engagement": features_engagement}


def feature_matrix(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """All 35 features: customers with history at obs, other groups left-joined,
    missing numbers filled with 0."""
    shapes = Shapes.stored(history(tx, cal))
    m = features_recency(tx, cal, shapes)
    for name in ("frequency", "monetary", "trend", "engagement"):
        m = m.join(GROUP_FUNCS[name](tx, cal, shapes), "customer_id", "left")
    return m.na.fill(0).select("customer_id", *FEATURES)


def feature_catalog(spark) -> DataFrame:
    """Category -> feature list (static description of the matrix)."""
    rows = [(g, f, i + 1) for g, fs in FEATURE_GROUPS.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "category string, feature string, position int")


def feature_summary(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """describe() of the feature matrix: count, mean, std, min, quartiles, max per feature."""
    from attrition.operators.quality import numeric_describe
    spark = tx.sparkSession
    # the statistics and the percentiles each go through the matrix
    matrix = read_table(spark, write_table(feature_matrix(tx, cal), scratch_path(spark, "feature-matrix")))
    return numeric_describe(matrix, FEATURES)
