"""Exploratory analyses of churned vs active customers.

Churn rule here (unless stated): customers whose first purchase is on/before
``obs - 60d`` (the churn cut-off); churned = last purchase on/before it.
Day counts are whole (floored) days.  Percentages are rounded half-up on the
decimal value (the original rounded half-even).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import (line_value, pct, round_half_up, round_stat, ts_lit, two_sided_p,
                                          upper_bucket, whole_days)
from attrition.operators.rank import prefix_sum
from attrition.operators.shapes import with_customer


def customer_summary(tx: DataFrame, cal: ChurnCalendar | None = None) -> DataFrame:
    """First/last purchase, orders, revenue, items and whole-day tenure (last - first)."""
    return tx.groupBy("customer_id").agg(
        F.min("invoice_ts").alias("first_purchase"), F.max("invoice_ts").alias("last_purchase"),
        F.count_distinct("invoice").alias("total_orders"),
        F.sum(line_value()).cast("double").alias("total_revenue"),
        F.sum("quantity").alias("total_items"),
    ).withColumn("tenure_days", whole_days("last_purchase", "first_purchase"))


def eligible_summary(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    cut = ts_lit(cal.eligibility_cutoff)
    s = customer_summary(tx).where(F.col("first_purchase") <= cut)
    s = s.withColumn("is_churned", F.when(F.col("last_purchase") <= cut, 1).otherwise(0))
    return s.withColumn("status", F.when(F.col("is_churned") == 1, "Churned").otherwise("Active"))


def churn_flag_last_purchase(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    s = eligible_summary(tx, cal)
    r = s.agg(F.count(F.lit(1)).alias("total_customers"), F.sum("is_churned").cast("bigint").alias("churned_customers"))
    return r.select("total_customers", "churned_customers",
                    (F.col("total_customers") - F.col("churned_customers")).alias("active_customers"),
                    pct("churned_customers", "total_customers").alias("churn_rate_pct"))


# Borders and labels of the reported groups.
ORDER_BUCKET_BOUNDS = (1, 3, 5, 10)
ORDER_BUCKET_LABELS = ("1 order", "2-3 orders", "4-5 orders", "6-10 orders", "10+ orders")


def _bucket_table(spark, labels: Sequence[str], name: str) -> DataFrame:
    return spark.createDataFrame([(lab, i + 1) for i, lab in enumerate(labels)], f"{name} string, _o int")


def churn_by_order_bucket(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Right-closed order-count buckets; every bucket is reported, empty ones with 0."""
    s = eligible_summary(tx, cal)
    label, _ = upper_bucket(F.col("total_orders"), ORDER_BUCKET_BOUNDS, ORDER_BUCKET_LABELS)
    g = s.groupBy(label.alias("order_bucket")).agg(F.count(F.lit(1)).alias("customers"),
                                                   F.sum("is_churned").alias("churned"))
    dim = _bucket_table(tx.sparkSession, ORDER_BUCKET_LABELS, "order_bucket")
    return (F.broadcast(dim).join(g, "order_bucket", "left").orderBy("_o")
              .select("order_bucket", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
                      F.coalesce("churned", F.lit(0)).cast("bigint").alias("churned"),
                      pct("churned", "customers").alias("churn_rate_pct")))


# Borders and labels of the reported groups.
WINDOW_BOUNDS = (30, 60, 90)
WINDOW_LABELS = ("Last 30 days", "31-60 days before", "61-90 days before", "90+ days before")


def activity_windows(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Orders and revenue by whole days before each customer's last purchase,
    for churned and active customers in one pass."""
    s = eligible_summary(tx, cal).select("customer_id", "last_purchase", F.col("status").alias("customer_type"))
    # baskets (not lines) meet the per-customer table
    baskets = tx.groupBy("customer_id", "invoice", "invoice_ts").agg(F.sum(line_value()).alias("lv"))
    lines = with_customer(baskets, s, "invoice")
    label, order = upper_bucket(whole_days("last_purchase", "invoice_ts"), WINDOW_BOUNDS, WINDOW_LABELS)
    g = (lines.groupBy("customer_type", label.alias("time_window"), (-order).alias("_o"))
              .agg(F.count_distinct("customer_id").alias("unique_customers"),
                   F.count_distinct("invoice").alias("total_orders"), F.sum("lv").alias("_rev")))
    return (g.orderBy("customer_type", "_o")
             .select("customer_type", "time_window", "unique_customers", "total_orders",
                     round_half_up(F.col("_rev").cast("double")).alias("total_revenue"),
                     round_half_up(F.col("total_orders").cast("double") / F.col("unique_customers")).alias("orders_per_customer"),
                     round_half_up(F.col("_rev").cast("double") / F.col("unique_customers")).alias("revenue_per_customer")))


def _analysis(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    s = eligible_summary(tx, cal)
    return (s.withColumn("avg_order_value", F.col("total_revenue") / F.col("total_orders"))
             .withColumn("orders_per_month",
                         F.col("total_orders") / (F.greatest(F.col("tenure_days"), F.lit(1)) / F.lit(30.0))))


def status_comparison(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    a = _analysis(tx, cal)
    g = a.groupBy("status").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("total_orders").alias("_o"),
        F.median(F.col("total_orders").cast("double")).alias("_mo"), F.sum("total_revenue").alias("_r"),
        F.avg("avg_order_value").alias("_aov"), F.sum("tenure_days").alias("_t"),
        F.avg("orders_per_month").alias("_opm"))
    n = F.col("customers")
    return g.select("status", "customers",
                    round_half_up(F.col("_o").cast("double") / n).alias("avg_orders"),
                    round_half_up("_mo").alias("median_orders"),
                    round_half_up(F.col("_r") / n).alias("avg_revenue"),
                    round_half_up("_aov").alias("avg_order_value"),
                    round_half_up(F.col("_t").cast("double") / n).alias("avg_tenure_days"),
                    round_half_up("_opm").alias("avg_orders_per_month"))


def clipped_histogram(df: DataFrame, value_col: str, bins: int, group_col: str | None = None,
                      upper: float | None = None) -> DataFrame:
    """Density histogram per group over the group's own [min, max] range
    (last bin right-closed), values clipped at ``upper``.  Empty bins are
    reported with count 0.  Groups are few (statuses/segments), so the
    per-group edges are a small table."""
    x = F.col(value_col).cast("double")
    if upper is not None:
        x = F.least(x, F.lit(float(upper)))
    g = F.col(group_col) if group_col else F.lit("all")
    v = df.select(g.alias("group"), x.alias("x")).where(F.col("x").isNotNull())
    stats = v.groupBy("group").agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("n"))

    def lo_hi(mn, mx):
        return (F.when(mn == mx, mn - 0.5).otherwise(mn).alias("lo"),
                F.when(mn == mx, mx + 0.5).otherwise(mx).alias("hi"))

    if group_col:
        edges = stats.select("group", "n", *lo_hi(F.col("mn"), F.col("mx")))
        # one row per group (statuses, segments): bounded broadcast
        placed = v.join(F.broadcast(edges.select("group", "lo", "hi")), "group")
    else:
        # one group: its edges are scalars, so nothing is joined on a constant key
        mn, mx = stats.select("mn").scalar(), stats.select("mx").scalar()
        edges = stats.select("group", "n", *lo_hi(mn, mx))
        placed = v.select("group", "x", *lo_hi(mn, mx))
    norm = F.lit(float(bins)) / (F.col("hi") - F.col("lo"))
    idx = F.least(F.floor((F.col("x") - F.col("lo")) * norm).cast("int"), F.lit(bins - 1))
    counts = placed.groupBy("group", idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = edges.select("group", "lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    join_keys = ["group", "bin"] if group_col else ["bin"]
    counts = counts if group_col else counts.drop("group")
    return (grid.join(counts, join_keys, "left")
                .select("group", "bin",
                        round_stat(F.col("lo") + F.col("bin") * w).alias("bin_start"),
                        round_stat(F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"),
                        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                        round_stat(F.coalesce("count", F.lit(0)) / (F.col("n") * w)).alias("density"))
                .orderBy("group", "bin"))


# (key suffix, metric, upper clip, bins) of the status histograms
STATUS_HISTOGRAMS = (("orders", "total_orders", 20, 20), ("revenue", "total_revenue", 2000, 30),
                     ("order_value", "avg_order_value", 500, 30), ("tenure", "tenure_days", None, 30))


def status_histogram(tx: DataFrame, cal: ChurnCalendar, metric: str, upper, bins: int) -> DataFrame:
    return clipped_histogram(_analysis(tx, cal), metric, bins, "status", upper)


def churned_lifetime_histogram(tx: DataFrame, cal: ChurnCalendar, bins: int = 50) -> DataFrame:
    return clipped_histogram(_analysis(tx, cal).where(F.col("is_churned") == 1), "tenure_days", bins)


MW_METRICS = ("total_orders", "total_revenue", "avg_order_value", "tenure_days")


def mann_whitney_u(tx: DataFrame, cal: ChurnCalendar, metrics: Sequence[str] = MW_METRICS) -> DataFrame:
    """Two-sided Mann-Whitney U (normal approximation with tie and continuity
    correction) of churned vs active, per metric.

    Mid-ranks come from counts per distinct value and a distributed running
    sum in value order, so no task holds all values of a metric.
    """
    a = _analysis(tx, cal)
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = (a.select("is_churned", F.inline(arr)).where(F.col("value").isNotNull()))
    per_value = long.groupBy("metric", "value").agg(
        F.count(F.lit(1)).alias("t"), F.sum("is_churned").alias("t1"))
    # everything below, the means too, is read from the numbered copy of the counts
    cum = prefix_sum(per_value, [F.col("metric").asc(), F.col("value").asc()], "t", "_cum")
    start = cum.groupBy("metric").agg(F.min(F.col("_cum") - F.col("t")).alias("_start"))
    ranked = (cum.join(F.broadcast(start), "metric")
                 .withColumn("midrank", (F.col("_cum") - F.col("_start")) - (F.col("t") - 1) / 2.0))
    stats = ranked.groupBy("metric").agg(
        F.sum(F.col("t1") * F.col("midrank")).alias("r1"),
        F.sum("t1").alias("n1"), F.sum("t").alias("n"),
        (F.sum(F.col("t1") * F.col("value")) / F.sum("t1")).alias("churned_mean"),
        (F.sum((F.col("t") - F.col("t1")) * F.col("value")) / F.sum(F.col("t") - F.col("t1"))).alias("active_mean"),
        F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("ties"))
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    u_big = F.greatest(u1, n1 * n2 - u1)
    z = F.try_divide(u_big - n1 * n2 / 2.0 - 0.5, sigma)
    return (stats
                 .select("metric", n1.cast("bigint").alias("n_churned"), n2.cast("bigint").alias("n_active"),
                         round_stat("churned_mean").alias("churned_mean"),
                         round_stat("active_mean").alias("active_mean"),
                         round_stat(u1).alias("u_statistic"), round_stat(z).alias("z_score")))


def mann_whitney_p_values(tx: DataFrame, cal: ChurnCalendar, alpha: float = 0.05) -> DataFrame:
    """The tests with their two-sided p-values; ``p_exponent`` is the power of ten of a p-value too small for six decimals."""
    r = mann_whitney_u(tx, cal).withColumn("_p", two_sided_p(F.col("z_score")))
    exponent = F.when(F.col("_p") > 0, F.floor(F.log10("_p"))).cast("int")
    return r.select("*", round_stat("_p").alias("p_value"), exponent.alias("p_exponent"), (F.col("_p") < alpha).alias("significant")).drop("_p")


def time_to_churn(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    c = _analysis(tx, cal).where(F.col("is_churned") == 1)
    c = c.withColumn("inactive_days", whole_days(ts_lit(cal.eligibility_cutoff), F.col("last_purchase")))
    r = c.agg(F.count(F.lit(1)).alias("churned_customers"), F.sum("tenure_days").alias("_t"),
              F.median(F.col("tenure_days").cast("double")).alias("_mt"),
              F.stddev_samp(F.col("tenure_days").cast("double")).alias("_st"),
              F.sum("inactive_days").alias("_i"), F.median(F.col("inactive_days").cast("double")).alias("_mi"),
              F.count_if(F.col("tenure_days") <= 30).alias("_w30"))
    n = F.col("churned_customers")
    return r.select("churned_customers",
                    round_half_up(F.col("_t").cast("double") / n).alias("mean_lifetime_days"),
                    round_half_up("_mt").alias("median_lifetime_days"),
                    round_half_up("_st").alias("std_lifetime_days"),
                    round_half_up(F.col("_i").cast("double") / n).alias("mean_inactive_days"),
                    round_half_up("_mi").alias("median_inactive_days"),
                    pct("_w30", "churned_customers").alias("pct_within_30_days"))


# Borders and labels of the reported groups.
CUT_BOUNDS = (7, 30, 60, 90, 180, 365)
CUT_LABELS = ("0-7d", "8-30d", "31-60d", "61-90d", "91-180d", "181-365d", "365d+")


def lifetime_buckets_cut(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Left-open lifetime buckets of churned customers: a lifetime of 0 days
    falls in no bucket, but the share is taken of all churned customers."""
    c = _analysis(tx, cal).where(F.col("is_churned") == 1)
    total = c.select(F.count(F.lit(1))).scalar()
    label, _ = upper_bucket(F.col("tenure_days"), CUT_BOUNDS, CUT_LABELS)
    g = (c.where(F.col("tenure_days") > 0).groupBy(label.alias("lifetime_bucket"))
          .agg(F.count(F.lit(1)).alias("customers")))
    dim = _bucket_table(tx.sparkSession, CUT_LABELS, "lifetime_bucket")
    return (F.broadcast(dim).join(g, "lifetime_bucket", "left").orderBy("_o")
              .select("lifetime_bucket", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
                      pct(F.coalesce("customers", F.lit(0)), total).alias("pct_of_churned")))


OBS_FEATURES = ("recency_days", "tenure_days", "total_orders", "total_transactions", "unique_products",
                "total_quantity", "total_revenue", "avg_order_value", "orders_per_month",
                "avg_items_per_transaction")


def observation_features(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Per-customer features from lines up to obs; churned = more than 60 whole
    days since the last purchase; customers first seen on/before obs - 60d."""
    obs = ts_lit(cal.observation)
    f = tx.where(F.col("invoice_ts") <= obs).groupBy("customer_id").agg(
        F.max("invoice_ts").alias("last_purchase"), F.min("invoice_ts").alias("first_purchase"),
        F.count_distinct("invoice").alias("total_orders"), F.count("invoice").alias("total_transactions"),
        F.count_distinct("stock_code").alias("unique_products"), F.sum("quantity").alias("total_quantity"),
        (F.sum("quantity") / F.count("quantity")).alias("avg_quantity"),
        F.sum(line_value()).cast("double").alias("total_revenue"))
    f = (f.withColumn("avg_items_per_transaction", F.col("total_transactions") / F.col("total_orders"))
          .withColumn("recency_days", whole_days(obs, F.col("last_purchase")))
          .withColumn("tenure_days", whole_days("last_purchase", "first_purchase"))
          .withColumn("avg_order_value", F.col("total_revenue") / F.col("total_orders"))
          .withColumn("orders_per_month",
                      F.col("total_orders") / (F.greatest(F.col("tenure_days"), F.lit(1)) / F.lit(30.0)))
          .withColumn("is_churned", (F.col("recency_days") > cal.churn_window_days).cast("int")))
    return f.where(F.col("first_purchase") <= ts_lit(cal.eligibility_cutoff))


def target_correlation(tx: DataFrame, cal: ChurnCalendar, features: Sequence[str] = OBS_FEATURES) -> DataFrame:
    f = observation_features(tx, cal)
    wide = f.agg(*[F.corr(F.col(c).cast("double"), F.col("is_churned").cast("double")).alias(c) for c in features])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in features])
    out = wide.select(F.inline(arr)).select("feature", round_stat("corr").alias("correlation"))
    return out.orderBy(F.abs("correlation").desc(), "feature")


def correlation_matrix(tx: DataFrame, cal: ChurnCalendar, features: Sequence[str] = OBS_FEATURES) -> DataFrame:
    """Pearson correlations of all pairs (lower triangle, i > j) in one aggregation."""
    cols = list(features) + ["is_churned"]
    f = observation_features(tx, cal)
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]
    wide = f.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    arr = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                             F.col(f"`{a}|{b}`").alias("c")) for a, b in pairs])
    return wide.select(F.inline(arr)).select("feature_a", "feature_b", round_stat("c").alias("correlation"))


def eda_summary(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Headline row: churn rate, one-time and 10+ order bucket rates, median
    churned lifetime and the share leaving within 30 days."""
    a = _analysis(tx, cal)
    b = churn_by_order_bucket(tx, cal)
    one = b.where(F.col("order_bucket") == ORDER_BUCKET_LABELS[0]).select("churn_rate_pct").scalar()
    ten = b.where(F.col("order_bucket") == ORDER_BUCKET_LABELS[-1]).select("churn_rate_pct").scalar()
    r = a.agg(F.count(F.lit(1)).alias("n"), F.sum("is_churned").alias("c"),
              F.median(F.when(F.col("is_churned") == 1, F.col("tenure_days").cast("double"))).alias("_m"),
              F.count_if((F.col("is_churned") == 1) & (F.col("tenure_days") <= 30)).alias("_w"))
    return r.select(pct("c", "n").alias("churn_rate_pct"), one.alias("one_time_churn_rate_pct"),
                    ten.alias("ten_plus_churn_rate_pct"), round_half_up("_m").alias("median_churned_lifetime_days"),
                    pct("_w", "c").alias("pct_churned_within_30_days"))
