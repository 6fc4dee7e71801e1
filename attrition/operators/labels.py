"""Forward-looking churn labels, leakage checks, model-ready table and a
reproducible stratified split.

Label: an eligible customer (first purchase on/before obs - 60d) is churned
when no purchase falls in (obs, prediction_end].
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import pct, round_half_up, ts_lit, whole_days
from attrition.operators.features import FEATURES, feature_matrix, history
from attrition.operators.rank import global_rank


def future_active_customers(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Customers with a purchase in (obs, prediction_end]."""
    fut = tx.where((F.col("invoice_ts") > ts_lit(cal.observation)) & (F.col("invoice_ts") <= ts_lit(cal.prediction_end)))
    return fut.select("customer_id").distinct()


def eligible_customers(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    return (tx.groupBy("customer_id").agg(F.min("invoice_ts").alias("first_purchase"))
              .where(F.col("first_purchase") <= ts_lit(cal.eligibility_cutoff)).select("customer_id"))


def churn_labels(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """One aggregation: eligibility and future activity per customer."""
    fut = (F.col("invoice_ts") > ts_lit(cal.observation)) & (F.col("invoice_ts") <= ts_lit(cal.prediction_end))
    c = tx.groupBy("customer_id").agg(F.min("invoice_ts").alias("first_purchase"),
                                      F.max(fut.cast("int")).alias("_active"))
    return (c.where(F.col("first_purchase") <= ts_lit(cal.eligibility_cutoff))
             .select("customer_id", (1 - F.col("_active")).cast("int").alias("is_churned")))


def is_churned_at(tx: DataFrame, snapshots: Sequence[dt.date], window_days: int = 60,
                  min_history_days: int = 60) -> DataFrame:
    """Labels for many observation dates in one pass over the lines.

    The snapshot list is a parameter (a handful of dates), so each snapshot
    becomes one conditional flag in a single per-customer aggregation - no
    join of the lines with the snapshots at all - and the flags are
    unpivoted into (obs_date, customer) rows.
    """
    aggs = [F.min("invoice_ts").alias("first_purchase")]
    for i, d in enumerate(snapshots):
        obs = ts_lit(d)
        end = ts_lit(d + dt.timedelta(days=window_days))
        aggs.append(F.max(((F.col("invoice_ts") > obs) & (F.col("invoice_ts") <= end)).cast("int")).alias(f"_a{i}"))
    per = tx.groupBy("customer_id").agg(*aggs)
    arr = F.array(*[F.struct(F.lit(d).alias("obs_date"),
                             (F.col("first_purchase") <= ts_lit(d - dt.timedelta(days=min_history_days))).alias("eligible"),
                             (1 - F.col(f"_a{i}")).cast("int").alias("is_churned"))
                    for i, d in enumerate(snapshots)])
    return (per.select("customer_id", F.inline(arr)).where(F.col("eligible"))
               .select("obs_date", "customer_id", "is_churned"))


#: Snapshots whose table may be sent to every task: a list of dates given by the caller.
MAX_SNAPSHOTS = 100_000


def is_churned_range(tx: DataFrame, snapshots: Sequence[dt.date], window_days: int = 60, min_history_days: int = 60) -> DataFrame:
    """``is_churned_at`` for hundreds of observation dates: no column and no join per date.

    Counted in midnights, a purchase whose next midnight is ``m`` (its own, if it falls on one) is active for the dates
    from ``m - window_days`` to ``m - 1``, and makes its customer eligible from ``m + min_history_days`` on.  So a
    customer's distinct midnights in order cut its eligible time into spans of one label: up to ``window_days`` before a
    midnight nothing is bought (churned), from there on something is.  The spans, about two a midnight, do not overlap
    and are dealt over the tasks evenly; each is expanded to its dates once, so every row of the result is made once.
    """
    dates = sorted(set(snapshots))
    if len(dates) > MAX_SNAPSHOTS:
        raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots")
    c, spark, epoch = F.col, tx.sparkSession, dt.date(1970, 1, 1)
    numbers = [(d - epoch).days for d in dates]
    first_day, last_day = (numbers[0], numbers[-1]) if numbers else (0, -1)
    date = F.to_date("invoice_ts")
    midnight = F.datediff(date, F.lit("1970-01-01").cast("date")) + (c("invoice_ts") > date.cast("timestamp_ntz")).cast("int")
    marks = tx.select("customer_id", midnight.alias("_m")).where(c("_m").isNotNull()).distinct()
    # at most one mark a day of a customer
    by_customer = Window.partitionBy("customer_id")
    in_order = by_customer.orderBy("_m")
    start = F.greatest(F.min("_m").over(by_customer) + min_history_days, F.lit(first_day))
    marks = marks.select("customer_id", "_m", start.alias("_start"), F.lag("_m").over(in_order).alias("_before"),
                         F.lead("_m").over(in_order).isNull().alias("_last"))
    seen = F.coalesce(c("_before"), c("_start"))  # dates from here on are not labelled by an earlier purchase
    opens = c("_m") - window_days
    span = lambda lo, hi, churned: F.struct(F.greatest(lo, c("_start")).alias("lo"), F.least(hi, F.lit(last_day)).alias("hi"),
                                            F.lit(churned).alias("is_churned"))
    spans = F.array(span(seen, opens - 1, 1), span(F.greatest(seen, opens), c("_m") - 1, 0),
                    F.when(c("_last"), span(c("_m"), F.lit(last_day), 1)))
    spans = marks.select("customer_id", F.explode(F.array_compact(spans)).alias("s")).select("customer_id", "s.*").where(c("lo") <= c("hi"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    days = spans.repartition(n).select("customer_id", F.explode(F.sequence("lo", "hi")).alias("_d"), "is_churned")
    if len(dates) != last_day - first_day + 1:
        # at most MAX_SNAPSHOTS numbers
        days = days.join(F.broadcast(spark.createDataFrame([(x,) for x in numbers], "_d int")), "_d")
    return days.select(F.date_add(F.lit("1970-01-01").cast("date"), c("_d")).alias("obs_date"), "customer_id", "is_churned")


def churn_by_snapshot(tx: DataFrame, snapshots: Sequence[dt.date], window_days: int = 60, min_history_days: int = 60) -> DataFrame:
    """Eligible and churned customers for every observation date that has any."""
    g = is_churned_range(tx, snapshots, window_days, min_history_days).groupBy("obs_date").agg(
        F.count(F.lit(1)).alias("eligible"), F.sum("is_churned").cast("bigint").alias("churned"))
    return g.select("obs_date", "eligible", "churned", pct("churned", "eligible").alias("churn_rate_pct"))


def label_distribution(tx: DataFrame, cal: ChurnCalendar, imbalance_limit: float = 3.0) -> DataFrame:
    lab = churn_labels(tx, cal)
    r = lab.agg(F.count(F.lit(1)).alias("total"), F.sum("is_churned").cast("bigint").alias("churned"))
    active = F.col("total") - F.col("churned")
    ratio = F.try_divide(active.cast("double"), F.col("churned").cast("double"))
    return r.select(F.col("total").alias("total_customers"), F.col("churned").alias("churned"),
                    active.alias("active"), pct("churned", "total").alias("churned_pct"),
                    pct(active, F.col("total")).alias("active_pct"),
                    round_half_up(ratio).alias("imbalance_ratio"),
                    F.coalesce(ratio > imbalance_limit, F.lit(True)).alias("needs_rebalancing"))


#: The checks in order; each counts the rows that break it.
LEAKAGE_CHECKS = ("recency_not_negative", "recency_recomputed", "active_buy_in_label_period", "churned_do_not_buy", "labels_known_once")


def leakage_checks(feature_table: DataFrame, label_table: DataFrame, tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Assertions on a stored feature and label table against the transactions.

    Features know nothing after the observation: no recency is negative, and
    each equals the one recomputed from the purchases up to it.  Labels follow
    the label period: an active customer bought in it, a churned one did not.
    Every labelled customer was known at the observation and has one label.
    """
    obs, end = ts_lit(cal.observation), ts_lit(cal.prediction_end)
    c = F.col
    past = history(tx, cal).groupBy("customer_id").agg(whole_days(obs, F.max("invoice_ts")).alias("_days"))
    future = tx.where((c("invoice_ts") > obs) & (c("invoice_ts") <= end)).select("customer_id").distinct().withColumn("_buys", F.lit(True))
    feats = feature_table.select("customer_id", "recency_days").join(past, "customer_id", "left").agg(
        F.count_if(c("recency_days") < 0).alias("v1"), F.count_if(~c("recency_days").eqNullSafe(c("_days"))).alias("v2"))
    per_label = label_table.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(c("is_churned") == 0).alias("_active"), F.count_if(c("is_churned") == 1).alias("_churned"))
    labs = per_label.join(future, "customer_id", "left").join(past, "customer_id", "left").agg(
        F.coalesce(F.sum(F.when(c("_buys").isNull(), c("_active"))), F.lit(0)).alias("v3"),
        F.coalesce(F.sum(F.when(c("_buys"), c("_churned"))), F.lit(0)).alias("v4"),
        F.coalesce(F.sum(F.when(c("_days").isNull(), c("_n"))), F.lit(0)).alias("_unknown"), F.count_if(c("_n") > 1).alias("_twice"))
    counts = [feats.select("v1").scalar(), feats.select("v2").scalar(), c("v3"), c("v4"), c("_unknown") + c("_twice")]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("check_id"), F.lit(name).alias("check_name"), n.cast("bigint").alias("violations"))
                     for i, (name, n) in enumerate(zip(LEAKAGE_CHECKS, counts))])
    return labs.select(F.inline(rows)).withColumn("passed", c("violations") == 0)


def model_ready(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    """Features inner-joined with labels; missing numbers 0; customer id kept."""
    return (feature_matrix(tx, cal).join(churn_labels(tx, cal), "customer_id", "inner")
            .na.fill(0).select("customer_id", *FEATURES, "is_churned"))


def split_hash(c: Column) -> Column:
    """Multiplicative hash of a non-negative id modulo 2^32, computed in 16-bit
    halves so the products never overflow a bigint."""
    a = F.pmod(c.cast("bigint"), F.lit(4294967296))
    hi, lo = F.floor(a / 65536).cast("bigint"), F.pmod(a, F.lit(65536))
    k = F.lit(2654435761)
    return F.pmod(F.pmod(hi * k, F.lit(65536)) * 65536 + lo * k, F.lit(4294967296))


def stratified_split(df: DataFrame, label_col: str = "is_churned", test_frac: float = 0.2,
                     val_frac: float = 0.2) -> DataFrame:
    """Deterministic stratified train/validation/test split.

    Inside each class, rows are ordered by a hash of the customer id (id as
    tie-break); the first round(test_frac * n_c) go to test, the next
    round(val_frac * (n_c - test)) to validation, the rest to train.  The
    order comes from the distributed ranking (a class can hold most rows, so
    no per-class window is used).
    """
    h = df.withColumn("_h", split_hash(F.col("customer_id")))
    ranked = global_rank(h, [F.col(label_col).asc(), F.col("_h").asc(), F.col("customer_id").asc()], "_pos")
    # the numbered copy, not the input, which would be computed again
    sizes = ranked.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
    # one row per class
    sizes = sizes.select(label_col, "_nc", F.coalesce(F.sum("_nc").over(w), F.lit(0)).alias("_start"))
    r = ranked.join(F.broadcast(sizes), label_col)
    pos = F.col("_pos") - F.col("_start")
    n_test = F.floor(F.col("_nc") * F.lit(test_frac) + 0.5)
    n_val = F.floor((F.col("_nc") - n_test) * F.lit(val_frac) + 0.5)
    split = F.when(pos < n_test, "test").when(pos < n_test + n_val, "validation").otherwise("train")
    return r.withColumn("split", split).drop("_h", "_pos", "_n", "_nc", "_start")


def model_ready_split(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    return stratified_split(model_ready(tx, cal))


def split_report(tx: DataFrame, cal: ChurnCalendar) -> DataFrame:
    s = model_ready_split(tx, cal)
    total = s.select(F.count(F.lit(1))).scalar()
    g = s.groupBy("split").agg(F.count(F.lit(1)).alias("customers"), F.sum("is_churned").alias("_c"))
    return g.select("split", "customers", pct("customers", total).alias("pct_of_customers"),
                    pct("_c", "customers").alias("churn_rate_pct"))
