"""Data-quality profiling of a transactions table.

Every profile is one aggregation pass (plus an unpivot of its single result
row), so the cost is one scan regardless of the number of columns.  Exact
distinct counts and percentiles are the default; ``approx=True`` switches to
sketches (HyperLogLog++, GK quantiles) for very large inputs, where an exact
global distinct or percentile would be merged in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import ChurnCalendar
from attrition.functions.timeutil import pct, round_half_up, round_stat, ts_lit, whole_days
from attrition.operators.rank import grouped_percentiles

# Expected column types of the transactions table.
EXPECTED_TYPES = {
    "invoice": "string", "stock_code": "string", "description": "string", "quantity": "bigint",
    "invoice_ts": "timestamp_ntz", "price": "double", "customer_id": "bigint", "country": "string",
}


def schema_report(df: DataFrame, expected: dict | None = None) -> DataFrame:
    """Column, current type, expected type and whether a conversion is needed."""
    expected = expected or EXPECTED_TYPES
    rows = [(f.name, f.dataType.simpleString(), expected.get(f.name),
             "Yes" if expected.get(f.name) not in (None, f.dataType.simpleString()) else "No")
            for f in df.schema.fields]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, current_type string, expected_type string, needs_conversion string")


def missing_values(df: DataFrame) -> DataFrame:
    """Per column: missing count, % of rows, non-missing; most missing first."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("missing_count")) for c in cols])
    out = wide.select("_n", F.inline(arr))
    return (out.select("column_name", F.col("missing_count").cast("bigint").alias("missing_count"),
                       pct("missing_count", "_n").alias("missing_pct"),
                       (F.col("_n") - F.col("missing_count")).cast("bigint").alias("non_missing"))
               .orderBy(F.col("missing_count").desc(), "column_name"))


def missing_severity(df: DataFrame) -> DataFrame:
    """Severity class of each column's missing share: >10% red, >1% orange, else green."""
    mv = missing_values(df)
    sev = (F.when(F.col("missing_pct") > 10, "red").when(F.col("missing_pct") > 1, "orange")
            .otherwise("green"))
    return mv.select("column_name", "missing_pct", sev.alias("severity"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, rows, unique_values`` of every column, exact.

    Each row gives its (column, value) pairs, which are counted by hash before the shuffle, so a task sends a
    value once, and each row is read once.  (Several distinct counts in one aggregate would copy the whole row per column.)
    Values are compared by their text, which tells all values of a column's type apart; 0.0 and -0.0 are one value.
    """
    kinds = dict(df.dtypes)
    value = lambda c: F.col(f"`{c}`") + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), value(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counted = df.select(F.inline(pairs)).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("c").agg(F.sum("n").alias("rows"), F.count("v").alias("unique_values"))
    return per.select(F.get(F.array(*map(F.lit, columns)), F.col("c")).alias("column_name"), "rows", "unique_values")


def cardinality(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Per column: distinct non-null values and their share of the rows."""
    cols = df.columns
    if not approx:
        return distinct_counts(df, cols).select("column_name", "unique_values", pct("unique_values", "rows").alias("cardinality_pct"))
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("unique_values")) for c in cols])
    return (wide.select("_n", F.inline(arr))
                .select("column_name", F.col("unique_values").cast("bigint").alias("unique_values"),
                        pct("unique_values", "_n").alias("cardinality_pct")))


DESCRIBE_PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
_PCT_NAMES = ("p1", "p5", "p25", "p50", "p75", "p95", "p99")


def numeric_describe(df: DataFrame, columns: Sequence[str] = ("quantity", "price"),
                     approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """count, mean, sample std, min, percentiles (linear interpolation), max.

    Exact percentiles come from distributed running counts per distinct value
    (no task holds a column's value map); ``approx=True`` uses GK sketches.
    """
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.inline(arr))
    stats = long.groupBy("column_name").agg(
        F.count("x").cast("bigint").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    if approx:
        q = long.groupBy("column_name").agg(F.percentile_approx("x", list(DESCRIBE_PERCENTILES), accuracy).alias("q"))
        q = q.select("column_name", *[F.col("q")[i].alias(n) for i, n in enumerate(_PCT_NAMES)])
    else:
        q = grouped_percentiles(long, ["column_name"], "x", DESCRIBE_PERCENTILES, _PCT_NAMES)
    # one row per described column on each side
    return stats.join(q, "column_name").select(
        "column_name", "count", round_stat("mean").alias("mean"), round_stat("std").alias("std"), "min",
        *[round_stat(n).alias(n) for n in _PCT_NAMES], "max")


def date_range(df: DataFrame) -> DataFrame:
    r = df.agg(F.min("invoice_ts").alias("start_ts"), F.max("invoice_ts").alias("end_ts"))
    return r.select("start_ts", "end_ts", whole_days("end_ts", "start_ts").alias("span_days"))


def daily_volume(df: DataFrame) -> DataFrame:
    """Rows per calendar day, with the mean rows per active day (one row per
    day of history, so the mean is taken over a calendar-bounded table)."""
    d = df.groupBy(F.to_date("invoice_ts").alias("day")).agg(F.count(F.lit(1)).alias("transactions"))
    mean = d.select((F.sum("transactions").cast("double") / F.count(F.lit(1)))).scalar()
    return d.select("day", "transactions", round_half_up(mean).alias("avg_per_day")).orderBy("day")


def monthly_volume(df: DataFrame) -> DataFrame:
    m = F.trunc(F.col("invoice_ts").cast("date"), "month")
    return df.groupBy(m.alias("month")).agg(F.count(F.lit(1)).alias("transactions")).orderBy("month")


def out_of_range_dates(df: DataFrame, cal: ChurnCalendar) -> DataFrame:
    return df.agg(F.count_if(F.col("invoice_ts") > ts_lit(cal.valid_to)).alias("future_rows"),
                  F.count_if(F.col("invoice_ts") < ts_lit(cal.valid_from)).alias("old_rows"))


def _invalid_flags():
    return [
        ("cancellations", F.coalesce(F.col("invoice").cast("string").startswith("C"), F.lit(False))),
        ("negative_quantity", F.coalesce(F.col("quantity") < 0, F.lit(False))),
        ("non_positive_price", F.coalesce(F.col("price") <= 0, F.lit(False))),
        ("missing_customer", F.col("customer_id").isNull()),
    ]


def invalid_transactions(df: DataFrame) -> DataFrame:
    flags = _invalid_flags()
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(p).alias(n) for n, p in flags])
    arr = F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("rows")) for n, _ in flags])
    return (wide.select("_n", F.inline(arr))
                .select("issue", F.col("rows").cast("bigint").alias("rows"), pct("rows", "_n").alias("pct_of_rows")))


def cancel_negative_overlap(df: DataFrame) -> DataFrame:
    f = dict(_invalid_flags())
    c, q = f["cancellations"], f["negative_quantity"]
    r = df.agg(F.count_if(c & q).alias("both_rows"), F.count_if(c).alias("cancellations"),
               F.count_if(q).alias("negative_quantity"))
    return r.select("both_rows", "cancellations", "negative_quantity",
                    pct("both_rows", "cancellations").alias("pct_of_cancellations"),
                    pct("both_rows", "negative_quantity").alias("pct_of_negative"))


SPECIAL_CODE_PATTERN = r"^\d+[A-Za-z]?$"


def special_stock_codes(df: DataFrame, top_k: int = 20) -> DataFrame:
    """Codes that are not 'digits plus optional letter': top ``top_k`` by rows
    (ties by code) with the overall count and share of special-code rows.

    One aggregation per stock code (bounded by the catalogue, not by the
    rows) feeds the top-k and both totals; the totals' subqueries reuse its
    exchange instead of scanning the table again."""
    is_special = ~F.coalesce(F.col("stock_code").cast("string").rlike(SPECIAL_CODE_PATTERN), F.lit(False))
    per_code = df.groupBy("stock_code", is_special.alias("_special")).agg(F.count(F.lit(1)).alias("transactions"))
    total_special = per_code.where(F.col("_special")).select(F.sum("transactions")).scalar()
    total_rows = per_code.select(F.sum("transactions")).scalar()
    top = (per_code.where(F.col("_special")).orderBy(F.col("transactions").desc(), "stock_code").limit(top_k))
    return top.select("stock_code", "transactions", total_special.cast("bigint").alias("total_special_rows"),
                      pct(total_special, total_rows).alias("total_special_pct"))


def quality_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """Headline profile of a (cleaned) table in one row."""
    cols = df.columns
    names = {"customer_id": "customers", "stock_code": "products", "invoice": "invoices", "country": "countries"}
    null_cells = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    dup = (df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_c"))
             .select(F.sum(F.col("_c") - 1).cast("bigint")).scalar())
    plain = [F.count(F.lit(1)).alias("transactions"), F.min("invoice_ts").alias("_s"), F.max("invoice_ts").alias("_e"), F.sum(null_cells).alias("missing_cells")]
    if approx:
        r = df.agg(*plain, *[F.approx_count_distinct(c).alias(n) for c, n in names.items()])
    else:
        # one row with the four counts, read as one scalar
        unique = distinct_counts(df, list(names)).agg(F.struct(*[
            F.coalesce(F.max(F.when(F.col("column_name") == c, F.col("unique_values"))), F.lit(0).cast("bigint")).alias(n) for c, n in names.items()])).scalar()
        r = df.agg(*plain).select("*", *[unique[n].alias(n) for n in names.values()])
    return r.select("transactions", "customers", "products", "invoices", "countries",
                    F.to_date("_s").alias("start_date"), F.to_date("_e").alias("end_date"),
                    whole_days("_e", "_s").alias("duration_days"),
                    F.col("missing_cells").cast("bigint").alias("missing_cells"),
                    F.coalesce(dup, F.lit(0).cast("bigint")).alias("duplicate_rows"))


def sample_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows in a total, explicit order (a top-k, not a scan prefix)."""
    order = [F.col(c).asc_nulls_first() for c in ("invoice_ts", "invoice", "stock_code", "customer_id",
                                                    "quantity", "price", "description", "country")]
    return df.orderBy(*order).limit(n)
