"""Rule-based cleaning (one conjunctive filter) and its waterfall report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.calendar import SERVICE_CODES

# Ordered cleaning rules: (step name, predicate that a row must satisfy).
def _rules(service_codes: Sequence[str]):
    return [
        ("has_customer", F.col("customer_id").isNotNull()),
        ("not_cancelled", ~F.col("invoice").cast("string").startswith("C")),
        ("positive_quantity", F.col("quantity") > 0),
        ("positive_price", F.col("price") > 0),
        ("not_service_code", ~F.col("stock_code").isin(list(service_codes))),
    ]


def clean_transactions(raw: DataFrame, service_codes: Sequence[str] = SERVICE_CODES) -> DataFrame:
    """Drop rows without customer, cancellations, non-positive quantity or price,
    and service codes; the customer key becomes a bigint."""
    cond = None
    for _, pred in _rules(service_codes):
        # coalesce: a NULL predicate (e.g. null invoice) fails the rule like pandas.
        p = F.coalesce(pred, F.lit(False))
        cond = p if cond is None else cond & p
    return raw.where(cond).withColumn("customer_id", F.col("customer_id").cast("bigint"))


def failed_rule(service_codes: Sequence[str] = SERVICE_CODES):
    """Name of the first rule that a row breaks; null for a clean row."""
    out = None
    for name, pred in _rules(service_codes):
        broken = ~F.coalesce(pred, F.lit(False))
        out = F.when(broken, F.lit(name)) if out is None else out.when(broken, F.lit(name))
    return out


def cleaning_waterfall(raw: DataFrame, service_codes: Sequence[str] = SERVICE_CODES) -> DataFrame:
    """Rows left / removed after each ordered step, in one pass over the input.

    Each row is tagged with the index of the first rule it fails (0 = passes
    all); a single aggregation counts the tags, and the waterfall is a suffix
    sum over the handful of resulting columns.
    """
    rules = _rules(service_codes)
    first_fail = None
    for i, (_, pred) in enumerate(rules, start=1):
        ok = F.coalesce(pred, F.lit(False))
        first_fail = F.when(~ok, F.lit(i)) if first_fail is None else first_fail.when(~ok, F.lit(i))
    first_fail = first_fail.otherwise(F.lit(0))
    tagged = raw.select(first_fail.alias("_fail"), F.col("customer_id"))
    aggs = [F.count(F.lit(1)).alias("n_input")]
    aggs += [F.count_if(F.col("_fail") == i).alias(f"fail_{i}") for i in range(1, len(rules) + 1)]
    aggs.append(F.count_distinct(F.when(F.col("_fail") == 0, F.col("customer_id"))).alias("clean_customers"))
    counts = tagged.agg(*aggs)
    rows = []
    remaining = F.col("n_input")
    for i, (name, _) in enumerate(rules, start=1):
        removed = F.col(f"fail_{i}")
        remaining = remaining - removed
        rows.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("rule"),
                             remaining.cast("bigint").alias("rows_after"),
                             removed.cast("bigint").alias("rows_removed")))
    return (counts.select(F.explode(F.array(*rows)).alias("s"), "n_input", "clean_customers")
                  .select("s.step", "s.rule", "s.rows_after", "s.rows_removed",
                          F.col("n_input").cast("bigint").alias("rows_input"),
                          F.col("clean_customers").cast("bigint").alias("clean_customers")))
