"""Benchmark of the headline analyses.

Protocol: local[$BENCH_CPUS], data at $BENCH_SF_DIR (default sf0.1), UI off.
The raw view is cleaned and materialised once as Parquet (timed as
``prepare_transactions``), as the analyses in production read the stored
clean table (BENCH_LAYOUT=plain|bucketed);
every analysis then runs on that table into a ``noop`` sink:
one warm-up, median of three.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attrition.calendar import TESTDATA_CALENDAR as CAL  # noqa: E402
from attrition.operators import activity, behavior, churn, cohorts, cost, eda, features, labels, metrics, quality, segments  # noqa: E402,E501
from attrition.operators.clean import clean_transactions, cleaning_waterfall  # noqa: E402
from attrition.plans.pipeline import materialize_transactions  # noqa: E402
from attrition.session import get_session  # noqa: E402
from attrition.sources.retail import retail_raw  # noqa: E402


def headline(tx, raw):
    sc = lambda: metrics.heuristic_scores(tx, CAL)
    return {
        "cleaning_waterfall": lambda: cleaning_waterfall(raw),
        "quality_report": lambda: quality.quality_report(tx),
        "churn_rate_overall": lambda: churn.churn_rate_overall(tx, CAL),
        "churn_by_monetary_quintile": lambda: churn.churn_by_monetary_quintile(tx, CAL),
        "churn_by_country": lambda: churn.churn_by_country(tx, CAL),
        "time_to_second_purchase": lambda: churn.time_to_second_purchase(tx, CAL),
        "activity_windows_churned": lambda: activity.activity_windows_churned(tx, CAL),
        "purchase_gaps": lambda: activity.purchase_gaps(tx, CAL),
        "recent_vs_historical_order_value": lambda: activity.recent_vs_historical_order_value(tx, CAL),
        "rfm_cells": lambda: behavior.rfm_cells(tx, CAL),
        "basket_patterns": lambda: behavior.basket_patterns(tx, CAL),
        "velocity_change": lambda: behavior.velocity_change(tx, CAL),
        "cohort_retention": lambda: cohorts.cohort_retention(tx, CAL),
        "mann_whitney_u": lambda: eda.mann_whitney_u(tx, CAL),
        "feature_matrix": lambda: features.feature_matrix(tx, CAL),
        "model_ready": lambda: labels.model_ready(tx, CAL),
        "evaluate_scores": lambda: metrics.evaluate_scores(sc()),
        "threshold_sweep": lambda: cost.threshold_sweep(sc()),
        "segment_budget": lambda: segments.segment_budget(sc()),
    }


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    scratch = tempfile.mkdtemp(prefix="attrition-bench-")
    spark = get_session(f"local[{cpus}]", "attrition-bench", shuffle_partitions=2 * cpus, extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
        "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
    })
    spark.sparkContext.setLogLevel("ERROR")

    raw = retail_raw(spark, sf_dir)
    t0 = time.perf_counter()
    layout = os.environ.get("BENCH_LAYOUT", "plain")
    tx = materialize_transactions(clean_transactions(raw), os.path.join(scratch, "transactions_clean"),
                                  layout=layout, num_buckets=2 * cpus, table="transactions_clean")
    prepare = time.perf_counter() - t0

    timings = {"prepare_transactions": round(prepare, 3)}
    for name, build in headline(tx, raw).items():
        run_noop(build())  # warm-up
        ts = []
        for _ in range(runs):
            t = time.perf_counter()
            run_noop(build())
            ts.append(time.perf_counter() - t)
        timings[name] = round(statistics.median(ts), 3)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_seconds", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
