import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from attrition.session import get_session
    scratch = tempfile.mkdtemp(prefix="attrition-tests-")
    s = get_session("local[4]", "attrition-tests", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
        "spark.driver.memory": "4g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cal():
    from attrition.calendar import TESTDATA_CALENDAR
    return TESTDATA_CALENDAR


TX_SCHEMA = ("invoice string, stock_code string, description string, quantity double, "
             "invoice_ts timestamp_ntz, price double, customer_id bigint, country string")


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture(scope="session")
def make_tx(spark):
    """Rows (invoice, stock_code, quantity, 'YYYY-MM-DD HH:MM:SS', price, customer, country[, description])."""
    def _make(rows):
        full = []
        for r in rows:
            inv, code, qty, t, price, cust, country = r[:7]
            desc = r[7] if len(r) > 7 else f"item {code}"
            full.append((inv, code, desc, float(qty), ts(t), float(price), cust, country))
        return spark.createDataFrame(full, TX_SCHEMA)
    return _make
