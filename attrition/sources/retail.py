"""Transaction sources.

``retail_raw`` derives a retail line-item table (the schema of the original
analysis) from the driver's star-schema tables.  It is deterministic integer
arithmetic over the inputs, so any SQL engine produces the same rows, and it
injects every defect the cleaning step has to remove (missing customer,
cancellations, returns, zero prices, service codes) plus a time of day.

Columns: invoice string, stock_code string, description string,
quantity double, invoice_ts timestamp_ntz, price double, customer_id bigint,
country string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that the retail view reads.
RETAIL_TABLES = ("lineitem", "orders", "part", "customer", "nation")
TRANSACTION_COLUMNS = ["invoice", "stock_code", "description", "quantity",
                       "invoice_ts", "price", "customer_id", "country"]


def read_parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_parquet_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber")
    o = read_parquet_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = read_parquet_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    c = read_parquet_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation has a fixed 25 rows: safe to broadcast at any scale.
    n = F.broadcast(read_parquet_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))

    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(n, c.c_nationkey == n.n_nationkey))

    ok = F.col("o_orderkey")
    pk = F.col("l_partkey")
    returned = F.col("l_returnflag") == "R"
    invoice = F.concat(F.when(returned & (ok % 5 == 0), F.lit("C")).otherwise(F.lit("")),
                       ok.cast("string"))
    pk_mod = pk % 200
    stock_code = (F.when(pk_mod == 0, F.lit("POST"))
                   .when(pk_mod == 1, F.lit("M"))
                   .when(pk_mod == 2, F.lit("BANK CHARGES"))
                   .when(pk_mod == 3, F.lit("gift_0001"))
                   .otherwise(F.concat(pk.cast("string"),
                                       F.when(pk % 2 == 1, F.lit("A")).otherwise(F.lit("")))))
    quantity = F.when(returned & (ok % 5).isin(0, 1) & (F.col("l_linenumber") != 7),
                      -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    invoice_ts = F.timestamp_add("SECOND", ((ok * 7919) % 86400).cast("int"),
                                F.col("o_orderdate").cast("timestamp_ntz"))
    price = F.when(pk % 50 == 7, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    customer_id = F.when(ok % 4 == 3, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey"))
    return j.select(
        invoice.alias("invoice"),
        stock_code.alias("stock_code"),
        F.col("p_name").alias("description"),
        quantity.cast("double").alias("quantity"),
        invoice_ts.alias("invoice_ts"),
        price.cast("double").alias("price"),
        customer_id.cast("bigint").alias("customer_id"),
        F.col("n_name").alias("country"),
    )


def events_purchases(spark: SparkSession, sf_dir: str, home_country: str = "NATION_0") -> DataFrame:
    """Purchase events viewed as transactions (time-of-day, short horizons)."""
    ev = read_parquet_table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").cast("string").alias("invoice"),
        (F.col("event_id") % 50).cast("string").alias("stock_code"),
        F.lit(None).cast("string").alias("description"),
        F.lit(1.0).alias("quantity"),
        F.col("ts").cast("timestamp_ntz").alias("invoice_ts"),
        F.col("value").cast("double").alias("price"),
        F.col("user_id").cast("bigint").alias("customer_id"),
        F.lit(home_country).alias("country"),
    )
