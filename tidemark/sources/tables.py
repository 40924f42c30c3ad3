"""Reading the benchmark tables and giving them readable column names.

Question resolution works on words in column names, so the TPC-H style names
(``o_totalprice``) are projected to readable ones (``total_price``) first.
The projection is a pure rename: Catalyst still prunes columns and pushes
filters into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

READABLE = {
    "orders": {
        "o_orderkey": "order_key", "o_custkey": "customer_key",
        "o_orderstatus": "order_status", "o_totalprice": "total_price",
        "o_orderdate": "order_date", "o_orderpriority": "order_priority",
    },
    "lineitem": {
        "l_orderkey": "order_key", "l_partkey": "part_key", "l_suppkey": "supplier_key",
        "l_linenumber": "line_number", "l_quantity": "quantity",
        "l_extendedprice": "extended_price", "l_discount": "discount", "l_tax": "tax",
        "l_returnflag": "return_flag", "l_linestatus": "line_status",
        "l_shipdate": "ship_date",
    },
    "customer": {
        "c_custkey": "customer_key", "c_name": "customer_name", "c_nationkey": "nation_key",
        "c_acctbal": "account_balance", "c_mktsegment": "market_segment",
    },
    "part": {
        "p_partkey": "part_key", "p_name": "part_name", "p_brand": "brand",
        "p_type": "part_type", "p_size": "part_size", "p_retailprice": "retail_price",
    },
    "supplier": {
        "s_suppkey": "supplier_key", "s_name": "supplier_name",
        "s_nationkey": "nation_key", "s_acctbal": "account_balance",
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A2: one Parquet table of the test set."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readable(spark: SparkSession, sf_dir: str, name: str,
             columns: list[str] | None = None) -> DataFrame:
    """The table with readable names; ``columns`` picks a subset (raw names)."""
    mapping = READABLE[name]
    raw = columns or list(mapping)
    return table(spark, sf_dir, name).select(*[F.col(c).alias(mapping[c]) for c in raw])
