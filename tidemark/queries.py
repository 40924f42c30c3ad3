"""Registered queries over the test tables, each with its DuckDB oracle SQL.

Every query reads whole tables through the library's operators. Floating
results are rounded to 6 digits in both the Spark query and the oracle SQL
(sums in a different order differ in the last bits).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import rounded
from tidemark.operators import marts
from tidemark.operators.anomaly import ADVICE
from tidemark.plans.question import answer
from tidemark.session import shared_table
from tidemark.sources.tables import readable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


# ------------------------------------------------------------------ C1, C2, G5
@register("question_answer_avg", """
SELECT o_orderpriority AS order_priority, COUNT(*) AS record_count,
       ROUND(AVG(o_totalprice), 6) AS avg_total_price
FROM orders GROUP BY o_orderpriority
""")
def question_answer_avg(spark, sf):
    orders = readable(spark, sf, "orders")
    _, mart = answer(orders, "Which order priorities generate the highest average price?")
    return rounded(mart)


@register("question_answer_sum", """
SELECT o_orderstatus AS order_status, COUNT(*) AS record_count,
       ROUND(COALESCE(SUM(o_totalprice), 0), 6) AS total_total_price
FROM orders GROUP BY o_orderstatus
""")
def question_answer_sum(spark, sf):
    orders = readable(spark, sf, "orders")
    _, mart = answer(orders, "What is the total price by order status?")
    return rounded(mart)


@register("question_answer_count", """
SELECT l_returnflag AS return_flag, COUNT(*) AS record_count
FROM lineitem GROUP BY l_returnflag
""")
def question_answer_count(spark, sf):
    items = readable(spark, sf, "lineitem")
    _, mart = answer(items, "Count the line items for each return flag")
    return mart


@register("question_answer_lowest", """
SELECT c_mktsegment AS market_segment, COUNT(*) AS record_count,
       ROUND(AVG(c_acctbal), 6) AS avg_account_balance
FROM customer GROUP BY c_mktsegment
""")
def question_answer_lowest(spark, sf):
    customers = readable(spark, sf, "customer")
    _, mart = answer(customers, "Which market segment has the lowest average account balance?",
                     metric="account_balance")
    return rounded(mart)


# --------------------------------------------------------------- C3, E1-E3
@register("top_entities", """
SELECT ROW_NUMBER() OVER (ORDER BY total_l_extendedprice DESC, l_suppkey) AS rank,
       l_suppkey, record_count, ROUND(total_l_extendedprice, 6) AS total_l_extendedprice
FROM (SELECT l_suppkey, COUNT(*) AS record_count,
             COALESCE(SUM(l_extendedprice), 0) AS total_l_extendedprice
      FROM lineitem GROUP BY l_suppkey
      ORDER BY total_l_extendedprice DESC, l_suppkey LIMIT 20) t
""")
def top_entities(spark, sf):
    items = table(spark, sf, "lineitem")
    return rounded(marts.top_entities_mart(items, "l_suppkey", "l_extendedprice", "sum"))


# ------------------------------------------------------------------- C4-C6
@register("release_impact", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, COUNT(o_totalprice) AS record_count,
       ROUND(COALESCE(SUM(o_totalprice), 0), 6) AS total_o_totalprice,
       ROUND(AVG(o_totalprice), 6) AS avg_o_totalprice
FROM orders GROUP BY 1
""")
def release_impact(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("order_year"), "o_totalprice")
    return rounded(marts.release_impact_mart(orders, "o_totalprice", year_column="order_year"))


@register("provider_performance", """
SELECT l_suppkey, COUNT(l_quantity) AS record_count,
       ROUND(COALESCE(SUM(l_quantity), 0), 6) AS total_l_quantity,
       ROUND(AVG(l_quantity), 6) AS avg_l_quantity
FROM lineitem GROUP BY l_suppkey
""")
def provider_performance(spark, sf):
    items = table(spark, sf, "lineitem")
    return rounded(marts.provider_performance_mart(items, "l_quantity", provider_column="l_suppkey"))


@register("catalog_summary", """
SELECT p_brand, COUNT(*) AS record_count,
       ROUND(COALESCE(SUM(p_retailprice), 0), 6) AS total_p_retailprice,
       ROUND(AVG(p_retailprice), 6) AS avg_p_retailprice
FROM part GROUP BY p_brand
""")
def catalog_summary(spark, sf):
    return rounded(marts.catalog_summary_mart(table(spark, sf, "part"), "p_brand", "p_retailprice"))


# ---------------------------------------------------------------------- C7
@register("distribution", """
WITH s AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
e AS (
  SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001
                 WHEN i = 10 THEN hi
                 ELSE lo + i * ((hi - lo) / 10) END AS edge
  FROM s CROSS JOIN range(0, 11) r(i)),
b AS (SELECT a.i AS bin, a.edge AS e0, c.edge AS e1 FROM e a JOIN e c ON c.i = a.i + 1)
SELECT ROUND(e0, 3) AS bin_start, ROUND(e1, 3) AS bin_end,
       COUNT(l.l_extendedprice) AS record_count
FROM b LEFT JOIN lineitem l ON l.l_extendedprice > b.e0 AND l.l_extendedprice <= b.e1
GROUP BY b.bin, b.e0, b.e1
""")
def distribution(spark, sf):
    return marts.distribution_mart(table(spark, sf, "lineitem"), "l_extendedprice")


# ---------------------------------------------------------------------- C8
@register("summary_stats", """
SELECT 'o_totalprice' AS source_metric_column,
       ROUND(MIN(o_totalprice), 6) AS min_o_totalprice,
       ROUND(MAX(o_totalprice), 6) AS max_o_totalprice,
       ROUND(AVG(o_totalprice), 6) AS avg_o_totalprice,
       ROUND(QUANTILE_CONT(o_totalprice, 0.5), 6) AS median_o_totalprice,
       ROUND(COALESCE(STDDEV_SAMP(o_totalprice), 0), 6) AS std_o_totalprice,
       ROUND(QUANTILE_CONT(o_totalprice, 0.05), 6) AS p05_o_totalprice,
       ROUND(QUANTILE_CONT(o_totalprice, 0.25), 6) AS p25_o_totalprice,
       ROUND(QUANTILE_CONT(o_totalprice, 0.75), 6) AS p75_o_totalprice,
       ROUND(QUANTILE_CONT(o_totalprice, 0.95), 6) AS p95_o_totalprice
FROM orders
""")
def summary_stats(spark, sf):
    return rounded(marts.summary_stats_mart(table(spark, sf, "orders"), "o_totalprice"))


# ---------------------------------------------------------------- C9, B15
@register("time_trend", """
SELECT STRFTIME(ts, '%Y-%m-%d') AS ts, COUNT(*) AS record_count,
       ROUND(AVG(value), 6) AS avg_value
FROM events GROUP BY 1
""")
def time_trend(spark, sf):
    events = table(spark, sf, "events").select("ts", "value", "event_type")
    return rounded(marts.time_trend_mart(events, "value", "average"))


# --------------------------------------------------------------- C11, D5
_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(table_name: str, cols: list[str]) -> str:
    names = sorted(cols)
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            parts.append(f"SELECT '{a}' AS left_metric, '{b}' AS right_metric, "
                         f"CORR({a}, {b}) AS correlation FROM {table_name}")
    return ("SELECT left_metric, right_metric, ROUND(correlation, 6) AS correlation FROM ("
            + " UNION ALL ".join(parts) + ") t WHERE correlation IS NOT NULL AND NOT isnan(correlation)")


@register("correlation", _corr_sql("lineitem", _CORR_COLS))
def correlation(spark, sf):
    return rounded(marts.correlation_mart(table(spark, sf, "lineitem"), _CORR_COLS))


# ------------------------------------------------------------------ B1-B8
def dirty_orders(spark, sf):
    """Stand-in raw input: the whole orders table as untyped text, the way a CSV
    export arrives. Some cells are dirtied (a word in a number column, blanks,
    a bad date) and some rows appear twice. It only shapes input; all cleaning
    work happens in ``tidemark.operators.cleaning``."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    # every 50th order appears twice: a per-row repeat count, one scan, no filter
    copies = F.explode(F.array_repeat(F.lit(1), F.when(k % 50 == 0, 2).otherwise(1)))
    raw = o.select(copies.alias("_copy"), "*").select(
        k.cast("string").alias(" Order Key "),
        F.col("o_custkey").cast("string").alias("Customer Key"),
        F.col("o_orderstatus").alias("Order Status"),
        F.when(k % 97 == 0, F.lit("oops")).when(k % 89 == 0, F.lit("  "))
         .otherwise(F.format_string("%.2f", "o_totalprice")).alias("Total Price"),
        F.when(k % 101 == 0, F.lit("not-a-date"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Order Date"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Created At"),
        F.when(k % 13 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("Order Priority"),
    )
    return raw


_DIRTY_ORDERS_SQL = """
WITH src AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS c_key, CAST(o_custkey AS VARCHAR) AS c_cust,
         o_orderstatus AS c_status,
         CASE WHEN o_orderkey % 97 = 0 THEN 'oops' WHEN o_orderkey % 89 = 0 THEN '  '
              ELSE printf('%.2f', o_totalprice) END AS c_price,
         CASE WHEN o_orderkey % 101 = 0 THEN 'not-a-date'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS c_date,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c_created,
         CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS c_priority
  FROM orders),
raw AS (SELECT * FROM src UNION ALL SELECT * FROM src WHERE CAST(c_key AS BIGINT) % 50 = 0),
typed AS (
  SELECT CAST(TRIM(c_key) AS BIGINT) AS order_key,
         CAST(TRIM(c_cust) AS BIGINT) AS customer_key,
         CASE WHEN regexp_matches(c_status, '^\\s*$') THEN NULL ELSE c_status END AS order_status,
         TRY_CAST(CASE WHEN regexp_matches(c_price, '^\\s*$') THEN NULL ELSE TRIM(c_price) END AS DOUBLE) AS total_price,
         CASE WHEN regexp_matches(c_date, '^\\s*$') THEN NULL ELSE c_date END AS order_date,
         strptime(c_created, '%Y-%m-%d %H:%M:%S') AS created_at,
         CASE WHEN regexp_matches(c_priority, '^\\s*$') THEN NULL ELSE c_priority END AS order_priority,
         (c_price IS NOT NULL AND NOT regexp_matches(c_price, '^\\s*$')
          AND TRY_CAST(TRIM(c_price) AS DOUBLE) IS NULL) AS type_issue,
         (c_date IS NOT NULL AND NOT regexp_matches(c_date, '^\\s*$')
          AND TRY_STRPTIME(c_date, '%Y-%m-%d') IS NULL) AS date_issue
  FROM raw)
"""


@register("clean_table", _DIRTY_ORDERS_SQL + """
SELECT order_key, customer_key, order_status, ROUND(total_price, 6) AS total_price, order_date,
       created_at, order_priority,
       (order_key IS NULL OR customer_key IS NULL OR order_status IS NULL OR total_price IS NULL
        OR order_date IS NULL OR created_at IS NULL OR order_priority IS NULL) AS has_nulls,
       bool_or(date_issue) AS invalid_date_parse, bool_or(type_issue) AS type_conversion_issue
FROM typed
GROUP BY order_key, customer_key, order_status, total_price, order_date, created_at, order_priority
""")
def clean_table(spark, sf):
    """Names, blanks, numeric casts, date parsing, dedup, flags."""
    from tidemark.operators.cleaning import clean
    return rounded(clean(dirty_orders(spark, sf)).df)


@register("cleaning_log", _DIRTY_ORDERS_SQL + """
SELECT 'column_normalization' AS step, 'normalize_column_names' AS action,
       ' Order Key ,Customer Key,Order Status,Total Price,Order Date,Created At,Order Priority' AS column_name,
       CAST(NULL AS BIGINT) AS rows_affected
UNION ALL
SELECT 'missing_value_standardization', 'replace_blank_with_null', 'total_price',
       COUNT(*) FROM raw WHERE regexp_matches(c_price, '^\\s*$')
UNION ALL
SELECT 'missing_value_standardization', 'replace_blank_with_null', 'order_priority',
       COUNT(*) FROM raw WHERE regexp_matches(c_priority, '^\\s*$')
UNION ALL SELECT 'type_enforcement', 'cast_to_numeric', 'order_key', NULL
UNION ALL SELECT 'type_enforcement', 'cast_to_numeric', 'customer_key', NULL
UNION ALL
SELECT 'type_enforcement', 'cast_to_numeric', 'total_price', COUNT(*) FROM typed WHERE type_issue
UNION ALL
SELECT 'date_parsing', 'skip_date_parse', 'order_date', COUNT(*) FROM typed WHERE date_issue
UNION ALL SELECT 'date_parsing', 'cast_to_datetime', 'created_at', NULL
UNION ALL
SELECT 'deduplication', 'remove_duplicate_rows', NULL,
       (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * EXCLUDE (type_issue, date_issue) FROM typed))
""")
def cleaning_log(spark, sf):
    """The decision log as a table."""
    from tidemark.operators.cleaning import clean
    return clean(dirty_orders(spark, sf)).log.drop("details")


@register("cleaning_summary", _DIRTY_ORDERS_SQL + """,
staged AS (
  SELECT order_key, customer_key, order_status, total_price, order_date, created_at, order_priority,
         bool_or(date_issue) AS invalid_date_parse, bool_or(type_issue) AS type_conversion_issue
  FROM typed
  GROUP BY order_key, customer_key, order_status, total_price, order_date, created_at, order_priority)
SELECT COUNT(*) AS row_count, CAST(7 AS BIGINT) AS column_count, CAST(7 AS BIGINT) AS input_column_count,
       (SELECT COUNT(*) FROM raw) - COUNT(*) AS duplicate_row_count,
       COUNT(*) FILTER (WHERE order_key IS NULL OR customer_key IS NULL OR order_status IS NULL
                        OR total_price IS NULL OR order_date IS NULL OR created_at IS NULL
                        OR order_priority IS NULL) AS rows_with_nulls,
       COUNT(*) FILTER (WHERE invalid_date_parse) AS rows_with_invalid_date_parse,
       COUNT(*) FILTER (WHERE type_conversion_issue) AS rows_with_type_conversion_issue
FROM staged
""")
def cleaning_summary(spark, sf):
    """One-row summary of the staging table."""
    from tidemark.operators.cleaning import clean
    return clean(dirty_orders(spark, sf)).summary()


@register("cleaning_null_counts", _DIRTY_ORDERS_SQL + """,
staged AS (
  SELECT DISTINCT order_key, customer_key, order_status, total_price, order_date, created_at,
         order_priority FROM typed)
SELECT column_name, null_count FROM (
  SELECT COUNT(*) FILTER (WHERE order_key IS NULL) AS order_key,
         COUNT(*) FILTER (WHERE customer_key IS NULL) AS customer_key,
         COUNT(*) FILTER (WHERE order_status IS NULL) AS order_status,
         COUNT(*) FILTER (WHERE total_price IS NULL) AS total_price,
         COUNT(*) FILTER (WHERE order_date IS NULL) AS order_date,
         COUNT(*) FILTER (WHERE created_at IS NULL) AS created_at,
         COUNT(*) FILTER (WHERE order_priority IS NULL) AS order_priority
  FROM staged) UNPIVOT (null_count FOR column_name IN (order_key, customer_key, order_status,
       total_price, order_date, created_at, order_priority))
""")
def cleaning_null_counts(spark, sf):
    """NULL count per staged column."""
    from tidemark.operators.cleaning import clean
    return clean(dirty_orders(spark, sf)).null_counts()


# ------------------------------------------ B10, B17, C18, D2-D6, C10, C12, C13
def _yearly_inputs(spark, sf):
    from tidemark.operators.integrate import standardize
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("order_year"), "o_totalprice", "o_orderkey")
    items = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("bigint").alias("ship_year"), "l_extendedprice")
    events = table(spark, sf, "events").select(
        F.year("ts").cast("bigint").alias("event_year"), "value")
    return [standardize(orders, "orders", "order_year", "o_totalprice"),
            standardize(items, "lineitem", "ship_year", "l_extendedprice"),
            standardize(events, "events", "event_year", "value")]


def integrated_wide_table(spark, sf) -> DataFrame:
    from tidemark.operators.integrate import integrate
    return integrate(_yearly_inputs(spark, sf)).wide


_LONG_SQL = """
WITH long AS (
  SELECT CAST(CAST(ROUND(CAST(year(o_orderdate) AS DOUBLE)) AS BIGINT) AS VARCHAR) AS year,
         'orders' AS dataset_name, o_totalprice AS v FROM orders
  UNION ALL SELECT CAST(CAST(year(l_shipdate) AS BIGINT) AS VARCHAR), 'lineitem', l_extendedprice FROM lineitem
  UNION ALL SELECT CAST(CAST(year(ts) AS BIGINT) AS VARCHAR), 'events', value FROM events),
wide AS (
  SELECT year, AVG(v) FILTER (WHERE dataset_name = 'events') AS events,
         AVG(v) FILTER (WHERE dataset_name = 'lineitem') AS lineitem,
         AVG(v) FILTER (WHERE dataset_name = 'orders') AS orders
  FROM long GROUP BY year)
"""


@register("integrated_wide", _LONG_SQL + """
SELECT year, ROUND(events, 6) AS events, ROUND(lineitem, 6) AS lineitem, ROUND(orders, 6) AS orders
FROM wide
""")
def integrated_wide(spark, sf):
    return rounded(integrated_wide_table(spark, sf))


@register("integrated_trend", _LONG_SQL + """
SELECT year, COUNT(orders) AS record_count, ROUND(AVG(orders), 6) AS avg_orders
FROM wide GROUP BY year HAVING COUNT(orders) > 0
""")
def integrated_trend(spark, sf):
    return rounded(marts.integrated_trend_mart(integrated_wide_table(spark, sf), "orders", "average"))


@register("ranked_periods", _LONG_SQL + """
SELECT year, record_count, ROUND(total_lineitem, 6) AS total_lineitem FROM (
  SELECT year, COUNT(lineitem) AS record_count, COALESCE(SUM(lineitem), 0) AS total_lineitem
  FROM wide GROUP BY year ORDER BY total_lineitem DESC, year LIMIT 10)
""")
def ranked_periods(spark, sf):
    return rounded(marts.ranked_periods_mart(integrated_wide_table(spark, sf), "lineitem", "sum"))


@register("by_decade", _LONG_SQL + """
SELECT CAST(FLOOR(CAST(TRY_CAST(year AS DOUBLE) AS BIGINT) / 10) * 10 AS BIGINT) AS decade,
       COUNT(orders) AS record_count, ROUND(AVG(orders), 6) AS avg_orders
FROM wide WHERE TRY_CAST(year AS DOUBLE) IS NOT NULL GROUP BY 1
""")
def by_decade(spark, sf):
    return rounded(marts.decade_mart(integrated_wide_table(spark, sf), "orders", "average"))


@register("integrated_correlation", _LONG_SQL + """
SELECT left_metric, right_metric, ROUND(correlation, 6) AS correlation FROM (
  SELECT 'lineitem' AS left_metric, 'orders' AS right_metric, CORR(lineitem, orders) AS correlation FROM wide)
WHERE correlation IS NOT NULL AND NOT isnan(correlation)
""")
def integrated_correlation(spark, sf):
    """C11 on the integrated table: 'events' has one year only, so its pairs
    have no correlation and are dropped (S9)."""
    wide = integrated_wide_table(spark, sf)
    return rounded(marts.correlation_mart(wide, ["events", "lineitem", "orders"]))


# ---------------------------------------------------------------------- F12
@register("coverage", """
SELECT 'orders' AS dataset, CAST(MIN(year(o_orderdate)) AS BIGINT) AS min_year,
       CAST(MAX(year(o_orderdate)) AS BIGINT) AS max_year FROM orders
UNION ALL
SELECT 'events', CAST(MIN(year(ts)) AS BIGINT), CAST(MAX(year(ts)) AS BIGINT) FROM events
UNION ALL
SELECT 'lineitem_text', CAST(MIN(year(l_shipdate)) AS BIGINT), CAST(MAX(year(l_shipdate)) AS BIGINT) FROM lineitem
""")
def coverage(spark, sf):
    from tidemark.operators.integrate import coverage as cov
    orders = cov(table(spark, sf, "orders"), "o_orderdate").select(F.lit("orders").alias("dataset"), "*")
    events = cov(table(spark, sf, "events"), "ts").select(F.lit("events").alias("dataset"), "*")
    text = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_text"))
    items = cov(text, "ship_text").select(F.lit("lineitem_text").alias("dataset"), "*")
    return orders.unionByName(events).unionByName(items)


# -------------------------------------------------------------- A7, F1-F6
_CUSTOMER_COLS = [("c_custkey", True), ("c_name", False), ("c_nationkey", True),
                  ("c_acctbal", True), ("c_mktsegment", False)]


@register("schema_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, COUNT(*) FILTER (WHERE {c} IS NULL) > 0 AS nullable, "
    f"COUNT(*) AS row_count, CAST(5 AS BIGINT) AS column_count FROM customer"
    for c, t in [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")]))
def schema_summary(spark, sf):
    from tidemark.operators.quality import schema_summary as summary
    return summary(table(spark, sf, "customer"))


@register("profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, "
    f"ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100, 2) AS null_percentage, "
    f"COUNT(DISTINCT {c}) AS unique_count, "
    + (f"ROUND(CAST(MIN({c}) AS DOUBLE), 6) AS min, ROUND(CAST(MAX({c}) AS DOUBLE), 6) AS max "
       if num else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max ")
    + "FROM customer" for c, num in _CUSTOMER_COLS))
def profile(spark, sf):
    """F1 without the sample values (hash-chosen; checked in the tests)."""
    from tidemark.operators.quality import profile as prof
    return rounded(prof(table(spark, sf, "customer")).drop("sample_values", "dtype"))


def _dq_sql(cols) -> str:
    parts = []
    for c, num in cols:
        if num:
            outlier = (f"(SELECT CASE WHEN COUNT({c}) >= 4 AND STDDEV_SAMP({c}) <> 0 THEN "
                       f"(SELECT COUNT(*) FROM customer x, (SELECT AVG({c}) m, STDDEV_SAMP({c}) s FROM customer) p "
                       f"WHERE abs(x.{c} - p.m) > 3 * p.s) / COUNT({c}) > 0.05 ELSE false END FROM customer)")
        else:
            outlier = "false"
        parts.append(
            f"SELECT '{c}' AS column_name, ROUND(CAST(COUNT({c}) AS DOUBLE) / COUNT(*) * 100, 1) AS completeness, "
            f"CASE WHEN COUNT({c}) = 0 THEN CAST(100.0 AS DOUBLE) ELSE "
            f"ROUND(CAST(COUNT(DISTINCT {c}) AS DOUBLE) / COUNT({c}) * 100, 1) END AS uniqueness, "
            f"{outlier} AS outlier_flag, CAST(100.0 AS DOUBLE) AS format_score FROM customer")
    return ("WITH s AS (" + " UNION ALL ".join(parts) + ") SELECT column_name, completeness, uniqueness, "
            "outlier_flag, format_score, ROUND(completeness * 0.4 + uniqueness * 0.2 + format_score * 0.4, 1) "
            "AS dq_score FROM s")


@register("dq_score", _dq_sql(_CUSTOMER_COLS))
def dq_score(spark, sf):
    from tidemark.operators.quality import dq_scores
    return dq_scores(table(spark, sf, "customer")).drop("dtype", "dominant_class_share")


@register("dq_overall", "SELECT ROUND(AVG(dq_score), 1) AS overall_score, COUNT(*) AS column_count FROM ("
          + _dq_sql(_CUSTOMER_COLS) + ")")
def dq_overall(spark, sf):
    from tidemark.operators.quality import dq_overall as overall, dq_scores
    return overall(dq_scores(table(spark, sf, "customer")))


# ------------------------------------------------------------------ F7-F11
_ANOMALY_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"]


def _anomaly_rules_sql(cols, tbl="events") -> str:
    stats = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS col, COUNT({c}) AS n, QUANTILE_CONT({c}, 0.25) AS q1, "
        f"QUANTILE_CONT({c}, 0.75) AS q3, AVG({c}) AS m, STDDEV_POP({c}) AS s FROM {tbl}"
        for i, c in enumerate(cols))
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, COUNT(*) FILTER (WHERE b.q3 - b.q1 <> 0 AND ({c} < b.lo OR {c} > b.hi)) AS iqr_n, "
        f"COUNT(*) FILTER (WHERE b.s <> 0 AND abs(({c} - b.m) / b.s) > 3.0) AS z_n "
        f"FROM {tbl}, b WHERE b.col = '{c}'" for c in cols)
    return f"""
WITH st AS ({stats}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM st WHERE n >= 4),
cnt AS ({counts}),
rules AS (
  SELECT b.pos, b.col AS "column", b.lo, b.hi, b.m, b.s,
         CASE WHEN cnt.iqr_n > 0 THEN 'iqr' WHEN cnt.z_n > 0 THEN 'zscore' END AS method,
         CASE WHEN cnt.iqr_n > 0 THEN printf('%.4f to %.4f', b.lo, b.hi) ELSE '|z| > 3.0' END AS threshold,
         CASE WHEN cnt.iqr_n > 0 THEN cnt.iqr_n ELSE cnt.z_n END AS anomaly_count
  FROM b JOIN cnt ON cnt.col = b.col)
"""


_EVENT_COLS = ["event_id", "user_id", "value"]


@register("anomaly_report", _anomaly_rules_sql(_EVENT_COLS)
          + "SELECT \"column\", method, threshold, anomaly_count FROM rules WHERE method IS NOT NULL")
def anomaly_report(spark, sf):
    """F7, F8, F10 (examples are row-order dependent and checked in the tests)."""
    from tidemark.operators.anomaly import detect_anomalies
    return detect_anomalies(table(spark, sf, "events")).report.drop("example_values")


@register("anomaly_report_lineitem", _anomaly_rules_sql(_ANOMALY_COLS, "lineitem")
          + "SELECT \"column\", method, threshold, anomaly_count FROM rules WHERE method IS NOT NULL")
def anomaly_report_lineitem(spark, sf):
    """F7-F10 on eight numeric columns where neither rule fires (empty report)."""
    from tidemark.operators.anomaly import detect_anomalies
    return detect_anomalies(table(spark, sf, "lineitem")).report.drop("example_values")


def _flag_sql(cols) -> str:
    cases = []
    for c in cols:
        r = f"(SELECT * FROM rules WHERE \"column\" = '{c}' AND method IS NOT NULL)"
        cases.append(
            f"CASE WHEN EXISTS {r} AND ((SELECT method FROM rules WHERE \"column\" = '{c}') = 'iqr' AND "
            f"({c} < (SELECT lo FROM rules WHERE \"column\" = '{c}') OR {c} > (SELECT hi FROM rules WHERE \"column\" = '{c}')) "
            f"OR (SELECT method FROM rules WHERE \"column\" = '{c}') = 'zscore' AND "
            f"abs(({c} - (SELECT m FROM rules WHERE \"column\" = '{c}')) / (SELECT s FROM rules WHERE \"column\" = '{c}')) > 3.0) "
            f"THEN '{c}' END")
    return "concat_ws(',', " + ", ".join(cases) + ")"


@register("anomaly_rows", _anomaly_rules_sql(_EVENT_COLS)
          + f", flagged AS (SELECT event_id, event_type, {_flag_sql(_EVENT_COLS)} AS anomaly_columns "
          "FROM events) SELECT event_id, event_type, anomaly_columns, true AS has_anomaly "
          "FROM flagged WHERE anomaly_columns <> ''")
def anomaly_rows(spark, sf):
    """the flagged rows with the list of flagged columns."""
    from tidemark.operators.anomaly import detect_anomalies
    res = detect_anomalies(table(spark, sf, "events"))
    return res.flagged_rows.select("event_id", "event_type", "anomaly_columns", "has_anomaly")


_ACTION_SQL = "CASE impact " + " ".join(
    f"WHEN '{tier}' THEN printf('{text}', \"column\", method)" for tier, text in ADVICE.items()) + " END"

_FRAMED_SQL = _anomaly_rules_sql(_EVENT_COLS) + """
, f AS (SELECT pos, "column", method, threshold, anomaly_count,
              CAST(anomaly_count AS DOUBLE) / (SELECT COUNT(*) FROM events) AS fr
       FROM rules WHERE method IS NOT NULL),
framed AS (SELECT pos, "column", method, threshold, anomaly_count, ROUND(fr, 4) AS frequency,
                  CASE WHEN fr >= 0.10 THEN 'high' WHEN fr >= 0.02 THEN 'medium' ELSE 'low' END AS impact
           FROM f)
"""


@register("anomaly_framing", _FRAMED_SQL + f"""
SELECT "column", method, threshold, anomaly_count, frequency, impact, {_ACTION_SQL} AS suggested_action
FROM framed
""")
def anomaly_framing(spark, sf):
    """F11 per column: frequency, impact tier and the suggested action."""
    from tidemark.operators.anomaly import detect_anomalies, frame_anomalies
    res = detect_anomalies(table(spark, sf, "events"))
    return frame_anomalies(res.report, res.total_rows).drop("example_values")


@register("anomaly_summary", _FRAMED_SQL + f""",
flagged AS (SELECT {_flag_sql(_EVENT_COLS)} AS anomaly_columns FROM events),
counts AS (SELECT COUNT(*) FILTER (WHERE anomaly_columns <> '') AS a, COUNT(*) AS t FROM flagged),
tiers AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE impact = 'high') AS high,
                 COUNT(*) FILTER (WHERE impact = 'medium') AS medium,
                 string_agg(CASE WHEN impact = 'high' THEN '`' || "column" || '`' END, ', ' ORDER BY pos) AS high_cols,
                 string_agg(CASE WHEN impact = 'medium' THEN '`' || "column" || '`' END, ', ' ORDER BY pos) AS medium_cols
          FROM framed)
SELECT a AS anomaly_row_count, t AS total_row_count,
       CASE WHEN n = 0 OR a = 0 THEN 'No anomalies were detected.'
            ELSE printf('%d rows (%s%%) hold anomalies; ', a, CAST(ROUND(100.0 * a / t, 1) AS VARCHAR))
                 || CASE WHEN high > 0 THEN 'high-impact columns: ' || high_cols
                         WHEN medium > 0 THEN 'medium-impact columns: ' || medium_cols
                         ELSE printf('low-frequency in %d column(s)', n) END END AS business_summary
FROM counts, tiers
""")
def anomaly_summary(spark, sf):
    """the one-sentence summary over the framed report."""
    from tidemark.operators.anomaly import business_summary, detect_anomalies, frame_anomalies
    res = detect_anomalies(table(spark, sf, "events"))
    framed = frame_anomalies(res.report, res.total_rows)
    return business_summary(framed, res.anomaly_row_count(), res.total_rows)


# ------------------------------------------------ A12-A18, B9, B11-B14, C19
@register("yearly_sum", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, ROUND(SUM(o_totalprice), 6) AS total_price,
       printf('%04d-01', CAST(year(o_orderdate) AS BIGINT)) AS date
FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1997 GROUP BY 1
""")
def yearly_sum(spark, sf):
    """A18 + B9: dates as text are coerced to years, windowed, summed."""
    from tidemark.operators.series import yearly_series
    orders = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"), "o_totalprice")
    return rounded(yearly_series(orders, "total_price", "order_day", "sum", "o_totalprice",
                                 min_year=1993, max_year=1997))


@register("yearly_avg", """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, ROUND(AVG(l_quantity), 6) AS avg_quantity,
       printf('%04d-01', CAST(year(l_shipdate) AS BIGINT)) AS date
FROM lineitem GROUP BY 1
""")
def yearly_avg(spark, sf):
    """A18 + B9 numeric path: a fractional year is rounded half to even."""
    from tidemark.operators.series import yearly_series
    items = table(spark, sf, "lineitem").select(
        (F.year("l_shipdate") + F.lit(0.3)).alias("ship_year"), "l_quantity")
    return rounded(yearly_series(items, "avg_quantity", "ship_year", "average", "l_quantity"))


@register("yearly_count", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, COUNT(o_totalprice) AS order_count,
       printf('%04d-01', CAST(year(o_orderdate) AS BIGINT)) AS date
FROM orders GROUP BY 1
""")
def yearly_count(spark, sf):
    from tidemark.operators.series import yearly_series
    return yearly_series(table(spark, sf, "orders"), "order_count", "o_orderdate", "count",
                         "o_totalprice")


@register("yearly_distinct", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, COUNT(DISTINCT item) AS distinct_labels,
       printf('%04d-01', CAST(year(o_orderdate) AS BIGINT)) AS date
FROM (SELECT o_orderdate, UNNEST([o_orderpriority, o_orderstatus]) AS item FROM orders)
GROUP BY 1
""")
def yearly_distinct(spark, sf):
    """A18 count_distinct + B13 list cells + C19: list literals in a text cell."""
    from tidemark.operators.series import yearly_series
    orders = table(spark, sf, "orders").select(
        "o_orderdate",
        F.format_string("['%s', '%s']", "o_orderpriority", "o_orderstatus").alias("labels"))
    return yearly_series(orders, "distinct_labels", "o_orderdate", "count_distinct",
                         entity_column="labels", list_cells=True)


@register("entity_filter", """
SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice,
       CAST(1 AS BIGINT) AS month, printf('%04d-01', CAST(year(o_orderdate) AS BIGINT)) AS date
FROM orders WHERE o_orderstatus = 'F'
""")
def entity_filter(spark, sf):
    """One entity's rows with a numeric year, month 1 and a label."""
    from tidemark.operators.series import entity_series
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("double").alias("year"),
        "o_totalprice", "o_orderpriority")
    return entity_series(orders, "o_orderstatus", "F", "year",
                         ["o_orderkey", "o_orderstatus", "year", "o_totalprice"])


@register("indicator_series", """
SELECT o_orderpriority AS country_name, o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year,
       o_totalprice AS urgent_price, printf('%04d-01', CAST(year(o_orderdate) AS BIGINT)) AS date
FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def indicator_series(spark, sf):
    """Configurable country/year/value columns, text values cast."""
    from tidemark.operators.series import indicator_series as ind
    raw = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Country Name"), "o_orderkey",
        F.year("o_orderdate").cast("string").alias("Year"),
        F.format_string("%.2f", "o_totalprice").alias("Value"))
    return ind(raw, "urgent_price", country_value="1-URGENT")


@register("json_records", """
SELECT event_id, event_type AS "Country Name", 'U' || CAST(user_id AS VARCHAR) AS "Country Code",
       'event value' AS "Indicator Name", 'EV' AS "Indicator Code",
       strftime(ts, '%Y-%m-%d') AS "Year", value AS "Value"
FROM events
""")
def json_records(spark, sf):
    """A ``[meta, [records]]`` feed per event, with one non-object record
    that is skipped."""
    from tidemark.operators.series import json_feed_records
    ev = table(spark, sf, "events")
    feed = F.format_string(
        '[{"page": 1, "pages": 1}, [{"country": {"id": "U%d", "value": "%s"}, '
        '"indicator": {"id": "EV", "value": "event value"}, "date": "%s", "value": %s}, 7]]',
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd"), F.col("value").cast("string"))
    return json_feed_records(ev.select("event_id", feed.alias("value")))


@register("decimal_year", """
WITH d AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) + l_discount AS y FROM lineitem),
e AS (SELECT l_orderkey, l_linenumber,
             make_date(CAST(floor(y) AS INTEGER), 1, 1)
               + CAST(round_even((y - floor(y)) * 365.2425, 0) AS INTEGER) AS observed FROM d)
SELECT l_orderkey, l_linenumber, CAST(year(observed) AS BIGINT) AS year,
       CAST(month(observed) AS BIGINT) AS month, strftime(observed, '%Y-%m-%d') AS day
FROM e
""")
def decimal_year(spark, sf):
    """Decimal years to dates."""
    from tidemark.functions.exprs import decimal_year_to_date
    items = table(spark, sf, "lineitem")
    d = decimal_year_to_date(F.year("l_shipdate") + F.col("l_discount"))
    return items.select("l_orderkey", "l_linenumber", F.year(d).cast("bigint").alias("year"),
                        F.month(d).cast("bigint").alias("month"),
                        F.date_format(d, "yyyy-MM-dd").alias("day"))


@register("monthly_extent", """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
       'lineitem' AS source_dataset, l_returnflag AS region, l_quantity AS ice_extent,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS area,
       printf('%04d-%02d', year(l_shipdate), month(l_shipdate)) AS date
FROM lineitem WHERE l_tax <> 0
""")
def monthly_extent(spark, sf):
    """A15 + B14 + D3: several same-shape tables with messy headers unioned,
    sentinels to NULL, rows without a value dropped."""
    from tidemark.operators.series import monthly_extent as extent
    items = table(spark, sf, "lineitem")
    is_open = F.col("l_linestatus").eqNullSafe(F.lit("O"))
    def frame(open_rows):
        part = items.where(is_open if open_rows else ~is_open)
        return part.select(
            F.year("l_shipdate").cast("bigint").alias("year"),
            F.month("l_shipdate").cast("bigint").alias(" mo"),
            F.lit("lineitem").alias("source_dataset"), F.col("l_returnflag").alias(" region"),
            F.when(F.col("l_tax") == 0, F.lit(-9999.0)).otherwise(F.col("l_quantity")).alias(" extent"),
            F.when(F.col("l_discount") == 0, F.lit(-9999.0)).otherwise(F.col("l_extendedprice")).alias("   area"))
    return extent([frame(True), frame(False)])


@register("text_series", """
SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month,
       value AS temperature_anomaly, CAST(user_id AS DOUBLE) AS monthly_uncertainty,
       CAST(NULL AS DOUBLE) AS annual_temperature_anomaly, CAST(NULL AS DOUBLE) AS annual_uncertainty,
       CAST(NULL AS DOUBLE) AS five_year_temperature_anomaly, CAST(NULL AS DOUBLE) AS five_year_uncertainty,
       CAST(NULL AS DOUBLE) AS ten_year_temperature_anomaly, CAST(NULL AS DOUBLE) AS ten_year_uncertainty,
       CAST(NULL AS DOUBLE) AS twenty_year_temperature_anomaly, CAST(NULL AS DOUBLE) AS twenty_year_uncertainty,
       printf('%04d-%02d', year(ts), month(ts)) AS date, 'berkeley_earth' AS source
FROM events WHERE event_type <> 'error'
""")
def text_series(spark, sf):
    """Whitespace lines with % comment lines (error events become comments)."""
    from tidemark.operators.series import whitespace_series
    ev = table(spark, sf, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("% note "), F.col("props"))) \
        .otherwise(F.format_string("  %d  %d  %s  %d", F.year("ts"), F.month("ts"),
                                   F.col("value").cast("string"), F.col("user_id")))
    return whitespace_series(ev.select(line.alias("value")))


@register("page_arrays", """
WITH pages AS (SELECT l_orderkey, l_linenumber, 1990 + l_orderkey % 30 AS y, l_quantity AS q, l_extendedprice AS p,
                      l_partkey % 7 = 0 AS bad, l_partkey % 7 = 1 AS uneven FROM lineitem),
points AS (SELECT l_orderkey, l_linenumber, CAST(y AS DOUBLE) AS year_decimal, make_date(CAST(y AS INTEGER), 1, 1) AS d,
                  q AS sea_level FROM pages WHERE NOT bad AND NOT uneven
           UNION ALL SELECT l_orderkey, l_linenumber, y + 0.5, make_date(CAST(y AS INTEGER), 1, 1) + 183, p
           FROM pages WHERE NOT bad AND NOT uneven)
SELECT l_orderkey, l_linenumber, year_decimal, CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month,
       strftime(d, '%Y-%m') AS date, sea_level, 'nasa_satellite_altimetry' AS source, CAST(NULL AS VARCHAR) AS error
FROM points
UNION ALL
SELECT l_orderkey, l_linenumber, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN uneven THEN 'arrays differ in length' ELSE 'an array item is not a number' END
FROM pages WHERE bad OR uneven
""")
def page_arrays(spark, sf):
    """One page of several lines per line item, its two arrays zipped; pages
    with an item that is no number or with uneven arrays give an error row."""
    from tidemark.operators.series import page_arrays as arrays
    items = table(spark, sf, "lineitem")
    year = (1990 + F.col("l_orderkey") % 30).cast("string")
    html = F.concat(
        F.lit("<script>\nvar chart_x = [\n\t"), year, F.lit(".0,\n\u00a0"), year, F.lit(".5,\n];\nvar chart_y = [\n"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit("oops")).otherwise(F.col("l_quantity").cast("string")),
        F.when(F.col("l_partkey") % 7 == 1, F.lit("")).otherwise(
            F.concat(F.lit(",\r\n"), F.col("l_extendedprice").cast("string"))),
        F.lit("\n];\nvar chart_z = 1;</script>"))
    return arrays(items.select("l_orderkey", "l_linenumber", html.alias("html")))


@register("sql_export", """
SELECT printf('(%d, ''%s'', %d)', n_nationkey, replace(n_name, chr(39), chr(39) || chr(39)), n_regionkey) AS row_sql
FROM nation
UNION ALL
SELECT printf('(%d, ''%s'', %s, ''%s'')', o_orderkey, o_orderstatus,
              CASE WHEN o_orderkey % 3 = 1 THEN chr(39) || 'Infinity' || chr(39) ELSE 'NULL' END,
              strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.000000+00') FROM orders
""")
def sql_export(spark, sf):
    """Every row as an SQL ``VALUES`` tuple: text, numbers, NaN, infinity, NULL and timestamps."""
    from tidemark.sources.sinks import value_tuples
    nation = table(spark, sf, "nation")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 3 == 1, F.lit(float("inf")))
        .alias("x"), "o_orderdate")
    return nation.select(value_tuples(nation).alias("row_sql")).unionByName(
        orders.select(value_tuples(orders).alias("row_sql")))


@register("sql_insert", """
WITH v AS (
  SELECT printf('(%d, ''%s'', %s, ''%s'')', o_orderkey, o_orderstatus,
                CASE WHEN o_orderkey % 3 = 0 THEN 'NULL' ELSE CAST(o_custkey AS VARCHAR) END,
                strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.000000+00') AS row_sql, o_orderstatus AS s FROM orders),
n AS (SELECT row_sql, row_number() OVER (ORDER BY s, row_sql) - 1 AS n FROM v)
SELECT n // 500 AS batch, 'INSERT INTO "orders" ("order_key", "order_status", "customer", "order_date") VALUES' || chr(10)
       || string_agg(row_sql, ',' || chr(10) ORDER BY n) || ';' AS statement
FROM n GROUP BY 1
""")
def sql_insert(spark, sf):
    """The INSERT statements of a whole table, 500 rows each, in the order of a column."""
    from tidemark.sources.sinks import insert_statements
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("order_status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("customer"), F.col("o_orderdate").alias("order_date"))
    return insert_statements(orders, "orders", order_by=["order_status"])


# --------------------------------------------------- raw input as it arrives
@register("clean_whitespace", """
SELECT DISTINCT o_orderkey AS order_key, o_totalprice AS total_price,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority,
       o_orderkey % 5 = 0 AS has_nulls, false AS invalid_date_parse, false AS type_conversion_issue
FROM orders
""")
def clean_whitespace(spark, sf):
    """Numbers between tabs, no-break spaces and line ends; blanks of other white space."""
    from tidemark.operators.cleaning import clean
    orders = table(spark, sf, "orders")
    edge = F.element_at(F.array(*[F.lit(x) for x in ("\t", "\u00a0", " ", "\u2003\n", "")]),
                        (F.col("o_orderkey") % 5 + 1).cast("int"))
    raw = orders.select(
        F.concat(edge, F.col("o_orderkey").cast("string"), edge).alias("Order Key"),
        F.concat(F.lit("\u3000"), F.col("o_totalprice").cast("string"), F.lit("\r\n")).alias("Total Price"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("\u00a0\t")).otherwise(F.col("o_orderpriority")).alias("Priority"))
    return clean(raw).df


@register("clean_dates", """
SELECT DISTINCT o_orderkey AS order_key, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS order_date,
       CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS named_date,
       CAST(date_trunc('minute', o_orderdate) AS TIMESTAMP) AS clock_timestamp, CAST(NULL AS TIMESTAMP) AS empty_date,
       true AS has_nulls, false AS invalid_date_parse, false AS type_conversion_issue
FROM orders
""")
def clean_dates(spark, sf):
    """Unpadded dates, month names, twelve-hour clocks and a date column without a value."""
    from tidemark.operators.cleaning import clean
    orders = table(spark, sf, "orders")
    raw = orders.select(
        F.col("o_orderkey").alias("Order Key"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("Order Date"),
        F.concat(F.lit(" "), F.date_format("o_orderdate", "d-MMM-yyyy")).alias("Named Date"),
        F.date_format("o_orderdate", "M/d/yyyy h:mm a").alias("Clock Timestamp"),
        F.lit("  ").alias("Empty Date"))
    return clean(raw).df


@register("typed_text", """
SELECT s_suppkey AS k, s_acctbal AS balance, s_suppkey % 2 = 0 AS flag, 'n' || s_nationkey AS label FROM supplier
""")
def typed_text(spark, sf):
    """A1: text columns get the type that all their values have."""
    from tidemark.sources.readers import type_text_columns
    s = table(spark, sf, "supplier")
    return type_text_columns(s.select(
        F.concat(F.lit("\t"), F.col("s_suppkey").cast("string")).alias("k"), F.col("s_acctbal").cast("string").alias("balance"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(" TRUE")).otherwise(F.lit("false")).alias("flag"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("label")))


@register("list_cells", """
WITH cells AS (SELECT p_partkey, unnest(CASE p_partkey % 5 WHEN 0 THEN [p_brand, p_name] WHEN 1 THEN [p_brand, 'True', '7']
                                        WHEN 2 THEN [p_brand] WHEN 3 THEN [p_name] ELSE CAST([] AS VARCHAR[]) END) AS item FROM part)
SELECT item, COUNT(*) AS parts FROM cells GROUP BY item
""")
def list_cells(spark, sf):
    """List, tuple and set cells with None, bare words and trailing commas; a plain text is one item."""
    from tidemark.functions.exprs import list_cell_items
    part = table(spark, sf, "part")
    brand, name = F.col("p_brand"), F.col("p_name")
    cell = (F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("['"), brand, F.lit("', None, \""), name, F.lit("\"]")))
             .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("('"), brand, F.lit("', True, 7, ' ')")))
             .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit(" {'"), brand, F.lit("',}")))
             .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("\t"), name)).otherwise(F.lit("[]")))
    return part.select(F.explode(list_cell_items(cell)).alias("item")).groupBy("item").agg(F.count("*").alias("parts"))


@register("half_years", """
SELECT CAST(CAST(round_even(1990 + (event_id % 60) / 2.0, 0) AS BIGINT) AS VARCHAR) AS year,
       COUNT(*) AS row_count, ROUND(SUM(value), 6) AS total
FROM events GROUP BY 1
""")
def half_years(spark, sf):
    """Year numbers at the half go to the even year."""
    from tidemark.operators.integrate import standardize
    ev = table(spark, sf, "events").select((1990 + (F.col("event_id") % 60) / 2).alias("t"), "value")
    std = standardize(ev, "events", "t", "value").df
    return std.groupBy("year").agg(F.count("*").alias("row_count"), F.round(F.sum("source_metric_value"), 6).alias("total"))


@register("json_text_values", """
SELECT event_id, user_id % 3 = 2 OR value IS NULL AS missing, CASE WHEN user_id % 3 < 2 THEN value END AS "Value" FROM events
""")
def json_text_values(spark, sf):
    """Values given as numbers, as text with white space, and as a word."""
    from tidemark.operators.series import json_feed_records
    ev = table(spark, sf, "events")
    number = F.col("value").cast("string")
    given = F.when(F.col("user_id") % 3 == 0, number).when(
        F.col("user_id") % 3 == 1, F.concat(F.lit('" '), number, F.lit('\\t"'))).otherwise(F.lit('"n/a"'))
    feed = F.concat(F.lit('[{"page": 1}, [{"country": {"id": "a", "value": "b"}, "date": "2020", "value": '), given, F.lit("}]]"))
    out = json_feed_records(ev.select("event_id", feed.alias("value")))
    return out.select("event_id", F.col("Value").isNull().alias("missing"), "Value")


# ------------------------------------------------------------------------- sets of marts
def _set_sizes(built: dict[str, DataFrame]) -> DataFrame:
    """(mart, mart_rows, records): the size of each mart and the sum of its counts."""
    sizes = [mart.agg(F.lit(name).alias("mart"), F.count("*").alias("mart_rows"),
                      (F.sum("record_count") if "record_count" in mart.columns else F.lit(None)).cast("bigint")
                      .alias("records")) for name, mart in built.items()]
    return reduce(DataFrame.unionByName, sizes)


@register("mart_set", """
WITH n AS (SELECT COUNT(*) AS r, COUNT(DISTINCT o_orderpriority) AS p, COUNT(DISTINCT o_orderdate) AS d,
                  COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS days, LEAST(10, COUNT(DISTINCT o_totalprice)) AS b FROM orders)
SELECT 'mart_question_answer' AS mart, p AS mart_rows, CAST(r AS BIGINT) AS records FROM n
UNION ALL SELECT 'mart_top_entities', LEAST(p, 20), r FROM n
UNION ALL SELECT 'mart_catalog_summary', p, r FROM n
UNION ALL SELECT 'mart_distribution', b, r FROM n
UNION ALL SELECT 'mart_summary_stats', 1, NULL FROM n
UNION ALL SELECT 'mart_time_trend', days, r FROM n
""")
def mart_set(spark, sf):
    """C17: the marts that a question and the columns of a table allow."""
    from tidemark.plans.mart_sets import available_marts
    from tidemark.plans.question import resolve
    orders = readable(spark, sf, "orders")
    built, _ = available_marts(orders, resolve(orders, "Which order priorities generate the highest average price?"))
    return _set_sizes(built)


@register("mart_set_skipped", """
SELECT unnest(['mart_distribution', 'mart_summary_stats']) AS mart, COUNT(*) AS table_rows FROM lineitem
""")
def mart_set_skipped(spark, sf):
    """C17: the marts that a counting question skips, beside the rows it counts."""
    from tidemark.plans.mart_sets import available_marts
    from tidemark.plans.question import resolve
    items = readable(spark, sf, "lineitem")
    built, skipped = available_marts(items, resolve(items, "Count the line items for each return flag"))
    names = spark.createDataFrame([(name,) for name, _ in skipped], "mart string")
    total = built["mart_question_answer"].agg(F.sum("record_count")).first()[0]
    return names.withColumn("table_rows", F.lit(total).cast("bigint"))


# ---------------------------------------------------------------- marts over input with NULLs
def _sparse_customers(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_mktsegment") != "BUILDING"), F.col("c_acctbal")).alias("balance"))


_SPARSE_SQL = """
WITH c AS (SELECT CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS segment,
                  CASE WHEN c_custkey % 3 <> 0 AND c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance FROM customer)
"""


@register("sparse_catalog", _SPARSE_SQL + """
SELECT segment, COUNT(*) AS record_count, ROUND(COALESCE(SUM(balance), 0), 6) AS total_balance,
       ROUND(AVG(balance), 6) AS avg_balance FROM c GROUP BY segment
""")
def sparse_catalog(spark, sf):
    """C6 over NULL keys, NULL values and a group without a value: rows are counted."""
    return rounded(marts.catalog_summary_mart(_sparse_customers(spark, sf), "segment", "balance"))


@register("sparse_provider", _SPARSE_SQL + """
SELECT segment, COUNT(balance) AS record_count, ROUND(COALESCE(SUM(balance), 0), 6) AS total_balance,
       ROUND(AVG(balance), 6) AS avg_balance FROM c GROUP BY segment
""")
def sparse_provider(spark, sf):
    """C5 over the same input: values are counted."""
    return rounded(marts.provider_performance_mart(_sparse_customers(spark, sf), "balance", provider_column="segment"))


@register("sparse_schema", _SPARSE_SQL + """
SELECT 'segment' AS column_name, 'string' AS dtype, COUNT(segment) < COUNT(*) AS nullable, COUNT(*) AS row_count,
       CAST(2 AS BIGINT) AS column_count FROM c
UNION ALL SELECT 'balance', 'double', COUNT(balance) < COUNT(*), COUNT(*), 2 FROM c
""")
def sparse_schema(spark, sf):
    """Nullability as observed."""
    from tidemark.operators.quality import schema_summary as summary
    return summary(_sparse_customers(spark, sf))


@register("anomaly_zscore", """
WITH v AS (SELECT CASE WHEN l_orderkey % 101 = 0 AND l_linenumber = 1 THEN l_quantity * 1000 ELSE 5.0 END AS x FROM lineitem),
s AS (SELECT AVG(x) AS m, STDDEV_POP(x) AS sd FROM v)
SELECT 'x' AS "column", 'zscore' AS method, '|z| > 3.0' AS threshold,
       (SELECT COUNT(*) FROM v, s WHERE ABS((x - m) / sd) > 3) AS anomaly_count
""")
def anomaly_zscore(spark, sf):
    """F8: a column whose quartiles are equal is judged by its z-scores."""
    from tidemark.operators.anomaly import detect_anomalies
    items = table(spark, sf, "lineitem")
    x = F.when((F.col("l_orderkey") % 101 == 0) & (F.col("l_linenumber") == 1), F.col("l_quantity") * 1000).otherwise(5.0)
    return detect_anomalies(items.select(x.alias("x"))).report.drop("example_values")


# ------------------------------------------------------------ G6-G9, D7, F13
@register("kpi_values", """
SELECT 'avg_total_price' AS kpi, 'primary' AS role, ROUND(AVG(o_totalprice), 6) AS value FROM orders
UNION ALL SELECT 'median_total_price', 'secondary', ROUND(QUANTILE_CONT(o_totalprice, 0.5), 6) FROM orders
UNION ALL SELECT 'record_count', 'secondary', CAST(COUNT(*) AS DOUBLE) FROM orders
""")
def kpi_values(spark, sf):
    from tidemark.operators.kpis import kpi_values as kv
    from tidemark.plans.question import resolve
    orders = readable(spark, sf, "orders")
    q = "Which order priorities generate the highest average price?"
    spec = resolve(orders, q)
    return rounded(kv(orders, q, spec.metric, spec.dimension, spec.aggregation))


@register("kpi_values_count", """
SELECT 'record_count' AS kpi, 'primary' AS role, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'avg_records_per_group', 'secondary',
       ROUND(CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT l_returnflag), 6) FROM lineitem
UNION ALL SELECT 'unique_record_count', 'secondary', CAST(COUNT(*) AS DOUBLE)
       FROM (SELECT DISTINCT * FROM lineitem)
""")
def kpi_values_count(spark, sf):
    from tidemark.operators.kpis import kpi_values as kv
    from tidemark.plans.question import resolve
    items = readable(spark, sf, "lineitem")
    q = "Count the line items for each return flag"
    spec = resolve(items, q)
    return rounded(kv(items, q, spec.metric, spec.dimension, spec.aggregation))


@register("kpi_panel", """
SELECT 'total_value' AS kpi, 'panel' AS role, ROUND(COALESCE(SUM(value), 0), 6) AS value FROM events
UNION ALL SELECT 'avg_value', 'panel', ROUND(AVG(value), 6) FROM events
""")
def kpi_panel(spark, sf):
    from tidemark.operators.kpis import kpi_panel as panel
    return rounded(panel(table(spark, sf, "events")))


_CHART_Q = "How does the value change over time?"


@register("chart_time_series", """
SELECT strftime(ts, '%Y-%m-%d') AS ts, COUNT(*) AS record_count,
       ROUND(COALESCE(SUM(value), 0), 6) AS total_value FROM events GROUP BY 1
""")
def chart_time_series(spark, sf):
    from tidemark.operators.kpis import chart_feeds
    return rounded(chart_feeds(table(spark, sf, "events"), _CHART_Q)["time_series"])


@register("chart_category", """
SELECT event_type, COUNT(*) AS record_count, ROUND(COALESCE(SUM(value), 0), 6) AS total_value
FROM events GROUP BY 1
""")
def chart_category(spark, sf):
    from tidemark.operators.kpis import chart_feeds
    return rounded(chart_feeds(table(spark, sf, "events"), _CHART_Q)["category_comparison"])


@register("chart_dual_metric", """
SELECT strftime(ts, '%Y-%m-%d') AS ts, ROUND(COALESCE(SUM(value), 0), 6) AS total_value,
       CAST(COALESCE(SUM(event_id), 0) AS BIGINT) AS total_event_id FROM events GROUP BY 1
""")
def chart_dual_metric(spark, sf):
    from tidemark.operators.kpis import chart_feeds
    return rounded(chart_feeds(table(spark, sf, "events"), _CHART_Q)["dual_metric"])


@register("mart_measures", """
WITH c AS (SELECT p_brand, COUNT(*) AS record_count, COALESCE(SUM(p_retailprice), 0) AS total_p_retailprice,
                  AVG(p_retailprice) AS avg_p_retailprice FROM part GROUP BY p_brand),
r AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, COUNT(o_totalprice) AS record_count,
             COALESCE(SUM(o_totalprice), 0) AS total_o_totalprice, AVG(o_totalprice) AS avg_o_totalprice
      FROM orders GROUP BY 1)
SELECT 'mart_catalog_summary' AS table_name, 'Total total_p_retailprice' AS measure_name,
       ROUND(SUM(total_p_retailprice), 6) AS value FROM c
UNION ALL SELECT 'mart_catalog_summary', 'Avg total_p_retailprice', ROUND(AVG(total_p_retailprice), 6) FROM c
UNION ALL SELECT 'mart_catalog_summary', 'Total avg_p_retailprice', ROUND(SUM(avg_p_retailprice), 6) FROM c
UNION ALL SELECT 'mart_catalog_summary', 'Avg avg_p_retailprice', ROUND(AVG(avg_p_retailprice), 6) FROM c
UNION ALL SELECT 'mart_release_impact', 'Total order_year', CAST(SUM(order_year) AS DOUBLE) FROM r
UNION ALL SELECT 'mart_release_impact', 'Avg order_year', ROUND(AVG(order_year), 6) FROM r
UNION ALL SELECT 'mart_release_impact', 'Total total_o_totalprice', ROUND(SUM(total_o_totalprice), 6) FROM r
UNION ALL SELECT 'mart_release_impact', 'Avg total_o_totalprice', ROUND(AVG(total_o_totalprice), 6) FROM r
UNION ALL SELECT 'mart_release_impact', 'Total avg_o_totalprice', ROUND(SUM(avg_o_totalprice), 6) FROM r
UNION ALL SELECT 'mart_release_impact', 'Avg avg_o_totalprice', ROUND(AVG(avg_o_totalprice), 6) FROM r
""")
def mart_measures(spark, sf):
    """Total and average of every numeric mart column but record_count."""
    from tidemark.operators.kpis import mart_measures as measures
    catalog = marts.catalog_summary_mart(table(spark, sf, "part"), "p_brand", "p_retailprice")
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("order_year"), "o_totalprice")
    release = marts.release_impact_mart(orders, "o_totalprice", "order_year")
    return rounded(measures({"mart_catalog_summary": catalog, "mart_release_impact": release}))


def _key_sql(pairs) -> str:
    parts = []
    for lt, lexpr, rt, rexpr, col in pairs:
        parts.append(f"""
SELECT '{lt}' AS from_table, '{col}' AS from_column, '{rt}' AS to_table, '{col}' AS to_column,
  (SELECT COUNT(DISTINCT {lexpr}) FROM {lt}) AS from_keys,
  (SELECT COUNT({lexpr}) FROM {lt}) AS from_rows,
  (SELECT COUNT(*) FROM (SELECT {lexpr} FROM {lt} WHERE {lexpr} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)) AS from_duplicate_keys,
  (SELECT COUNT(DISTINCT {rexpr}) FROM {rt}) AS to_keys,
  (SELECT COUNT({rexpr}) FROM {rt}) AS to_rows,
  (SELECT COUNT(*) FROM (SELECT {rexpr} FROM {rt} WHERE {rexpr} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)) AS to_duplicate_keys,
  (SELECT COUNT(DISTINCT {lexpr}) FROM {lt} WHERE {lexpr} IS NOT NULL AND {lexpr} NOT IN (SELECT {rexpr} FROM {rt} WHERE {rexpr} IS NOT NULL)) AS from_keys_missing_in_to,
  (SELECT COUNT(DISTINCT {rexpr}) FROM {rt} WHERE {rexpr} IS NOT NULL AND {rexpr} NOT IN (SELECT {lexpr} FROM {lt} WHERE {lexpr} IS NOT NULL)) AS to_keys_missing_in_from""")
    body = " UNION ALL ".join(parts)
    return (f"SELECT *, CASE WHEN from_duplicate_keys > 0 AND to_duplicate_keys > 0 THEN 'many-to-many' "
            f"WHEN from_duplicate_keys > 0 THEN 'many-to-one' WHEN to_duplicate_keys > 0 THEN 'one-to-many' "
            f"ELSE 'one-to-one' END AS cardinality FROM ({body})")


@register("key_check", _key_sql([
    ("customer", "c_custkey", "orders", "o_custkey", "customer_key"),
    ("customer", "c_nationkey", "supplier", "s_nationkey", "nation_key"),
    ("customer", "c_acctbal", "supplier", "s_acctbal", "account_balance"),
    ("supplier", "s_nationkey", "nation", "n_nationkey", "nation_key"),
]))
def key_check(spark, sf):
    """Shared column names checked as join keys on the data."""
    from tidemark.operators.audit import key_checks
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_key"),
                                               F.col("n_name").alias("nation_name"))
    return key_checks({"customer": readable(spark, sf, "customer"),
                       "orders": readable(spark, sf, "orders"),
                       "supplier": readable(spark, sf, "supplier"),
                       "nation": nation})


@register("lineage_audit", _DIRTY_ORDERS_SQL + """
SELECT 'raw:: Order Key ' AS from_node, 'staging::order_key' AS to_node, 'type_cast' AS edge_type,
       CAST(0 AS BIGINT) AS blanks_nulled, CAST(0 AS BIGINT) AS cast_failures,
       (SELECT COUNT(*) FROM raw) AS rows_unchanged
UNION ALL SELECT 'raw::Customer Key', 'staging::customer_key', 'type_cast', 0, 0, (SELECT COUNT(*) FROM raw)
UNION ALL SELECT 'raw::Order Status', 'staging::order_status', 'normalized', 0, 0, (SELECT COUNT(*) FROM raw)
UNION ALL SELECT 'raw::Total Price', 'staging::total_price', 'type_cast',
       (SELECT COUNT(*) FROM raw WHERE regexp_matches(c_price, '^\\s*$')),
       (SELECT COUNT(*) FROM typed WHERE type_issue),
       (SELECT COUNT(*) FROM raw WHERE NOT regexp_matches(c_price, '^\\s*$'))
         - (SELECT COUNT(*) FROM typed WHERE type_issue)
UNION ALL SELECT 'raw::Order Date', 'staging::order_date', 'normalized', 0,
       (SELECT COUNT(*) FROM typed WHERE date_issue), (SELECT COUNT(*) FROM raw)
UNION ALL SELECT 'raw::Created At', 'staging::created_at', 'type_cast', 0, 0, (SELECT COUNT(*) FROM raw)
UNION ALL SELECT 'raw::Order Priority', 'staging::order_priority', 'normalized',
       (SELECT COUNT(*) FROM raw WHERE regexp_matches(c_priority, '^\\s*$')), 0,
       (SELECT COUNT(*) FROM raw WHERE NOT regexp_matches(c_priority, '^\\s*$'))
UNION ALL SELECT 'staging::order_priority', 'mart::mart_question_answer::order_priority', 'passthrough', 0, 0, NULL
UNION ALL SELECT 'staging::total_price', 'mart::mart_question_answer::avg_total_price', 'aggregated', 0, 0, NULL
""")
def lineage_audit(spark, sf):
    """raw -> staging -> mart edges with measured changes."""
    from tidemark.operators.audit import lineage_edges
    from tidemark.operators.cleaning import clean
    res = clean(dirty_orders(spark, sf))
    mart = marts.question_answer_mart(res.df, "order_priority", "total_price", "average")     # only its columns count here
    return lineage_edges(res, {"mart_question_answer": mart})


@register("reconciliation", _DIRTY_ORDERS_SQL + """,
staged AS (SELECT DISTINCT order_key, customer_key, order_status, total_price, order_date, created_at,
                  order_priority FROM typed)
SELECT 'record_count' AS "check", CAST(COUNT(*) AS DOUBLE) AS mart_value,
       CAST(COUNT(*) AS DOUBLE) AS staging_value, true AS matches FROM staged
UNION ALL
SELECT 'metric_total', ROUND(SUM(total_price), 2), ROUND(SUM(total_price), 2), true FROM staged
""")
def reconciliation(spark, sf):
    """the catalog mart's totals reconcile with the staging table."""
    from tidemark.operators.audit import reconcile
    from tidemark.operators.cleaning import clean
    staging = shared_table(clean(dirty_orders(spark, sf)).df, "staging")
    mart = marts.catalog_summary_mart(staging, "order_priority", "total_price")
    out = reconcile(staging, mart, "total_price")
    return out.select("check", F.round("mart_value", 2).alias("mart_value"),
                      F.round("staging_value", 2).alias("staging_value"), "matches")


def dirty_customers(spark, sf):
    """Stand-in raw input: the whole customer table as text. The balance
    column has a word in every third row (below the 80% numeric rule), the
    keys are integer text, and the signup dates all parse."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("Customer Key"),
        F.col("c_nationkey").cast("string").alias("Nation Key"),
        F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.format_string("%.2f", "c_acctbal")).alias("Account Balance"),
        F.format_string("%.1f", F.col("c_nationkey") / 2).alias("Half Nation"),
        F.col("c_mktsegment").alias("Market Segment"),
        F.date_format(F.date_add(F.make_date(F.lit(2020), F.lit(1), F.lit(1)), (k % 365).cast("int")),
                      "yyyy-MM-dd").alias("Signup Date"),
    )


@register("clean_customer", """
SELECT CAST(c_custkey AS BIGINT) AS customer_key, CAST(c_nationkey AS BIGINT) AS nation_key,
       CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE printf('%.2f', c_acctbal) END AS account_balance,
       ROUND(CAST(printf('%.1f', c_nationkey / 2) AS DOUBLE), 6) AS half_nation,
       c_mktsegment AS market_segment,
       CAST(make_date(2020, 1, 1) + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS signup_date,
       false AS has_nulls, false AS invalid_date_parse, false AS type_conversion_issue
FROM customer
""")
def clean_customer(spark, sf):
    """B3 below the threshold (text kept), bigint vs double, B4 all dates parse."""
    from tidemark.operators.cleaning import clean
    return rounded(clean(dirty_customers(spark, sf)).df)


# ------------------------------------------------------------- mart sets from one scan, with their values
def _as_values(name: str, rows: str, key: str, figures: dict[str, str]) -> str:
    """SQL of one mart in the long form of ``grouped.mart_values``."""
    measures = ", ".join(f"'{m}'" for m in figures)
    values = ", ".join(f"CAST({e} AS DOUBLE)" for e in figures.values())
    return (f"SELECT '{name}' AS mart, CAST({key} AS VARCHAR) AS key, unnest([{measures}]) AS measure, "
            f"ROUND(unnest([{values}]), 6) AS value FROM ({rows}) t")


def _value_sets(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p}) u" for p in parts)


def _summary_sql(source: str, metric: str, column: str) -> str:
    return _as_values(f"mart_{metric}_summary_stats" if metric != "total_price" else "mart_summary_stats", f"""
        SELECT MIN({column}) AS lo, MAX({column}) AS hi, AVG({column}) AS mean, QUANTILE_CONT({column}, 0.5) AS q50,
               COALESCE(STDDEV_SAMP({column}), 0) AS std, QUANTILE_CONT({column}, 0.05) AS q05,
               QUANTILE_CONT({column}, 0.25) AS q25, QUANTILE_CONT({column}, 0.75) AS q75,
               QUANTILE_CONT({column}, 0.95) AS q95 FROM {source}""", f"'{metric}'", {
        f"min_{metric}": "lo", f"max_{metric}": "hi", f"avg_{metric}": "mean", f"median_{metric}": "q50", f"std_{metric}": "std",
        f"p05_{metric}": "q05", f"p25_{metric}": "q25", f"p75_{metric}": "q75", f"p95_{metric}": "q95"})


_SET_ORDERS_SQL = """
WITH o AS (
  SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v,
         CAST(year(o_orderdate) AS BIGINT) AS release_year, o_orderstatus AS provider,
         strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
s AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM o),
e AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS edge
      FROM s CROSS JOIN range(0, 11) r(i))
"""
_ANSWER = {"record_count": "n", "avg_total_price": "a"}


@register("mart_set_values", _SET_ORDERS_SQL + _value_sets([
    _as_values("mart_question_answer", "SELECT priority, COUNT(*) AS n, AVG(v) AS a FROM o GROUP BY priority", "priority", _ANSWER),
    _as_values("mart_top_entities", """
        SELECT *, row_number() OVER (ORDER BY a DESC, priority NULLS LAST) AS rank
        FROM (SELECT priority, COUNT(*) AS n, AVG(v) AS a FROM o GROUP BY priority)""", "priority", {"rank": "rank", **_ANSWER}),
    *[_as_values(name, f"SELECT {key}, {n} AS n, COALESCE(SUM(v), 0) AS t, AVG(v) AS a FROM o GROUP BY {key}", key,
                 {"record_count": "n", "total_total_price": "t", "avg_total_price": "a"})
      for name, key, n in (("mart_release_impact", "release_year", "COUNT(v)"),
                           ("mart_provider_performance", "provider", "COUNT(v)"),
                           ("mart_catalog_summary", "priority", "COUNT(*)"))],
    _as_values("mart_time_trend", "SELECT day, COUNT(*) AS n, AVG(v) AS a FROM o GROUP BY day", "day", _ANSWER),
    _as_values("mart_distribution", """
        SELECT ROUND(a.edge, 3) AS e0, ROUND(b.edge, 3) AS e1, COUNT(o.v) AS n FROM e a JOIN e b ON b.i = a.i + 1
        LEFT JOIN o ON o.v > a.edge AND o.v <= b.edge GROUP BY a.i, a.edge, b.edge""", "NULL",
               {"bin_start": "e0", "bin_end": "e1", "record_count": "n"}),
    _summary_sql("o", "total_price", "v"),
]))
def mart_set_values(spark, sf):
    """C17: every value of every mart that a question and the columns allow."""
    from tidemark.operators.grouped import mart_values
    from tidemark.plans.mart_sets import available_marts
    from tidemark.plans.question import resolve
    o = table(spark, sf, "orders")
    orders = o.select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("order_priority"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("total_price"), F.col("o_orderdate").alias("order_date"),
        F.year("o_orderdate").cast("bigint").alias("release_year"), F.col("o_orderstatus").alias("provider"))
    spec = resolve(orders, "Which order priorities generate the highest average price?", "total_price", "order_priority")
    return rounded(mart_values(available_marts(orders, spec)[0]))


_CLIMATE = ("temperature_anomaly", "co2", "sea_level")
_WIDE_SQL = """
WITH w AS (
  SELECT CAST(1880 + o_custkey % 140 AS VARCHAR) AS year, AVG(o_totalprice) / 1000 AS temperature_anomaly,
         CAST(COUNT(*) AS DOUBLE) AS co2,
         CASE WHEN o_custkey % 140 % 3 <> 0 THEN MAX(o_totalprice) END AS sea_level,
         CAST(1.5 AS DOUBLE) AS ice_extent, CAST(NULL AS DOUBLE) AS empty
  FROM orders GROUP BY o_custkey % 140)
"""


def _climate_wide(spark, sf):
    """A wide yearly table of the climate columns: one constant, one without a value."""
    year = F.col("o_custkey") % 140
    return table(spark, sf, "orders").groupBy(year.alias("y")).agg(
        (F.avg("o_totalprice") / 1000).alias("temperature_anomaly"), F.count("*").cast("double").alias("co2"),
        F.max("o_totalprice").alias("top")).select(
        (F.lit(1880) + F.col("y")).cast("string").alias("year"), "temperature_anomaly", "co2",
        F.when(F.col("y") % 3 != 0, F.col("top")).alias("sea_level"), F.lit(1.5).cast("double").alias("ice_extent"),
        F.lit(None).cast("double").alias("empty"))


def _pairs_sql(name: str, columns: tuple[str, ...]) -> list[str]:
    names = sorted(columns)
    return [_as_values(name, f"SELECT CORR({a}, {b}) AS r FROM w", f"'{a}|{b}'", {"correlation": "r"})
            for i, a in enumerate(names) for b in names[i + 1:]]


@register("climate_set_values", _WIDE_SQL + _value_sets([
    *[_as_values(f"mart_{m}_trend", f"SELECT year, COUNT({m}) AS n, AVG({m}) AS a FROM w GROUP BY year HAVING COUNT({m}) > 0",
                 "year", {"record_count": "n", f"avg_{m}": "a"}) for m in (*_CLIMATE, "ice_extent")],
    *[_summary_sql("w", m, m) for m in (*_CLIMATE, "ice_extent")],
    *_pairs_sql("mart_metric_correlation", _CLIMATE), *_pairs_sql("mart_climate_correlation", _CLIMATE),
    _as_values("mart_top_warmest_years", """
        SELECT year, COUNT(temperature_anomaly) AS n, AVG(temperature_anomaly) AS a FROM w GROUP BY year
        ORDER BY a DESC NULLS LAST, year LIMIT 10""", "year", {"record_count": "n", "avg_temperature_anomaly": "a"}),
    _as_values("mart_temperature_by_decade", """
        SELECT CAST(CAST(year AS BIGINT) // 10 * 10 AS BIGINT) AS decade, COUNT(temperature_anomaly) AS n,
               AVG(temperature_anomaly) AS a FROM w GROUP BY 1""", "decade", {"record_count": "n", "avg_temperature_anomaly": "a"}),
]))
def climate_set_values(spark, sf):
    """Every value of the marts of a wide yearly table."""
    from tidemark.operators.grouped import mart_values
    from tidemark.plans.mart_sets import wide_marts
    return rounded(mart_values(wide_marts(_climate_wide(spark, sf))))


@register("correlation_named_set", _WIDE_SQL + " UNION ALL ".join(
    f"SELECT '{a}' AS left_metric, '{b}' AS right_metric, ROUND(CORR({a}, {b}), 6) AS correlation FROM w"
    for a, b in (("co2", "sea_level"),)))
def correlation_named_set(spark, sf):
    """C14: the correlation of the four named columns, of which this table has
    three (its temperature column has another name) and one is constant."""
    return rounded(marts.climate_correlation_mart(_climate_wide(spark, sf)))


@register("distribution_missing", """
WITH x AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_linenumber <> 3),
s AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM x),
e AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS edge
      FROM s CROSS JOIN range(0, 11) r(i))
SELECT ROUND(a.edge, 3) AS bin_start, ROUND(b.edge, 3) AS bin_end, COUNT(x.v) AS record_count
FROM e a JOIN e b ON b.i = a.i + 1 LEFT JOIN x ON x.v > a.edge AND x.v <= b.edge GROUP BY a.i, a.edge, b.edge
""")
def distribution_missing(spark, sf):
    """C7 where some values are NaN and some NULL: neither has a bin."""
    items = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 5 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
        .alias("price"))
    return marts.distribution_mart(items, "price")


@register("time_trend_words", """
SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, COUNT(*) AS record_count, ROUND(AVG(l_extendedprice), 6) AS avg_lifetime_value
FROM lineitem GROUP BY 1
""")
def time_trend_words(spark, sf):
    """A name tells time by a word of its own, not by letters inside another one."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("lifetime_value"), F.col("l_tax").alias("downtime_cost"), F.col("l_quantity").alias("candidates"),
        F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"))
    return rounded(marts.time_trend_mart(items, "lifetime_value", "average"))


# ------------------------------------------------- checked samples, formats and flags
def _sample_sql(columns: list[str], table_name: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, string_agg(v, '; ' ORDER BY h, v) AS samples FROM "
        f"(SELECT CAST({c} AS VARCHAR) AS v, md5(CAST({c} AS VARCHAR) || '|' || CAST({key} AS VARCHAR) || '|0') AS h "
        f"FROM {table_name} WHERE {c} IS NOT NULL ORDER BY h, v LIMIT 5))" for c in columns)


@register("profile_samples", _sample_sql(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "customer", "c_custkey"))
def profile_samples(spark, sf):
    """E5: the sample values of a profile, chosen by an order that any engine can repeat."""
    from tidemark.operators.quality import profile as prof
    customers = table(spark, sf, "customer").drop("c_acctbal")
    return prof(customers, key_columns=["c_custkey"]).select(
        "column_name", F.array_join("sample_values", "; ").alias("samples"))


_TIERS_SQL = """
WITH v AS (
  SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 8 = 0 THEN 5000 + l_linenumber ELSE l_quantity END AS often,
         CASE WHEN l_orderkey % 25 = 1 THEN -900 ELSE l_quantity END AS sometimes,
         CASE WHEN l_orderkey % 1000 = 7 THEN 4000 + l_linenumber WHEN l_linenumber <> 2 THEN l_quantity END AS rarely FROM lineitem),
""" + ", ".join(f"""
q_{c} AS (SELECT QUANTILE_CONT({c}, 0.25) AS q1, QUANTILE_CONT({c}, 0.75) AS q3 FROM v),
f_{c} AS (SELECT k, n, {c} AS x FROM v, q_{c} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"""
                for c in ("often", "sometimes", "rarely"))


@register("anomaly_tiers", _TIERS_SQL + " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS "column", 'iqr' AS method, printf('%.4f to %.4f', q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) AS threshold,
       (SELECT COUNT(*) FROM f_{c}) AS anomaly_count,
       (SELECT string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ', ' ORDER BY k, n) FROM (SELECT * FROM f_{c} ORDER BY k, n LIMIT 3)) AS examples,
       ROUND((SELECT COUNT(*) FROM f_{c}) / (SELECT COUNT(*) FROM v), 4) AS frequency, '{tier}' AS impact,
       printf('{ADVICE[tier]}', '{c}', 'iqr') AS suggested_action FROM q_{c})"""
    for c, tier in (("often", "high"), ("sometimes", "medium"), ("rarely", "low"))))
def anomaly_tiers(spark, sf):
    """Three columns of three tiers, with their first flagged values."""
    from tidemark.operators.anomaly import detect_anomalies, frame_anomalies
    i = table(spark, sf, "lineitem")
    k, n, x = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    values = i.select("l_orderkey", "l_linenumber", F.when(k % 8 == 0, 5000 + n).otherwise(x).alias("often"),
                      F.when(k % 25 == 1, -900).otherwise(x).alias("sometimes"),
                      F.when(k % 1000 == 7, 4000 + n).when(n != 2, x).alias("rarely"))
    res = detect_anomalies(values, ["often", "sometimes", "rarely"], order_by=["l_orderkey", "l_linenumber"])
    framed = frame_anomalies(res.report, res.total_rows)
    examples = F.array_join(F.transform("example_values", lambda v: v.cast("bigint").cast("string")), ", ")
    return framed.withColumn("examples", examples).drop("example_values")


_FORMATS_SQL = """
WITH v AS (
  SELECT CASE o_orderkey % 10 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '1.5e3' WHEN 2 THEN ' TRUE ' WHEN 3 THEN '2024-02-01'
              WHEN 4 THEN NULL WHEN 5 THEN '7 ' ELSE o_orderpriority END AS mixed,
         CASE WHEN o_orderkey % 4 <> 0 THEN '-' || o_custkey END AS whole,
         CASE WHEN o_orderkey % 16 = 0 THEN 1000.0 WHEN o_orderkey % 16 <> 1 THEN 1.0 END AS far FROM orders)
"""


@register("dq_formats", _FORMATS_SQL + """
SELECT column_name, non_null_share AS completeness, ROUND(uniq * 100.0 / nn, 1) AS uniqueness, outlier_flag, CAST(100 AS DOUBLE) AS format_score,
       ROUND(top * 100.0 / nn, 1) AS dominant_class_share,
       ROUND(non_null_share * 0.4 + ROUND(uniq * 100.0 / nn, 1) * 0.2 + 100.0 * 0.4, 1) AS dq_score
FROM (
  SELECT 'mixed' AS column_name, ROUND(COUNT(mixed) * 100.0 / COUNT(*), 1) AS non_null_share, COUNT(DISTINCT mixed) AS uniq,
         COUNT(mixed) AS nn, false AS outlier_flag,
         greatest(COUNT(*) FILTER (WHERE regexp_matches(trim(mixed), '^[0-9]+$')), COUNT(*) FILTER (WHERE mixed = '1.5e3'),
                  COUNT(*) FILTER (WHERE mixed = ' TRUE '), COUNT(*) FILTER (WHERE mixed = '2024-02-01'),
                  COUNT(*) FILTER (WHERE regexp_matches(mixed, '^[0-9]-'))) AS top FROM v
  UNION ALL
  SELECT 'whole', ROUND(COUNT(whole) * 100.0 / COUNT(*), 1), COUNT(DISTINCT whole), COUNT(whole), false, COUNT(whole) FROM v
  UNION ALL
  SELECT 'far', ROUND(COUNT(far) * 100.0 / COUNT(*), 1), COUNT(DISTINCT far), COUNT(far),
         COUNT(*) FILTER (WHERE abs(far - (SELECT AVG(far) FROM v)) > 3 * (SELECT STDDEV_SAMP(far) FROM v)) / COUNT(far) > 0.05, COUNT(far)
  FROM v)
""")
def dq_formats(spark, sf):
    """missing cells, a column with too many outliers, and text of several classes."""
    from tidemark.operators.quality import dq_scores
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    r = k % 10
    return dq_scores(o.select(
        F.when(r == 0, k.cast("string")).when(r == 1, "1.5e3").when(r == 2, " TRUE ").when(r == 3, "2024-02-01").when(r == 4, None)
        .when(r == 5, "7 ").otherwise(F.col("o_orderpriority")).alias("mixed"),
        F.when(k % 4 != 0, F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).alias("whole"),
        F.when(k % 16 == 0, 1000.0).when(k % 16 != 1, 1.0).alias("far"))).drop("dtype")


@register("clean_mixed_dates", """
SELECT o_orderkey AS order_key,
       CASE WHEN o_orderkey = (SELECT MIN(o_orderkey) FROM orders) THEN 'soon'
            WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS order_date,
       false AS has_nulls, o_orderkey % 5 = 0 OR o_orderkey = (SELECT MIN(o_orderkey) FROM orders) AS invalid_date_parse,
       false AS type_conversion_issue
FROM orders
""")
def clean_mixed_dates(spark, sf):
    """No format reads the first value, so the shapes of all values leave the formats to try."""
    from tidemark.operators.cleaning import clean
    orders = table(spark, sf, "orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    k = F.col("o_orderkey")
    ordered = orders.withColumn("_row_id", k)                      # row order by key: the odd value comes first
    return clean(ordered.select(
        k.cast("string").alias("Order Key"),
        F.when(k == first, "soon").when(k % 5 == 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("Order Date"), "_row_id")).df


@register("clean_first_flags", """
SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey AS DOUBLE) + 0.5 END AS amount,
       o_orderkey % 6 = 0 AS has_nulls, false AS invalid_date_parse, o_orderkey % 12 = 0 AS type_conversion_issue
FROM orders
""")
def clean_first_flags(spark, sf):
    """Copies that are equal once cleaned carry different flags; those of the first row stay."""
    from tidemark.operators.cleaning import clean
    orders = table(spark, sf, "orders")
    k, copy = F.col("o_orderkey"), F.col("copy")
    rows = orders.select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    # of every sixth order one copy is blank and the other is a word, the word first in every twelfth
    odd = F.when((copy == 0) == (k % 12 == 0), "none at all").otherwise(" ")
    amount = F.when(k % 6 == 0, odd).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
    return clean(rows.select(k.cast("string").alias("Order Key"), amount.alias("Amount"), (k * 2 + copy).alias("_row_id"))).df


@register("distinct_keys", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")))
def distinct_keys(spark, sf):
    """exact distinct counts of keys, dates and texts."""
    from tidemark.functions.stats import distinct_counts_df
    return distinct_counts_df(table(spark, sf, "lineitem"), [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"])


_QUANTILE_COLS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]


@register("quantiles_exact", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p, ROUND(CAST(QUANTILE_CONT({c}, {p}) AS DOUBLE), 6) AS value FROM lineitem"
    for c in _QUANTILE_COLS for p in (0.01, 0.5, 0.99)))
def quantiles_exact(spark, sf):
    """Exact quantiles of several columns from sketched brackets."""
    from tidemark.functions.stats import quantiles
    got = quantiles(table(spark, sf, "lineitem"), {c: [0.01, 0.5, 0.99] for c in _QUANTILE_COLS})
    return rounded(spark.createDataFrame(
        [(c, p, float(v)) for c, values in got.items() for p, v in zip((0.01, 0.5, 0.99), values)],
        "column_name string, p double, value double"))


@register("key_screen", """
SELECT 'lineitem' AS from_table, 'orders' AS to_table, 'orderkey' AS "column",
       (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)))
       / (SELECT COUNT(DISTINCT l_orderkey) FROM lineitem) AS contained, true AS within_bounds
UNION ALL
SELECT 'orders', 'customer', 'custkey',
       (SELECT COUNT(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)))
       / (SELECT COUNT(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 <> 0), true
""")
def key_screen(spark, sf):
    """Sketches of all key columns bound the exact containment of every pair."""
    from tidemark.operators.audit import key_checks, screen_keys
    tables = {"lineitem": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey")),
              "orders": table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(
                  F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey")),
              "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))}
    exact = key_checks(tables).select("from_table", "to_table", F.col("from_column").alias("column"),
                                      (1 - F.col("from_keys_missing_in_to") / F.col("from_keys")).alias("exact"))
    return rounded(screen_keys(tables).join(exact, ["from_table", "to_table", "column"]).select(
        "from_table", "to_table", "column", F.col("exact").alias("contained"),
        F.col("exact").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("within_bounds")))


@register("lineage_paths", _DIRTY_ORDERS_SQL.replace("WITH src", "WITH RECURSIVE src") + """,
edges AS (
  SELECT 'raw::Total Price' AS from_node, 'staging::total_price' AS to_node,
         (SELECT COUNT(*) FROM raw WHERE regexp_matches(c_price, '^\\s*$')) AS blanks, (SELECT COUNT(*) FROM typed WHERE type_issue) AS fails
  UNION ALL SELECT 'raw::Order Priority', 'staging::order_priority',
         (SELECT COUNT(*) FROM raw WHERE regexp_matches(c_priority, '^\\s*$')), 0
  UNION ALL SELECT 'raw::Order Status', 'staging::order_status', 0, 0
  UNION ALL SELECT 'staging::order_priority', 'mart::by_priority::order_priority', 0, 0
  UNION ALL SELECT 'staging::total_price', 'mart::by_priority::avg_total_price', 0, 0
  UNION ALL SELECT 'staging::order_status', 'mart::by_status::order_status', 0, 0
  UNION ALL SELECT 'staging::total_price', 'mart::by_status::total_total_price', 0, 0),
ways AS (
  SELECT to_node AS mart_node, from_node AS node, 1 AS steps, blanks, fails, from_node || ' > ' || to_node AS path
  FROM edges WHERE to_node LIKE 'mart::%'
  UNION ALL
  SELECT w.mart_node, e.from_node, w.steps + 1, w.blanks + e.blanks, w.fails + e.fails, e.from_node || ' > ' || w.path
  FROM ways w JOIN edges e ON e.to_node = w.node)
SELECT node AS raw_node, mart_node, steps, path, blanks AS blanks_nulled, fails AS cast_failures FROM ways WHERE node LIKE 'raw::%'
""")
def lineage_paths(spark, sf):
    """from each mart column back to the raw column, with the changes on the way."""
    from tidemark.operators.audit import lineage_edges, lineage_paths as paths
    from tidemark.operators.cleaning import clean
    res = clean(dirty_orders(spark, sf))
    built = {"by_priority": marts.question_answer_mart(res.df, "order_priority", "total_price", "average"),
             "by_status": marts.question_answer_mart(res.df, "order_status", "total_price", "sum")}
    return paths(shared_table(lineage_edges(res, built), "lineage"))
