"""Mart sets from one scan, numbering and what reads them."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordering import numbered
from tidemark.operators import marts
from tidemark.operators.grouped import GroupedMart, GroupedMarts, mart_values
from tidemark.operators.kpis import chart_feeds
from tidemark.plans import mart_sets
from tidemark.plans.question import resolve
from tidemark.sources import sinks

SF = "/root/testdata/sf0.001"


def _scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan parquet")


def _orders(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
                    F.year("o_orderdate").cast("bigint").alias("release_year"), F.col("o_orderstatus").alias("provider"),
                    F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("order_date"))


def _wanted():
    return [marts.keyed_mart("a", "priority", F.col("priority"), "price", "average"),
            marts.keyed_mart("b", "provider", F.col("provider"), "price", "sum", "lowest", limit=2, ranked=True),
            GroupedMart("c", "day", F.date_format("order_date", "yyyy-MM-dd"), {"record_count": F.count("price")}),
            GroupedMart("w", None, None, marts.summary_figures("price"))]


def test_all_grouped_marts_come_from_one_scan(spark):
    grouped = GroupedMarts(_orders(spark), _wanted(), keep=lambda df: df)
    assert _scans(grouped.aggregated) == 1


def test_grouped_marts_equal_single_marts(spark):
    df = _orders(spark)
    grouped = GroupedMarts(df, _wanted())
    single = {"a": marts.aggregate_by_dimension(df, "priority", "price", "average"),
              "b": marts.top_entities_mart(df, "provider", "price", "sum", "lowest", limit=2)}
    for name, want in single.items():
        got, want = grouped.mart(name), want
        assert got.columns == want.columns
        assert [f.metadata for f in got.schema.fields] == [f.metadata for f in want.schema.fields]
        for x, y in zip(got.collect(), want.collect()):
            assert all(math.isclose(p, q) if isinstance(p, float) else p == q for p, q in zip(x, y))
    days = grouped.mart("c").collect()
    assert days[-1].day is None and sum(r.record_count for r in days) == df.count()      # a null key is a key
    assert grouped.whole("w")["n"] == df.count()


def test_null_keys_are_not_the_keys_that_a_set_leaves_out(spark):
    df = spark.createDataFrame([(None, "x", 1.0), ("k", None, 2.0), (None, None, 4.0)], "a string, b string, v double")
    grouped = GroupedMarts(df, [GroupedMart("a", "a", F.col("a"), {"t": F.sum("v")}), GroupedMart("b", "b", F.col("b"), {"t": F.sum("v")}),
                                GroupedMart("ab", None, None, {"t": F.sum("v")})])
    assert {tuple(r) for r in grouped.mart("a").collect()} == {("k", 2.0), (None, 5.0)}
    assert {tuple(r) for r in grouped.mart("b").collect()} == {("x", 1.0), (None, 6.0)}
    assert grouped.whole("ab") == {"t": 7.0}
    assert mart_values({"a": grouped.mart("a")}).collect()[0].measure == "t"


def test_empty_table_has_empty_marts(spark):
    df = _orders(spark).limit(0)
    grouped = GroupedMarts(df, _wanted())
    assert grouped.mart("a").collect() == [] and grouped.whole("w")["n"] is None


def test_chart_feeds_share_a_scan_and_order(spark):
    feeds = chart_feeds(_orders(spark))
    assert set(feeds) == {"time_series", "category_comparison", "dual_metric"} or set(feeds) == {"time_series", "category_comparison"}
    keys = [r[0] for r in feeds["time_series"].collect()]
    assert keys == sorted(k for k in keys if k is not None) + [k for k in keys if k is None]


def test_wide_marts_are_generic_and_climate_marts(spark):
    wide = spark.createDataFrame([(str(1980 + i), i * 0.1, 300.0 + i * i, None if i % 2 else float(i)) for i in range(25)],
                                 "year string, temperature_anomaly double, co2 double, sea_level double")
    both = {**mart_sets.generic_marts(wide), **mart_sets.climate_marts(wide)}
    together = mart_sets.wide_marts(wide)
    assert set(together) == set(both)
    for name in both:
        assert sorted(map(str, together[name].collect())) == sorted(map(str, both[name].collect())), name


def test_many_pairs_are_correlated_in_scans_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(marts, "PAIRS_PER_PASS", 2)
    wide = spark.createDataFrame([(str(i), float(i), float(i * i), float(-i)) for i in range(9)], "year string, a double, b double, c double")
    got = mart_sets.generic_marts(wide)["mart_metric_correlation"].collect()
    assert len(got) == 3 and {r.left_metric for r in got} == {"a", "b"}


def test_names_tell_time_by_whole_words(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, "2024-01")], "lifetime_value double, downtime_cost double, candidates int, shipMonth string")
    assert marts.find_time_column(df) == "shipMonth"
    assert marts.find_time_column(df.drop("shipMonth")) is None


def test_distribution_of_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert sum(r.record_count for r in marts.distribution_mart(df, "x").collect()) == 3
    assert marts.summary_stats_mart(df, "x").first().max_x == 3.0
    with pytest.raises(ValueError):
        marts.distribution_mart(df.union(spark.createDataFrame([(float("inf"),)], "x double")), "x")


@pytest.mark.parametrize("parts", [1, 7])
def test_numbering_under_any_layout(spark, parts):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id")).repartition(parts)
    rows = sorted(numbered(df, [F.col("k"), F.col("id").desc()]).collect(), key=lambda r: r.row_number)
    assert [r.row_number for r in rows] == list(range(1000))
    assert [(r.k, r.id) for r in rows] == sorted(((i % 3, i) for i in range(1000)), key=lambda t: (t[0], -t[1]))
    hot = spark.range(900).select(F.lit(1).alias("k")).repartition(parts)
    assert sorted(r.row_number for r in numbered(hot, [F.col("k")]).collect()) == list(range(900))
    assert numbered(df.limit(0), [F.col("k")]).collect() == []


def test_statements_do_not_depend_on_layout(spark):
    df = spark.range(1203).select("id", F.concat(F.lit("n'"), F.col("id").cast("string")).alias("na\"me"))
    want = {r.batch: r.statement for r in sinks.insert_statements(df, "t").collect()}
    assert sorted(want) == [0, 1, 2] and [want[b].count("\n(") for b in sorted(want)] == [500, 500, 203]
    assert '"na""me"' in want[0]
    for parts in (1, 7):
        assert {r.batch: r.statement for r in sinks.insert_statements(df.repartition(parts), "t").collect()} == want


def test_question_marts_with_backticks_and_dots(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 5.0)], "`pro.vi``der` string, `va``lue` double")
    built, _ = mart_sets.available_marts(df, resolve(df, "x", "va`lue", "pro.vi`der"))
    assert [tuple(r) for r in built["mart_question_answer"].collect()] == [("a", 2, 3.0), ("b", 1, 3.0)]
