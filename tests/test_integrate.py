import pytest
from pyspark.sql import functions as F

from tidemark.operators import marts
from tidemark.operators.integrate import coverage, infer_metric_column, integrate, standardize


def test_time_key_rules(spark):
    months = spark.createDataFrame([("2020-01", 1.0), ("2020-02", 2.0), ("2020-02", 4.0), ("bad", 5.0),
                                    ("2020-03", None)], "date string, value double")
    std = standardize(months, "Sea Level", "date")
    assert std.time_rule == "date_text" and std.dataset_name == "sea_level"
    keys = [r["year"] for r in std.df.collect()]
    assert keys[:3] == ["2020-01-01", "2020-02-01", "2020-02-01"] and keys[3] == "bad"
    years = spark.createDataFrame([(1990.0, 1.0), (1991.4, 2.0), (None, 3.0)], "yr double, v double")
    std2 = standardize(years, "temp", "yr")
    assert std2.time_rule == "year_number"
    assert [r["year"] for r in std2.df.collect()] == ["1990", "1991", None]
    far = spark.createDataFrame([(15.0, 1.0), (2000.0, 2.0)], "yr double, v double")
    assert [r["year"] for r in standardize(far, "x", "yr").df.collect()] == ["15.0", "2000.0"]
    with pytest.raises(ValueError):
        standardize(spark.createDataFrame([(2000, None)], "year bigint, v double"), "e", "year", "v")
    with pytest.raises(ValueError):
        standardize(months, "x", "missing")


def test_integration_alignment_and_mean(spark):
    a = standardize(spark.createDataFrame([(2020, 1.0), (2020, 3.0), (2021, 5.0)], "year bigint, revenue double"),
                    "revenue", "year")
    b = standardize(spark.createDataFrame([(2021, 7.0), (2022, 9.0)], "year bigint, cost double"), "cost", "year")
    res = integrate([a, b])
    assert res.wide.columns == ["year", "cost", "revenue"]
    rows = [tuple(r) for r in res.wide.collect()]
    assert rows == [("2020", None, 2.0), ("2021", 7.0, 5.0), ("2022", 9.0, None)]
    assert {d["dataset_name"]: d["unit"] for d in res.datasets} == {"revenue": "usd", "cost": None}


def test_metric_inference_and_coverage(spark):
    df = spark.createDataFrame([(2020, 1, None, 3.5)], "year bigint, row_id bigint, empty double, co2 double")
    assert infer_metric_column(df, "year") == "co2"
    text = spark.createDataFrame([("1999",), ("2004",)], "y string")
    assert tuple(coverage(text, "y").collect()[0]) == (1999, 2004)
    dates = spark.createDataFrame([("2001-05-01",), ("1998-01-01",)], "d string")
    assert tuple(coverage(dates, "d").collect()[0]) == (1998, 2001)


def test_metric_metadata_and_approx_summary(spark):
    df = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("A", 30.0)], "provider string, revenue double")
    mart = marts.aggregate_by_dimension(df, "provider", "revenue", "sum")
    meta = mart.schema["total_revenue"].metadata
    assert meta == {"source_column": "revenue", "aggregation": "sum", "unit": "usd"}
    approx = marts.summary_stats_mart(df, "revenue", approx_accuracy=10000).collect()[0]
    assert approx["median_revenue"] == 20.0
