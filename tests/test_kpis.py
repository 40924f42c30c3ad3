import pytest

from tidemark.functions.semantic import metric_name, parse_metric_name
from tidemark.operators.kpis import (
    chart_feeds, chart_measures, kpi_panel, kpi_values, mart_measures, primary_measure, rank_dimensions)


@pytest.fixture()
def x19(spark):
    return spark.createDataFrame(
        [(2023, "A", "X", 1000, 10), (2024, "B", "Y", 1500, 12), (2025, "A", "Z", 2000, 14)],
        "release_year bigint, provider string, artist string, streams bigint, track_count bigint")


def test_kpi_values_follow_question(x19):
    q = "Which release years generate the strongest average streams by provider?"
    assert primary_measure(x19, q) == "streams"
    assert rank_dimensions(x19, q)[:2] == ["release_year", "provider"]
    rows = [(r["kpi"], r["role"], r["value"]) for r in kpi_values(x19, q).collect()]
    assert rows == [("avg_streams", "primary", 1500.0), ("median_streams", "secondary", 1500.0),
                    ("record_count", "secondary", 3.0)]
    total = {r["kpi"]: r["value"] for r in kpi_values(x19, "What are the total streams?").collect()}
    assert total["total_streams"] == 4500.0


def test_kpi_values_count_case(spark):
    df = spark.createDataFrame([("Tech", "A", 1), ("Health", "B", 2), ("Tech", "C", 3), ("Tech", "C", 3)],
                               "sector string, company string, cik bigint")
    rows = {r["kpi"]: r["value"] for r in kpi_values(
        df, "Which sectors contain the highest number of companies?", "record_count", "sector", "count").collect()}
    assert rows == {"record_count": 4.0, "avg_records_per_group": 2.0, "unique_record_count": 3.0}


def test_kpi_panel_and_measures(spark, x19):
    panel = [(r["kpi"], r["value"]) for r in kpi_panel(x19).collect()]
    assert panel == [("total_streams", 4500.0), ("avg_streams", 1500.0),
                     ("total_track_count", 36.0), ("avg_track_count", 12.0)]
    bare = spark.createDataFrame([(1.0,)], "x double")
    assert [r["kpi"] for r in kpi_panel(bare).collect()] == ["record_count"]
    measures = {(r["table_name"], r["measure_name"]): r["value"]
                for r in mart_measures({"m": x19.select("provider", "streams")}).collect()}
    assert measures == {("m", "Total streams"): 4500.0, ("m", "Avg streams"): 1500.0}


def test_chart_feeds(spark):
    df = spark.createDataFrame([(2024, "A", 250, 10), (2025, "B", 400, 20), (2025, "A", 100, 5)],
                               "release_year bigint, provider string, streams bigint, track_count bigint")
    feeds = chart_feeds(df)
    assert set(feeds) == {"time_series", "category_comparison", "dual_metric"}
    assert [tuple(r) for r in feeds["time_series"].collect()] == [(2024, 1, 250), (2025, 2, 500)]
    cat = {r["provider"]: r["total_streams"] for r in feeds["category_comparison"].collect()}
    assert cat == {"A": 350, "B": 400}
    dual = [tuple(r) for r in feeds["dual_metric"].collect()]
    assert dual == [(2024, 250, 10), (2025, 500, 25)]
    climate = spark.createDataFrame([(2020, 0.8, 410), (2021, 0.9, 412)],
                                    "year bigint, temperature_anomaly double, co2 bigint")
    q = "How has temperature anomaly changed over time, and how does it relate to CO2?"
    assert chart_measures(climate, q) == ["temperature_anomaly", "co2"]


def test_semantic_contract():
    assert metric_name("streams", "average") == "avg_streams"
    assert metric_name("record_count", "sum") == "record_count"
    with pytest.raises(ValueError):
        metric_name("x", "mode")
    assert parse_metric_name("total_revenue") == {"source_column": "revenue", "aggregation": "sum", "unit": "usd"}
    assert parse_metric_name("record_count")["unit"] == "count"
    assert parse_metric_name("plain") is None
