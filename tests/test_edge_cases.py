import math

from tidemark.operators import marts
from tidemark.operators.anomaly import detect_anomalies
from tidemark.operators.cleaning import clean
from tidemark.operators.quality import dq_overall, dq_scores, profile
from tidemark.sources import readers

SCHEMA = "k string, v double, d string"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    res = clean(empty)
    assert res.df.count() == 0 and res.summary().collect()[0]["row_count"] == 0
    assert detect_anomalies(empty).report.count() == 0
    prof = {r["column_name"]: r for r in profile(empty).collect()}
    assert prof["v"]["null_percentage"] == 0.0 and prof["v"]["unique_count"] == 0
    scores = {r["column_name"]: r for r in dq_scores(empty).collect()}
    assert scores["k"]["completeness"] == 100.0 and scores["k"]["uniqueness"] == 100.0
    assert dq_overall(dq_scores(empty)).collect()[0]["column_count"] == 3
    assert marts.aggregate_by_dimension(empty, "k", "v", "sum").count() == 0


def test_nan_is_missing_at_parquet_source(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), "x"), ("a", 2.0, "y")], SCHEMA)
    path = str(tmp_path / "t.parquet")
    df.write.parquet(path)
    back = readers.read_source(spark, path)
    vals = sorted((r["v"] for r in back.collect()), key=lambda x: (x is None, x))
    assert vals == [2.0, None]
    mart = marts.aggregate_by_dimension(back, "k", "v", "average").collect()[0]
    assert mart["avg_v"] == 2.0 and not math.isnan(mart["avg_v"])


def test_all_null_metric_and_constant_columns(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", None, "x")], SCHEMA)
    rows = {r["k"]: r for r in marts.aggregate_by_dimension(df, "k", "v", "sum").collect()}
    assert rows["a"]["total_v"] == 0
    assert detect_anomalies(df).report.count() == 0
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    assert marts.correlation_mart(const, ["a", "b"]).count() == 0
