import pytest

from tidemark.operators.anomaly import business_summary, detect_anomalies, frame_anomalies
from tidemark.operators.quality import dq_overall, dq_scores, profile, schema_summary


def test_anomalies_iqr_and_flagged_rows(spark):
    df = spark.createDataFrame(
        [(2023, 100, 10, "A"), (2024, 110, 11, "A"), (2025, 105, 10, "B"),
         (2026, 115, 12, "B"), (2027, 600, 50, "C")],
        "release_year bigint, streams bigint, track_count bigint, provider string").coalesce(1)
    res = detect_anomalies(df)
    report = {r["column"]: r.asDict() for r in res.report.collect()}
    assert set(report) == {"streams", "track_count"}
    assert report["streams"]["method"] == "iqr"
    assert report["streams"]["anomaly_count"] == 1
    assert report["streams"]["example_values"] == [600.0]
    flagged = res.flagged_rows.collect()
    assert len(flagged) == 1
    assert flagged[0]["anomaly_columns"] == "streams,track_count"
    assert flagged[0]["provider"] == "C"
    assert res.anomaly_row_count() == 1
    framed = {r["column"]: r.asDict() for r in frame_anomalies(res.report, res.total_rows).collect()}
    assert framed["streams"]["frequency"] == 0.2
    assert framed["streams"]["impact"] == "high"
    summary = business_summary(frame_anomalies(res.report, 5), 1, 5).collect()[0]["business_summary"]
    assert summary.startswith("1 rows (20.0%) hold anomalies; high-impact columns")
    assert "`streams`, `track_count`" in summary


def test_anomalies_zscore_fallback(spark):
    # IQR flags nothing when three quarters of the values are equal; z-score decides
    vals = [5.0] * 30 + [6.0] * 10 + [100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    res = detect_anomalies(df)
    rows = res.report.collect()
    assert len(rows) == 1
    assert rows[0]["method"] in ("iqr", "zscore")
    import numpy as np
    a = np.array(vals)
    q1, q3 = np.quantile(a, [0.25, 0.75])
    if q3 - q1 == 0:
        assert rows[0]["method"] == "zscore"
        assert rows[0]["threshold"] == "|z| > 3.0"


def test_no_anomalies_summary(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    res = detect_anomalies(df)
    assert res.report.count() == 0
    text = business_summary(frame_anomalies(res.report, 5), 0, 5).collect()[0]["business_summary"]
    assert text == "No anomalies were detected."


def test_dq_scores(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a", None), (2, 2.0, "a", None), (None, 2.0, "b", None), (4, 2.0, "b", None),
         (5, 2.0, "c", None), (6, 2.0, "c", None), (7, 2.0, "c", None), (8, 2.0, "c", None),
         (9, 2.0, "c", None), (10, 2.0, "c", None), (11, 2.0, "c", None), (12, 1000.0, "c", None)],
        "id bigint, v double, s string, empty double")
    scores = {r["column_name"]: r.asDict() for r in dq_scores(df).collect()}
    assert scores["id"]["completeness"] == round(11 / 12 * 100, 1)
    assert scores["id"]["uniqueness"] == 100.0
    assert scores["v"]["outlier_flag"] is True
    assert scores["id"]["outlier_flag"] is False
    assert scores["s"]["uniqueness"] == 25.0
    assert scores["empty"]["completeness"] == 0.0
    assert scores["empty"]["uniqueness"] == 100.0
    assert scores["s"]["format_score"] == 100.0
    overall = dq_overall(dq_scores(df)).collect()[0]
    assert overall["column_count"] == 4


def test_profile_and_schema(spark):
    df = spark.createDataFrame([(1, 10.5, "N"), (2, None, "S"), (3, 7.0, None), (4, 1.0, "N")],
                               "order_id bigint, sales double, region string")
    prof = {r["column_name"]: r.asDict() for r in profile(df).collect()}
    assert prof["sales"]["null_percentage"] == 25.0
    assert prof["sales"]["unique_count"] == 3
    assert prof["sales"]["min"] == 1.0 and prof["sales"]["max"] == 10.5
    assert prof["region"]["min"] is None
    assert len(prof["order_id"]["sample_values"]) == 4
    assert sorted(prof["region"]["sample_values"]) == ["N", "N", "S"]
    again = {r["column_name"]: r["sample_values"] for r in profile(df).collect()}
    assert again["order_id"] == prof["order_id"]["sample_values"]
    sch = {r["column_name"]: r.asDict() for r in schema_summary(df).collect()}
    assert sch["sales"]["nullable"] is True and sch["order_id"]["nullable"] is False
    assert sch["order_id"]["row_count"] == 4
