import pytest

from tidemark.operators.anomaly import business_summary, frame_anomalies

SCHEMA = "column string, method string, threshold string, anomaly_count bigint, example_values array<double>"


def _report(spark, rows):
    return spark.createDataFrame([(c, m, "t", n, [1.0]) for c, m, n in rows], SCHEMA)


@pytest.mark.parametrize("count,impact", [(0, "low"), (5, "low"), (20, "medium"), (70, "medium"),
                                          (100, "high"), (500, "high")])
def test_impact_tiers_at_boundaries(spark, count, impact):
    framed = frame_anomalies(_report(spark, [("revenue", "iqr", count)]), 1000).collect()[0]
    assert framed["impact"] == impact
    assert framed["frequency"] == round(count / 1000, 4)


def test_actions_and_fields(spark):
    rows = frame_anomalies(_report(spark, [("revenue", "iqr", 200), ("qty", "zscore", 50),
                                           ("tax", "iqr", 1)]), 1000).collect()
    by = {r["column"]: r for r in rows}
    assert "`revenue`" in by["revenue"]["suggested_action"] and "a tenth of the rows or more" in by["revenue"]["suggested_action"]
    assert "zscore" in by["qty"]["suggested_action"]
    assert "few values" in by["tax"]["suggested_action"]
    assert by["revenue"]["anomaly_count"] == 200 and by["revenue"]["method"] == "iqr"


def test_summaries(spark):
    high = frame_anomalies(_report(spark, [("price", "iqr", 200)]), 1000)
    text = business_summary(high, 200, 1000).collect()[0]["business_summary"]
    assert text == "200 rows (20.0%) hold anomalies; high-impact columns: `price`"
    medium = frame_anomalies(_report(spark, [("qty", "zscore", 50)]), 1000)
    text = business_summary(medium, 50, 1000).collect()[0]["business_summary"]
    assert "medium-impact" in text and "`qty`" in text
    low = frame_anomalies(_report(spark, [("a", "iqr", 1), ("b", "iqr", 2)]), 1000)
    text = business_summary(low, 3, 1000).collect()[0]["business_summary"]
    assert text == "3 rows (0.3%) hold anomalies; low-frequency in 2 column(s)"
    many = frame_anomalies(_report(spark, [(c, "iqr", 300) for c in "wxyz"]), 1000)
    text = business_summary(many, 900, 1000).collect()[0]["business_summary"]
    assert "`w`, `x`, `y`" in text and "`z`" not in text
