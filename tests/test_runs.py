from tidemark.plans.runs import run_datasets, run_question


def test_run_question_end_to_end(spark, tmp_path):
    src = tmp_path / "release_impact.csv"
    src.write_text("release_year,provider,catalog,streams\n2024,A,Pop,100\n2024,B,Pop,150\n"
                   "2025,A,Rock,200\n2025,C,Rock,900\n2026,B,Jazz,120\n2026,B,Jazz,120\n")
    out = run_question(spark, str(src), "Which providers generated the highest total streams?",
                       str(tmp_path / "proj"))
    assert out["spec"].metric == "streams" and out["spec"].dimension == "provider"
    assert out["primary_mart"] == "mart_question_answer"
    qa = {r["provider"]: r["total_streams"] for r in out["marts"]["mart_question_answer"].collect()}
    assert qa == {"A": 300, "B": 270, "C": 900}
    assert out["cleaning_summary"].collect()[0]["duplicate_row_count"] == 1
    assert {"mart_release_impact", "mart_provider_performance", "mart_time_trend"} <= set(out["marts"])
    assert out["dq_overall"].collect()[0]["column_count"] == 4
    assert out["lineage"].count() > 4
    assert set(out["sql_export"]) == set(out["marts"])
    kpis = {r["kpi"]: r["value"] for r in out["kpis"].collect()}
    assert kpis["total_streams"] == 1470.0  # after the duplicate row is removed
    assert set(out["chart_feeds"]) == {"time_series", "category_comparison"}  # one measure only
    assert out["mart_measures"].count() > 0
    assert out["mart_key_checks"].count() > 0


def test_run_datasets_integrates(spark, tmp_path):
    for name, rows in (("revenue", "year,revenue\n2020,100\n2021,120\n2022,140\n"),
                       ("cost", "year,cost\n2021,70\n2022,85\n2023,90\n")):
        (tmp_path / f"{name}.csv").write_text(rows)
    out = run_datasets(spark, [
        {"name": "revenue", "path": str(tmp_path / "revenue.csv"), "time_column": "year"},
        {"name": "cost", "path": str(tmp_path / "cost.csv"), "time_column": "year",
         "trend_aggregation": "sum"}], str(tmp_path / "proj"), question="How did cost change over time?")
    wide = out["integrated"]
    assert wide.columns == ["year", "cost", "revenue"]
    assert [r["year"] for r in wide.collect()] == ["2020", "2021", "2022", "2023"]
    assert {"mart_revenue_trend", "mart_cost_trend", "mart_metric_correlation"} <= set(out["marts"])
    assert out["primary_mart"] == "mart_cost_trend"
    cost = {r["year"]: r["total_cost"] for r in out["marts"]["mart_cost_trend"].collect()}
    assert cost == {"2021": 70.0, "2022": 85.0, "2023": 90.0}
    cov = out["coverage"]["revenue"].collect()[0]
    assert (cov["min_year"], cov["max_year"]) == (2020, 2022)
