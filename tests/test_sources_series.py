import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.sources import loaders, readers, sinks


def test_csv_typing_and_na_words(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("customer_id,amount,region,flag,mixed\n1,10.5,N,true,1\n2,NA,S,false,x\n3,7,,TRUE,2\n")
    df = readers.read_source(spark, str(p))
    types = dict(df.dtypes)
    assert types["customer_id"] == "bigint"
    assert types["amount"] == "double"
    assert types["region"] == "string"
    assert types["flag"] == "boolean"
    assert types["mixed"] == "string"
    rows = df.orderBy("_row_id").collect()
    assert [r["amount"] for r in rows] == [10.5, None, 7.0]
    assert rows[2]["region"] is None


def test_format_detection_and_missing(spark, tmp_path):
    assert readers.detect_format("a/b.PQ") == "parquet"
    assert readers.detect_format("x.txt", "csv") == "csv"
    with pytest.raises(ValueError):
        readers.detect_format("x.txt")
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, str(tmp_path / "nope.csv"))
    with pytest.raises(ValueError):
        readers.read_source(spark, "https://example.org/a.csv")
    assert readers.source_name_of("/data/Sales Export.csv") == "sales_export"


def test_snapshot_audit_and_marts(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("customer_id,amount,region\n1,10,N\n2,,S\n")
    snap, manifest = sinks.ingest(spark, str(p), str(tmp_path / "proj"))
    assert manifest["rows_processed"] == 2 and manifest["column_count"] == 3
    assert snap.count() == 2
    audit = spark.read.parquet(str(tmp_path / "proj" / "audit" / "ingestion"))
    assert audit.count() == 1
    path, mart = sinks.write_mart(snap.groupBy("region").count(), str(tmp_path / "proj"), "Mart X")
    assert path.endswith("marts/mart_x") and mart.count() == 2
    staged1 = sinks.write_staging(snap, str(tmp_path / "proj"), "src")
    staged2 = sinks.write_staging(snap, str(tmp_path / "proj"), "src")
    assert staged1 != staged2


def test_sql_insert_batches(spark):
    df = spark.createDataFrame([(i, f"o'k{i}", None if i % 2 else 1.5) for i in range(1203)],
                               "id bigint, name string, v double").repartition(3)
    stmts = sinks.insert_statements(df, "t", batch_size=500).collect()
    total = sum(s["statement"].count("\n(") for s in stmts)
    assert total == 1203
    assert all(s["statement"].count("\n(") <= 500 for s in stmts)
    text = "".join(s["statement"] for s in stmts)
    assert "'o''k7'" in text and "NULL" in text
    assert 'CREATE TABLE "t"' in sinks.create_table_sql(df, "t")
    assert "DOUBLE PRECISION" in sinks.create_table_sql(df, "t")


def test_whitespace_feed(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("% header line\n%\n  1850   1  -0.777  0.4  NaN NaN\n  1850   2  -0.2 0.3 % trailing\n\n")
    df = loaders.load_dataset(spark, {"loader": "berkeley_temperature", "path": str(p)})
    rows = df.orderBy("month").collect()
    assert len(rows) == 2
    assert rows[0]["date"] == "1850-01" and rows[0]["temperature_anomaly"] == -0.777
    assert rows[0]["annual_temperature_anomaly"] is None
    assert rows[1]["source"] == "berkeley_earth"


def test_entity_and_indicator(spark, tmp_path):
    p = tmp_path / "co2.csv"
    p.write_text("country,year,iso_code,co2,co2_growth_abs,co2_growth_prct,co2_per_capita,"
                 "share_global_co2,population\nWorld,2000.0,,25.1,1,2,3,100,6000\n"
                 "France,2000,FRA,0.4,1,2,3,1,60\nWorld,,,26,1,2,3,100,6100\n")
    df = loaders.load_dataset(spark, {"loader": "owid_world_co2", "path": str(p)})
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["year"] == 2000 and rows[0]["date"] == "2000-01"
    assert rows[0]["month"] == 1
    feed = tmp_path / "wb.json"
    feed.write_text(json.dumps([{"page": 1, "pages": 1}, [
        {"country": {"id": "1W", "value": "World"}, "indicator": {"id": "NY", "value": "GDP"},
         "date": "2020", "value": 1.5},
        "junk",
        {"country": {"id": "FR", "value": "France"}, "indicator": {"id": "NY", "value": "GDP"},
         "date": "2020", "value": 2.5}]]))
    ind = loaders.load_dataset(spark, {"loader": "world_indicator_series", "path": str(feed),
                                       "metric_column": "gdp"})
    rows = ind.collect()
    assert len(rows) == 1 and rows[0]["gdp"] == 1.5 and rows[0]["year"] == 2020
    assert rows[0]["country_name"] == "World"


def test_page_arrays(spark):
    html = "<script>var chart_x = [1993.0417, 1993.125,\n 2000.5]\n var chart_y = [1.0, 2.0, 3.5]\n var z = 1</script>"
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id bigint, html string")
    rows = series.page_arrays(pages, key_columns=["page_id"]).orderBy("page_id", "year_decimal").collect()
    good = [r for r in rows if r["page_id"] == 1]
    assert [r["sea_level"] for r in good] == [1.0, 2.0, 3.5]
    assert good[0]["date"] == "1993-01" and good[1]["date"] == "1993-02"
    bad = [r for r in rows if r["page_id"] == 2]
    assert len(bad) == 1 and bad[0]["error"] == "page has no array chart_x"


def test_monthly_extent(spark, tmp_path):
    for m in (1, 2):
        (tmp_path / f"N_{m:02d}_extent_v4.0.csv").write_text(
            f"year, mo, source_dataset, region, extent,   area\n2000, {m}, x, N, {10 + m}, 9\n"
            f"2001, {m}, x, N, -9999, -9999\n")
    used, fallback, skipped = loaders.monthly_paths(spark, str(tmp_path), "3.0")
    assert len(used) == 2 and len(fallback) == 2 and len(skipped) == 20
    df = loaders.load_dataset(spark, {"loader": "nsidc_monthly_ice_extent", "path": str(tmp_path),
                                      "version": "3.0"})
    rows = df.orderBy("month").collect()
    assert [r["ice_extent"] for r in rows] == [11.0, 12.0]
    assert rows[0]["date"] == "2000-01" and "area" in df.columns


def test_yearly_aggregate_and_lists(spark, tmp_path):
    p = tmp_path / "books.csv"
    p.write_text('year,artists,rating\n2001,"[\'a\', \'b\']",4.0\n2001,"[\'a\']",3.0\n'
                 '2002,plain,\n1999,"[\'z\']",5\n')
    df = loaders.load_dataset(spark, {"loader": "aggregated_time_series", "path": str(p),
                                      "metric_column": "total_artists", "aggregation": "count_distinct",
                                      "entity_column": "artists", "entity_parser": "python_list",
                                      "min_year": 2000})
    assert [(r["year"], r["total_artists"]) for r in df.collect()] == [(2001, 2), (2002, 1)]
    avg = loaders.load_dataset(spark, {"loader": "aggregated_time_series", "path": str(p),
                                       "metric_column": "avg_rating", "aggregation": "average",
                                       "value_column": "rating"})
    assert [(r["year"], r["avg_rating"]) for r in avg.collect()] == [(1999, 5.0), (2001, 3.5)]
    with pytest.raises(ValueError):
        loaders.load_dataset(spark, {"loader": "aggregated_time_series", "path": str(p),
                                     "metric_column": "m", "aggregation": "sum",
                                     "value_column": "rating", "min_year": 2050})
    with pytest.raises(ValueError):
        loaders.load_dataset(spark, {"loader": "nope", "path": str(p)})


def test_coerce_year_rules(spark):
    df = spark.createDataFrame([("2020-05-01",), ("c. 1999",), ("2021-01-02",)], "t string")
    got = [r[0] for r in df.select(series.coerce_year(df, "t")).collect()]
    assert got == [2020, 1999, 2021]
    nums = spark.createDataFrame([(2020.5,), (2021.4,), (None,)], "t double")
    assert [r[0] for r in nums.select(series.coerce_year(nums, "t")).collect()][:2] == [2020, 2021]


def test_sql_literal_rendering(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame(
        [(True, dt.datetime(2024, 1, 2, 3, 4, 5), "a'b", None), (False, None, None, 2.5)],
        "flag boolean, ts timestamp, name string, v double")
    text = "".join(r["statement"] for r in sinks.insert_statements(df, "t").collect())
    assert "(TRUE, '2024-01-02 03:04:05.000000+00', 'a''b', NULL)" in text
    assert "(FALSE, NULL, NULL, 2.5)" in text
    ddl = sinks.create_table_sql(df, "t")
    assert '"flag" BOOLEAN' in ddl and '"ts" TIMESTAMPTZ' in ddl and '"name" TEXT' in ddl
    written = sinks.export_sql_text({"Mart A": df, "empty": df.limit(0)}, str(tmp_path / "sql"))
    assert list(written) == ["Mart A"]
    assert spark.read.text(written["Mart A"] + "/schema").count() > 0
