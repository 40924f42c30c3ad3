from pyspark.sql import functions as F

from tidemark.operators.cleaning import clean


def _rows(df):
    return [r.asDict() for r in df.orderBy("_row_id").collect()]


def test_clean_applies_strategy(spark):
    data = [
        ("2026-01-01", "100", "A", True, "2026-01-01T10:00:00"),
        ("2026-01-01", "100", "A", True, "2026-01-01T10:00:00"),
        ("bad-date", "200", "B", False, "2026-02-01T09:30:00"),
        ("2026-03-15", "oops", "C", True, "not-a-date"),
        ("2026-04-20", "300", "D", False, "2026-04-20T12:00:00"),
        (None, "400", " ", True, None),
    ]
    df = spark.createDataFrame(
        data, "` Release Date ` string, `Score Value` string, `Category Name` string, "
              "is_active boolean, `Created At` string").coalesce(1)
    res = clean(df)
    out = res.df_with_row_id
    assert res.df.columns == ["release_date", "score_value", "category_name", "is_active",
                              "created_at", "has_nulls", "invalid_date_parse",
                              "type_conversion_issue"]
    types = dict(res.df.dtypes)
    assert types["release_date"] == "string"
    assert types["score_value"] == "bigint"
    assert types["is_active"] == "boolean"
    assert types["created_at"] == "string"
    rows = _rows(out)
    assert len(rows) == 5
    assert [r["has_nulls"] for r in rows] == [False, False, True, False, True]
    assert [r["invalid_date_parse"] for r in rows] == [False, True, True, False, False]
    assert [r["type_conversion_issue"] for r in rows] == [False, False, True, False, False]
    s = res.summary().collect()[0].asDict()
    assert s == {"row_count": 5, "column_count": 5, "input_column_count": 5,
                 "duplicate_row_count": 1, "rows_with_nulls": 2,
                 "rows_with_invalid_date_parse": 2, "rows_with_type_conversion_issue": 1}
    nulls = {r["column_name"]: r["null_count"] for r in res.null_counts().collect()}
    assert nulls == {"release_date": 1, "score_value": 1, "category_name": 1,
                     "is_active": 0, "created_at": 1}
    log = {(r["action"], r["column_name"]): r["rows_affected"] for r in res.log.collect()}
    assert log[("replace_blank_with_null", "category_name")] == 1
    assert log[("cast_to_numeric", "score_value")] == 1
    assert log[("skip_date_parse", "release_date")] == 1
    assert log[("skip_date_parse", "created_at")] == 1
    assert log[("remove_duplicate_rows", None)] == 1


def test_clean_parses_valid_dates_and_keeps_text(spark):
    df = spark.createDataFrame(
        [("2026-01-01", "10", 1.5, True), ("2026-01-02", "ABC", 2.5, False)],
        "`Updated At` string, `Mixed Code` string, Amount double, is_active boolean")
    res = clean(df)
    types = dict(res.df.dtypes)
    assert types["updated_at"] == "timestamp"
    assert types["mixed_code"] == "string"
    assert types["amount"] == "double"
    rows = res.df.orderBy("updated_at").collect()
    assert [r["updated_at"].day for r in rows] == [1, 2]
    assert not any(r["invalid_date_parse"] or r["type_conversion_issue"] or r["has_nulls"]
                   for r in rows)
    assert res.summary().collect()[0]["duplicate_row_count"] == 0


def test_numeric_text_rules(spark):
    vals = ["1e3", " 7 ", "inf", "1,000", "1_000", "0x10", "1d", "nan", "2.5", "-3"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    from tidemark.functions.exprs import parse_number
    got = [r[0] for r in df.select(parse_number(F.col("v"))).collect()]
    assert got[0] == 1000.0 and got[1] == 7.0 and got[2] == float("inf")
    assert got[3:8] == [None] * 5
    assert got[8:] == [2.5, -3.0]


def test_name_collision_raises(spark):
    import pytest
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int")
    with pytest.raises(ValueError):
        clean(df)


def test_dedup_keeps_null_keys_together(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), ("1", None)], "a string, b string")
    res = clean(df)
    assert res.df.count() == 2


def test_dedup_keeps_first_rows_flags(spark):
    # 'oops' (cast failure) and '  ' (blank) both become NULL: one group, first row wins
    nums = [("B", "1"), ("B", "2"), ("C", "3"), ("D", "4"), ("E", "5")]
    first_bad = spark.createDataFrame([("A", "oops"), ("A", "  ")] + nums,
                                      "k string, n string").coalesce(1)
    res = clean(first_bad)
    row = [r for r in res.df.collect() if r["k"] == "A"]
    assert len(row) == 1 and row[0]["n"] is None and row[0]["type_conversion_issue"] is True
    first_blank = spark.createDataFrame([("A", "  "), ("A", "oops")] + nums,
                                        "k string, n string").coalesce(1)
    row = [r for r in clean(first_blank).df.collect() if r["k"] == "A"]
    assert len(row) == 1 and row[0]["type_conversion_issue"] is False
