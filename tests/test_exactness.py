"""Exact counts, quantiles, formats and samples against plain Python."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.exprs import WHITE_SPACE, strip
from tidemark.operators.audit import key_checks, lineage_paths, screen_keys
from tidemark.operators.cleaning import DATE_FORMATS, candidate_formats, clean, value_shapes
from tidemark.operators.quality import dq_scores, profile
from tidemark.sources.loaders import load_monthly_extent, read_with_headers


def test_distinct_whole_numbers_as_words(spark):
    rows = [(i % 70 - 35, dt.date(1960, 1, 1) + dt.timedelta(days=i % 90), i % 2 == 0 if i % 5 else None, 2 ** 62 - i, f"t{i % 4}",
             -0.0 if i % 2 else 0.0) for i in range(500)] + [(None,) * 6, (-(2 ** 31), None, None, -(2 ** 63), "t0", 1.0)]
    df = spark.createDataFrame(rows, "a int, d date, b boolean, l long, s string, x double").repartition(4)
    got = {r.column_name: r.distinct_count for r in stats.distinct_counts_df(df, df.columns).collect()}
    want = {c: len({r[i] for r in rows if r[i] is not None}) for i, c in enumerate(df.columns)}
    assert got == want
    assert stats.distinct_counts_df(df.limit(0), ["a"]).collect() == []


@pytest.mark.parametrize("margin", [0.004, 1e-9])
def test_quantiles_from_sketched_brackets(spark, monkeypatch, margin):
    monkeypatch.setattr(stats, "SKETCH_MARGIN", margin)          # too narrow: ranks go back to the whole range
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 3) * rng.choice((-1, 1)) for _ in range(4000)] + [7.5] * 2000 + [1e300, -1e-300]
    df = spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(values)] + [(float("nan"), None), (None, None)], "x double, y double")
    probs = [0.0, 0.003, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = stats.quantiles(df.repartition(5), {"x": probs, "y": [0.5]})
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got["x"], np.quantile(values, probs)))
    assert got["y"] == [1.0]
    assert stats.quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}


def test_quantiles_with_infinities(spark):
    values = [float("inf"), float("-inf"), 1.0, 2.0, 3.0]
    assert stats.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), {"x": [0.5, 0.25]}) == {"x": [2.0, 1.0]}


def test_few_scans_for_quantiles(spark, monkeypatch):
    passes = []
    narrowed = stats._narrowed
    monkeypatch.setattr(stats, "_narrowed", lambda *a: passes.append(1) or narrowed(*a))
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    stats.quantiles(df, {"l_extendedprice": [0.25, 0.5], "l_orderkey": [0.75], "l_discount": [0.5]})
    assert len(passes) == 1                 # beside the pass of the sketches and the one that counts around them


def test_brackets_of_many_rows_are_refined_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 10)
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    values = [r[0] for r in df.select("l_extendedprice").collect()]
    got = stats.quantiles(df, {"l_extendedprice": [0.1, 0.5]})["l_extendedprice"]
    assert all(math.isclose(a, b) for a, b in zip(got, np.quantile(values, [0.1, 0.5])))


def test_strip_removes_all_white_space(spark):
    texts = [a + b + c for a in ("", " ", " \t", "　") for b in ("", "x", "x y", "é", "x é", "​") for c in ("", "\n", " ")]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip(WHITE_SPACE) for t in texts] + [None]


def test_shapes_leave_the_formats_that_can_read(spark):
    texts = ["2024/01/02", "2024/1/2", "03.04.2024", "May 5, 2024", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+01:00", "12", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shapes = {r["shape"]: r["n"] for r in value_shapes(df, {"t": F.col("t")}).collect()}
    assert shapes["9999/99/99"] == 1 and shapes["aaa 9, 9999"] == 1 and sum(shapes.values()) == 8
    allowed = candidate_formats(value_shapes(df, {"t": F.col("t")}))["t"]
    read = {DATE_FORMATS[k]: n for k, n in allowed.items()}
    assert read["yyyy/M/d"] == 2 and read["d.M.yyyy"] == 1 and read["yyyy-MM-dd'T'HH:mm:ssXXX"] == 2
    assert "yyyy-MM" not in read and "M/d/yyyy" not in read


def test_a_format_is_chosen_where_the_first_value_is_no_date(spark):
    rows = ["tbd"] + ["2024/03/04"] * 3 + ["05.06.2024"] * 2 + [" "]
    got = clean(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "k int, start_date string").coalesce(1))
    decision = next(d for d in got.decisions if d.column == "start_date")
    assert (decision.date_format, decision.failed, decision.kind) == ("yyyy/M/d", 3, "date_skipped")


def test_samples_follow_the_key(spark):
    rows = [(i, f"v{i % 7}" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v string")
    want = [v for _, v in sorted((hashlib.md5(f"{v}|{k}|0".encode()).hexdigest(), v) for k, v in rows if v)[:5]]
    for parts in (1, 6):
        got = {r.column_name: r.sample_values for r in profile(df.repartition(parts), key_columns=["k"]).collect()}
        assert got["v"] == want
    assert len(profile(df.select(F.lit(1).alias("same"))).first().sample_values) == 5


def test_class_shares(spark):
    df = spark.createDataFrame([(t,) for t in ["1", " 2 ", "3.5", "true", "2024-01-01", "word", "word", None]], "t string")
    assert dq_scores(df).first().dominant_class_share == round(200 / 7, 1)


def test_screened_containment_bounds_the_exact_one(spark):
    def keys(lo, hi):
        return spark.range(lo, hi).select(F.col("id").alias("k"))
    tables = {"a": keys(0, 40_000), "b": keys(10_000, 90_000), "c": keys(89_990, 90_010), "d": keys(0, 0)}
    screened = {(r.from_table, r.to_table): r for r in screen_keys(tables).collect()}
    for r in key_checks(tables).collect():
        s = screened[r.from_table, r.to_table]
        if r.from_keys:
            exact = 1 - r.from_keys_missing_in_to / r.from_keys
            assert s.low <= exact + 1e-12 and exact <= s.high + 1e-12
    small = screen_keys({"x": keys(0, 100), "y": keys(50, 120)}).first()
    assert small.contained == small.low == small.high == 0.5


def test_lineage_paths_add_up(spark):
    edges = spark.createDataFrame([("raw::a", "staging::a", 2, 1), ("staging::a", "mart::m::t", 0, 0), ("raw::b", "staging::b", 5, 0),
                                   ("staging::a", "mid::a", 1, 1), ("mid::a", "mart::n::t", 0, 3)],
                                  "from_node string, to_node string, blanks_nulled bigint, cast_failures bigint")
    got = {(r.raw_node, r.mart_node): (r.steps, r.blanks_nulled, r.cast_failures) for r in lineage_paths(edges).collect()}
    assert got == {("raw::a", "mart::m::t"): (2, 2, 1), ("raw::a", "mart::n::t"): (3, 3, 5)}


def _monthly(folder):
    folder.mkdir()
    (folder / "N_01_extent_v4.0.csv").write_text("year, mo,    extent, area\n1979, 1, 15.41, 12.4\n1980, 1, -9999, 1\n\n")
    (folder / "N_02_extent_v3.0.csv").write_text("extent,year,mo,source type\n16.2,1979,2,\"a, b\"\n")
    (folder / "N_03_extent_v4.0.csv").write_text("year,mo,extent\n1979,3,16.3\n1981,3,16.4\n")
    return folder


def test_monthly_files_of_different_headers(spark, tmp_path):
    folder = _monthly(tmp_path / "ice")
    paths = [str(folder / n) for n in ("N_01_extent_v4.0.csv", "N_02_extent_v3.0.csv", "N_03_extent_v4.0.csv")]
    read = read_with_headers(spark, paths)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    got = {(r.year, r.month): r.ice_extent for r in load_monthly_extent(spark, str(folder), {"version": "4.0"}).collect()}
    assert got == {(1979, 1): 15.41, (1979, 3): 16.3, (1981, 3): 16.4}       # February is there as v3.0 only
    older = load_monthly_extent(spark, str(folder), {"version": "3.0"}).collect()
    assert {(r.year, r.month) for r in older} == {(1979, 1), (1979, 2), (1979, 3), (1981, 3)}
    assert next(r for r in older if r.month == 2).source_type == "a, b"
    one = load_monthly_extent(spark, paths[2], {}).collect()
    assert sorted(r.date for r in one) == ["1979-03", "1981-03"]
    with pytest.raises(ValueError):
        load_monthly_extent(spark, str(tmp_path / "none"), {})
