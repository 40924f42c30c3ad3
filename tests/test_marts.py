import math

import numpy as np
import pytest

from tidemark.functions import stats
from tidemark.operators import marts


@pytest.fixture()
def plays(spark):
    rows = [(1999, "north", "jazz", 7), (1999, "south", "folk", 11), (1999, "north", "folk", 4), (2003, "south", "jazz", 20)]
    return spark.createDataFrame(rows, "release_year bigint, provider string, catalog string, plays bigint")


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_grouped_marts(plays):
    assert _rows(marts.release_impact_mart(plays, "plays")) == [(1999, 3, 22, 22 / 3), (2003, 1, 20, 20.0)]
    assert sorted(_rows(marts.provider_performance_mart(plays, "plays"))) == [("north", 2, 11, 5.5), ("south", 2, 31, 15.5)]
    assert sorted(_rows(marts.catalog_summary_mart(plays, "catalog", "plays"))) == [("folk", 2, 15, 7.5), ("jazz", 2, 27, 13.5)]
    assert _rows(marts.top_entities_mart(plays, "provider", "plays", "sum")) == [(1, "south", 2, 31), (2, "north", 2, 11)]


def test_mart_columns(plays):
    columns = {
        "release_year,record_count,avg_plays": marts.question_answer_mart(plays, "release_year", "plays", "average"),
        "rank,provider,record_count,total_plays": marts.top_entities_mart(plays, "provider", "plays", "sum"),
        "bin_start,bin_end,record_count": marts.distribution_mart(plays, "plays"),
        "release_year,record_count,total_plays": marts.time_trend_mart(plays, "plays", "sum", time_column="release_year"),
        "source_metric_column,min_plays,max_plays,avg_plays,median_plays,std_plays,p05_plays,p25_plays,p75_plays,p95_plays":
            marts.summary_stats_mart(plays, "plays"),
    }
    for names, mart in columns.items():
        assert ",".join(mart.columns) == names


def test_time_trend_is_ordered_by_its_figure(plays):
    highest = _rows(marts.time_trend_mart(plays, "plays", "sum", "highest", "release_year"))
    lowest = _rows(marts.time_trend_mart(plays, "plays", "sum", "lowest", "release_year"))
    assert highest == [(1999, 3, 22), (2003, 1, 20)] and lowest == highest[::-1]


def test_count_keeps_rows_without_a_value(spark):
    df = spark.createDataFrame([("p", None), ("p", 3.5), ("p", None), ("q", 1.0)], "shop string, price double")
    assert _rows(marts.question_answer_mart(df, "shop", "price", "count")) == [("p", 3, 3), ("q", 1, 1)]


def test_null_group_and_all_null_sum(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", None)], "k string, v double")
    rows = {r["k"]: r for r in marts.aggregate_by_dimension(df, "k", "v", "sum").collect()}
    assert rows[None]["total_v"] == 3.0 and rows["x"]["total_v"] == 0.0
    ordered = marts.aggregate_by_dimension(df, "k", "v", "average", "lowest").collect()
    assert ordered[-1]["k"] == "x"  # NULL average sorts last either way


def test_find_time_column_skips_flags(spark):
    df = spark.createDataFrame([("A", False, False)], "country string, invalid_date_parse boolean, has_nulls boolean")
    assert marts.find_time_column(df) is None


def _pandas_like_bins(values, bins=10):
    a = np.array(values, dtype=float)
    lo, hi = a.min(), a.max()
    n = min(bins, len(set(values)))
    edges = np.linspace(lo, hi, n + 1)
    edges[0] -= (hi - lo) * 0.001
    counts = [int(((a > edges[i]) & (a <= edges[i + 1])).sum()) for i in range(n)]
    return counts


def test_distribution_matches_equal_width_right_closed(spark):
    vals = [1.0, 2.0, 2.0, 3.5, 10.0, 7.25, 7.25, 9.0, 4.0, 5.5, 6.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = marts.distribution_mart(df, "x").collect()
    assert [r["record_count"] for r in rows] == _pandas_like_bins(vals)
    assert rows[0]["bin_start"] == round(1.0 - 9.0 * 0.001, 3)
    assert rows[-1]["bin_end"] == 10.0
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [tuple(r) for r in marts.distribution_mart(one, "x").collect()] == [(3.0, 3.0, 2)]
    few = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double")
    assert [r["record_count"] for r in marts.distribution_mart(few, "x").collect()] == [1, 2]
    with pytest.raises(ValueError):
        marts.distribution_mart(spark.createDataFrame([(None,)], "x double"), "x")


def test_summary_stats_values(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = marts.summary_stats_mart(df, "x").collect()[0]
    a = np.array(vals)
    assert r["median_x"] == pytest.approx(np.median(a))
    assert r["std_x"] == pytest.approx(a.std(ddof=1))
    for p, name in ((0.05, "p05_x"), (0.25, "p25_x"), (0.75, "p75_x"), (0.95, "p95_x")):
        assert r[name] == pytest.approx(np.quantile(a, p))
    single = spark.createDataFrame([(7.0,)], "x double")
    assert marts.summary_stats_mart(single, "x").collect()[0]["std_x"] == 0.0


@pytest.mark.parametrize("buckets", [64, 1024])
def test_quantile_refinement_matches_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(stats, "BUCKETS", buckets)
    rng = np.random.default_rng(7)
    hot = np.concatenate([rng.lognormal(3, 1, 600), np.full(400, 42.0)])          # one hot value
    mid = np.concatenate([np.full(450, 10.0), rng.uniform(10, 20, 100), np.full(450, 20.0)])
    wide = rng.choice([-1.7e308, 1.7e308, -1.0, 1e-300, 0.0, 5e-324, 1e17], 1000)
    rows = [(float(a), float(b), float(c), None, 3 if i % 2 else None) for i, (a, b, c) in enumerate(zip(hot, mid, wide))]
    df = spark.createDataFrame(rows + [(float("nan"), None, None, None, None)],
                               "hot double, mid double, `wi.de` double, none double, few int").repartition(6)
    probs = [0.05, 0.25, 0.49, 0.5, 0.95, 0.0, 1.0]
    got = stats.quantiles(df, {c: probs for c in df.columns})
    for name, values in (("hot", hot), ("mid", mid)):
        assert got[name] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    ordered = np.sort(wide)
    assert got["wi.de"][-1] == ordered[-1] and got["wi.de"][-2] == ordered[0]
    assert got["none"] == [None] * len(probs) and got["few"] == [3.0] * len(probs)


def test_quantiles_with_infinities(spark):
    values = [float("-inf"), 1.0, 2.0, 1.7e308, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert stats.quantiles(df, {"x": [0.2, 0.4, 1.0]})["x"] == [1.0, 2.0, float("inf")]


def test_correlation_pairwise_and_constant(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.1, 5.0, 1.0), (3.0, 5.9, 5.0, 2.0), (4.0, 8.2, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    out = {(r["left_metric"], r["right_metric"]): r["correlation"]
           for r in marts.correlation_mart(df, ["b", "a", "c", "d"]).collect()}
    assert set(out) == {("a", "b"), ("a", "d"), ("b", "d")}
    assert out[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2.0, 4.1, 5.9, 8.2])[0, 1])
    assert out[("a", "d")] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        marts.correlation_mart(df, ["a", "zzz"])


def test_integrated_marts(spark):
    df = spark.createDataFrame([("2020", 100.0, 60.0), ("2021", 120.0, None), ("2021", 140.0, 85.0),
                                ("x", 1.0, 1.0), ("1999", None, 2.0)], "year string, revenue double, cost double")
    trend = {r["year"]: r for r in marts.integrated_trend_mart(df, "revenue").collect()}
    assert "1999" not in trend and trend["2021"]["avg_revenue"] == 130.0
    ranked = marts.ranked_periods_mart(df, "revenue", "sum", limit=2).collect()
    assert [r["year"] for r in ranked] == ["2021", "2020"]
    dec = [(r["decade"], r["record_count"]) for r in marts.decade_mart(df, "cost").collect()]
    assert dec == [(1990, 1), (2020, 2)]
    assert marts.integrated_metric_columns(df) == ["revenue", "cost"]


def test_histogram_edges_match_pandas_cut():
    import pandas as pd
    rng = np.random.default_rng(3)
    for _ in range(100):
        scale = 10.0 ** int(rng.integers(-4, 7))
        vals = pd.Series(rng.normal(0, 1, 40) * scale + rng.normal() * scale)
        n = min(10, vals.nunique())
        cats = pd.cut(vals, bins=n)
        iv = cats.cat.categories
        edges, labels = marts.histogram_edges(float(vals.min()), float(vals.max()), n)
        assert labels == [float(iv[0].left)] + [float(i.right) for i in iv]
        a = vals.to_numpy()
        assert [int(((a > edges[i]) & (a <= edges[i + 1])).sum()) for i in range(n)] == \
            cats.value_counts(sort=False).tolist()


def test_numeric_text_rule_matches_pandas():
    import re
    import pandas as pd
    from tidemark.functions.exprs import NUMERIC_TEXT
    for t in ["1", " 2 ", "1e3", "1E-2", "+5", "-7.5", ".5", "5.", "inf", "-inf", "Infinity", "nan",
              "NaN", "1,000", "1_000", "0x10", "1d", "1f", "abc", "1.2.3", "--1", "1e", "e3", "1 000"]:
        p = pd.to_numeric(pd.Series([t.strip()], dtype="string"), errors="coerce").iloc[0]
        assert (not pd.isna(p)) == (re.match(NUMERIC_TEXT, t.strip()) is not None), t


def test_correlation_batches(spark, monkeypatch):
    monkeypatch.setattr(marts, "PAIRS_PER_PASS", 2)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(30, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, d double")
    out = {(r["left_metric"], r["right_metric"]): r["correlation"]
           for r in marts.correlation_mart(df, ["a", "b", "c", "d"]).collect()}
    assert len(out) == 6
    assert out[("b", "d")] == pytest.approx(np.corrcoef(data[:, 1], data[:, 3])[0, 1])
