"""Aggregate marts (C1-C13) with sorting, top-k and ranking.

Every mart is a single ``groupBy().agg()`` (the reference's "aggregate, then
merge a second aggregate back on the key" is fused into one aggregation, so
there is no join and null group keys survive, S1/S2). Sorting follows pandas:
nulls last in both directions (S4).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import (
    day_label, decade_of, field_types, is_numeric_type, is_time_type, nan_to_null, quoted)
from tidemark.functions.names import QUALITY_FLAG_COLUMNS
from tidemark.functions.semantic import metric_metadata, metric_name
from tidemark.functions.stats import quantile_figures, quantiles
from tidemark.functions.wording import tells_time
from tidemark.operators.grouped import GroupedMart

AGGREGATIONS = ("average", "sum", "count")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Fail before any job when a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def _c(name: str) -> Column:
    return quoted(name)


def _named(expr: Column, source: str | None, aggregation: str) -> Column:
    name = metric_name(source, aggregation) if source else "record_count"
    return expr.alias(name, metadata=metric_metadata(name, source, aggregation))


def _order(col: Column, ascending: bool) -> Column:
    return col.asc_nulls_last() if ascending else col.desc_nulls_last()


def metric_aggregate(metric: str, aggregation: str, null_sum_is_zero: bool = True) -> Column:
    """avg / sum / count of a metric column, named by the semantic contract."""
    m = _c(metric)
    if aggregation == "average":
        expr = F.avg(m)
    elif aggregation == "sum":
        expr = F.coalesce(F.sum(m), F.lit(0)) if null_sum_is_zero else F.sum(m)
    elif aggregation == "count":
        expr = F.count(m)
    else:
        raise ValueError(f"Unsupported aggregation: {aggregation}")
    return _named(expr, metric, aggregation)


# --------------------------------------------------------------------------- C1
def aggregate_by_dimension(df: DataFrame, dimension: str, metric: str,
                           aggregation: str, ordering: str = "highest") -> DataFrame:
    """Group size plus the metric aggregate per dimension value.

    ``record_count`` is the group size (rows, S5); aggregation ``count`` also
    counts rows, nulls included (S6); ``sum`` of an all-null group is 0 (S3).
    The virtual metric ``record_count`` yields only the group size.
    """
    require_columns(df, [dimension])
    ascending = ordering == "lowest"
    rows = _named(F.count(F.lit(1)), None, "count")
    if metric == "record_count":
        mart = df.groupBy(_c(dimension)).agg(rows)
        sort_col = "record_count"
    else:
        require_columns(df, [metric])
        if aggregation == "average":
            value = F.avg(_c(metric))
        elif aggregation == "sum":
            value = F.coalesce(F.sum(_c(metric)), F.lit(0))
        elif aggregation == "count":
            value = F.count(F.lit(1))
        else:
            raise ValueError(f"Unsupported aggregation: {aggregation}")
        mart = df.groupBy(_c(dimension)).agg(rows, _named(value, metric, aggregation))
        sort_col = metric_name(metric, aggregation)
    return mart.orderBy(_order(_c(sort_col), ascending), _c(dimension).asc_nulls_last())


def keyed_mart(name: str, key_name: str, key: Column, metric: str, aggregation: str, ordering: str = "highest",
               order: tuple | None = None, **more) -> GroupedMart:
    """C1 as one of several marts of a scan (:mod:`tidemark.operators.grouped`):
    the same figures and order as :func:`aggregate_by_dimension`."""
    rows, figures = F.count(F.lit(1)), {}
    figures["record_count"] = rows
    if metric != "record_count":
        value = {"average": F.avg(_c(metric)), "sum": F.coalesce(F.sum(_c(metric)), F.lit(0)), "count": rows}.get(aggregation)
        if value is None:
            raise ValueError(f"Unsupported aggregation: {aggregation}")
        figures[metric_name(metric, aggregation)] = value
    lead = list(figures)[-1]
    return GroupedMart(name, key_name, key, figures, ((lead, ordering == "lowest"),) if order is None else order,
                       metadata=figure_metadata(metric, aggregation), **more)


def figure_metadata(metric: str | None, *aggregations: str) -> dict[str, dict]:
    """The metadata of the figures of a metric, and of the row count."""
    out = {"record_count": metric_metadata("record_count", None, "count")}
    if metric and metric != "record_count":
        out.update((metric_name(metric, a), metric_metadata(metric_name(metric, a), metric, a)) for a in aggregations)
    return out


def question_answer_mart(df: DataFrame, dimension: str, metric: str, aggregation: str,
                         ordering: str = "highest") -> DataFrame:
    """The mart that answers the question."""
    return aggregate_by_dimension(df, dimension, metric, aggregation, ordering)


def top_entities_mart(df: DataFrame, dimension: str, metric: str, aggregation: str,
                      ordering: str = "highest", limit: int = 20) -> DataFrame:
    """First ``limit`` rows of C1 with rank 1..n.

    The sort + limit plans as TakeOrderedAndProject (a per-task top-k, then a
    merge of k rows per task); the rank window only ever sees those k rows.
    """
    ranked = aggregate_by_dimension(df, dimension, metric, aggregation, ordering).limit(limit)
    ascending = ordering == "lowest"
    sort_col = "record_count" if metric == "record_count" else metric_name(metric, aggregation)
    w = Window.orderBy(_order(_c(sort_col), ascending), _c(dimension).asc_nulls_last())
    out = ranked.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return out.select("rank", *[c for c in ranked.columns])


# ------------------------------------------------------------------------ C4-C6
def _metric_summary(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Non-null metric count (S5), total (S3) and average per key."""
    return df.groupBy(_c(key)).agg(
        _named(F.count(_c(metric)), None, "count"),
        _named(F.coalesce(F.sum(_c(metric)), F.lit(0)), metric, "sum"),
        _named(F.avg(_c(metric)), metric, "average"),
    )


def release_impact_mart(df: DataFrame, metric: str, year_column: str = "release_year") -> DataFrame:
    """C4: per release year, sorted by year."""
    require_columns(df, [year_column, metric])
    return _metric_summary(df, year_column, metric).orderBy(_c(year_column).asc_nulls_last())


def provider_performance_mart(df: DataFrame, metric: str, provider_column: str = "provider") -> DataFrame:
    """Per provider, sorted by total descending."""
    require_columns(df, [provider_column, metric])
    return _metric_summary(df, provider_column, metric).orderBy(
        _c(metric_name(metric, "sum")).desc_nulls_last(), _c(provider_column).asc_nulls_last())


def catalog_summary_mart(df: DataFrame, catalog_column: str, metric: str | None = None) -> DataFrame:
    """Rows per catalog value, plus total and average when a metric is given."""
    required = [catalog_column] + ([metric] if metric else [])
    require_columns(df, required)
    aggs = [_named(F.count(F.lit(1)), None, "count")]
    if metric:
        aggs += [_named(F.coalesce(F.sum(_c(metric)), F.lit(0)), metric, "sum"),
                 _named(F.avg(_c(metric)), metric, "average")]
    return df.groupBy(_c(catalog_column)).agg(*aggs).orderBy(
        F.col("record_count").desc(), _c(catalog_column).asc_nulls_last())


# --------------------------------------------------------------------------- C7
def _round_fraction(x: float, precision: int) -> float:
    """Round the fractional part to ``precision`` digits (significant when |x| < 1)."""
    if not math.isfinite(x) or x == 0:
        return x
    whole = math.trunc(x)
    if whole == 0:
        frac = x - whole
        digits = -int(math.floor(math.log10(abs(frac)))) - 1 + precision
    else:
        digits = precision
    return round(x, digits)


def histogram_edges(lo: float, hi: float, bins: int) -> tuple[list[float], list[float]]:
    """Equal-width, right-closed edges with the first edge lowered by 0.1% of
    the range, plus the edge labels rounded to the least precision (from 3 up)
    that keeps them distinct. At most ``bins + 1`` numbers: driver-side."""
    step = (hi - lo) / bins
    edges = [lo + i * step for i in range(bins + 1)]
    edges[-1] = hi
    edges[0] = edges[0] - (hi - lo) * 0.001
    labels = edges
    for precision in range(3, 20):
        candidate = [_round_fraction(e, precision) for e in edges]
        if len(set(candidate)) == len(candidate):
            labels = candidate
            break
    return edges, labels


def value_of(metric: str) -> Column:
    """A metric as a double; NaN is missing."""
    return nan_to_null(_c(metric).cast("double"))


def range_figures(metric: str) -> dict[str, Column]:
    """What a distribution needs to know of a whole table."""
    x = value_of(metric)
    return {"n": F.count(x), "lo": F.min(x), "hi": F.max(x)}


def distribution_mart(df: DataFrame, metric: str, bins: int = 10, known: dict | None = None) -> DataFrame:
    """Histogram with n = min(bins, distinct values) equal-width bins.

    Pass 1 (one global aggregate, or ``known`` from one): min, max, non-null
    count. The distinct values are counted up to ``bins`` only (a limit per task
    and in all: no more are needed to know n). Pass 2 is one more global
    aggregate with one ``count_if`` per bin, unpivoted to rows, so empty bins
    appear with 0 and no join or shuffle of rows is needed. NaN is missing; an
    infinite value has no bin, so it raises.
    """
    require_columns(df, [metric])
    x = value_of(metric)
    stats = known or df.agg(*[e.alias(n) for n, e in range_figures(metric).items()]).collect()[0].asDict()
    if not stats["n"]:
        raise ValueError(f"Column {metric} holds no values to bin.")
    lo, hi = stats["lo"], stats["hi"]
    if math.isinf(lo) or math.isinf(hi):
        raise ValueError(f"Column {metric} holds infinite values, which no bin of equal width can hold.")
    distinct = df.select(x.alias("x")).where(F.col("x").isNotNull()).distinct().limit(bins).count()
    if lo == hi or distinct <= 1:
        return df.agg(F.lit(lo).alias("bin_start"), F.lit(hi).alias("bin_end"),
                      F.count(x).alias("record_count"))
    n = min(bins, distinct)
    edges, labels = histogram_edges(lo, hi, n)
    counts = [F.count_if((x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))).alias(f"b{i}")
              for i in range(n)]
    one_row = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(float(labels[i])).alias("bin_start"),
                              F.lit(float(labels[i + 1])).alias("bin_end"),
                              F.col(f"b{i}").alias("record_count")) for i in range(n)])
    return one_row.select(F.inline(rows))


# --------------------------------------------------------------------------- C8
SUMMARY_PROBS = (0.5, 0.05, 0.25, 0.75, 0.95)


def summary_figures(metric: str) -> dict[str, Column]:
    """The figures of C8 that one aggregate gives."""
    x = value_of(metric)
    return {**range_figures(metric), "mean": F.avg(x), "std": F.stddev_samp(x)}


def summary_stats_mart(df: DataFrame, metric: str, approx_accuracy: int | None = None,
                       known: dict | None = None) -> DataFrame:
    """One row of min, max, mean, median, std (ddof 1, 0 for one value),
    p05/p25/p75/p95 (exact, linear interpolation; or, when
    ``approx_accuracy`` is given, Spark's ``percentile_approx`` in one pass).
    ``known`` may hold :func:`summary_figures` of a pass before."""
    require_columns(df, [metric])
    figures = {**summary_figures(metric)}
    if approx_accuracy:
        figures["q"] = F.percentile_approx(value_of(metric), list(SUMMARY_PROBS), approx_accuracy)
    else:
        figures.update(quantile_figures(metric, list(SUMMARY_PROBS)))
    base = known if known and not approx_accuracy else df.agg(*[e.alias(n) for n, e in figures.items()]).collect()[0].asDict()
    if not base["n"]:
        raise ValueError(f"Column {metric} holds no values to summarise.")
    q = [float(v) for v in base["q"]] if approx_accuracy else \
        quantiles(df, {metric: list(SUMMARY_PROBS)}, {metric: base} if "brackets" in base else None)[metric]
    figures = {"min": base["lo"], "max": base["hi"], "average": base["mean"], "median": q[0],
               "std": base["std"] if base["n"] > 1 else 0.0, "p05": q[1], "p25": q[2], "p75": q[3], "p95": q[4]}
    one = df.sparkSession.createDataFrame([(metric,)], "source_metric_column string")
    return one.select("source_metric_column",
                      *[_named(F.lit(v).cast("double"), metric, agg) for agg, v in figures.items()])


# ------------------------------------------------------------------ C9 and G10
def find_time_column(df: DataFrame) -> str | None:
    """The first column that holds dates or times, or whose name says so by
    a word of its own (``lifetime_value`` does not)."""
    able = (f for f in df.schema.fields
            if f.name.lower() not in QUALITY_FLAG_COLUMNS and not isinstance(f.dataType, T.BooleanType))
    return next((f.name for f in able if is_time_type(f.dataType) or tells_time(f.name)), None)


def time_trend_mart(df: DataFrame, metric: str, aggregation: str, ordering: str = "highest",
                    time_column: str | None = None) -> DataFrame:
    """C1 over the day label of the time column; sorted by the metric."""
    column = time_column or find_time_column(df)
    if column is None:
        raise ValueError("the table has no time column for a trend")
    dtype = field_types(df)[column]
    period = day_label(_c(column)) if is_time_type(dtype) else _c(column)
    needed = [metric] if metric != "record_count" and metric in df.columns else []
    working = df.select(period.alias("_time_period"), *[_c(m) for m in needed])
    mart = aggregate_by_dimension(working, "_time_period", metric, aggregation, ordering)
    return mart.withColumnRenamed("_time_period", column)


# ---------------------------------------------------------------- C10, C12, C13
def integrated_metric_columns(df: DataFrame, time_column: str = "year") -> list[str]:
    """Numeric (non-bool) columns of an integrated table, time key excluded.
    The all-null check needs data and is done by the caller's stats pass."""
    return [f.name for f in df.schema.fields
            if f.name != time_column and is_numeric_type(f.dataType)]


def _keyed_metric(df: DataFrame, key: Column, key_name: str, column: str,
                  aggregation: str) -> DataFrame:
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"Unsupported integrated aggregation: {aggregation}")
    return df.groupBy(key.alias(key_name)).agg(
        _named(F.count(_c(column)), None, "count"),
        metric_aggregate(column, aggregation))


def integrated_trend_mart(df: DataFrame, column: str, aggregation: str = "average",
                          time_column: str = "year") -> DataFrame:
    """Per time key, non-null count and the aggregate; empty keys dropped."""
    require_columns(df, [time_column, column])
    mart = _keyed_metric(df, _c(time_column), time_column, column, aggregation)
    return mart.where(F.col("record_count") > 0).orderBy(_c(time_column).asc_nulls_last())


def ranked_periods_mart(df: DataFrame, column: str, aggregation: str = "average",
                        time_column: str = "year", ordering: str = "highest",
                        limit: int = 10) -> DataFrame:
    """Periods ranked by the aggregate (then time ascending), top ``limit``."""
    require_columns(df, [time_column, column])
    mart = _keyed_metric(df, _c(time_column), time_column, column, aggregation)
    value = _c(metric_name(column, aggregation))
    return mart.orderBy(_order(value, ordering == "lowest"),
                        _c(time_column).asc_nulls_last()).limit(limit)


def decade_mart(df: DataFrame, column: str, aggregation: str = "average",
                year_column: str = "year") -> DataFrame:
    """Per decade of the numeric year; non-numeric years are dropped."""
    require_columns(df, [year_column, column])
    working = df.select(decade_of(_c(year_column)).alias("decade"), _c(column)).where(
        F.col("decade").isNotNull())
    mart = _keyed_metric(working, F.col("decade"), "decade", column, aggregation)
    return mart.orderBy("decade")


# ------------------------------------------------------------------ C11, C14
def correlation_figure(a: str, b: str) -> Column:
    """Pearson correlation over the rows that hold both values; NULL for a constant."""
    both = _c(a).isNotNull() & _c(b).isNotNull()
    xa, xb = F.when(both, _c(a).cast("double")), F.when(both, _c(b).cast("double"))
    return F.try_divide(F.covar_samp(xa, xb), F.stddev_samp(xa) * F.stddev_samp(xb))


def correlation_pairs(columns: list[str]) -> list[tuple[str, str]]:
    names = sorted(columns)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


def correlation_rows(one_row: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """The long form of a row of correlations; ``pairs`` names the pair of each column.
    Pairs without a correlation are left out (S9)."""
    structs = [F.struct(F.lit(a).alias("left_metric"), F.lit(b).alias("right_metric"), quoted(c).alias("correlation"))
               for c, (a, b) in pairs.items()]
    return one_row.select(F.inline(F.array(*structs))).where(
        F.col("correlation").isNotNull() & ~F.isnan("correlation"))


def correlation_mart(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, long form, left < right.

    Pairwise-complete (a row counts for a pair only when both values are
    present). A constant column has no correlation: ``try_divide`` yields NULL
    and the pair is dropped (S9). All k(k-1)/2 pairs are computed in one
    aggregate over the table; the one-row result is unpivoted.
    """
    available = [c for c in columns if c in df.columns]
    if len(available) < 2:
        raise ValueError("a correlation needs two columns at least")
    pairs = correlation_pairs(available)
    out = None
    # pairs are computed in batches so one generated aggregate stays compact
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        named = {f"r_{i}": p for i, p in enumerate(pairs[start:start + PAIRS_PER_PASS])}
        part = correlation_rows(df.agg(*[correlation_figure(*p).alias(c) for c, p in named.items()]), named)
        out = part if out is None else out.unionByName(part)
    return out


PAIRS_PER_PASS = 64

# The four named climate columns of the specialised mart set.
CLIMATE_COLUMNS = ("temperature", "co2", "sea_level", "ice_extent")


def climate_correlation_mart(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C14: correlation over the named climate column set."""
    return correlation_mart(df, list(columns or CLIMATE_COLUMNS))
