"""KPI values, KPI panel, chart feeds and mart measures (G6-G9), re-aimed:
the reference names these figures; here they are computed.

Each output is a long ``(name, value)`` table from one aggregate per input
(unpivoted), so the cost is one pass per table regardless of the KPI count.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import day_label, is_numeric_type, is_time_type, quoted
from tidemark.functions.stats import quantile_figures, quantiles
from tidemark.functions.wording import best_first, plain_words, tells_time
from tidemark.operators.grouped import GroupedMart, GroupedMarts
from tidemark.operators.marts import keyed_mart

# Measure- and dimension-name hints of the KPI rules.
KPI_METRIC_HINTS = ("streams", "sales", "revenue", "amount", "value", "score", "count")
KPI_DIMENSION_HINTS = ("year", "date", "provider", "artist", "category", "type", "region")
AVERAGE_WORDS = {"average", "avg", "mean"}
COUNT_WORDS = {"count", "number", "most", "largest"}
SUM_WORDS = {"total", "sum"}


def _c(name: str) -> Column:
    return quoted(name)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def _long(one_row: DataFrame, items: list[tuple[str, str, Column]]) -> DataFrame:
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("kpi"), F.lit(role).alias("role"), expr.cast("double").alias("value"))
        for name, role, expr in items])))


def _fit(name: str, asked: frozenset[str], hints: tuple[str, ...]) -> tuple[int, int]:
    """How well a column name suits a question: shared words, then hints in the name."""
    return len(plain_words(name) & asked), sum(hint in name.lower() for hint in hints)


def primary_measure(df: DataFrame, question: str) -> str | None:
    """The numeric column that suits the question best."""
    asked = plain_words(question)
    return next(iter(best_first(_numeric(df), lambda c: _fit(c, asked, KPI_METRIC_HINTS))), None)


def rank_dimensions(df: DataFrame, question: str, limit: int = 3) -> list[str]:
    """G6 (schema only): columns that are no numbers or carry a dimension hint, best first."""
    asked = plain_words(question)
    fits = {f.name: _fit(f.name, asked, KPI_DIMENSION_HINTS) for f in df.schema.fields}
    able = [f.name for f in df.schema.fields if fits[f.name][1] or not is_numeric_type(f.dataType)]
    return best_first(able, fits.get)[:limit]


def _intent(question: str) -> str:
    """The first of these that the question has a word of; average if none."""
    asked = plain_words(question)
    meant = {"count": COUNT_WORDS, "average": AVERAGE_WORDS, "sum": SUM_WORDS, "median": {"median"}}
    return next((intent for intent, words in meant.items() if words & asked), "average")


def kpi_values(df: DataFrame, question: str, metric: str | None = None,
               dimension: str | None = None, aggregation: str | None = None) -> DataFrame:
    """The primary and secondary KPIs of a question, with their values.

    Count questions give record_count, unique_record_count (distinct rows) and
    avg_records_per_group (rows / distinct dimension values). Otherwise the
    primary KPI follows the intent (avg_/total_/median_) and the secondary
    ones are avg_, median_ and record_count of the measure.
    """
    measure = metric or primary_measure(df, question)
    intent = aggregation or _intent(question)
    if measure is None or measure == "record_count" or intent == "count":
        if measure is None and not dimension:                       # nothing to average over
            head = _long(df.agg(F.count(F.lit(1)).alias("n")), [("record_count", "primary", F.col("n"))])
            return head.unionByName(_long(df.distinct().agg(F.count(F.lit(1)).alias("u")),
                                          [("unique_record_count", "secondary", F.col("u"))]))
        groups = F.count_distinct(_c(dimension)) if dimension else F.lit(1)
        head = _long(df.agg(F.count(F.lit(1)).alias("n"), groups.alias("g")),
                     [("record_count", "primary", F.col("n")),
                      ("avg_records_per_group", "secondary", F.try_divide(F.col("n"), F.col("g")))])
        unique = _long(df.distinct().agg(F.count(F.lit(1)).alias("u")),
                       [("unique_record_count", "secondary", F.col("u"))])
        return head.unionByName(unique)
    m = _c(measure).cast("double")
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.avg(m).alias("a"), F.coalesce(F.sum(m), F.lit(0.0)).alias("s"),
                  *[e.alias(name) for name, e in quantile_figures(measure, [0.5]).items()]).collect()[0].asDict()
    median = quantiles(df, {measure: [0.5]}, {measure: base})[measure][0]
    values = {"avg": base["a"], "total": base["s"], "median": median}
    lead = {"average": "avg", "sum": "total", "median": "median"}.get(intent, "avg")
    items = [(f"{lead}_{measure}", "primary", values[lead])]
    items += [(f"{k}_{measure}", "secondary", values[k]) for k in ("avg", "median") if k != lead]
    items.append(("record_count", "secondary", float(base["rows"])))
    return df.sparkSession.createDataFrame(
        [(name, role, None if v is None else float(v)) for name, role, v in items], "kpi string, role string, value double")


def kpi_panel(df: DataFrame, limit: int = 6) -> DataFrame:
    """total_ and avg_ of every numeric column whose name carries a metric
    hint (first ``limit``), else record_count; one aggregate."""
    items = []
    for c in _numeric(df):
        if any(h in c.lower() for h in KPI_METRIC_HINTS):
            items.append((f"total_{c}", F.coalesce(F.sum(_c(c)), F.lit(0))))
            items.append((f"avg_{c}", F.avg(_c(c))))
    items = items[:limit]
    if not items:
        return _long(df.agg(F.count(F.lit(1)).alias("n")), [("record_count", "panel", F.col("n"))])
    one = df.agg(*[e.alias(f"k{i}") for i, (_, e) in enumerate(items)])
    return _long(one, [(n, "panel", F.col(f"k{i}")) for i, (n, _) in enumerate(items)])


def chart_measures(df: DataFrame, question: str | None = None) -> list[str]:
    """Numbers that tell no time; with a question, those it names come first:
    by words of the name that it has, then by where the whole name stands."""
    measures = [c for c in _numeric(df) if not tells_time(c)]
    if question is None:
        return measures
    asked = frozenset(re.findall("[0-9a-z]+", question.lower().replace("_", " ")))

    def named(column: str) -> tuple[int, bool, int]:
        phrase = column.lower().replace("_", " ")
        at = question.lower().find(phrase)
        return len(asked.intersection(phrase.split())), at >= 0, -at

    return best_first(measures, named)


def chart_feeds(df: DataFrame, question: str | None = None,
                aggregation: str = "sum") -> dict[str, DataFrame]:
    """The aggregated tables behind the three suggested charts:
    time_series (first measure by the first time column), category_comparison
    (first measure by the first text column) and dual_metric (first two
    measures by the first time or text column), all from one scan."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    times = [c for c, t in fields.items() if is_time_type(t) or tells_time(c)]
    cats = [c for c, t in fields.items() if not is_numeric_type(t) and not is_time_type(t)]
    measures = chart_measures(df, question)

    def keyed(col):
        return day_label(_c(col)) if is_time_type(fields[col]) else _c(col)

    wanted = []
    if times and measures:
        wanted.append(keyed_mart("time_series", times[0], keyed(times[0]), measures[0], aggregation, order=()))
    if cats and measures:
        wanted.append(keyed_mart("category_comparison", cats[0], _c(cats[0]), measures[0], aggregation))
    if len(measures) >= 2:
        key = times[0] if times else (cats[0] if cats else None)
        fn = {"sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "average": F.avg}[aggregation]
        prefix = "total" if aggregation == "sum" else "avg"
        wanted.append(GroupedMart("dual_metric", key, keyed(key) if key else None,
                                  {f"{prefix}_{m}": fn(_c(m)) for m in measures[:2]}))
    if not wanted:
        return {}
    grouped = GroupedMarts(df, wanted)
    return {m.name: grouped.mart(m.name) for m in wanted}


def mart_measures(mart_tables: dict[str, DataFrame]) -> DataFrame:
    """Total and average of every numeric mart column except record_count
    (one aggregate per mart, unpivoted and unioned)."""
    parts = []
    for name, mart in mart_tables.items():
        cols = [c for c in _numeric(mart) if c != "record_count"]
        if not cols:
            continue
        one = mart.agg(*[e for c in cols for e in
                         (F.sum(_c(c)).alias(f"s{cols.index(c)}"), F.avg(_c(c)).alias(f"a{cols.index(c)}"))])
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(f"{lbl} {c}").alias("measure_name"),
                     F.col(f"{k}{i}").cast("double").alias("value"))
            for i, c in enumerate(cols) for lbl, k in (("Total", "s"), ("Avg", "a"))]))))
    if not parts:
        raise ValueError("No numeric mart columns to measure.")
    return reduce(lambda a, b: a.unionByName(b), parts)
