"""Numeric anomaly detection (F7-F10) and framing.

Per numeric (non-bool) column with at least 4 values: IQR fences at 1.5 x IQR
(exact linear quantiles); when they flag nothing, |z| > 3 with the population
standard deviation. The passes over the table do not grow with the number of
columns: moments and bounds, the shared passes of ``stats.quantiles``, then one
aggregate that counts both rules' flags for every column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import is_numeric_type, quoted
from tidemark.functions.stats import quantile_figures, quantiles

ROW_ID = "_row_id"

# Detection rule parameters.
MIN_VALUES_FOR_ANALYSIS = 4
IQR_MULTIPLIER = 1.5
ZSCORE_THRESHOLD = 3.0


def _c(name: str) -> Column:
    return quoted(name)


@dataclass
class ColumnRule:
    column: str
    method: str            # iqr | zscore
    threshold: str
    flag: Column           # row-level condition
    anomaly_count: int


@dataclass
class AnomalyResult:
    report: DataFrame              # column, method, threshold, anomaly_count, example_values
    flagged_rows: DataFrame        # input rows with has_anomaly, anomaly_columns
    rules: list[ColumnRule]
    total_rows: int

    def anomaly_row_count(self) -> int:
        return self.flagged_rows.count()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != ROW_ID and is_numeric_type(f.dataType)]


def detect_anomalies(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None) -> AnomalyResult:
    """F7-F10. The examples of a column (E4) are its first flagged values in the
    order of ``order_by`` (columns of ``df``), else in row order."""
    data = df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())
    cols = columns or numeric_columns(df)
    # the statistics passes read only the numeric columns; flagged rows come from the full input
    full = data
    keys = [_c(c).alias(f"__key_{i}") for i, c in enumerate(order_by or [])]
    data = data.select(*[_c(c) for c in cols], *keys, F.col(ROW_ID))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = _c(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 *[e.alias(f"{name}{i}") for name, e in quantile_figures(c, [0.25, 0.75]).items()]]
    stats = data.agg(*aggs).collect()[0]
    eligible = [c for i, c in enumerate(cols) if stats[f"n{i}"] >= MIN_VALUES_FOR_ANALYSIS]
    bounds = {c: {k: stats[f"{k}{cols.index(c)}"] for k in ("n", "lo", "hi", "brackets")} for c in eligible}
    fences = quantiles(data, {c: [0.25, 0.75] for c in eligible}, bounds) if eligible else {}
    candidates = []
    count_aggs = [F.lit(1).alias("_one")]
    for c in eligible:
        i = cols.index(c)
        x = _c(c).cast("double")
        q1, q3 = fences[c]
        iqr_flag = z_flag = None
        if q1 is not None and not math.isclose(q3 - q1, 0.0, abs_tol=0.0):
            lo, hi = q1 - IQR_MULTIPLIER * (q3 - q1), q3 + IQR_MULTIPLIER * (q3 - q1)
            iqr_flag = ((x < F.lit(lo)) | (x > F.lit(hi)), f"{lo:.4f} to {hi:.4f}")
            count_aggs.append(F.count_if(iqr_flag[0]).alias(f"iqr{i}"))
        mean, sd = stats[f"m{i}"], stats[f"s{i}"]
        if sd is not None and not math.isclose(sd, 0.0, abs_tol=0.0):
            z_flag = (F.abs((x - F.lit(mean)) / F.lit(sd)) > F.lit(ZSCORE_THRESHOLD),
                      f"|z| > {ZSCORE_THRESHOLD:.1f}")
            count_aggs.append(F.count_if(z_flag[0]).alias(f"z{i}"))
        candidates.append((c, i, iqr_flag, z_flag))
    counts = data.agg(*count_aggs).collect()[0] if candidates else {}
    rules: list[ColumnRule] = []
    for c, i, iqr_flag, z_flag in candidates:
        if iqr_flag and counts[f"iqr{i}"] > 0:
            rules.append(ColumnRule(c, "iqr", iqr_flag[1], F.coalesce(iqr_flag[0], F.lit(False)), counts[f"iqr{i}"]))
        elif z_flag and counts[f"z{i}"] > 0:
            rules.append(ColumnRule(c, "zscore", z_flag[1], F.coalesce(z_flag[0], F.lit(False)), counts[f"z{i}"]))
    order = [f"__key_{i}" for i in range(len(keys))] + [ROW_ID]
    return AnomalyResult(_report(data, rules, order), _flagged(full, rules), rules, stats["_rows"])


def _report(data: DataFrame, rules: list[ColumnRule], order: list[str]) -> DataFrame:
    """one row per flagged column, with the first 3 flagged values."""
    spark = data.sparkSession
    schema = "column string, method string, threshold string, anomaly_count bigint"
    base = spark.createDataFrame([(r.column, r.method, r.threshold, r.anomaly_count) for r in rules], schema)
    if not rules:
        return base.withColumn("example_values", F.array().cast("array<double>"))
    long = data.select(*order, F.inline(F.array(*[
        F.struct(F.lit(r.column).alias("column"), _c(r.column).cast("double").alias("value"),
                 r.flag.alias("flagged")) for r in rules]))).where("flagged")
    w = Window.partitionBy("column").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    first3 = long.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 3)
    examples = first3.groupBy("column").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", "value"))), lambda s: s["value"]).alias("example_values"))
    # both sides hold one row per numeric column: bounded by the schema width
    return base.join(F.broadcast(examples), "column", "left")


def _flagged(data: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """rows with at least one flag, naming the flagged columns."""
    if not rules:
        return data.where(F.lit(False)).withColumns(
            {"has_anomaly": F.lit(True), "anomaly_columns": F.lit("")})
    names = F.array_compact(F.array(*[F.when(r.flag, F.lit(r.column)) for r in rules]))
    return (data.withColumn("anomaly_columns", F.concat_ws(",", names))
                .withColumn("has_anomaly", F.col("anomaly_columns") != F.lit(""))
                .where("has_anomaly"))


# Impact tiers (share of all rows).
HIGH_IMPACT = 0.10
MEDIUM_IMPACT = 0.02
ADVICE = {
    "high": "`%s`: a tenth of the rows or more lie outside the %s limits. Find out where they come from before any figure is built on the column.",
    "medium": "`%s`: a noticeable share of values lies outside the %s limits. Tell errors from real extremes, then report.",
    "low": "`%s`: few values lie outside the %s limits. They hardly move a total; look again when the table has grown.",
}


def frame_anomalies(report: DataFrame, total_rows: int) -> DataFrame:
    """frequency (4 decimals), impact tier and suggested action per column."""
    freq = F.col("anomaly_count") / F.lit(total_rows) if total_rows > 0 else F.lit(0.0)
    impact = F.when(freq >= HIGH_IMPACT, "high").when(freq >= MEDIUM_IMPACT, "medium").otherwise("low")
    action = F.coalesce(*[F.when(impact == tier, F.format_string(text, "column", "method")) for tier, text in ADVICE.items()])
    return report.withColumns({"frequency": F.round(freq, 4), "impact": impact,
                               "suggested_action": action})


def business_summary(framed: DataFrame, anomaly_row_count: int, total_rows: int) -> DataFrame:
    """one sentence for the whole table (one-row aggregate of the framing)."""
    pct = round(100.0 * anomaly_row_count / total_rows, 1) if total_rows > 0 else 0.0
    def cols_of(tier):
        listed = F.filter(F.array_sort(F.collect_list(F.when(F.col("impact") == tier,
                          F.struct(F.col("_order"), F.col("column"))))), lambda s: s.isNotNull())
        return F.array_join(F.transform(F.slice(listed, 1, 3),
                                        lambda s: F.concat(F.lit("`"), s["column"], F.lit("`"))), ", ")
    ordered = framed.withColumn("_order", F.monotonically_increasing_id())
    agg = ordered.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col("impact") == "high").alias("high"),
                      F.count_if(F.col("impact") == "medium").alias("medium"),
                      cols_of("high").alias("high_cols"), cols_of("medium").alias("medium_cols"))
    found = f"{anomaly_row_count} rows ({pct}%) hold anomalies"
    text = (F.when((F.col("n") == 0) | F.lit(anomaly_row_count == 0), F.lit("No anomalies were detected."))
             .when(F.col("high") > 0, F.concat(F.lit(f"{found}; high-impact columns: "), F.col("high_cols")))
             .when(F.col("medium") > 0, F.concat(F.lit(f"{found}; medium-impact columns: "), F.col("medium_cols")))
             .otherwise(F.format_string(found.replace("%", "%%") + "; low-frequency in %d column(s)", "n")))
    return agg.select(F.lit(anomaly_row_count).cast("bigint").alias("anomaly_row_count"),
                      F.lit(total_rows).cast("bigint").alias("total_row_count"),
                      text.alias("business_summary"))
