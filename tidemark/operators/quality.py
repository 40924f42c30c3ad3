"""Schema summary (A7), column profile (F1) and data-quality scores.

All per-column numbers come from a fixed number of table passes regardless of
the column count: one aggregate for null counts / min / max / moments, one
unpivot + two-level ``groupBy`` for exact distinct counts, and (scores only)
one aggregate for the 3-sigma outlier counts. Per-column results are unpivoted
one-row aggregates, so every output here is a Spark-derived DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import INTEGER_TEXT, NUMERIC_TEXT, is_numeric_type, quoted, strip
from tidemark.functions.names import QUALITY_FLAG_COLUMNS
from tidemark.functions.stats import distinct_counts_df, unpivot_values

ROW_ID = "_row_id"


def _c(name: str) -> Column:
    return quoted(name)


def _unpivot_row(one_row: DataFrame, fields: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame:
    """Turn a one-row aggregate into one row per column."""
    structs = [F.struct(F.lit(name).alias("column_name"), *[e.alias(k) for k, e in parts])
               for name, parts in fields]
    return one_row.select(F.inline(F.array(*structs)))


def schema_summary(df: DataFrame) -> DataFrame:
    """Name, type and nullability as observed, with row and column counts."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(_c(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    return _unpivot_row(one, [(c, [("dtype", F.lit(types[c])),
                                   ("nullable", F.col(f"n{i}") > 0),
                                   ("row_count", F.col("_rows")),
                                   ("column_count", F.lit(len(cols)).cast("bigint"))])
                              for i, c in enumerate(cols)])


def _numeric_like(dtype: T.DataType) -> bool:
    return is_numeric_type(dtype) or isinstance(dtype, T.BooleanType)


def profile(df: DataFrame, sample_size: int = 5, seed: int = 0,
            approx_distinct: bool = False, key_columns: list[str] | None = None) -> DataFrame:
    """per column dtype, null % (2 decimals), distinct count, samples, and
    min/max for numeric (and boolean) columns.

    Samples (E5) are the ``sample_size`` non-null values with the smallest md5 of
    value, key and seed; see ``sample_values``.
    ``approx_distinct`` swaps the exact distinct counts (a shuffle of every
    distinct value) for HyperLogLog sketches on very large tables.
    """
    data = df.withColumn(ROW_ID, F.monotonically_increasing_id()) if ROW_ID not in df.columns else df
    cols = [c for c in df.columns if c != ROW_ID]
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(_c(c)).alias(f"nn{i}"))
        if _numeric_like(types[c]):
            x = _c(c).cast("double")
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    row = data.agg(*aggs).collect()[0]
    rows = row["_rows"]
    per_col = df.sparkSession.createDataFrame(
        [(c, types[c].simpleString(), rows - row[f"nn{i}"], rows,
          *((row[f"mn{i}"], row[f"mx{i}"]) if _numeric_like(types[c]) else (None, None))) for i, c in enumerate(cols)],
        "column_name string, dtype string, nulls bigint, n bigint, min double, max double")
    per_col = per_col.withColumn("null_percentage", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(
        F.round(F.col("nulls") / F.col("n") * 100.0, 2)))
    distinct = distinct_counts_df(data, cols, approx_distinct).withColumnRenamed(
        "distinct_count", "unique_count")
    samples = sample_values(data, {c: row[f"nn{i}"] for i, c in enumerate(cols)}, sample_size, seed,
                            key_columns)
    out = (per_col.join(distinct, "column_name", "left").join(samples, "column_name", "left")
                  .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
                  .withColumn("sample_values", F.coalesce(
                      "sample_values", F.array().cast("array<string>"))))
    return out.select("column_name", "dtype", "null_percentage", "unique_count",
                      "sample_values", "min", "max")


SAMPLE_ROOM = 16            # times as many candidates as samples are expected below the hash bound


def sample_values(df: DataFrame, counts: dict[str, int], k: int = 5, seed: int = 0,
                  key_columns: list[str] | None = None) -> DataFrame:
    """E5: ``(column_name, sample_values)`` - the k non-null values of each
    column with the smallest md5 of the text ``value|key|...|seed``, smallest first.

    The key is the text of ``key_columns``, so that the choice depends on the rows
    alone and any engine can repeat it, or else the row id. ``counts`` has the
    columns and their non-null counts: only cells whose hash lies below a bound that
    about ``SAMPLE_ROOM * k`` of them pass are compared, so no task sorts its
    cells. A column with too few below it is read again without a bound. The driver
    gets at most k values a column."""
    spark = df.sparkSession
    key = F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in key_columns or [ROW_ID]])
    keyed = df.withColumn("__key", key)
    h = F.md5(F.concat_ws("|", "value", "__key", F.lit(str(seed))).cast("binary"))
    w = Window.partitionBy("column_name").orderBy("_h", "value")

    def picked(cols: list[str], bounds: dict[str, str]) -> dict[str, list[str]]:
        low = F.create_map(*[F.lit(x) for c in cols for x in (c, bounds[c])]) if bounds else None
        long = unpivot_values(keyed, cols, keep=["__key"]).withColumn("_h", h)
        if bounds:
            long = long.where(F.col("_h") <= low[F.col("column_name")])
        top = long.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
        out: dict[str, list[str]] = {c: [] for c in cols}
        for r in sorted(top.select("column_name", "_rn", "value").collect(), key=lambda r: r["_rn"]):
            out[r["column_name"]].append(r["value"])
        return out

    cols = [c for c, n in counts.items() if n]
    span = 1 << 128
    bounds = {c: f"{min(span - 1, span // counts[c] * SAMPLE_ROOM * k):032x}" for c in cols}
    got = picked(cols, bounds) if cols else {}
    short = [c for c in cols if len(got[c]) < min(k, counts[c])]
    if short:
        got.update(picked(short, {}))
    return spark.createDataFrame(list(got.items()), "column_name string, sample_values array<string>")


# Score weights and outlier rule.
COMPLETENESS_WEIGHT = 0.40
UNIQUENESS_WEIGHT = 0.20
FORMAT_WEIGHT = 0.40
OUTLIER_SIGMA = 3.0
OUTLIER_SHARE = 0.05
MIN_VALUES_FOR_OUTLIERS = 4

# what a text can be read as; the last one is the rest
VALUE_CLASSES = ("int", "float", "bool", "date", "other")


def value_class(stripped: Column) -> Column:
    """The class of a text without white space at its ends; NULL for NULL."""
    number = F.when(stripped.rlike(INTEGER_TEXT), "int").otherwise("float")
    rest = F.when(F.lower(stripped).isin("true", "false"), "bool").when(
        F.try_to_timestamp(stripped).isNotNull(), "date").otherwise("other")
    return F.when(stripped.rlike(NUMERIC_TEXT), number).when(stripped.isNotNull(), rest)


def dq_scores(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Completeness, uniqueness, outlier flag, format score, weighted score.

    A Spark text column holds only text, so its format score is 100; the extra
    ``dominant_class_share`` reports how uniform the raw text is (share of the
    most common of int/float/bool/date/other).
    """
    cols = [c for c in df.columns if c not in QUALITY_FLAG_COLUMNS and c != ROW_ID]
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if is_numeric_type(types[c])]
    text = [c for c in cols if isinstance(types[c], T.StringType)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(_c(c)).alias(f"nn{i}"))
    for c in numeric:
        x = _c(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{cols.index(c)}"), F.stddev_samp(x).alias(f"sd_{cols.index(c)}")]
    moments = df.agg(*aggs).collect()[0]
    # pass 2: outlier counts with the moments as literals, and text value classes
    aggs2 = [F.lit(1).alias("_one")]
    for c in numeric:
        i = cols.index(c)
        mean, sd = moments[f"mean_{i}"], moments[f"sd_{i}"]
        if moments[f"nn{i}"] >= MIN_VALUES_FOR_OUTLIERS and sd not in (None, 0.0):
            dev = F.abs(_c(c).cast("double") - F.lit(mean))
            aggs2.append(F.count_if(dev > F.lit(OUTLIER_SIGMA * sd)).alias(f"out_{i}"))
    for c in text:
        i = cols.index(c)
        aggs2 += [F.count_if(F.col(f"__class_{i}") == name).alias(f"cls_{name}_{i}") for name in VALUE_CLASSES]
    # each text cell is stripped once and then classed once, below the aggregate
    stripped = df.select("*", *[strip(_c(c)).alias(f"__text_{cols.index(c)}") for c in text])
    classed = stripped.select("*", *[value_class(F.col(f"__text_{cols.index(c)}")).alias(f"__class_{cols.index(c)}") for c in text])
    counts = classed.agg(*aggs2)
    distinct = distinct_counts_df(df, cols, approx_distinct)
    rows, fields = moments["_rows"], []
    for i, c in enumerate(cols):
        nn = moments[f"nn{i}"]
        if f"out_{i}" in counts.columns:
            outlier = (F.col(f"out_{i}") / F.lit(nn)) > F.lit(OUTLIER_SHARE)
        else:
            outlier = F.lit(False)
        if c in text and nn > 0:
            share = F.round(F.greatest(*[F.col(f"cls_{n}_{i}") for n in VALUE_CLASSES]) * 100.0 / F.lit(nn), 1)
        else:
            share = F.lit(100.0)
        fields.append((c, [("dtype", F.lit(types[c].simpleString())),
                           ("non_null", F.lit(nn).cast("bigint")),
                           ("outlier_flag", outlier),
                           ("dominant_class_share", share.cast("double"))]))
    per_col = _unpivot_row(counts, fields)
    out = per_col.join(distinct, "column_name", "left")
    completeness = (F.lit(100.0) if rows == 0 else
                    F.round(F.col("non_null") / F.lit(rows) * 100.0, 1))
    uniqueness = F.when(F.col("non_null") == 0, F.lit(100.0)).otherwise(
        F.round(F.coalesce("distinct_count", F.lit(0)) / F.col("non_null") * 100.0, 1))
    scored = out.select("column_name", "dtype", completeness.alias("completeness"),
                        uniqueness.alias("uniqueness"), "outlier_flag",
                        F.lit(100.0).alias("format_score"), "dominant_class_share")
    return scored.withColumn("dq_score", F.round(
        F.col("completeness") * COMPLETENESS_WEIGHT + F.col("uniqueness") * UNIQUENESS_WEIGHT
        + F.col("format_score") * FORMAT_WEIGHT, 1))


def dq_overall(scores: DataFrame) -> DataFrame:
    """plain mean of the column scores (one row)."""
    return scores.agg(F.coalesce(F.round(F.avg("dq_score"), 1), F.lit(0.0)).alias("overall_score"),
                      F.count(F.lit(1)).alias("column_count"))
