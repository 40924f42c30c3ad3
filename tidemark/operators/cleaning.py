"""Cleaning to a staging table.

Passes over the source:

0. for date-named text columns only, their first non-blank value (row order)
   picks the date format (S11); where no format reads it, a histogram of value
   shapes leaves only the formats that some value can have;
1. one global aggregate over the raw columns counts, per text column, blanks,
   values a numeric parser accepts, integer-looking values, and parse
   failures of the chosen date format. The decisions are exact (no sample).
2. a lazy projection applies the decisions (blank -> NULL, casts, row flags),
   then duplicates are removed with a ``groupBy`` over all data columns that
   keeps the flags of the first row (``min_by`` on the row id, S13). The
   ``groupBy`` aggregates map-side first, so a duplicated row held by a third
   of the input collapses before the shuffle.

Each pass reads the source with column pruning and strips a text cell once;
nothing is cached.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import (
    INTEGER_TEXT, NUMERIC_CONVERSION_THRESHOLD, NUMERIC_TEXT, nan_to_null, number_of, quoted, strip)
from tidemark.functions.names import QUALITY_FLAG_COLUMNS, normalized_names

ROW_ID = "_row_id"

# Name fragments that mark a date column.
DATE_COLUMN_HINTS = ("date", "datetime", "timestamp", "created_at", "updated_at", "release_date")

# Candidate formats, tried against the first non-null value of a column.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy/M/d",
    "yyyy/M/d H:mm:ss",
    "M/d/yyyy",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm a",
    "M/d/yyyy h:mm:ss a",
    "d/M/yyyy",                # read when the first value's first number is no month
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d.M.yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "yyyy-MM",
)


def format_shape(fmt: str, folded: bool = False) -> str:
    """A regex that every string the strict parser accepts for ``fmt`` matches
    (a superset: a field of one letter is any digit run, others have their width). Strings outside it cannot
    parse, so they are counted as failures without running the parser. With
    ``folded`` it matches the shapes of such strings, where letters are ``a``."""
    out, i = ["^"], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(re.sub("[A-Za-z]", "a", fmt[i + 1:j]) if folded else fmt[i + 1:j]))
            i = j + 1
            continue
        j = i
        while j < len(fmt) and fmt[j] == ch:
            j += 1
        if ch in "yMdHhmsS" and not (ch == "M" and j - i > 2):
            out.append("\\d+" if j - i == 1 else "\\d{4,}" if ch == "y" else f"\\d{{{j - i}}}")
        elif ch == "X":
            out.append(f"({'a' if folded else 'Z'}|[+-]\\d{{1,2}}(:?\\d{{2}})?)")
        elif ch.isalpha():
            out.append("\\S+")
        else:
            out.append(re.escape(fmt[i:j]))
        i = j
    out.append("$")
    return "".join(out)


def parsed_as(stripped: Column, fmt: str) -> Column:
    """``stripped`` as a timestamp of ``fmt``, else NULL (shape-guarded, so text of
    another shape never reaches the parser)."""
    return F.when(stripped.rlike(format_shape(fmt)), F.try_to_timestamp(stripped, F.lit(fmt)))


def looks_like_date_column(name: str) -> bool:
    lowered = name.lower()
    return any(h in lowered for h in DATE_COLUMN_HINTS)


def with_row_id(df: DataFrame) -> DataFrame:
    """A row-order key (a long). The readers add it right after the file
    scan, where it follows file and offset order; otherwise it follows the
    partition order of the input. It is deterministic on recomputation."""
    if ROW_ID in df.columns:
        return df
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def _c(name: str) -> Column:
    return quoted(name)


@dataclass
class ColumnDecision:
    column: str
    raw_name: str
    kind: str                      # keep | numeric | datetime | date_skipped
    target_type: str | None = None
    blanks: int = 0
    non_null: int = 0
    numeric_ok: int = 0
    failed: int = 0
    date_format: str | None = None


@dataclass
class CleanResult:
    df: DataFrame                  # data columns + 3 flag columns
    df_with_row_id: DataFrame
    decisions: list[ColumnDecision]
    renamed: dict[str, str]
    input_rows: int
    original_columns: list[str]
    log: DataFrame = field(repr=False, default=None)

    def summary(self, staged: DataFrame | None = None) -> DataFrame:
        """One-row summary of the staging table (``staged``: as written and
        read again, so that cleaning does not run anew)."""
        data_cols = [c for c in self.df.columns if c not in QUALITY_FLAG_COLUMNS]
        return (staged or self.df).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.lit(len(data_cols)).cast("bigint").alias("column_count"),
            F.lit(len(self.original_columns)).cast("bigint").alias("input_column_count"),
            (F.lit(self.input_rows) - F.count(F.lit(1))).alias("duplicate_row_count"),
            F.count_if("has_nulls").alias("rows_with_nulls"),
            F.count_if("invalid_date_parse").alias("rows_with_invalid_date_parse"),
            F.count_if("type_conversion_issue").alias("rows_with_type_conversion_issue"),
        )

    def log_of(self, staged: DataFrame) -> DataFrame:
        """B7 with the removed duplicates counted on the written staging table."""
        return _decision_log(self, staged)

    def null_counts(self, staged: DataFrame | None = None) -> DataFrame:
        """NULL count per data column, long form (one aggregate, unpivoted)."""
        data_cols = [c for c in self.df.columns if c not in QUALITY_FLAG_COLUMNS]
        one = (staged or self.df).agg(*[F.count_if(_c(c).isNull()).alias(f"n{i}")
                            for i, c in enumerate(data_cols)])
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
            for i, c in enumerate(data_cols)])))


def _stripped(i: int) -> Column:
    """The stripped text of the i-th text column, NULL where it is blank."""
    return F.col(f"__text_{i}")


def _with_stripped(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Strip each text cell once, for every expression above; blank text is NULL
    there (and stays as it is in its own column)."""
    return df.select("*", *[F.nullif(strip(_c(c)), F.lit("")).alias(f"__text_{i}") for i, c in enumerate(text_cols)])


def _first_value_formats(df: DataFrame, text_cols: list[str], date_cols: list[str]) -> dict[str, int | None]:
    """Index of the first format that reads each date-named column's
    first non-blank value (row order); one job reading only those columns."""
    if not date_cols:
        return {}
    at = {c: _stripped(text_cols.index(c)) for c in date_cols}
    firsts = df.agg(*[F.min_by(at[c], F.when(at[c].isNotNull(), F.col(ROW_ID))).alias(f"f{i}")
                      for i, c in enumerate(date_cols)])
    row = firsts.select(*[F.try_to_timestamp(F.col(f"f{i}"), F.lit(fmt)).isNotNull().alias(f"ok_{i}_{k}")
                          for i in range(len(date_cols)) for k, fmt in enumerate(DATE_FORMATS)]).collect()[0]
    out = {}
    for i, c in enumerate(date_cols):
        out[c] = next((k for k in range(len(DATE_FORMATS)) if row[f"ok_{i}_{k}"]), None)
    return out


def value_shapes(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """(column_name, shape, n): how often each shape occurs among the non-null
    texts of ``cells``. In a shape every digit is 9 and every letter a; a column
    of dates or numbers has few, and any number of them is counted distributed."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), e.alias("text")) for c, e in cells.items()])))
    folded = F.regexp_replace(F.translate("text", "012345678", "999999999"), r"\p{L}", "a")
    return long.where(F.col("text").isNotNull()).groupBy("column_name", folded.alias("shape")).agg(F.count("*").alias("n"))


def candidate_formats(shapes: DataFrame) -> dict[str, dict[int, int]]:
    """Per column, the formats that any of its shapes allows, with the number of
    values of those shapes: no format can read more. The driver gets one row per column."""
    fits = [F.sum(F.when(F.col("shape").rlike(format_shape(fmt, folded=True)), F.col("n")).otherwise(0)).alias(f"fit_{k}")
            for k, fmt in enumerate(DATE_FORMATS)]
    rows = shapes.groupBy("column_name").agg(*fits).collect()
    return {r["column_name"]: {k: r[f"fit_{k}"] for k in range(len(DATE_FORMATS)) if r[f"fit_{k}"]} for r in rows}


def _stats_pass(df: DataFrame, text_cols: list[str], date_formats: dict[str, list[int]]) -> dict:
    """One aggregate: per text column blanks, values, numeric and integer
    counts, and parse failures for the candidate date formats."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(text_cols):
        value = _stripped(i)
        number = value.rlike(NUMERIC_TEXT)
        aggs += [
            F.count(_c(c)).alias(f"text_{i}"),
            F.count(value).alias(f"nn_{i}"),
            F.count_if(number).alias(f"num_{i}"),
            F.count_if(F.when(number, value.rlike(INTEGER_TEXT) & value.try_cast("bigint").isNotNull())).alias(f"int_{i}"),
        ]
        for k in date_formats.get(c, []):
            aggs.append(F.count_if(value.isNotNull() & parsed_as(value, DATE_FORMATS[k]).isNull()).alias(f"dfail_{i}_{k}"))
    stats = df.agg(*aggs).collect()[0].asDict()
    for i in range(len(text_cols)):
        stats[f"blank_{i}"] = stats[f"text_{i}"] - stats[f"nn_{i}"]
    return stats


def clean(df: DataFrame) -> CleanResult:
    """Clean a table; returns the lazy staging DataFrame and the decision log."""
    spark = df.sparkSession
    original = [c for c in df.columns if c != ROW_ID]
    mapping = normalized_names(original)
    renamed = {raw: new for raw, new in mapping.items() if raw != new}
    base = with_row_id(df).select(*[_c(raw).alias(mapping[raw]) for raw in original], F.col(ROW_ID))
    types = {f.name: f.dataType for f in base.schema.fields}
    columns = [mapping[raw] for raw in original]
    text_cols = [c for c in columns if isinstance(types[c], T.StringType)]
    date_cols = [c for c in text_cols if looks_like_date_column(c)]
    base = _with_stripped(base, text_cols)
    # The format is the first one that reads the column's first value; only
    # when none does, the formats that the shapes of its values allow are counted
    # and the best one taken.
    chosen = _first_value_formats(base, text_cols, date_cols)
    unread = [c for c in date_cols if chosen[c] is None]
    allowed = candidate_formats(value_shapes(base, {c: _stripped(text_cols.index(c)) for c in unread})) if unread else {}
    candidates = {c: ([k] if k is not None else sorted(allowed.get(c, ())) or [0]) for c, k in chosen.items()}
    stats = _stats_pass(base, text_cols, candidates)

    decisions: list[ColumnDecision] = []
    projected: list[Column] = []
    type_issues: list[Column] = []
    date_issues: list[Column] = []
    inverse = {v: k for k, v in mapping.items()}
    for c in columns:
        dtype = types[c]
        d = ColumnDecision(c, inverse[c], "keep")
        if not isinstance(dtype, T.StringType):
            col = nan_to_null(_c(c)).cast(dtype) if isinstance(dtype, (T.DoubleType, T.FloatType)) else _c(c)
            projected.append(col.alias(c))
            decisions.append(d)
            continue
        i = text_cols.index(c)
        text = _stripped(i)
        value = F.when(text.isNotNull(), _c(c))
        d.blanks, d.non_null, d.numeric_ok = stats[f"blank_{i}"], stats[f"nn_{i}"], stats[f"num_{i}"]
        if d.non_null > 0 and d.numeric_ok / d.non_null >= NUMERIC_CONVERSION_THRESHOLD:
            number = number_of(text)
            if stats[f"int_{i}"] == d.numeric_ok:
                d.target_type = "bigint"
                out = text.try_cast("bigint")        # every number of the column is a whole one
            else:
                d.target_type = "double"
                out = number
            d.kind = "numeric"
            d.failed = d.non_null - d.numeric_ok
            projected.append(out.alias(c))
            type_issues.append(text.isNotNull() & ~text.rlike(NUMERIC_TEXT) if d.failed else F.lit(False))
        elif c in date_cols and d.non_null > 0:
            k = chosen[c]
            if k is None:   # first value matches no format: the format failing least
                k = min(candidates[c], key=lambda j: stats[f"dfail_{i}_{j}"])
            d.date_format = DATE_FORMATS[k]
            d.failed = stats[f"dfail_{i}_{k}"]
            parsed = parsed_as(text, d.date_format)
            if d.failed == 0:
                d.kind, d.target_type = "datetime", "timestamp"
                projected.append(parsed.alias(c))
            else:
                d.kind = "date_skipped"
                projected.append(value.alias(c))
                date_issues.append(text.isNotNull() & parsed.isNull())
        elif c in date_cols:                       # a date column without a value
            d.kind, d.target_type = "datetime", "timestamp"
            projected.append(F.lit(None).cast("timestamp").alias(c))
        else:
            projected.append(value.alias(c))
        decisions.append(d)

    any_of = lambda conds: F.greatest(*[F.coalesce(x, F.lit(False)) for x in conds]) \
        if len(conds) > 1 else (F.coalesce(conds[0], F.lit(False)) if conds else F.lit(False))
    typed = base.select(*projected,
                        any_of(type_issues).alias("type_conversion_issue"),
                        any_of(date_issues).alias("invalid_date_parse"),
                        F.col(ROW_ID))
    # The first row's flags, packed in an int so the aggregation buffer is
    # fixed-width and the dedup plans as a HashAggregate (a struct value
    # would force a sort-based aggregate over all the key columns).
    packed = F.col("type_conversion_issue").cast("int") + F.col("invalid_date_parse").cast("int") * 2
    deduped = typed.groupBy(*[_c(c) for c in columns]).agg(
        F.min_by(packed, F.col(ROW_ID)).alias("_flags"), F.min(ROW_ID).alias(ROW_ID))
    has_nulls = F.greatest(*[_c(c).isNull() for c in columns]) if len(columns) > 1 \
        else _c(columns[0]).isNull()
    staged = deduped.select(
        *[_c(c) for c in columns],
        has_nulls.alias("has_nulls"),
        (F.col("_flags").bitwiseAND(2) > 0).alias("invalid_date_parse"),
        (F.col("_flags").bitwiseAND(1) > 0).alias("type_conversion_issue"),
        F.col(ROW_ID))
    result = CleanResult(df=staged.drop(ROW_ID), df_with_row_id=staged, decisions=decisions,
                         renamed=renamed, input_rows=stats["__rows"], original_columns=original)
    result.log = _decision_log(result)
    return result


LOG_SCHEMA = "step string, action string, column_name string, rows_affected bigint, details string"


def _decision_log(result: CleanResult, staged: DataFrame | None = None) -> DataFrame:
    """One row per decision; the dedup row is computed from the staged table."""
    spark = result.df.sparkSession
    rows = []
    if result.renamed:
        rows.append(("column_normalization", "normalize_column_names",
                     ",".join(result.renamed), None,
                     f"Renamed {len(result.renamed)} column(s)"))
    for d in result.decisions:
        if d.blanks > 0:
            rows.append(("missing_value_standardization", "replace_blank_with_null", d.column,
                         d.blanks, f"{d.blanks} blank value(s) replaced with NULL"))
    for d in result.decisions:
        if d.kind == "numeric":
            ratio = d.numeric_ok / d.non_null
            rows.append(("type_enforcement", "cast_to_numeric", d.column,
                         d.failed if d.failed > 0 else None,
                         f"cast to {d.target_type} (ratio: {ratio:.0%})"))
    for d in result.decisions:
        if d.kind == "date_skipped":
            rows.append(("date_parsing", "skip_date_parse", d.column, d.failed,
                         f"{d.failed} value(s) do not parse as {d.date_format}"))
        elif d.kind == "datetime":
            rows.append(("date_parsing", "cast_to_datetime", d.column, None,
                         f"cast to timestamp (UTC) with {d.date_format}" if d.date_format
                         else "cast to timestamp (UTC): no value"))
    decided = spark.createDataFrame(rows, LOG_SCHEMA)
    dedup = (staged or result.df).agg((F.lit(result.input_rows) - F.count(F.lit(1))).alias("rows_affected")) \
        .where(F.col("rows_affected") > 0).select(
            F.lit("deduplication").alias("step"), F.lit("remove_duplicate_rows").alias("action"),
            F.lit(None).cast("string").alias("column_name"), "rows_affected",
            F.format_string("%d duplicate row(s) removed (first kept)", "rows_affected").alias("details"))
    return decided.unionByName(dedup)
