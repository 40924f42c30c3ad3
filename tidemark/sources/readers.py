"""Reading sources (A1-A5).

Any Hadoop-FS URI works (local paths, ``file://``, object stores); the format
comes from the extension or an override. CSV is read as text and typed in
one aggregate: a column becomes bigint / double / boolean only when every
non-null value parses. Every reader adds ``_row_id``, a long row-order key taken right after the
scan, so "first row" rules stay deterministic without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import INTEGER_TEXT, NUMERIC_TEXT, drop_nan, parse_number, quoted, strip
from tidemark.functions.names import normalize_name

ROW_ID = "_row_id"

# Text read as missing, as a pandas CSV reader does by default.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
            "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}


def detect_format(path: str, override: str | None = None) -> str:
    """A3: format from an override or the file extension."""
    if override:
        kind = override.lower().lstrip(".")
        kind = FORMATS.get("." + kind, kind)
        if kind not in ("csv", "parquet"):
            raise ValueError(f"Unsupported source format: {override}")
        return kind
    lowered = path.lower().rstrip("/")
    for ext, kind in FORMATS.items():
        if lowered.endswith(ext):
            return kind
    raise ValueError(f"Could not detect the source format of {path!r}; pass source_format.")


def source_name_of(path: str, name: str | None = None) -> str:
    """A4: explicit name, else the file stem, normalised."""
    if name:
        return normalize_name(name)
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem else stem
    return normalize_name(stem)


def path_exists(spark: SparkSession, path: str) -> bool:
    """A4: existence through the Hadoop FileSystem of the path's scheme."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def _check_location(spark: SparkSession, path: str) -> None:
    if path.startswith(("http://", "https://")):
        raise ValueError("HTTP sources are not read directly; stage the file on shared storage "
                         "and pass its path.")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Source file not found: {path}")


def _row_id() -> Column:
    """Row-order key taken directly after the scan: ``monotonically_increasing_id``
    keeps the task index in the high bits and the position in the low bits.
    File splits are assigned to tasks in file and offset order, so the key
    follows the file order; it is a long so aggregates keyed on it stay
    hash-based."""
    return F.monotonically_increasing_id()


def _na_to_null(c: Column) -> Column:
    return F.when(c.isin(*NA_WORDS), F.lit(None)).otherwise(c)


def type_text_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A1 typing: all-int -> bigint, all-number -> double, all true/false ->
    boolean (counted in one aggregate); mixed columns stay text."""
    cols = columns or [f.name for f in df.schema.fields
                       if f.dataType.simpleString() == "string" and f.name != ROW_ID]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v = quoted(c)
        t = strip(v)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(t.rlike(INTEGER_TEXT) & t.try_cast("bigint").isNotNull()).alias(f"i{i}"),
                 F.count_if(t.rlike(NUMERIC_TEXT)).alias(f"d{i}"),
                 F.count_if(F.lower(t).isin("true", "false")).alias(f"b{i}")]
    row = df.agg(*aggs).collect()[0]
    exprs = []
    for c in df.columns:
        if c not in cols:
            exprs.append(quoted(c))
            continue
        i = cols.index(c)
        n = row[f"n{i}"]
        v = quoted(c)
        if n > 0 and row[f"i{i}"] == n:
            exprs.append(strip(v).try_cast("bigint").alias(c))
        elif n > 0 and row[f"d{i}"] == n:
            exprs.append(parse_number(v).alias(c))
        elif n > 0 and row[f"b{i}"] == n:
            exprs.append((F.lower(strip(v)) == "true").alias(c))
        else:
            exprs.append(v)
    return df.select(*exprs)


def read_csv(spark: SparkSession, path: str, options: dict | None = None,
             typed: bool = True) -> DataFrame:
    """A1: header CSV read as text (options pass through), NA words -> NULL,
    then typed by content."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    raw = reader.csv(path)
    df = raw.select(*[_na_to_null(quoted(c)).alias(c) for c in raw.columns],
                    _row_id().alias(ROW_ID))
    return type_text_columns(df) if typed else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A2: Parquet (Catalyst prunes columns and pushes filters into the scan)."""
    df = drop_nan(spark.read.parquet(path))       # S15: floating NaN is missing
    return df.select("*", _row_id().alias(ROW_ID))


def read_source(spark: SparkSession, path: str, source_format: str | None = None,
                read_options: dict | None = None) -> DataFrame:
    """A1-A4: read a CSV or Parquet source from any Hadoop-FS path."""
    _check_location(spark, path)
    kind = detect_format(path, source_format)
    if kind == "csv":
        return read_csv(spark, path, read_options)
    return read_parquet(spark, path)
