"""Time-series shaping used by the dataset loaders.

Each function takes a DataFrame (already read by ``tidemark.sources``) and
returns a lazy DataFrame; file handling stays in the sources package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import (
    decimal_year_to_date, is_numeric_type, is_time_type, list_cell_items, month_label,
    number_of, parse_number, quoted, sentinel_to_null, strip)

YEAR_NUMERIC_THRESHOLD = 0.8


def _c(name: str) -> Column:
    return quoted(name)


def _as_number(c: Column, dtype: T.DataType) -> Column:
    return c.cast("double") if is_numeric_type(dtype) else parse_number(c.cast("string"))


def year_label(year: Column) -> Column:
    """``yyyy-01`` for a yearly value."""
    return F.when(year.isNotNull(), F.format_string("%04d-01", year.cast("bigint")))


# ----------------------------------------------------------------------- B9
def coerce_year(df: DataFrame, column: str) -> Column:
    """Integer year from numbers, dates or text.

    One aggregate decides the rule: >= 80% numeric (over all rows) -> rounded
    number (half to even); else when some values parse as dates -> their year,
    with a 4-digit run from the text for the others; else the 4-digit run."""
    dtype = df.schema[column].dataType
    c = _c(column)
    if is_time_type(dtype):
        return F.year(c).cast("bigint")
    number = _as_number(c, dtype)
    parsed = F.try_to_timestamp(c.cast("string"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count(number).alias("num"),
                 F.count(parsed).alias("dates")).collect()[0]
    digits = F.regexp_extract(c.cast("string"), r"(\d{4})", 1)
    from_text = F.when(digits != "", digits.cast("bigint"))
    if row["rows"] > 0 and row["num"] / row["rows"] >= YEAR_NUMERIC_THRESHOLD:
        return F.bround(number).cast("bigint")
    if row["dates"] > 0:
        return F.coalesce(F.year(parsed).cast("bigint"), from_text)
    return from_text


# ---------------------------------------------------------------------- A18
def yearly_series(df: DataFrame, metric_column: str, time_column: str = "year",
                  aggregation: str = "sum", value_column: str | None = None,
                  entity_column: str | None = None, list_cells: bool = False,
                  min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """One value per year: average / sum / count of a numeric column, or
    the number of distinct entities (B13 list cells exploded first, C19).

    ``sum`` keeps NULL for a year with no values; numeric paths drop rows
    without a value first. Output: year, <metric_column>, date (``yyyy-01``).
    """
    if time_column not in df.columns:
        raise ValueError(f"a yearly series needs its time column {time_column}")
    year = coerce_year(df, time_column)
    working = df.withColumn("__year", year).where(F.col("__year").isNotNull())
    if min_year is not None:
        working = working.where(F.col("__year") >= int(min_year))
    if max_year is not None:
        working = working.where(F.col("__year") <= int(max_year))
    if aggregation == "count_distinct":
        if not entity_column:
            raise ValueError("a distinct count needs an entity column")
        if entity_column not in df.columns:
            raise ValueError(f"a yearly series needs its entity column {entity_column}")
        raw = _c(entity_column).cast("string")
        items = list_cell_items(raw) if list_cells else F.filter(
            F.array(strip(raw)), lambda x: x.isNotNull() & (x != F.lit("")))
        exploded = working.select("__year", F.explode(items).alias("__item"))
        out = exploded.groupBy("__year").agg(F.count_distinct("__item").alias(metric_column))
    else:
        if not value_column:
            raise ValueError("a numeric yearly series needs a value column")
        if value_column not in df.columns:
            raise ValueError(f"a yearly series needs its value column {value_column}")
        value = _as_number(_c(value_column), df.schema[value_column].dataType)
        vals = working.select("__year", value.alias("__v")).where(F.col("__v").isNotNull())
        fn = {"average": F.avg, "sum": F.sum, "count": F.count}.get(aggregation)
        if fn is None:
            raise ValueError(f"a yearly series cannot be aggregated by {aggregation}")
        out = vals.groupBy("__year").agg(fn("__v").alias(metric_column))
    return (out.select(F.col("__year").alias("year"), _c(metric_column),
                       year_label(F.col("__year")).alias("date"))
               .orderBy("year"))


# ---------------------------------------------------------------------- A13
def entity_series(df: DataFrame, entity_column: str, entity_value: str,
                  year_column: str = "year", columns: list[str] | None = None) -> DataFrame:
    """One entity's yearly rows (column subset), ``month`` = 1 and a
    ``yyyy-01`` label; rows without a numeric year are dropped."""
    keep = columns or df.columns
    missing = [c for c in set(keep) | {entity_column, year_column} if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {sorted(missing)}")
    year = _as_number(_c(year_column), df.schema[year_column].dataType)
    out = (df.where((_c(entity_column) == F.lit(entity_value)) & year.isNotNull())
             .select(*[(year.cast("bigint") if c == year_column else _c(c)).alias(c) for c in keep]))
    return out.withColumns({"month": F.lit(1).cast("bigint"),
                            "date": year_label(_c(year_column))})


# ---------------------------------------------------------------------- A16
def indicator_series(df: DataFrame, metric_column: str, country_column: str = "Country Name",
                     year_column: str = "Year", value_column: str = "Value",
                     country_value: str = "World") -> DataFrame:
    """One country's indicator values renamed to ``year`` / the metric."""
    missing = {country_column, year_column, value_column} - set(df.columns)
    if missing:
        raise ValueError(f"an indicator series lacks these columns: {', '.join(sorted(missing))}")
    year = _as_number(_c(year_column), df.schema[year_column].dataType)
    value = _as_number(_c(value_column), df.schema[value_column].dataType)
    rest = [c for c in df.columns if c not in (country_column, year_column, value_column)]
    out = df.where(_c(country_column) == F.lit(country_value)).select(
        _c(country_column).alias("country_name"), *[_c(c) for c in rest],
        year.cast("bigint").alias("year"), value.alias(metric_column))
    out = out.where(F.col("year").isNotNull() & _c(metric_column).isNotNull())
    return out.withColumn("date", year_label(F.col("year")))


# ---------------------------------------------------------------------- A12
# The twelve columns of the whitespace temperature feed.
TEMPERATURE_COLUMNS = (
    "year", "month", "temperature_anomaly", "monthly_uncertainty",
    "annual_temperature_anomaly", "annual_uncertainty", "five_year_temperature_anomaly",
    "five_year_uncertainty", "ten_year_temperature_anomaly", "ten_year_uncertainty",
    "twenty_year_temperature_anomaly", "twenty_year_uncertainty",
)


def whitespace_series(lines: DataFrame, names=TEMPERATURE_COLUMNS, comment: str = "%",
                      source: str = "berkeley_earth") -> DataFrame:
    """Whitespace-separated text (``value`` column, as ``spark.read.text``
    gives it) with ``%`` comments -> typed columns, all-empty rows dropped,
    ``yyyy-MM`` label and a source tag."""
    text = strip(F.regexp_replace("value", F.lit(f"{comment}.*$"), F.lit("")))
    parts = lines.select(F.split(text, r"\s+").alias("_p"), text.alias("_t")).where(F.col("_t") != "")
    typed = parts.select(*[parse_number(F.get(F.col("_p"), i)).alias(n) for i, n in enumerate(names)])
    typed = typed.na.drop(how="all")
    typed = typed.withColumns({"year": F.col("year").cast("bigint"),
                               "month": F.col("month").cast("bigint")})
    return typed.withColumns({"date": month_label(F.col("year"), F.col("month")),
                              "source": F.lit(source)})


# ---------------------------------------------------------------------- A14
def page_arrays(pages: DataFrame, html_column: str = "html", x_name: str = "chart_x",
                y_name: str = "chart_y", key_columns: list[str] | None = None,
                source: str = "nasa_satellite_altimetry") -> DataFrame:
    """Numeric JS arrays ``var <x> = [...]`` / ``var <y> = [...]`` of each
    page zipped into rows; decimal years become dates (B11).

    A page whose arrays are missing, of different lengths or not all numbers
    yields one row with ``error`` set instead of values.
    """
    keys = key_columns or [c for c in pages.columns if c != html_column]
    def arr(name):
        body = F.regexp_extract(_c(html_column), rf"(?s)var {name} = \[(.*?)\]\s*;?\s*var ", 1)
        items = F.filter(F.transform(F.split(body, ","), lambda s: strip(s)), lambda s: s != "")
        # parsed once: an item that is no number is NULL, which no number is
        return F.when(body != "", F.transform(items, number_of))
    def unread(name):
        return F.exists(name, lambda x: x.isNull())
    staged = pages.select(*[_c(k) for k in keys], arr(x_name).alias("_x"), arr(y_name).alias("_y"))
    error = (F.when(F.col("_x").isNull(), F.lit(f"page has no array {x_name}"))
              .when(F.col("_y").isNull(), F.lit(f"page has no array {y_name}"))
              .when(F.size("_x") != F.size("_y"), F.lit("arrays differ in length"))
              .when(unread("_x") | unread("_y"), F.lit("an array item is not a number")))
    staged = staged.withColumn("error", error)
    pairs = F.when(F.col("error").isNull(), F.arrays_zip(F.col("_x").alias("x"), F.col("_y").alias("y"))) \
             .otherwise(F.array(F.struct(F.lit(None).cast("double").alias("x"),
                                         F.lit(None).cast("double").alias("y"))))
    rows = staged.select(*[_c(k) for k in keys], "error", F.inline(pairs))
    observed = decimal_year_to_date(F.col("x"))
    return rows.select(*[_c(k) for k in keys],
                       F.col("x").alias("year_decimal"),
                       F.year(observed).cast("bigint").alias("year"),
                       F.month(observed).cast("bigint").alias("month"),
                       F.date_format(observed, "yyyy-MM").alias("date"),
                       F.col("y").alias("sea_level"),
                       F.when(F.col("error").isNull(), F.lit(source)).alias("source"),
                       "error")


# ---------------------------------------------------------------------- A15
def tidy_names(df: DataFrame) -> DataFrame:
    """Messy headers as trimmed, lower snake names; ``mo`` is ``month``, ``extent`` is
    ``ice_extent``. Columns that come to one name are one column: the first value of a row."""
    short = {"mo": "month", "extent": "ice_extent"}
    same: dict[str, list[str]] = {}
    for c in df.columns:
        name = c.strip().lower().replace(" ", "_")
        same.setdefault(short.get(name, name), []).append(c)
    return df.select(*[F.coalesce(*map(_c, own)).alias(name) for name, own in same.items()])


def monthly_extent(frames: list[DataFrame], sentinel: float = -9999) -> DataFrame:
    """Union of monthly tables (D3) with messy headers -> trimmed, lower
    snake names, ``mo``->``month``, ``extent``->``ice_extent``, numeric casts,
    sentinel -> NULL (B14), rows without an extent dropped, ``yyyy-MM`` label."""
    if not frames:
        raise ValueError("a monthly extent needs at least one monthly table")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tidy_names(f) for f in frames])
    types = dict((f.name, f.dataType) for f in union.schema.fields)
    numeric = {"year": "bigint", "month": "bigint", "ice_extent": "double", "area": "double"}
    exprs = []
    for c in union.columns:
        if c in numeric:
            v = sentinel_to_null(_as_number(_c(c), types[c]), sentinel)
            exprs.append(v.cast(numeric[c]).alias(c))
        elif is_numeric_type(types[c]):
            exprs.append(sentinel_to_null(_c(c), sentinel).alias(c))
        else:
            exprs.append(_c(c))
    out = union.select(*exprs).where(F.col("ice_extent").isNotNull())
    return out.withColumn("date", month_label(F.col("year"), F.col("month")))


# ---------------------------------------------------------------------- A17
def json_feed_records(feeds: DataFrame, text_column: str = "value") -> DataFrame:
    """``[meta, [records...]]`` JSON text -> one flat row per object
    record; records that are not objects are skipped, as is text that is no JSON.

    The text is parsed once, to a variant; fields are read from it by path. A
    value may be a number or a number as text."""
    keys = [c for c in feeds.columns if c != text_column]
    parsed = feeds.select(*[_c(k) for k in keys], F.try_parse_json(_c(text_column)).alias("_v"))
    exploded = parsed.select(*[_c(k) for k in keys], F.explode(F.try_variant_get("_v", "$[1]", "array<variant>")).alias("_r"))
    objects = exploded.where(F.schema_of_variant("_r").startswith("OBJECT"))

    def text(path: str) -> Column:
        return F.try_variant_get("_r", path, "string")

    return objects.select(*[_c(k) for k in keys],
                          text("$.country.value").alias("Country Name"),
                          text("$.country.id").alias("Country Code"),
                          text("$.indicator.value").alias("Indicator Name"),
                          text("$.indicator.id").alias("Indicator Code"),
                          text("$.date").alias("Year"),
                          parse_number(text("$.value")).alias("Value"))
