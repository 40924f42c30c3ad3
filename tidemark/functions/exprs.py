"""Scalar Column expressions shared by the operators.

All helpers return built-in Spark ``Column`` expressions so they stay inside
whole-stage codegen; none of them runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: share of convertible values needed before a text column is cast.
NUMERIC_CONVERSION_THRESHOLD = 0.8

# Text a pandas-style numeric parser accepts after trimming: decimal or
# exponent notation and infinities. Excludes Java's '1d'/'1f' suffixes, hex,
# thousands separators and 'nan' (which is missing, not a number).
NUMERIC_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
INTEGER_TEXT = r"^[+-]?\d+$"
# Everything Unicode counts as white space (fixed values).
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

_DICT_CELL = r"""^\{\s*('[^']*'|"[^"]*"|[^,'"]*)\s*:"""

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric_type(dtype: T.DataType) -> bool:
    """Numbers only; booleans are never treated as numeric metrics."""
    return isinstance(dtype, NUMERIC_TYPES)


def is_time_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIME_TYPES)


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def strip(text: Column) -> Column:
    """The text without white space at either end. Text between two visible ASCII
    characters, which is most, is not searched."""
    plain = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def is_blank(text: Column) -> Column:
    """B2: true for text of white space only (NULL stays NULL)."""
    return strip(text) == F.lit("")


def quoted(name: str) -> Column:
    """A top-level column by its exact name (dots and back-ticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_of(stripped: Column) -> Column:
    """S10 for text without white space at its ends: pandas-compatible text -> double;
    anything else (incl. 'nan') -> NULL."""
    return F.when(stripped.rlike(NUMERIC_TEXT), stripped.try_cast("double"))


def parse_number(text: Column) -> Column:
    """S10 for any text."""
    return number_of(strip(text))


def is_integer_text(text: Column) -> Column:
    return strip(text).rlike(INTEGER_TEXT)


def nan_to_null(c: Column) -> Column:
    """Floating NaN is missing."""
    return F.nanvl(c, F.lit(None).cast("double"))


def drop_nan(df: DataFrame) -> DataFrame:
    """Apply S15 to every floating column at the source."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(nan_to_null(quoted(f.name)).cast(f.dataType).alias(f.name))
        else:
            exprs.append(quoted(f.name))
    return df.select(*exprs)


def day_label(c: Column) -> Column:
    """``yyyy-MM-dd`` text of a date/timestamp."""
    return F.date_format(c, "yyyy-MM-dd")


def month_label(year: Column, month: Column) -> Column:
    """``yyyy-MM`` from numeric year and month; NULL when either is NULL."""
    y = year.cast("bigint")
    m = month.cast("bigint")
    return F.when(y.isNotNull() & m.isNotNull(), F.format_string("%04d-%02d", y, m))


def decimal_year_to_date(y: Column) -> Column:
    """1993.0417 -> 1993-01-01 + round(0.0417 * 365.2425) days."""
    whole = F.floor(y)
    days = F.bround((y - whole) * F.lit(365.2425)).cast("int")
    start = F.make_date(whole.cast("int"), F.lit(1), F.lit(1))
    return F.when(y.isNotNull(), F.date_add(start, days))


def decade_of(year: Column) -> Column:
    """Decade of a numeric year text/number; NULL when not numeric.

    The year is truncated toward zero first, then floored to the decade.
    """
    numeric = parse_number(year.cast("string"))
    truncated = numeric.cast("bigint")
    return F.when(numeric.isNotNull(), F.floor(truncated / F.lit(10)).cast("bigint") * 10)


def sentinel_to_null(c: Column, sentinel=-9999) -> Column:
    """A sentinel value means missing."""
    return F.when(c == F.lit(sentinel), F.lit(None)).otherwise(c)


def list_cell_items(text: Column) -> Column:
    """A list literal in a text cell -> array of trimmed non-blank items.

    Lists, tuples and sets count alike; ``None``, ``True`` and ``False`` stand
    for themselves (None is no item), and a nested list is one item. Anything
    that does not parse is one single item.
    """
    t = strip(text)
    closed = (t.startswith("[") & t.endswith("]")) | (t.startswith("(") & t.endswith(")")) \
        | (t.startswith("{") & t.endswith("}") & ~t.rlike(_DICT_CELL))
    inner = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r",\s*$", "")
    for word, json_word in (("None", "null"), ("True", '"True"'), ("False", '"False"')):
        # outside quotes only: the word stands between separators
        inner = F.regexp_replace(inner, rf"(^|,)\s*{word}\s*(?=,|$)", f"$1{json_word}")
    as_json = F.when(closed, F.concat(F.lit("["), inner, F.lit("]"))).otherwise(t)
    parsed = F.from_json(as_json, T.ArrayType(T.StringType()), {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    items = F.coalesce(parsed, F.array(text))
    trimmed = F.transform(items, lambda x: strip(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != F.lit("")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns (presentation step for cross-engine comparison)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.round(quoted(f.name), digits).alias(f.name))
        else:
            exprs.append(quoted(f.name))
    return df.select(*exprs)
