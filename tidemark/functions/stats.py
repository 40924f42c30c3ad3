"""Column statistics passes shared by the operators.

* :func:`column_counts` - rows, non-null and exact distinct counts for many
  columns: one ``agg`` for the null counts, and one unpivot followed by a
  two-level ``groupBy`` for distinct counts. Whole numbers, dates and booleans
  are counted as bitmaps of 64 values (``bit_or`` of a word per 64, combined
  map-side: dense keys need a 64th of the rows), all others as distinct texts.
  A value held by a third of all rows is collapsed before the shuffle.
* :func:`quantiles` - exact linear-interpolation quantiles of many columns at
  once by bucket refinement, one algorithm for every size: a pass counts rows
  per value bucket of each open bracket (hash-distributed, combined map-side,
  at most ``BUCKETS`` rows per bracket), and a rank's bracket shrinks to the
  smallest and largest value of its bucket until both are equal. No task ever
  holds the values themselves. Brackets start from min and max, or narrower from
  KLL sketches taken in the pass that found those (:func:`quantile_figures`); a
  rank that is not in its sketched bracket goes back to the whole range.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import quoted

# Value buckets per open bracket and pass.
BUCKETS = 1024
# Rows of a bracket that are counted value by value at most.
FEW = 8192


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Stable text of a value for distinct counting of mixed-type columns."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # -0.0 and 0.0 are the same number
        return (c + F.lit(0.0)).cast("string")
    return c.cast("string")


_DAYS = (T.DateType,)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _whole_number(c: Column, dtype: T.DataType) -> Column | None:
    """The value as a long where the type has at most one value for each, else None."""
    if isinstance(dtype, _DAYS):
        return F.unix_date(c).cast("long")
    return c.cast("long") if isinstance(dtype, _WHOLE) else None


def _whole_counts(df: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """(column_name, distinct_count) of whole numbers: one word of 64 bits for every
    64 neighbouring values, the bits of which say which of them occur."""
    names = list(numbers)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), x.alias("x")) for i, x in enumerate(numbers.values())])))
    words = long.where(F.col("x").isNotNull()).select(
        "c", F.shiftright("x", 6).alias("word"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit")) \
        .groupBy("c", "word").agg(F.bit_or("bit").alias("bits"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1)
    return words.groupBy(name.alias("column_name")).agg(F.sum(F.bit_count("bits")).cast("long").alias("distinct_count"))


def unpivot_values(df: DataFrame, columns: list[str], keep: list[str] | None = None,
                   name_col: str = "column_name", value_col: str = "value") -> DataFrame:
    """Long form ``(column_name, value-as-text)`` of the non-null cells."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keep = keep or []
    structs = [F.struct(F.lit(c).alias(name_col),
                        value_text(quoted(c), types[c]).alias(value_col))
               for c in columns]
    long = df.select(*keep, F.inline(F.array(*structs)))
    return long.where(F.col(value_col).isNotNull())


def distinct_counts_df(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """``(column_name, distinct_count)`` for the given columns (non-null values)."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, distinct_count bigint")
    if not approx:
        types = {f.name: f.dataType for f in df.schema.fields}
        numbers = {c: x for c in columns if (x := _whole_number(quoted(c), types[c])) is not None}
        texts = [c for c in columns if c not in numbers]
        if numbers:
            counted = _whole_counts(df, numbers)
            return counted.unionByName(distinct_counts_df(df, texts)) if texts else counted
    long = unpivot_values(df, columns)
    if approx:
        return long.groupBy("column_name").agg(
            F.approx_count_distinct("value").alias("distinct_count"))
    return (long.select("column_name", "value").distinct()
                .groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count")))


def non_null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Non-null count per column in one aggregate (no distinct counting)."""
    row = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)]).collect()[0]
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def column_counts(df: DataFrame, columns: list[str] | None = None,
                  approx_distinct: bool = False) -> dict:
    """Rows plus per-column non-null and distinct counts (two jobs, small results)."""
    columns = list(df.columns if columns is None else columns)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count(quoted(c)).alias(f"nn_{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).collect()[0]
    distinct = {r["column_name"]: r["distinct_count"]
                for r in distinct_counts_df(df, columns, approx_distinct).collect()}
    return {
        "rows": row["__rows"],
        "non_null": {c: row[f"nn_{i}"] for i, c in enumerate(columns)},
        "distinct": {c: int(distinct.get(c, 0)) for c in columns},
    }


def _interpolate(values_at: dict[int, float], n: int, p: float) -> float:
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    a, b = values_at[lo], values_at[hi]
    return a + (b - a) * (pos - lo) if hi != lo else a


def _ranks_for(n: int, probs: list[float]) -> list[int]:
    ranks = set()
    for p in probs:
        pos = p * (n - 1)
        ranks.add(math.floor(pos))
        ranks.add(math.ceil(pos))
    return sorted(ranks)


def _on_log_scale(x: Column) -> Column:
    """A monotone map of all doubles that spreads their magnitudes evenly (Java's
    logarithm never falls where its argument rises)."""
    size = F.log(F.abs(x)) + F.lit(746.0)             # above 0 for every double but 0
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0.0))


def _log_of(x: float) -> float:
    return math.copysign(math.log(abs(x)) + 746.0, x) if x else 0.0


def _bucket(x: Column, lo: float, hi: float, by_size: bool) -> Column:
    """Which of ``BUCKETS`` parts of [lo, hi] a value is in: equal parts of the
    range, or of its logarithmic scale. Infinities have a bucket of their own
    at either end, values outside have none."""
    low, high = max(lo, -_LARGEST), min(hi, _LARGEST)
    if by_size:
        start, width, at = _log_of(low), _log_of(high) - _log_of(low), _on_log_scale(x)
    else:
        start, width, at = low / 2, high / 2 - low / 2, x / 2     # halves: the whole may not be a double
    share = (at - F.lit(start)) / F.lit(width) if width > 0 else F.lit(0.0)
    part = F.least(F.greatest(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
    part = F.when(x == float("inf"), F.lit(BUCKETS)).when(x == float("-inf"), F.lit(-1)).otherwise(part)
    return F.when(x.between(F.lit(lo), F.lit(hi)), part)


_LARGEST = 1.7976931348623157e308


def _number(column: str) -> Column:
    x = quoted(column).cast("double")
    return F.when(~F.isnan(x), x)


SKETCH_K = 2048             # size of a KLL sketch: ranks are off by about 0.1 %
SKETCH_MARGIN = 0.003       # share of the rows that a sketched bracket reaches to either side


def quantile_figures(column: str, probs: list[float]) -> dict[str, Column]:
    """What :func:`quantiles` can start from, for an aggregate over the table:
    count, min, max and a bracket for each probability, from one KLL sketch."""
    x = _number(column)
    sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
    at = lambda p: F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(min(max(p, 0.0), 1.0))))
    return {"n": F.count(x), "lo": F.min(x), "hi": F.max(x), "brackets": F.array(*[
        F.struct(at(p - SKETCH_MARGIN).alias("lo"), at(p + SKETCH_MARGIN).alias("hi")) for p in probs])}


def numeric_bounds(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, dict]:
    """:func:`quantile_figures` of each column, in one aggregate."""
    aggs = [e.alias(f"{name}{i}") for i, (c, probs) in enumerate(wanted.items()) for name, e in quantile_figures(c, probs).items()]
    row = df.agg(*aggs).collect()[0]
    return {c: {name: row[f"{name}{i}"] for name in ("n", "lo", "hi", "brackets")} for i, c in enumerate(wanted)}


@dataclass(frozen=True)
class _Bracket:
    """Values of a column between two of them, the rows below them and, where it is known, among them."""
    column: str
    lo: float
    hi: float
    below: int
    inside: int | None = None

    def holds(self) -> Column:
        return _number(self.column).between(F.lit(self.lo), F.lit(self.hi))


def _sketched(df: DataFrame, wanted: dict[str, list[float]], known: dict[str, dict]) -> dict[_Bracket, set[int]]:
    """The sketched brackets and their ranks, by one aggregate that counts the rows
    below and in each. Ranks outside of it get the whole range."""
    spans = {(c, max(known[c]["lo"], b["lo"]), min(known[c]["hi"], b["hi"])): set() for c, probs in wanted.items()
             if known[c]["n"] for b in known[c]["brackets"]}
    if not spans:
        return {}
    counts = df.agg(*[e for i, (c, lo, hi) in enumerate(spans) for e in (
        F.count_if(_number(c) < lo).alias(f"below{i}"), F.count_if(_number(c).between(lo, hi)).alias(f"inside{i}"))]).collect()[0]
    found = [_Bracket(*span, counts[f"below{i}"], counts[f"inside{i}"]) for i, span in enumerate(spans)]
    out: dict[_Bracket, set[int]] = {}
    for c, probs in wanted.items():
        n = known[c]["n"]
        for r in _ranks_for(n, probs) if n else ():
            fitting = [b for b in found if b.column == c and b.below <= r < b.below + b.inside]
            best = min(fitting, key=lambda b: b.inside) if fitting else _Bracket(c, known[c]["lo"], known[c]["hi"], 0)
            out.setdefault(best, set()).add(r)
    return out


def _narrowed(df: DataFrame, open_ranks: dict[_Bracket, set[int]], by_size: bool) -> tuple[dict, dict]:
    """One pass over the rows that lie in any open bracket: ({(column, rank): value}
    found, the narrower brackets of the other ranks). A bracket of at most ``FEW`` rows
    is counted value by value, others by bucket."""
    brackets = list(open_ranks)
    parts = []
    for i, b in enumerate(brackets):
        x = _number(b.column)
        few = b.inside is not None and b.inside <= FEW
        part = F.when(b.holds(), F.lit(0)) if few else _bucket(x, b.lo, b.hi, by_size)
        parts.append(F.struct(F.lit(i).alias("bracket"), part.alias("part"), (x if few else F.lit(None).cast("double")).alias("value"),
                              x.alias("x")))
    held = df.where(reduce(lambda a, b: a | b, [b.holds() for b in dict.fromkeys(brackets)]))
    counted = held.select(F.inline(F.array(*parts))).where("part is not null").groupBy("bracket", "part", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    found, narrower, seen = {}, {}, {}
    for row in sorted(counted, key=lambda r: (r["bracket"], r["part"], r["lo"])):
        b = brackets[row["bracket"]]
        start = seen.get(b, b.below)
        seen[b] = start + row["n"]
        for r in open_ranks[b]:
            if start <= r < start + row["n"]:
                if row["lo"] == row["hi"]:
                    found[b.column, r] = row["lo"]
                else:
                    narrower.setdefault(_Bracket(b.column, row["lo"], row["hi"], start, row["n"]), set()).add(r)
    return found, narrower


def quantiles(df: DataFrame, wanted: dict[str, list[float]],
              known: dict[str, dict] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles (pandas ``quantile`` semantics) of
    several columns; all columns and ranks share each pass over the table.

    ``known`` may hold :func:`quantile_figures` per column when a pass before has
    them; without it one pass takes them. A pass over equal
    parts strictly narrows every open bracket, because its smallest and largest
    value fall into different buckets; every third pass takes parts of the
    logarithmic scale, which narrows ranges of many magnitudes. Tables of up to some
    million rows take the pass of the sketches, one that counts around their brackets
    and one over the rows in them. The driver reads at most ``BUCKETS + 2`` rows, or
    ``FEW`` values, per open bracket and pass."""
    known = known or numeric_bounds(df, wanted)
    open_ranks = _sketched(df, wanted, known)
    total = {c: b["n"] for c, b in known.items()}
    found: dict[tuple[str, int], float] = {}
    for turn in itertools.count(1):
        closed = [b for b in open_ranks if b.lo == b.hi]
        for b in closed:
            found.update({(b.column, r): b.lo for r in open_ranks.pop(b)})
        if not open_ranks:
            break
        now, open_ranks = _narrowed(df, open_ranks, turn % 3 == 0)
        found.update(now)
    return {c: [_interpolate({r: found[c, r] for r in _ranks_for(total[c], [p])}, total[c], p) if total[c] else None
                for p in probs] for c, probs in wanted.items()}
