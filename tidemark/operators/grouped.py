"""Many marts from one scan: each grouping key is one grouping set.

A set of marts is described first (:class:`GroupedMart`: key, figures, order),
then aggregated together: Spark expands every row once per different key, and
partial aggregation combines them map-side, so the table is read once however
many marts there are. Equal figures are computed once. The aggregated table
(one row per key value) is written and read again, and each mart is a filter and
a projection of it; figures of the whole table are the empty grouping set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import is_numeric_type, quoted
from tidemark.session import shared_table


@dataclass(frozen=True)
class GroupedMart:
    """One mart: ``figures`` (aggregate columns by output name) per value of ``key``.

    ``key`` None is the whole table. ``order`` lists (output column, ascending);
    the key ascending comes last. ``needs_rows`` drops keys where ``record_count``
    is 0, ``needs_key`` those without a key; ``ranked`` numbers the ``limit`` rows."""

    name: str
    key_name: str | None
    key: Column | None
    figures: dict[str, Column]
    order: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    ranked: bool = False
    needs_rows: bool = False
    needs_key: bool = False
    metadata: dict[str, dict] = field(default_factory=dict)


class GroupedMarts:
    """The marts of one table, computed together."""

    def __init__(self, df: DataFrame, marts: list[GroupedMart], keep: Callable[[DataFrame], DataFrame] = shared_table):
        self.marts = {m.name: m for m in marts}
        self._keys: dict[str, int] = {}            # a key's expression -> its place
        self._figures: dict[str, int] = {}
        keys, figures = [], []
        for m in marts:
            if m.key is not None and str(m.key) not in self._keys:
                self._keys[str(m.key)] = len(keys)
                keys.append(m.key.alias(f"key_{len(keys)}"))
            for figure in m.figures.values():
                if str(figure) not in self._figures:
                    self._figures[str(figure)] = len(figures)
                    figures.append(figure.alias(f"figure_{len(figures)}"))
        names = [f"key_{i}" for i in range(len(keys))]
        sets: list[list[str]] = [[n] for n in names]
        if any(m.key is None for m in marts):
            sets.append([])
        self.aggregated = df.select("*", *keys).groupingSets(sets, *names).agg(
            F.grouping_id().alias("mart_set"), *figures) if names else \
            df.agg(F.lit(0).cast("long").alias("mart_set"), *figures)
        self._names = names
        self.table = keep(self.aggregated)

    def _set(self, m: GroupedMart) -> int:
        """Spark's grouping id: a bit for each key that the set leaves out, the first key's the highest."""
        every = (1 << len(self._names)) - 1
        return every if m.key is None else every ^ (1 << (len(self._names) - 1 - self._keys[str(m.key)]))

    def whole(self, name: str) -> dict:
        """The figures of a mart of the whole table; an empty table has none."""
        m = self.marts[name]
        row = self.table.where(F.col("mart_set") == self._set(m)).select(
            *[F.col(f"figure_{self._figures[str(f)]}").alias(n) for n, f in m.figures.items()]).first()
        return row.asDict() if row else {n: None for n in m.figures}

    def mart(self, name: str) -> DataFrame:
        m = self.marts[name]
        figures = [F.col(f"figure_{self._figures[str(f)]}").alias(n, metadata=m.metadata.get(n, {}))
                   for n, f in m.figures.items()]
        rows = self.table.where(F.col("mart_set") == self._set(m))
        if m.key is None:
            return rows.select(*figures)
        out = rows.select(F.col(f"key_{self._keys[str(m.key)]}").alias(m.key_name), *figures)
        if m.needs_rows:
            out = out.where(F.col("record_count") > 0)
        if m.needs_key:
            out = out.where(quoted(m.key_name).isNotNull())
        order = [quoted(c).asc_nulls_last() if up else quoted(c).desc_nulls_last() for c, up in m.order]
        order.append(quoted(m.key_name).asc_nulls_last())
        out = out.orderBy(*order)
        if m.limit is not None:
            out = out.limit(m.limit)
        if m.ranked:
            out = out.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "*")
        return out


def mart_values(marts: dict[str, DataFrame]) -> DataFrame:
    """(mart, key, measure, value) of all marts: one row per figure. The key is
    the text of a mart's columns that are no numbers (years and decades count as
    keys too), joined by ``|``."""
    spark, parts = None, []
    for name, mart in marts.items():
        spark = mart.sparkSession
        keys = [f.name for i, f in enumerate(mart.schema.fields) if not is_numeric_type(f.dataType)
                or (i == 0 and f.name != "rank" and f.dataType.simpleString() in ("int", "bigint"))]
        if not keys and mart.columns[:1] == ["rank"]:
            keys = [mart.columns[1]]
        measures = [c for c in mart.columns if c not in keys]
        key = F.concat_ws("|", *[quoted(k).cast("string") for k in keys]) if len(keys) > 1 else \
            quoted(keys[0]).cast("string") if keys else F.lit(None).cast("string")
        parts.append(mart.select(F.lit(name).alias("mart"), key.alias("key"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("measure"), quoted(c).cast("double").alias("value")) for c in measures]))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
