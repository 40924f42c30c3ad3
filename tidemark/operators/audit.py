"""Join-key checks (D7) and the lineage audit with mart reconciliation.

Re-aimed from documents to measurements: a shared column name is only a
candidate key; the check measures distinct keys, duplicates and containment
on the data. Lineage edges carry the measured number of changed cells.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import quoted
from tidemark.functions.names import QUALITY_FLAG_COLUMNS
from tidemark.functions.semantic import parse_metric_name


def _c(name: str) -> Column:
    return quoted(name)


def candidate_pairs(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """Columns present in several tables, as chained (from, to, column) pairs."""
    owners: dict[str, list[str]] = {}
    for name, df in tables.items():
        for c in df.columns:
            owners.setdefault(c, []).append(name)
    pairs = []
    for col, names in owners.items():
        if len(names) < 2 or col in QUALITY_FLAG_COLUMNS or col == "_row_id":
            continue
        pairs += [(names[i], names[i + 1], col) for i in range(len(names) - 1)]
    return pairs


def _key_text(df: DataFrame, col: str) -> Column:
    """A key as text; whole numbers of any numeric type read alike."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = _c(col).try_cast("bigint")
        return F.when(whole.cast("double") == _c(col), whole.cast("string")).otherwise(_c(col).cast("string"))
    return _c(col).cast("string")


def key_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Per candidate pair, keys, rows and duplicate keys per side, keys of
    one side missing on the other and the measured cardinality.

    Each table is read once and gives one row per shared column; all keys of a
    column are counted per table in one grouping by (column, key), which is
    combined map-side, so a key with a third of the rows is no skew. There is
    no join. Keys are compared as text (their numbers' text where numeric)."""
    pairs = candidate_pairs(tables)
    if not pairs:
        raise ValueError("the tables share no column name")
    owners = list(dict.fromkeys(name for pair in pairs for name in pair[:2]))
    columns = list(dict.fromkeys(col for _, _, col in pairs))
    long = reduce(DataFrame.unionByName, [
        tables[name].select(F.lit(i).alias("t"), F.inline(F.array(*[
            F.struct(F.lit(columns.index(c)).alias("c"), _key_text(tables[name], c).alias("k"))
            for c in columns if c in tables[name].columns])))
        for i, name in enumerate(owners)]).where(F.col("k").isNotNull())
    per_key = long.groupBy("c", "k").agg(*[F.count_if(F.col("t") == i).alias(f"n{i}") for i in range(len(owners))])
    def side(name):
        n = F.col(f"n{owners.index(name)}")
        return F.when(n > 0, n)
    figures, described = [], []
    for p, (left, right, col) in enumerate(pairs):
        here, nl, nr = F.col("c") == columns.index(col), side(left), side(right)
        figures += [F.count(F.when(here, nl)).alias(f"a{p}"), F.sum(F.when(here, nl)).alias(f"b{p}"),
                    F.count_if(here & (nl > 1)).alias(f"c{p}"),
                    F.count(F.when(here, nr)).alias(f"d{p}"), F.sum(F.when(here, nr)).alias(f"e{p}"),
                    F.count_if(here & (nr > 1)).alias(f"f{p}"),
                    F.count_if(here & nl.isNotNull() & nr.isNull()).alias(f"g{p}"),
                    F.count_if(here & nr.isNotNull() & nl.isNull()).alias(f"h{p}")]
        zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
        described.append(F.struct(
            F.lit(left).alias("from_table"), F.lit(col).alias("from_column"),
            F.lit(right).alias("to_table"), F.lit(col).alias("to_column"),
            F.col(f"a{p}").alias("from_keys"), zero(f"b{p}").alias("from_rows"), F.col(f"c{p}").alias("from_duplicate_keys"),
            F.col(f"d{p}").alias("to_keys"), zero(f"e{p}").alias("to_rows"), F.col(f"f{p}").alias("to_duplicate_keys"),
            F.col(f"g{p}").alias("from_keys_missing_in_to"), F.col(f"h{p}").alias("to_keys_missing_in_from")))
    out = per_key.agg(*figures).select(F.inline(F.array(*described)))
    many_from = F.col("from_duplicate_keys") > 0
    many_to = F.col("to_duplicate_keys") > 0
    card = (F.when(many_from & many_to, "many-to-many").when(many_from, "many-to-one")
             .when(many_to, "one-to-many").otherwise("one-to-one"))
    return out.withColumn("cardinality", card)


def lineage_edges(result, mart_tables: dict[str, DataFrame]) -> DataFrame:
    """raw -> staging edges (passthrough / normalized / type_cast) with
    the measured cells nulled by blank handling, the values that failed a numeric
    or date cast (text of a date column stays as it was) and the rows whose cell
    was not nulled (before duplicates go), and staging
    -> mart edges (passthrough, or aggregated from the metric named in the
    mart column). ``result`` is a ``CleanResult``."""
    spark = result.df.sparkSession
    staging_cols = [c for c in result.df.columns if c not in QUALITY_FLAG_COLUMNS]
    rows = []
    for d in result.decisions:
        kind = ("type_cast" if d.kind in ("numeric", "datetime")
                else "normalized" if d.raw_name != d.column else "passthrough")
        rows.append((f"raw::{d.raw_name}", f"staging::{d.column}", kind, d.blanks, d.failed,
                     result.input_rows - d.blanks - (d.failed if d.kind == "numeric" else 0)))
    for mart, df in mart_tables.items():
        for c in df.columns:
            if c in QUALITY_FLAG_COLUMNS:
                continue
            if c in staging_cols:
                rows.append((f"staging::{c}", f"mart::{mart}::{c}", "passthrough", 0, 0, None))
                continue
            meta = parse_metric_name(c)
            source = meta and meta.get("source_column")
            if source in staging_cols:
                rows.append((f"staging::{source}", f"mart::{mart}::{c}", "aggregated", 0, 0, None))
    schema = ("from_node string, to_node string, edge_type string, blanks_nulled bigint, cast_failures bigint, "
              "rows_unchanged bigint")
    return spark.createDataFrame(rows, schema)


def lineage_paths(edges: DataFrame) -> DataFrame:
    """every way from a raw column to a mart column, by a recursive query over
    the edges (:func:`lineage_edges`, best written and read again): ``raw_node``,
    ``mart_node``, ``steps``, the nodes in between as ``path``, and the blanks and
    failed casts summed along it. A mart column without a way to raw data has no row."""
    return edges.sparkSession.sql("""
        WITH RECURSIVE ways(mart_node, node, steps, blanks_nulled, cast_failures, path) AS (
          SELECT to_node, from_node, 1, blanks_nulled, cast_failures, concat(from_node, ' > ', to_node)
          FROM {edges} WHERE to_node LIKE 'mart::%'
          UNION ALL
          SELECT w.mart_node, e.from_node, w.steps + 1, w.blanks_nulled + e.blanks_nulled,
                 w.cast_failures + e.cast_failures, concat(e.from_node, ' > ', w.path)
          FROM ways w JOIN {edges} e ON e.to_node = w.node)
        SELECT node AS raw_node, mart_node, steps, path, blanks_nulled, cast_failures
        FROM ways WHERE node LIKE 'raw::%'""", edges=edges)


SCREEN_ENTRIES = 12           # log2 of the hashes that a key sketch keeps
SCREEN_ERROR = 1e-6           # share of screened pairs whose containment may lie outside its bounds


def screen_keys(tables: dict[str, DataFrame], log_entries: int = SCREEN_ENTRIES) -> DataFrame:
    """D7 before the exact check: for each pair of tables with a column of one
    name, the estimated keys of both sides and the share of the first side's keys
    that the second one holds, with the bounds ``low`` and ``high``.

    Every column of every table becomes one theta sketch, in one aggregate per
    table, so a catalogue is screened without shuffling a key; pairs are compared by
    their sketches. Where both sketches hold all keys the share is exact (``low`` =
    ``high``); else the kept keys are a random sample of the first side's, and the
    bounds are Hoeffding's at ``SCREEN_ERROR``."""
    pairs = candidate_pairs(tables)
    if not pairs:
        raise ValueError("the tables share no column name")
    owned = {(name, c) for left, right, c in pairs for name in (left, right)}
    sketches = reduce(DataFrame.unionByName, [
        df.agg(*[F.theta_sketch_agg(_key_text(df, c), F.lit(log_entries)).alias(f"s{i}") for i, c in enumerate(own)])
        .select(F.inline(F.array(*[F.struct(F.lit(name).alias("t"), F.lit(c).alias("c"), F.col(f"s{i}").alias("sketch"))
                                   for i, c in enumerate(own)])))
        for name, df in tables.items() if (own := [c for c in df.columns if (name, c) in owned])])
    spark = sketches.sparkSession
    # one row per pair and one sketch per column: bounded by the catalogue
    wanted = spark.createDataFrame(pairs, "from_table string, to_table string, column string")
    sides = wanted.join(F.broadcast(sketches.selectExpr("t as from_table", "c as column", "sketch as a")), ["from_table", "column"]) \
        .join(F.broadcast(sketches.selectExpr("t as to_table", "c as column", "sketch as b")), ["to_table", "column"])
    number = lambda sketch: F.theta_sketch_estimate(sketch).cast("double")
    both = sides.select("from_table", "to_table", "column", number(F.col("a")).alias("from_keys"), number(F.col("b")).alias("to_keys"),
                        number(F.theta_intersection("a", "b")).alias("shared"))
    kept = F.least(F.lit(1.0), F.lit(float(1 << log_entries)) / F.greatest("from_keys", "to_keys", F.lit(1.0)))
    share = F.when(F.col("from_keys") > 0, F.least(F.lit(1.0), F.col("shared") / F.col("from_keys")))
    slack = F.when(kept < 1, F.sqrt(F.lit(math.log(2 / SCREEN_ERROR) / 2) / (F.col("from_keys") * kept))).otherwise(F.lit(0.0))
    return both.select("from_table", "to_table", "column", "from_keys", "to_keys", share.alias("contained"),
                       F.greatest(F.lit(0.0), share - slack).alias("low"), F.least(F.lit(1.0), share + slack).alias("high"))


def reconcile(staging: DataFrame, mart: DataFrame, metric: str | None = None,
              tolerance: float = 1e-6) -> DataFrame:
    """a mart's totals against the staging table it came from (row count
    and metric total), one aggregate per side, compared in long form."""
    checks_m = [F.sum("record_count").cast("double").alias("record_count")]
    checks_s = [F.count(F.lit(1)).cast("double").alias("record_count")]
    total = f"total_{metric}" if metric else None
    if metric and total in mart.columns:
        checks_m.append(F.sum(total).cast("double").alias("metric_total"))
        checks_s.append(F.coalesce(F.sum(_c(metric)), F.lit(0)).cast("double").alias("metric_total"))
    def long(one, side):
        return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value"))
                                              for c in one.columns]))).withColumn("side", F.lit(side))
    both = long(mart.agg(*checks_m), "mart").unionByName(long(staging.agg(*checks_s), "staging"))
    wide = both.groupBy("check").pivot("side", ["mart", "staging"]).agg(F.first("value"))
    diff = F.abs(F.col("mart") - F.col("staging"))
    scale = F.greatest(F.abs("mart"), F.abs("staging"), F.lit(1.0))
    return wide.select(F.col("check"), F.col("mart").alias("mart_value"),
                       F.col("staging").alias("staging_value"),
                       (diff <= F.lit(tolerance) * scale).alias("matches"))
