"""Sinks (A6, A8-A11, A19): snapshots, audit rows, staging, marts, SQL text.

Computing and writing are separate: operators return lazy DataFrames and
these functions write them. Folders are taken from the caller (a shared
location on a cluster), never from a machine-local temporary folder.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import quoted
from tidemark.functions.names import normalize_name
from tidemark.functions.ordering import numbered

ROW_ID = "_row_id"


def _stamp() -> tuple[str, str]:
    now = datetime.now(timezone.utc)
    return now.strftime("%Y_%m_%d_%H%M%S"), now.isoformat()


def write_snapshot(df: DataFrame, root: str, source_name: str,
                   snapshot_name: str | None = None, audit: bool = True,
                   original_input: str | None = None, source_type: str = "dataframe") -> dict:
    """A6 (+A8): raw snappy Parquet snapshot, named or timestamped; the row
    count and which columns hold NULLs are observed during the write (no second
    scan) and one audit row is appended to ``<root>/audit/ingestion``."""
    name = normalize_name(source_name)
    stamp, iso = _stamp()
    run_id = uuid.uuid4().hex[:8]
    path = f"{root.rstrip('/')}/raw/{normalize_name(snapshot_name) if snapshot_name else f'{name}_{stamp}_{run_id}'}"
    obs = Observation(f"ingest_{run_id}")
    data = df.drop(ROW_ID) if ROW_ID in df.columns else df
    nulls = [F.count_if(quoted(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(data.schema.fields)]
    data.observe(obs, F.count(F.lit(1)).alias("rows"), *nulls).write.mode("overwrite") \
        .option("compression", "snappy").parquet(path)
    rows = obs.get["rows"]
    schema = [{"name": f.name, "dtype": f.dataType.simpleString(), "nullable": obs.get[f"n{i}"] > 0}
              for i, f in enumerate(data.schema.fields)]
    record = {"run_id": run_id, "run_timestamp": iso, "source": name,
              "original_input": original_input, "source_type": source_type,
              "snapshot_path": path, "rows_processed": rows,
              "column_count": len(data.columns), "schema_json": json.dumps(schema)}
    if audit:
        spark = df.sparkSession
        audit_schema = ("run_id string, run_timestamp string, source string, original_input string, "
                        "source_type string, snapshot_path string, rows_processed bigint, "
                        "column_count bigint, schema_json string")
        spark.createDataFrame([record], audit_schema).write.mode("append") \
            .parquet(f"{root.rstrip('/')}/audit/ingestion")
    return record


def ingest(spark: SparkSession, path: str, root: str, source_name: str | None = None,
           source_format: str | None = None, read_options: dict | None = None,
           snapshot_name: str | None = None) -> tuple[DataFrame, dict]:
    """Read a source, snapshot it, return the snapshot (re-read, so
    downstream work starts from Parquet types) and the manifest."""
    from tidemark.sources.readers import detect_format, read_source, source_name_of
    df = read_source(spark, path, source_format, read_options)
    manifest = write_snapshot(df, root, source_name_of(path, source_name), snapshot_name,
                              original_input=path, source_type=detect_format(path, source_format))
    return spark.read.parquet(manifest["snapshot_path"]), manifest


def ingest_dataframe(df: DataFrame, root: str, source_name: str,
                     snapshot_name: str | None = None) -> tuple[DataFrame, dict]:
    """A5: the same snapshot path for an already loaded DataFrame."""
    manifest = write_snapshot(df, root, source_name, snapshot_name, original_input="dataframe")
    return df.sparkSession.read.parquet(manifest["snapshot_path"]), manifest


def write_staging(df: DataFrame, root: str, source_name: str) -> str:
    """Staging table at a unique path per run."""
    stamp, _ = _stamp()
    path = f"{root.rstrip('/')}/staging/staging_{normalize_name(source_name)}_{stamp}_{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_mart(df: DataFrame, root: str, mart_name: str) -> tuple[str, DataFrame]:
    """A10: overwrite the mart by name; return the path and the written table."""
    path = f"{root.rstrip('/')}/marts/{normalize_name(mart_name)}"
    df.write.mode("overwrite").parquet(path)
    return path, df.sparkSession.read.parquet(path)


def write_integrated(df: DataFrame, root: str, name: str = "master_dataset") -> str:
    """The integrated wide table under a chosen name."""
    path = f"{root.rstrip('/')}/integrated/{normalize_name(name)}"
    df.write.mode("overwrite").parquet(path)
    return path


# ---------------------------------------------------------------------- A19
# Spark type -> Postgres column type.
def pg_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE PRECISION"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMPTZ"
    return "TEXT"


def _sql_literal(c, dtype: T.DataType):
    if isinstance(dtype, T.BooleanType):
        v = F.when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        infinite = F.abs(c) == float("inf")
        v = F.when(infinite, F.concat(F.lit("'"), c.cast("string"), F.lit("'"))).otherwise(c.cast("string"))
        return F.when(c.isNull() | F.isnan(c), F.lit("NULL")).otherwise(v)
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        v = c.cast("string")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        v = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00'"))
    else:
        v = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(v)


def create_table_sql(df: DataFrame, table_name: str) -> str:
    cols = ",\n".join(f'  "{f.name}" {pg_type(f.dataType)}' for f in df.schema.fields)
    return f'DROP TABLE IF EXISTS "{table_name}";\nCREATE TABLE "{table_name}" (\n{cols}\n);'


def value_tuples(df: DataFrame) -> Column:
    """A row as the text of one SQL ``VALUES`` tuple. NaN is NULL, infinities are quoted."""
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    return F.concat(F.lit("("), F.concat_ws(", ", *[_sql_literal(quoted(f.name), f.dataType) for f in fields]),
                    F.lit(")"))


def insert_statements(df: DataFrame, table_name: str, batch_size: int = 500,
                      order_by: list[str] | None = None) -> DataFrame:
    """(batch, statement): ``INSERT`` statements of ``batch_size`` rows each, the
    last one of the rest, so ceil(rows / batch_size) of them whatever the layout.

    Rows are numbered in the order of ``order_by`` (ascending, nulls last) and then
    of their tuple text, which makes the statements the same for the same rows; a
    statement gathers ``batch_size`` rows at most.
    """
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    cols = ", ".join('"' + f.name.replace('"', '""') + '"' for f in fields)
    keys = [quoted(c).alias(f"key_{i}") for i, c in enumerate(order_by or [])]
    rows = df.select(*keys, value_tuples(df).alias("row_sql"))
    order = [F.col(f"key_{i}").asc_nulls_last() for i in range(len(keys))] + [F.col("row_sql")]
    grouped = numbered(rows, order, "sql-rows").groupBy(F.expr(f"row_number div {int(batch_size)}").alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("row_number", "row_sql"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row_sql"]), ",\n")
    head = 'INSERT INTO "' + table_name.replace('"', '""') + f'" ({cols}) VALUES\n'
    return grouped.select("batch", F.concat(F.lit(head), body, F.lit(";")).alias("statement"))


def export_sql_text(marts: dict[str, DataFrame], folder: str, batch_size: int = 500) -> dict[str, str]:
    """Per non-empty mart, a DDL file and the INSERT statements as text
    part files (written in parallel)."""
    written = {}
    for name, df in marts.items():
        if df.isEmpty():
            continue
        table_name = normalize_name(name)
        base = f"{folder.rstrip('/')}/{table_name}"
        spark = df.sparkSession
        spark.createDataFrame([(create_table_sql(df, table_name),)], "value string") \
            .coalesce(1).write.mode("overwrite").text(f"{base}/schema")
        insert_statements(df, table_name, batch_size).orderBy("batch").select("statement") \
            .write.mode("overwrite").text(f"{base}/inserts")
        written[name] = base
    return written


def export_jdbc(df: DataFrame, url: str, table_name: str, properties: dict | None = None,
                batch_size: int = 500) -> None:
    """Write through JDBC in batches, with the column types of ``pg_type``.
    Needs a reachable database and its driver."""
    props = {"batchsize": str(batch_size), **(properties or {})}
    df.write.mode("overwrite").option("createTableColumnTypes", jdbc_column_types(df)) \
        .jdbc(url, table_name, properties=props)


def jdbc_column_types(df: DataFrame) -> str:
    """The types as the writer's ``createTableColumnTypes`` takes them (Spark type names)."""
    names = {"BIGINT": "BIGINT", "DOUBLE PRECISION": "DOUBLE", "TIMESTAMPTZ": "TIMESTAMP", "BOOLEAN": "BOOLEAN",
             "TEXT": "STRING"}
    return ", ".join(f"`{f.name}` {names[pg_type(f.dataType)]}" for f in df.schema.fields)
