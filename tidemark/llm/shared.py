"""Helpers the corpus operators share: written intermediate tables and safe column projection."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - loads pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

# crc32(doc_id as text) mod HELD_OUT_MOD = 0 marks rows that no classifier learns from.
HELD_OUT_MOD = 5


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark-llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor re-reads files instead of
    recomputing the jobs before, and row ids taken before it stay fixed.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver found it
    (local mode and shared installs; otherwise ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH", ""), root]))


_worker: dict = {}


def worker_state(key: tuple, make: Callable[[], object]):
    """The object that a Python worker keeps between batches and tasks, made at
    the first call. Workers are reused by later stages: one object is kept at a
    time, a call with another key gives the one before up."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema) -> DataFrame:
    """``mapInArrow`` on workers that find this package."""
    ready_workers(df.sparkSession)
    return df.mapInArrow(run, schema)


def shuffle_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its exact name, dots and back-ticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def held_out(doc_id: Column) -> Column:
    """True for rows kept out of learning; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % HELD_OUT_MOD) == 0


def batches(stream: Iterator[pa.RecordBatch], text_index: int, max_bytes: int
            ) -> Iterator[pa.RecordBatch]:
    """Slice incoming batches so that one slice holds at most ``max_bytes`` of
    text (a longer single row comes alone)."""
    for batch in stream:
        if not batch.num_rows:
            continue
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_index)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
