"""Shards by a keyed permutation of global row numbers (law ``rows``).

Rows are numbered in the order of (id, text checksum, size); a Feistel
permutation with cycle walking shuffles the numbers, and a shuffled number p of
s shards means shard p mod s, slot p div s. The place of every row is so
computable from its number, the number of rows and the key alone; counts of
shards differ by one at most and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.feistel import permuted
from tidemark.llm.numbering import numbered
from tidemark.llm.shared import column, map_batches


def shard_rows(docs: DataFrame, shards: int = 16, key: int = 1, doc_id: str = "doc_id", text: str = "text"
               ) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    size is the text's UTF-8 length (null: none) plus 1, text_crc32 its
    checksum (null: of no bytes). The order of numbering depends on doc_id and
    text only, not on how the input is split; rows equal in both are
    interchangeable. Null ids come first. ``grown_shard`` is null: another
    number of shards deals all rows anew. Only the id, size and checksum are
    shuffled. An empty table gives an empty result.
    """
    body = F.coalesce(column(docs, text), F.lit("")).cast("binary")
    thin = docs.select(column(docs, doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    # the tie only splits rows equal in all that is returned; one value may so spread over tasks
    order = ["doc_id", "text_crc32", "size", "tie"]
    rows, total = numbered(thin.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie"), "shard-rows")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            place = permuted(batch.column(3).to_numpy().astype(np.int64), total, key)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                [*batch.schema.names, "shard", "slot"])

    ordered = rows.select("doc_id", "size", "text_crc32", "row_number")
    schema = StructType([*ordered.schema.fields]).add("shard", "integer").add("slot", "long")
    placed = map_batches(ordered, run, schema)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")
