"""Training-order files: token sequences in a shuffled order, in shards of fixed stride.

Documents become token ids, each closed by an end id; a task joins the ids of
its documents and cuts them into sequences of one length. Every sequence gets a
global slot by a keyed Feistel permutation with cycle walking of its number, so
the order of training is the order of the files. Shard k holds the slots from
k * per_shard on; a record is the ids as little-endian unsigned integers plus
one line-feed byte, so slot s starts at byte (s mod per_shard) * stride of its
shard and reading can start anywhere. Spark's text writer writes the records
(its commit protocol drops what a lost task left).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.feistel import permuted
from tidemark.llm.numbering import numbered
from tidemark.llm.shared import batches, column, map_batches, ready_workers
from tidemark.llm.tokens import SLICE_BYTES, token_bytes

_AT_ONCE = 256               # sequences of one output batch


def id_bytes(tokenizer: str) -> int:
    """2 where all ids of the vocabulary fit 16 bits, else 4."""
    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def sequences(docs: DataFrame, tokenizer: str, length: int, end_id: int, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(ids, n_tokens, doc_ids): sequences of ``length`` ids as bytes; the last
    one of a task is filled up with the end id, which n_tokens does not count.
    doc_ids lists the documents that have tokens in it, in order."""
    width = id_bytes(tokenizer)
    kind = f"<u{width}"
    data = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, owners = [], 0, []                 # of the sequence begun
        out: tuple[list, list, list] = ([], [], [])
        end = np.array([end_id], kind).tobytes()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(id_kind))],
                ["ids", "n_tokens", "doc_ids"])
            for part in out:
                part.clear()
            return batch

        for batch in batches(stream, 1, SLICE_BYTES):
            id_kind = batch.schema.field(0).type
            for owner, own in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1).to_pylist(), tokenizer)):
                body = np.frombuffer(own, "<u4").astype(kind).tobytes() + end
                at = 0
                while at < len(body):
                    part = body[at:at + length * width - size]
                    at += len(part)
                    ids.append(part)
                    size += len(part)
                    owners.append(owner)
                    if size == length * width:
                        for column_out, value in zip(out, (b"".join(ids), length, owners)):
                            column_out.append(value)
                        ids, size, owners = [], 0, []
                        if len(out[0]) >= _AT_ONCE:
                            yield flushed()
        if size:
            for column_out, value in zip(out, (b"".join(ids) + end * (length - size // width), size // width, owners)):
                column_out.append(value)
        if out[0]:
            yield flushed()

    kind_of_id = data.schema["doc_id"].dataType.simpleString()
    return map_batches(data, run, f"ids binary, n_tokens int, doc_ids array<{kind_of_id}>")


def write_training_order(docs: DataFrame, path: str, tokenizer: str, length: int = 2048, per_shard: int = 1024,
                         end_id: int = 0, key: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards below ``path`` (``shard=K/part-*``) and return one row
    per sequence: slot, shard, byte_offset, n_tokens, doc_ids, ids_crc32.

    Null and empty texts are one end id. Which documents share a sequence
    depends on how the input is split; the slots are a permutation without gaps
    in any case. An empty table writes no shard.
    """
    spark = docs.sparkSession
    rows, total = numbered(sequences(docs, tokenizer, length, end_id, doc_id, text), "training-sequences")
    stride = length * id_bytes(tokenizer) + 1
    ready_workers(spark)

    @F.arrow_udf("long")
    def slot_of(number: pa.Array) -> pa.Array:
        return pa.array(permuted(number.to_numpy(), total, key))

    placed = rows.withColumn("slot", slot_of("row_number")) \
        .withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
    shards = max(1, -(-total // per_shard))
    placed.select("shard", "slot", F.col("ids").cast("string").alias("value")) \
        .repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").drop("slot") \
        .write.partitionBy("shard").option("lineSep", "\n").text(path)
    return placed.select("slot", "shard", ((F.col("slot") % per_shard) * stride).alias("byte_offset"), "n_tokens",
                         "doc_ids", F.crc32("ids").alias("ids_crc32"))


def read_training_order(spark: SparkSession, path: str, length: int, id_width: int, per_shard: int,
                        first_slot: int = 0) -> DataFrame:
    """(slot, ids) of all sequences from ``first_slot`` on. Only the shards from
    that slot's on are opened; records are found by their offset."""
    stride = length * id_width + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
        .withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")) \
        .where(F.col("shard") >= first_slot // per_shard)
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / stride) - 1))
    return files.where(F.col("length") >= stride).select("shard", "content", place.alias("place")).select(
        (F.col("shard") * per_shard + F.col("place")).alias("slot"),
        F.expr(f"substring(content, cast(place * {stride} + 1 as int), {length * id_width})").alias("ids")) \
        .where(F.col("slot") >= first_slot)
