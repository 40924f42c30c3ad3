"""Best-fit packing with certified bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt over
partitions of bounded size; each partition is packed by best-fit decreasing and
gets a lower bound from dual-feasible functions: a count no packing of its
pieces can beat. A partition that meets its bound is final. The others give up
their unfilled sequences, exchange the pieces and are packed again, in fewer
partitions each time, as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import batches, column, map_batches, materialize
from tidemark.llm.tokens import SLICE_BYTES, token_bytes
from tidemark.llm.vectors import by_group

PIECES_AT_ONCE = 20_000      # pieces that one partition packs, about
ROUNDS = 4                   # exchanges at most
_END = (0).to_bytes(4, "little")


def pieces(docs: DataFrame, tokenizer: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a
    closing 0, cut only where longer than ``capacity``. A null text is empty."""
    data = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1, SLICE_BYTES):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(token_bytes(batch.column(1).to_pylist(), tokenizer)):
                ids += _END
                for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[s:s + 4 * capacity]
                    at.append(i)
                    piece.append(p)
                    start.append(s // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = data.schema["doc_id"].dataType.simpleString()
    return map_batches(data, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of sequences any packing of ``lengths`` needs, by two
    families of dual-feasible functions (and their sum of lengths itself).

    For a cut c below half the capacity: lengths over capacity - c fill a
    sequence alone, lengths below c count nothing, the others as they are. For a
    number k: a length x counts floor((k + 1) x / capacity) / k, or x / capacity
    where (k + 1) x divides evenly.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total = int((count * size).sum())
    best = -(-total // capacity)
    many, weight = np.cumsum(count), np.cumsum(count * size)
    for c in range(1, capacity // 2 + 1):
        alone = int(many[capacity] - many[capacity - c])
        between = int(weight[capacity - c] - weight[c - 1])
        best = max(best, alone - (-between // capacity))
    for k in range(1, 51):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)    # in units of 1 / (k capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece and the space left in each sequence.

    Longest first, each into the fullest sequence that still takes it; the
    sequences of each space are a stack, and one big integer marks which spaces
    have any, so the best fit is the lowest set bit from the length on.
    """
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, mask = [], 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = mask >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            own = bins[space].pop()
            if not bins[space]:
                mask &= ~(1 << space)
        else:
            own, space = len(spaces), capacity
            spaces.append(capacity)
        sequence[i], offset[i] = own, capacity - space
        left = space - need
        spaces[own] = left
        if left:
            bins[left].append(own)
            mask |= 1 << left
    return sequence, offset, np.array(spaces, np.int64)


def _pack(rows: DataFrame, capacity: int) -> DataFrame:
    """Pack each ``part``; adds sequence, offset, space (left in the sequence)
    and gap (sequences above the part's lower bound)."""
    ordered = rows.select("part", "row", "length").repartition("part").sortWithinPartitions("part", "row")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(stream, 1):
            lengths = group.column("length").to_numpy()
            sequence, offset, space = best_fit_decreasing(lengths, capacity)
            gap = len(space) - lower_bound(lengths, capacity)
            group = group.combine_chunks()
            yield from pa.Table.from_arrays(
                [*group.columns, pa.array(sequence), pa.array(offset), pa.array(space[sequence]),
                 pa.array(np.full(len(lengths), gap))],
                [*group.column_names, "sequence", "offset", "space", "gap"]).to_batches()

    return map_batches(ordered, run, "part long, row long, length long, sequence long, offset long, space long, gap long")


def _dealt(rows: DataFrame, count: int, turn: int) -> DataFrame:
    parts = max(1, -(-count // PIECES_AT_ONCE))
    return rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)).alias("part"))


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """``cut`` (a written table with ``row``, unique, and ``length`` <= capacity)
    with sequence_id and offset. No sequence holds more than ``capacity``.

    Pieces of the full capacity are sequences of their own. An unfilled
    sequence of a partition with a gap is opened again in the next round; a
    round that saves no sequence is the last one, and its result is dropped.
    """
    whole = cut.where(F.col("length") == capacity).select(
        "row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, turn = [whole], 0
    open_rows = cut.where(F.col("length") < capacity).select("row", "length")
    count = open_rows.count()
    before = None
    while count:
        packed = materialize(_pack(_dealt(open_rows, count, turn), capacity), "packing-round")
        # a part has far fewer than 2^20 sequences, as it has about PIECES_AT_ONCE pieces
        placed = packed.withColumn("sequence_id", F.lit(turn << 59) + F.shiftleft("part", 20) + F.col("sequence"))
        opened = placed.where("gap > 0 and space > 0")
        seen = packed.where("offset = 0").agg(
            F.count("*").alias("now"), F.count_if(F.expr("gap > 0 and space > 0")).alias("opened")).first()
        if before is not None and seen.now >= before[0]:
            done.append(before[1])                    # no better than what it was opened from
            break
        keep = placed.where("not (gap > 0 and space > 0)").select("row", "sequence_id", "offset")
        stay = opened.select("row", "sequence_id", "offset")
        done.append(keep)
        turn += 1
        if not seen.opened or turn > ROUNDS:
            done.append(stay)
            break
        before = (seen.opened, stay)
        open_rows = opened.select("row", "length")
        count = open_rows.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return cut.join(out, "row")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are pieces of one token. Repeated and null ids keep
    their rows. Other columns are not read.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, doc_id, text)
                      .withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
