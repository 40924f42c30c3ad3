"""Approximate nearest neighbours by inner product: cross-polytope hashing.

Vectors are scaled by the largest norm and given one more component that makes
them unit vectors (queries are normalised and get 0 there), so the largest
inner product is the smallest angle. A table's hash is the nearest signed axis
after three rounds of random signs and fast Hadamard transforms. Rows lie in
one bucket of each table; a query probes the axes it is closest to, in order.
Candidates are ranked by the exact inner product of the original vectors.

How many axes to probe is measured: for ``SAMPLE`` of the queries the exact
nearest rows are found among all rows, and the depth that would have found
``target`` of them is used for every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import column, map_batches, materialize
from tidemark.llm.vectors import matrix, norm, runs, usable

TABLES = 12
BLOCK = 4096             # rows of a bucket that one task holds at once
SAMPLE = 64              # queries that the probe depth is measured on
_ROUNDS = 3
_ALL = -1                # stands for a table in which every row has one bucket


def _hadamard(m: np.ndarray) -> np.ndarray:
    n, width = m.shape
    step = 1
    while step < width:
        m = m.reshape(n, -1, 2, step)
        m = np.concatenate([m[:, :, :1] + m[:, :, 1:], m[:, :, :1] - m[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return m


def _rotated(units: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of one table, padded to a power of two."""
    width = 1 << max(1, (units.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (_ROUNDS, width))
    m = np.zeros((len(units), width))
    m[:, :units.shape[1]] = units
    for row in signs:
        m = _hadamard(m * row) / np.sqrt(width)
    return m


def _signed(rotated: np.ndarray, axis: np.ndarray) -> np.ndarray:
    return 2 * axis + (np.take_along_axis(rotated, axis, 1) < 0)


def _axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first. Beyond one sign of
    each axis, the other signs follow, least negative first."""
    width = rotated.shape[1]
    order = np.argsort(-np.abs(rotated), axis=1, kind="stable")
    near = _signed(rotated, order[:, :min(probes, width)])
    if probes <= width:
        return near
    return np.concatenate([near, _signed(rotated, order)[:, ::-1][:, :probes - width] ^ 1], axis=1)


def _row_units(m: np.ndarray, longest: float) -> np.ndarray:
    scaled = m / longest
    rest = np.sqrt(np.clip(1 - (scaled * scaled).sum(axis=1, keepdims=True), 0, None))
    return np.concatenate([scaled, rest], axis=1)


def _query_units(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return np.concatenate([scaled / np.linalg.norm(scaled, axis=1, keepdims=True), np.zeros((len(m), 1))], axis=1)


def _keyed(rows: DataFrame, is_query: bool, probes: int, longest: float, seed: int) -> DataFrame:
    """(tbl, axis, size, row, id, vec): the buckets that rows lie in, or queries probe."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tbl", "axis", "size", "row", "id", "vec"]
        for batch in stream:
            sizes = batch.column(0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for at in range(0, part.num_rows, 4096):
                    few = part.slice(at, 4096)
                    m = matrix(few.column(3))
                    units = _query_units(m) if is_query else _row_units(m, longest)
                    for table in range(TABLES):
                        axes = _axes(_rotated(units, table, seed), probes)
                        for k in range(axes.shape[1]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(m), table, np.int64)), pa.array(axes[:, k].astype(np.int64)),
                                 *few.columns], names)

    kind = rows.schema["vec"].dataType.simpleString()
    return map_batches(rows.select("size", "row", "id", "vec"), run,
                       f"tbl long, axis long, size long, row long, id {rows.schema['id'].dataType.simpleString()}, "
                       f"vec {kind}")


def _nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, row, id, score): the ``k`` nearest of each bucket
    block for the queries that probe it. Both sides carry tbl, axis, size.

    A bucket is dealt over blocks of about ``BLOCK`` rows and its queries go to
    each block. The list of buckets with more than one block is broadcast: it
    has at most one row for each table, axis and vector length.
    """
    bucket = ["tbl", "axis", "size"]
    blocks = F.broadcast(rows.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    held = rows.join(blocks, bucket, "left").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.coalesce("blocks", F.lit(1)))).withColumn("asks", F.lit(0).cast("long"))
    asked = queries.join(blocks, bucket, "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))) \
        .withColumn("asks", F.lit(1).cast("long"))
    key = [*bucket, "block"]
    dealt = held.unionByName(asked).select(*key, "asks", "row", "id", "vec").repartition(*key) \
        .sortWithinPartitions(*key, "asks")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_at, m = [], None, None                   # a block's rows; its queries come behind them, batch by batch
        for (*at, asks), part in runs(stream, 5):
            if not asks:
                if at != held_at:
                    held, held_at, m = [], at, None
                held.append(part)
                continue
            if held_at != at:
                continue                                    # a probed bucket without rows
            if m is None:
                block = pa.Table.from_batches(held)
                m, row, block_ids = matrix(block.column("vec")), block.column("row").to_numpy(), block.column("id").combine_chunks()
                order = block_ids.fill_null(np.iinfo(np.int64).max).to_numpy() if block_ids.null_count else block_ids.to_numpy()
            for start in range(0, part.num_rows, 256):
                few = part.slice(start, 256)
                scores = matrix(few.column("vec")) @ m.T
                own = few.column("row").to_numpy()
                scores[own[:, None] == row[None, :]] = -np.inf
                picked = [_nearest(s, order, k) for s in scores]
                count = [len(p) for p in picked]
                flat = np.concatenate(picked)
                asker = np.repeat(np.arange(len(picked)), count)
                value = scores[asker, flat]
                real = value > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[asker][real]), few.column("id").take(pa.array(asker[real])),
                     pa.array(row[flat][real]), block_ids.take(pa.array(flat[real])),
                     pa.array(value[real])], ["query_row", "query_id", "row", "id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(dealt, run, f"query_row long, query_id {kind}, row long, id {kind}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query over all its buckets, ranked."""
    once = found.groupBy("query_row", "row").agg(F.first("query_id").alias("query_id"), F.first("id").alias("id"),
                                                 F.max("score").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _everywhere(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(_ALL).cast("long").alias("tbl"), F.lit(0).cast("long").alias("axis"),
                       "size", "row", "id", "vec")


def probe_depth(rows: DataFrame, queries: DataFrame, k: int, target: float, longest: float, seed: int) -> int:
    """How many axes a query probes in each table so that ``target`` of the
    exact ``k`` nearest rows lie in a probed bucket, measured on ``SAMPLE``
    queries against all rows (in blocks). The driver gets SAMPLE * (k + 1) vectors."""
    asked = queries.orderBy(F.xxhash64("row")).limit(SAMPLE)
    asked = rows.sparkSession.createDataFrame(asked.collect(), queries.schema)
    exact = _best(_search(_everywhere(rows), _everywhere(asked), k), k).select("query_row", F.col("row").alias("near"))
    pairs = exact.join(rows.select(F.col("row").alias("near"), F.col("vec").alias("near_vec")), "near") \
        .join(asked.select(F.col("row").alias("query_row"), "vec"), "query_row").select("vec", "near_vec").collect()
    depths = []
    for pair in pairs:
        own = _query_units(np.array([pair.vec], float))
        near = _row_units(np.array([pair.near_vec], float), longest)
        ranks = []
        for table in range(TABLES):
            rotated = _rotated(own, table, seed)
            axes = _axes(rotated, 2 * rotated.shape[1])[0]
            ranks.append(int(np.flatnonzero(axes == _axes(_rotated(near, table, seed), 1)[0, 0])[0]) + 1)
        depths.append(min(ranks))
    return int(np.quantile(depths, target, method="higher")) if depths else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            target: float = 0.97, seed: int = 15_485_863) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows found nearest to
    each query (a row where ``is_query`` holds) by inner product, itself excluded.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors are compared with those of equal length only. Ties go
    to the smaller vec_id (null last). A repeated vec_id keeps a row each, also
    as a query. A query for which the probes found fewer than ``k`` rows is
    compared with all rows, so it gets all there are. Other columns are not
    read, except by ``is_query``.
    """
    rows = materialize(vectors.select(column(vectors, vec_id).alias("id"), column(vectors, embedding).alias("vec"),
                                      F.coalesce(is_query, F.lit(False)).alias("asks"))
                       .where(usable(F.col("vec")))
                       .select("id", "vec", "asks", F.size("vec").cast("long").alias("size"),
                               F.monotonically_increasing_id().alias("row")), "ann-rows")
    queries = rows.where("asks").select("size", "row", "id", "vec")
    longest = rows.agg(F.max(norm(F.col("vec")))).first()[0] or 1.0
    depth = probe_depth(rows.select("size", "row", "id", "vec"), queries, k, target, longest, seed)
    found = materialize(_best(_search(_keyed(rows, False, 1, longest, seed),
                                      _keyed(queries, True, depth, longest, seed), k), k), "ann-found")
    full = found.groupBy("query_row").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = materialize(queries.join(full, F.col("row") == F.col("query_row"), "left_anti"), "ann-short")
    rest = _best(_search(_everywhere(rows), _everywhere(short), k), k)
    return found.join(full, "query_row", "left_semi").unionByName(rest).select(
        F.col("query_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
