"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label by concatenated random hashes (signs of
random projections, most significant first) and compares every vector with the
next ones in that order. Pairs at or above the threshold are united across passes.

A pass also tells how sure it is. Two vectors at the threshold agree in a hash bit
with a known probability r; a vector whose window ended at a neighbour with L equal
leading bits has met every other vector with more than L of them, so the pass finds
each of its links with probability r^(L+1) at least. Passes go on while many vectors
are left whose links may have been missed with more than ``MISS`` and that more
passes would decide. The vectors left then lie where the neighbourhood is so dense
that windows end too early; only these dense vectors are compared with their whole
label, in exact tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import column, map_batches, materialize
from tidemark.llm.vectors import by_group, matrix, usable

HASH_BITS = 63
MISS = 0.02              # probability of a missed link that makes a vector go on, and in the end compared exactly
TILE = 512               # vectors of a label on each side of one exact comparison, at least
TILE_VALUES = 1 << 18    # numbers in the vectors of a tile of over TILE vectors, at most
OPEN_SHARE = 0.1         # share of the vectors that a further pass must be able to decide; fewer are compared exactly
_CHUNK = 512
_UNKNOWN = HASH_BITS + 1     # leading bits of a window that a partition's border cut off: the pass tells nothing
_CUT = HASH_BITS + 2         # the window ended at a linked vector: the passes cannot tell all links


def _units(vectors: pa.Array) -> np.ndarray:
    m = matrix(vectors)
    m /= np.abs(m).max(axis=1, keepdims=True)          # keeps the squares finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position connected with each of ``n`` positions by links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _hash_keys(nodes: DataFrame, p: int, seed: int) -> DataFrame:
    """(label, size, key, node, vec): key holds the random hashes of the vector in pass ``p``."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)
        for batch in stream:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                m = matrix(part.column(3))
                if int(size) not in planes:
                    planes[int(size)] = np.random.default_rng([seed, p]).standard_normal((int(size), HASH_BITS))
                keys = (m @ planes[int(size)] > 0) @ powers
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(keys), part.column(0), part.column(3)],
                    ["label", "size", "key", "node", "vec"])

    kind = nodes.schema["vec"].dataType.simpleString()
    return map_batches(nodes.select("node", "label", "size", "vec"), run,
                       f"label long, size long, key long, node long, vec {kind}")


def _equal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits two arrays of hashes have in common."""
    apart = (a ^ b).astype(np.float64)
    return HASH_BITS - np.where(a == b, 0, np.frexp(apart)[1])


class _Run:
    """The vectors of one label in the order of a pass, as they arrive."""

    def __init__(self, first: bool, threshold: float, window: int):
        self.first, self.threshold, self.window = first, threshold, window
        self.ids, self.keys, self.units = np.empty(0, np.int64), np.empty(0, np.int64), None
        self.bits = np.empty(0, np.int64)                # what is known of the held vectors from what stands before them

    def add(self, ids: np.ndarray, keys: np.ndarray, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, w = len(self.ids), self.window
        self.ids, self.keys = np.concatenate([self.ids, ids]), np.concatenate([self.keys, keys])
        self.units = units if self.units is None else np.concatenate([self.units, units])
        # without a vector ``window`` places before, nothing is beyond, unless the partition begins there
        self.bits = np.concatenate([self.bits, np.full(len(ids), _UNKNOWN if self.first else -1)])
        i, j = np.nonzero(units @ self.units.T >= self.threshold)
        near = (i + held > j) & (i + held - j <= w)
        i, j = i[near] + held, j[near]
        far = np.arange(max(held, w), len(self.ids))     # vectors with one ``window`` places before
        equal = _equal_bits(self.keys[far], self.keys[far - w])
        at_end = i - j == w
        cut = np.zeros(len(self.ids), bool)
        cut[i[at_end]] = cut[j[at_end]] = True
        self.bits[far] = equal
        self.bits[cut] = _CUT
        done = max(0, len(self.ids) - w)                 # they have one ``window`` places behind as well
        forward = np.full(len(self.ids), -1)
        forward[far - w] = equal
        self.bits[:done] = np.maximum(self.bits[:done], forward[:done])
        both = (self.bits[i] == _CUT) & (self.bits[j] == _CUT)       # such pairs are counted exactly
        root = _roots(len(self.ids), i[both], j[both])
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield from _found(self.ids[i[~both]], self.ids[j[~both]], 0)
        yield from _found(self.ids[moved], self.ids[root[moved]], 1)
        yield from _told(self.ids[:done], self.bits[:done])
        self.ids, self.keys, self.units, self.bits = (x[done:] for x in (self.ids, self.keys, self.units, self.bits))

    def end(self, last: bool) -> Iterator[pa.RecordBatch]:
        yield from _told(self.ids, np.maximum(self.bits, _UNKNOWN if last else -1))


def _found(a: np.ndarray, b: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)),
                                          pa.nulls(len(a), pa.int64())], ["kind", "a", "b", "bits"])


def _told(node: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(node):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), 2)), pa.array(node), pa.nulls(len(node), pa.int64()),
                                          pa.array(bits.astype(np.int64))], ["kind", "a", "b", "bits"])


def _window_pass(nodes: DataFrame, p: int, threshold: float, window: int, seed: int) -> DataFrame:
    """One pass: (kind, a, b, bits). Kind 0 are links, kind 1 edges that span links
    between vectors whose windows are full of links, kind 2 tells for vector ``a``
    the leading bits it shares with the nearest vector beyond its window (-1: none)."""
    order = ["label", "size", "key", "node"]
    ranged = _hash_keys(nodes, p, seed).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held = None, None
        for batch in stream:
            if not batch.num_rows:
                continue
            labels = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1)
            cuts = np.flatnonzero((labels[1:] != labels[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if tuple(labels[s]) != label:
                    if held:
                        yield from held.end(False)
                    label, held = tuple(labels[s]), _Run(held is None, threshold, window)
                for at in range(s, e, _CHUNK):
                    part = batch.slice(at, min(_CHUNK, e - at))
                    yield from held.add(part.column(3).to_numpy(), part.column(2).to_numpy(), _units(part.column(4)))
        if held:
            yield from held.end(True)

    return map_batches(ranged.select(*order, "vec"), run, "kind long, a long, b long, bits long")


def _exact_links(nodes: DataFrame, dense: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """All links of ``dense`` (node), compared with every vector of their labels, as
    rows (a, b, links) of two kinds: how many rows of other vectors node ``a`` links
    with in one comparison (``b`` is null; for a vector that is not dense, of dense
    ones only), and edges (a, b) that join components of ``linked`` (``links`` is null).

    The dense vectors of a label are dealt over tiles, its vectors over chunks of
    the same size (m / 16 of them, at least TILE and at most TILE_VALUES numbers);
    every tile meets every chunk.
    """
    most = F.greatest(F.lit(TILE), F.floor(F.lit(TILE_VALUES) / F.col("size")))
    tile = F.least(most, F.greatest(F.lit(TILE), F.ceil(F.col("m") / 16)))
    marked = nodes.join(dense.withColumn("dense", F.lit(True)), "node", "left").join(linked, "node", "left") \
        .withColumn("dense", F.coalesce("dense", F.lit(False))).withColumn("root", F.coalesce("root", "node"))
    sizes = marked.groupBy("label", "size").agg(F.count("*").alias("m"), F.count_if("dense").alias("d")).where("d > 0") \
        .select("label", "size", F.ceil(F.col("m") / tile).alias("chunks"), F.ceil(F.col("d") / tile).alias("tiles"))
    placed = marked.join(sizes, ["label", "size"])
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    fields = ["label", "size", "tile", "chunk", "asks", "node", "n", "root", "dense", "vec"]
    asking = placed.where("dense").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).withColumn("chunk", upto("chunks")) \
        .withColumn("asks", F.lit(0).cast("long"))
    asked = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("tile", upto("tiles")) \
        .withColumn("asks", F.lit(1).cast("long"))
    keys = ["label", "size", "tile", "chunk"]
    dealt = asking.select(*fields).unionByName(asked.select(*fields)).repartition(*keys).sortWithinPartitions(*keys)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(stream, 4):
            asks = group.column("asks").to_numpy()
            node, n, units = group.column("node").to_numpy(), group.column("n").to_numpy(), _units(group.column("vec"))
            dense = group.column("dense").to_numpy()
            roots, part = np.unique(group.column("root").to_numpy(), return_inverse=True)
            joined = np.arange(len(roots))               # the smallest of the components joined with each
            links = np.zeros(len(node), np.int64)
            a, b = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
            others = units[b].T
            for at in range(0, len(a), _CHUNK):
                own = a[at:at + _CHUNK]
                near = units[own] @ others >= threshold
                near &= node[own][:, None] != node[b]
                if not near.any():
                    continue
                links[own] += (near @ n[b].astype(float)).astype(np.int64)   # sums of doubles are exact here
                links[b] += np.where(dense[b], 0, (n[own].astype(float) @ near).astype(np.int64))
                apart = near & (joined[part[own]][:, None] != joined[part[b]])
                if apart.any():
                    i, j = np.nonzero(apart)
                    joined = _roots(len(roots), joined[part[own[i]]], joined[part[b[j]]])[joined]
            some, moved = np.flatnonzero(links), np.flatnonzero(joined != np.arange(len(roots)))
            if len(some) or len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[some], roots[moved]])),
                     pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(roots[joined[moved]])]),
                     pa.concat_arrays([pa.array(links[some]), pa.nulls(len(moved), pa.int64())])], ["a", "b", "links"])

    return map_batches(dealt.select(*fields), run, "a long, b long, links long")


def _fingerprint(vec) -> list:
    """128 bits that name a vector; -0.0 and 0.0 are one number."""
    same = F.transform(vec, lambda x: x + F.lit(0).cast("float"))
    return [F.xxhash64(same).alias("h1"), F.xxhash64(F.lit(7), same).alias("h2")]


def _passes(nodes: DataFrame, threshold: float, passes: int, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(what the passes found and told, node and miss of every vector): passes
    go on while they still decide many vectors. The driver sees one row a pass."""
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    found = F.when(F.col("bits") == _UNKNOWN, 0.0).when(F.col("bits") < 0, 1.0).otherwise(F.pow(F.lit(agree), F.col("bits") + 1))
    # the logarithm of the probability that a link of the vector was missed; a cut window is never sure
    missed = F.when(F.col("bits") == _CUT, 1e6).otherwise(F.log(F.greatest(1 - found, F.lit(1e-9))))
    seen, told, rows = None, None, nodes
    for p in range(passes):
        now = materialize(_window_pass(rows, p, threshold, window, seed), "embedding-pass")
        seen = now if seen is None else seen.unionByName(now)
        told = seen.where("kind = 2").groupBy(F.col("a").alias("node")).agg(F.sum(missed).alias("missed"), F.count("*").alias("turns"))
        # as many passes again would not make them sure: dense
        going = (F.col("missed") > math.log(MISS)) & (F.col("missed") / F.col("turns") * passes <= math.log(MISS))
        left = told.agg(F.count("*").alias("all"), F.count_if(going).alias("going")).first()
        if p + 1 == passes or left.going <= OPEN_SHARE * left["all"]:
            break                                        # a few vectors meet their label exactly at the cost of a pass
        labels = nodes.join(told.where(going), "node").select("label", "size").distinct()
        rows = nodes.join(labels, ["label", "size"], "left_semi")
    return seen, told


def embedding_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                         label: str = "label", threshold: float = 0.98, passes: int = 12, window: int = 256,
                         seed: int = 20_011) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels (of any type) and equal length link at a
    cosine of at least ``threshold`` in double precision. n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable,
    kept says that it is the row's own. Links come from at most ``passes`` sorted
    passes of windows of ``window`` vectors; vectors that those may miss a link of
    with more than ``MISS`` are compared with their whole label. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without a
    label, have no links. Equal vectors of a label are compared once and counted as
    often as they occur; a repeated or null vec_id keeps a row each (a null id is no
    component's smallest unless all its ids are null). Other columns are not read.
    """
    rows = vectors.select(column(vectors, vec_id).alias("vec_id"), column(vectors, label).alias("of"),
                          column(vectors, embedding).alias("vec"))
    takes_part = rows.where(usable(F.col("vec")) & F.col("of").isNotNull())
    grouped = takes_part.groupBy("of", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    # a label is known by a hash of its value and type; the label itself takes part in the last join
    nodes = materialize(grouped.select(
        F.xxhash64("of").alias("label"), "of", "vec", "low", "n", F.size("vec").cast("long").alias("size"),
        *_fingerprint(F.col("vec")), F.monotonically_increasing_id().alias("node")), "embedding-nodes")
    seen, told = _passes(nodes, threshold, passes, window, seed)
    dense = materialize(told.where(F.col("missed") > math.log(MISS)).select("node"), "embedding-dense")
    linked = connected_components(seen.where("kind < 2").select("a", "b"), "a", "b", "embedding-links")
    pairs = seen.where("kind = 0").select("a", "b").distinct()
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = None
    if not dense.isEmpty():
        exact = materialize(_exact_links(nodes, dense, linked, threshold), "embedding-exact")
        missed = exact.where("b IS NOT NULL").select("a", "b")
        if not missed.isEmpty():
            linked = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))
                                          .unionByName(missed), "a", "b", "embedding-links")
        counted = exact.where("b IS NULL").select(F.col("a").alias("node"), "links")
        for side in ("a", "b"):                          # their links are all counted there
            sides = sides.join(dense.withColumnRenamed("node", side), side, "left_anti")
    own = sides.join(nodes.select(F.col("node").alias("b"), "n"), "b").select(F.col("a").alias("node"), F.col("n").alias("links"))
    counts = (own if counted is None else own.unionByName(counted)).groupBy("node").agg(F.sum("links").alias("links"))
    lows = linked.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"))
    placed = linked.join(lows, "root").select("node", "component_id")
    judged = nodes.select("node", "of", "h1", "h2", "low", "n").join(placed, "node", "left").join(counts, "node", "left").select(
        "of", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "low").alias("component_id"))
    named = rows.select("vec_id", "of", F.when(usable(F.col("vec")), F.col("vec")).alias("vec")) \
        .select("vec_id", "of", *_fingerprint(F.col("vec")), F.col("vec").isNotNull().alias("takes_part"))
    # rows that take no part have a key of their own, so they do not meet in one task
    key = F.when(F.col("takes_part"), F.col("h1")).otherwise(F.xxhash64("vec_id"))
    return named.withColumn("h1", key).join(judged.withColumn("takes_part", F.lit(True)), ["of", "h1", "h2", "takes_part"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.expr("vec_id <=> coalesce(component_id, vec_id)").alias("kept"))
