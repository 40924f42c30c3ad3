"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by anchor points.

Fingerprints within ``max_bits`` of each other are found with a covering code.
The 64 bits are cut into equal segments; fingerprints that differ in at most
``max_bits`` bits differ in at most ``max_bits // segments`` bits on one of
them. On a segment of 2^m bits the anchors are the words of the perfect
Hamming code of its first 2^m - 1 bits with the last bit free: every segment
value lies within the covering radius 1 of an anchor, so two values within the
threshold share every anchor that is nearest to one of them once each is
replicated to all anchors within radius + threshold. ``segments=1`` is the
plain form over all 64 bits (about 10,000 anchors a fingerprint at 3 bits);
two segments need about 17 each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import batches, column, map_batches, materialize

BITS = 64
SEED = 42
COVERING_RADIUS = 1
# Fingerprints of one anchor compared in one piece; larger anchors are split exactly (see _links).
ANCHOR_BLOCK = 4096
# Groups up to this size are compared pair by pair, all groups of a batch at once.
PAIRWISE = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SHINGLES_AT_ONCE = 1 << 16

# Eight one-bit counters, one byte each, for every byte value: adding up to 255 of them cannot overflow.
_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).view(np.uint64).ravel()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    spread = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text; see ``fingerprints``."""
    if not text:
        return 0
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())   # bytes.lower: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = max(1, len(words) - shingle + 1)
    starts = starts[:total].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for i in range(0, total, _SHINGLES_AT_ONCE):
        chunk = [digest(joined[s:e], SEED) for s, e in zip(starts[i:i + _SHINGLES_AT_ONCE],
                                                           ends[i:i + _SHINGLES_AT_ONCE])]
        counts += _bit_counts(np.array(chunk, np.uint64))
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(rows: DataFrame, text: str, shingle: int = 3, keep_text: bool = False) -> DataFrame:
    """``rows`` with ``fp`` (the fingerprint as a signed long) as last column;
    without the text unless ``keep_text``. No column may be called ``fp``.

    A text is lower-cased (A-Z only) and cut into words at blanks; a bit of the
    fingerprint is set if it is set in over half of the XXH64 hashes (seed 42)
    of its ``shingle``-word shingles, repeats included. Fewer words form one
    shingle; no word (null, empty, blank) gives zero.
    """
    names = [c for c in rows.columns if c != text] + [text]
    data = rows.select(*[column(rows, c) for c in names])
    at = len(names) - 1
    kept = len(names) if keep_text else at

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, at, 16 << 20):
            values = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(values.view(np.int64))],
                                             [*batch.schema.names[:kept], "fp"])

    schema = data.select(*[column(data, c) for c in names[:kept]]).schema.add("fp", "long", False)
    return map_batches(data, run, schema)


def _patterns(length: int, weight: int) -> list[np.ndarray]:
    """For every syndrome of the Hamming code of 2^m - 1 bits (the segment's last
    bit is free): the bit patterns of at most ``weight`` bits that lead to a codeword."""
    coded = length - 1
    by_syndrome: dict[int, list[int]] = {s: [] for s in range(length)}
    for k in range(weight + 1):
        for places in combinations(range(coded), k):
            syndrome, mask = 0, 0
            for p in places:
                syndrome ^= p + 1
                mask |= 1 << p
            by_syndrome[syndrome].append(mask)
            if k < weight:                       # the free bit uses up one of the distance
                by_syndrome[syndrome].append(mask | 1 << coded)
    return [np.array(by_syndrome[s], np.uint64) for s in range(length)]


def anchors(fps: np.ndarray, segment: int, segments: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, anchor) for all anchors of one segment that lie
    within covering radius + threshold of a fingerprint."""
    length = BITS // segments
    patterns = _patterns(length, COVERING_RADIUS + max_bits // segments)
    value = (fps >> np.uint64(segment * length)) & np.uint64((1 << length) - 1)
    syndrome = np.zeros(len(fps), np.int64)
    for p in range(length - 1):
        syndrome ^= np.where((value >> np.uint64(p)) & np.uint64(1), p + 1, 0)
    at, out = [], []
    for s, masks in enumerate(patterns):
        here = np.flatnonzero(syndrome == s)
        at.append(np.repeat(here, len(masks)))
        out.append((value[here][:, None] ^ masks[None, :]).ravel())
    return np.concatenate(at), np.concatenate(out)


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (member, representative) of the groups that the links within ``fps`` form."""
    left = np.ones(len(fps), bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            rest = np.flatnonzero(left)
            if not len(rest):
                return edges
            near = rest[np.bitwise_count(fps[rest] ^ fps[front.pop()]) <= max_bits]
            left[near] = False
            front.extend(near.tolist())
            edges.extend((int(fps[i]), int(fps[root])) for i in near)
    return edges


def _group_edges(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Edges of all groups of one sorted batch: pairs for small groups, a spanning forest for others."""
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    starts = np.concatenate(([0], cuts))
    sizes = np.diff(np.append(starts, len(fps)))
    found = []
    small = np.repeat(sizes <= PAIRWISE, sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    for lag in range(1, PAIRWISE):
        pair = small[lag:] & (group[lag:] == group[:-lag])
        if not pair.any():
            break
        at = np.flatnonzero(pair)
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= max_bits]
        found.append(np.stack([fps[at], fps[at + lag]], axis=1))
    for g in np.flatnonzero(sizes > PAIRWISE):
        edges = _forest(np.unique(fps[starts[g]:starts[g] + sizes[g]]), max_bits)
        found.append(np.array(edges, np.uint64).reshape(-1, 2))
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def _compare(groups: DataFrame, max_bits: int) -> DataFrame:
    """Edges that connect each group's linked fingerprints; input (group
    columns..., fp) comes sorted by group. Holds one batch and one group."""
    at = len(groups.columns) - 1

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty((0, at), np.int64), np.empty(0, np.uint64)
        for batch in stream:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([batch.column(i).to_numpy(zero_copy_only=False)
                                                   for i in range(at)], axis=1)])
            fps = np.concatenate([fps, batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])    # this group may go on
            if last:
                yield _edge_batch(_group_edges(keys[:last], fps[:last], max_bits))
                keys, fps = keys[last:], fps[last:]
        if len(fps):
            yield _edge_batch(_group_edges(keys, fps, max_bits))

    return map_batches(groups, run, "a long, b long")


def _edge_batch(edges: np.ndarray) -> pa.RecordBatch:
    values = np.ascontiguousarray(edges).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1])], ["a", "b"])


def _links(distinct_fps: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints the bit distance connects.

    Anchors are counted by a map-side combined aggregate. Those of at most
    ``ANCHOR_BLOCK`` fingerprints are compared as they are (a window over those few
    drops anchors of a single one). Of a larger one, which
    nearly fixes its own segment, each other segment is cut into ``max_bits + 1``
    slices, of which two linked fingerprints share at least one, and the
    fingerprints are dealt by the values of those.
    """
    def replicate(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                part = fps[i:i + 4096]
                for s in range(segments):
                    at, anchor = anchors(part, s, segments, max_bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), s, np.int64)), pa.array(anchor.view(np.int64)),
                         pa.array(part[at].view(np.int64))], ["segment", "anchor", "fp"])

    dealt = map_batches(distinct_fps.select("fp"), replicate, "segment long, anchor long, fp long")
    sizes = dealt.groupBy("segment", "anchor").agg(F.count("*").alias("n"))
    crowded = materialize(sizes.where(f"n > {ANCHOR_BLOCK}").select("segment", "anchor"), "simhash-crowded")
    shared = dealt.join(crowded, ["segment", "anchor"], "left_anti") \
        .withColumn("n", F.expr("count(*) over (partition by segment, anchor)")).where("n > 1")
    small = _compare(shared.select("segment", "anchor", "fp"), max_bits)
    slices, length = max_bits + 1, BITS // segments
    places = [(s, i, lo, min(lo + -(-length // slices), length)) for s in range(segments)
              for i, lo in enumerate(range(0, length, -(-length // slices)))]
    cut = F.array(*[F.struct(F.lit(s).cast("long").alias("of"), F.lit(i).cast("long").alias("slice"), F.expr(
        f"shiftrightunsigned(fp, {s * length + lo}) & {(1 << (hi - lo)) - 1}L").alias("value")) for s, i, lo, hi in places])
    keys = ["segment", "anchor", "of", "slice", "value"]
    large = dealt.join(crowded, ["segment", "anchor"], "left_semi").select("segment", "anchor", "fp", F.inline(cut)) \
        .where(F.lit(segments == 1) | (F.col("of") != F.col("segment"))) \
        .select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return small.unionByName(_compare(large, max_bits))


def near_duplicates(marked: DataFrame, doc_id: str, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct ``fp`` of ``marked``
    (a written table with the columns ``doc_id`` and ``fp``).

    Two fingerprints link at ``max_bits`` or fewer differing bits; component_id
    is the smallest doc_id reachable (null if all of the group's ids are null),
    root the smallest fingerprint of the group. Equal fingerprints are one row
    here, so copies are never expanded.
    """
    distinct_fps = materialize(marked.groupBy("fp").agg(F.min(column(marked, doc_id)).alias("low")), "simhash-fps")
    linked = connected_components(_links(distinct_fps, max_bits, segments), "a", "b", "simhash-links")
    rooted = distinct_fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.select("fp", "root").join(lows, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                       max_bits: int = 3, segments: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Repeated rows and null ids keep a row each. Other columns are not read.
    """
    ids = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    marked = materialize(fingerprints(ids, "text", shingle), "simhash-docs")
    groups = near_duplicates(marked, "doc_id", max_bits, segments).select("fp", "component_id")
    return marked.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                         max_bits: int = 3, segments: int = 2) -> DataFrame:
    """The documents with one of each near-duplicate group, all columns as they came.

    The document with the smallest id stays (a null id comes last; the first
    row of those that repeat an id).
    """
    names = docs.columns
    at = names.index(text)
    carried = docs.select(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(names)],
                          column(docs, doc_id).alias("k_id"), F.monotonically_increasing_id().alias("k_row"))
    marked = materialize(fingerprints(carried, f"c{at}", shingle, keep_text=True), "simhash-rows")
    groups = near_duplicates(marked, "k_id", max_bits, segments).select("fp", "root")
    order = F.struct(F.col("k_id").isNull().alias("n"), F.col("k_id").alias("i"), F.col("k_row").alias("r"))
    best = marked.groupBy("fp").agg(F.min(order).alias("best")).join(groups, "fp") \
        .groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r").alias("k_row"))
    return marked.join(best, "k_row", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
