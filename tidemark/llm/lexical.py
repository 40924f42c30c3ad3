"""Ranked lexical search: accumulator-limited term-at-a-time over documents.

One scan of the texts writes, for every document, its length and the terms of
the query items that it holds (a forward table). The terms of an item are taken
rarest first, in slices of doubling size. In a slice, every document that holds
a term of the item has an accumulator. An item stops creating accumulators once
the upper bounds of its remaining terms add up to less than the k-th highest
partial score: no document without an accumulator can reach the list any more.
The last scan updates the surviving accumulators with all terms, exactly.

A document's terms stand in one row, so accumulators never move: a scan sends
only the k best of each batch of documents through a shuffle. Items are taken in
blocks of at most ``MAX_PAIRS`` (item, term) pairs; only a block's terms,
weights and stops are sent to the tasks.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.numbering import numbered
from tidemark.llm.shared import batches, column, map_batches, materialize, worker_state

MAX_PAIRS = 250_000        # (item, term) pairs of a block; one longer item is a block of its own
FIRST_SLICE = 2            # terms of the first slice of an item; each later slice is twice as long
SLICE_BYTES = 4_000_000    # text that a worker cuts into terms at a time
_EXPANDED = 2_000_000      # (document, item, term) places worked on at a time

# Fixed values of the score.
_SCALE, _TF, _M, _M_LENGTH = 1_000_000_000, 1000, 20, 50
_NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# every ASCII byte that is no letter or digit becomes a blank; A-Z is lower-cased
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included; none for null."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _NO_TERM), lambda t: t != "")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class _Block:
    """The items of a block and what is known of their terms (arrays by term or by item)."""
    items: list
    vocabulary: list[bytes]
    pair_item: np.ndarray           # item and term of each pair
    pair_term: np.ndarray


def _numbered_items(items: DataFrame, item_column: str, text_column: str) -> tuple[DataFrame, DataFrame, int]:
    """((item, term) pairs, items with ``place`` on a line on which an item takes a
    power of two of at least its number of terms, length of that line)."""
    pairs = materialize(items.select(column(items, item_column).alias("item"),
                                     F.explode(terms(column(items, text_column))).alias("term")).distinct(), "lexical-pairs")
    sized = pairs.groupBy("item").agg(F.count("*").alias("n")) \
        .withColumn("room", F.expr("cast(power(2, ceil(log2(n))) as long)"))
    rows, _ = numbered(sized.orderBy("room", F.col("item").asc_nulls_last()), "lexical-items")
    # at most 63 sizes
    sizes = rows.groupBy("room").agg(F.count("*").alias("n")).orderBy("room").collect()
    at, place, first = 0, F.lit(0).cast("long"), 0
    for size in sizes:
        place = F.when(F.col("room") == size.room, F.lit(at) + (F.col("row_number") - first) * size.room).otherwise(place)
        first, at = first + size.n, at + size.n * size.room
    return pairs, rows.select("item", place.alias("place")), at


def _block(pairs: DataFrame, places: DataFrame, number: int) -> _Block:
    here = places.where(F.expr(f"place div {MAX_PAIRS}") == number)
    found = pairs.join(here, pairs["item"].eqNullSafe(here["item"])) \
        .select(pairs["item"], "place", F.col("term").cast("binary").alias("term")).collect()    # MAX_PAIRS, or one item
    items = {r.place: r.item for r in sorted(found, key=lambda r: r.place)}
    index = {place: i for i, place in enumerate(items)}
    vocabulary = sorted({bytes(r.term) for r in found})
    term_id = {t: i for i, t in enumerate(vocabulary)}
    return _Block(list(items.values()), vocabulary, np.array([index[r.place] for r in found], np.int64),
                  np.array([term_id[bytes(r.term)] for r in found], np.int64))


def _forward(docs: DataFrame, block: _Block, id_column: str, text_column: str, name: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of terms
    and the terms of the block among them."""
    sent = docs.sparkSession.sparkContext.broadcast(block.vocabulary)
    key = ("lexical", uuid.uuid4().hex)      # workers outlive this table

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_id = worker_state(key, lambda: {t: i for i, t in enumerate(sent.value)})
        for batch in batches(stream, 1, SLICE_BYTES):
            rows, lengths, ids, tfs, cuts = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.translate(_TERM_BYTES).split() if text else ()
                if words:
                    held = [(term_id[t], n) for t, n in Counter(words).items() if t in term_id]
                    rows.append(i)
                    lengths.append(len(words))
                    ids += [t for t, _ in held]
                    tfs += [n for _, n in held]
                    cuts.append(len(ids))
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"])

    source = docs.select(column(docs, id_column).cast("long").alias("doc_id"),
                         column(docs, text_column).cast("binary").alias("text"))
    return materialize(map_batches(source, run, "doc_id long, n long, terms array<int>, tfs array<long>"), name)


@dataclass
class _Scan:
    """What a task needs to score documents: for each term its weight and the
    entries (item, place of the term in the item) at ``starts[term]:starts[term + 1]``."""
    starts: np.ndarray
    entry_item: np.ndarray
    entry_place: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int
    k: int


def _expand(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, ... (counts[i] of them), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(at, counts)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(values[order], firsts) if len(firsts) else np.zeros(0, np.int64)


def _scores(doc: np.ndarray, term: np.ndarray, part: np.ndarray, scan: _Scan, creates: np.ndarray, uses: np.ndarray):
    """(document, item, score): accumulators are created by the entries in
    ``creates`` and hold the sum over all entries in ``uses``."""
    counts = scan.starts[term + 1] - scan.starts[term]
    entry = _expand(scan.starts[term], counts)
    own, value = np.repeat(doc, counts), np.repeat(part, counts)
    n_items = int(scan.entry_item.max()) + 1
    key = own * n_items + scan.entry_item[entry]
    made = np.unique(key[creates[entry]])
    used = uses[entry]
    key, value = key[used], value[used]
    at = np.minimum(np.searchsorted(made, key), max(len(made) - 1, 0))
    kept = made[at] == key if len(made) else np.zeros(len(key), bool)
    keys, sums = _summed(key[kept], value[kept])
    return keys // n_items, keys % n_items, sums


def _best(scan: _Scan, creates: np.ndarray, uses: np.ndarray, forward: DataFrame) -> DataFrame:
    """(item, doc_id, score): of each batch of documents, every item's k best
    accumulators above 0 (highest first, then smallest doc_id, null last)."""
    sent = forward.sparkSession.sparkContext.broadcast((scan, creates, uses))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, creates, uses = sent.value
        per_term = np.diff(scan.starts)
        for batch in stream:
            lengths = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            if not lengths.sum():
                continue
            term = batch.column(2).flatten().to_numpy().astype(np.int64)
            tf = batch.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            m = 50 + (_M_LENGTH * batch.column(1).to_numpy() * scan.n_docs) // scan.n_terms
            part = scan.weights[term] * ((_SCALE * tf) // (_TF * tf + _M * m[doc]))
            done = np.cumsum(per_term[term])
            found, at = [], 0
            while at < len(term):      # whole documents, about _EXPANDED places at a time
                stop = np.searchsorted(done, (done[at - 1] if at else 0) + _EXPANDED, "right")
                stop = np.searchsorted(doc, doc[min(stop, len(term) - 1)], "left") if stop < len(term) else len(term)
                if stop <= at:
                    stop = np.searchsorted(doc, doc[at], "right")
                found.append(_scores(doc[at:stop], term[at:stop], part[at:stop], scan, creates, uses))
                at = stop
            own, item, score = (np.concatenate(c) for c in zip(*found))
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy()
            order = np.lexsort((number[own], ~known[own], -score, item))
            order = order[score[order] > 0]
            own, item, score = own[order], item[order], score[order]
            firsts = np.searchsorted(item, item, "left")
            top = np.arange(len(item)) - firsts < scan.k
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[top].astype(np.int32)), ids.take(pa.array(own[top])), pa.array(score[top])],
                names=["item", "doc_id", "score"])

    return map_batches(forward, run, "item int, doc_id long, score long")


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_ranks(spark: SparkSession, forward: DataFrame, block: _Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    held = forward.where(F.size("terms") > 0).select(
        (50 + F.expr(f"({_M_LENGTH} * n * {n_docs}) div {n_terms}")).alias("m"), F.inline(F.arrays_zip("terms", "tfs"))) \
        .groupBy("terms").agg(F.count("*").alias("df"),
                              F.max(F.expr(f"({_SCALE} * tfs) div ({_TF} * tfs + {_M} * m)")).alias("most"))
    known = held.collect()                      # one row per term of the block
    df, most = np.zeros(len(block.vocabulary), np.int64), np.zeros(len(block.vocabulary), np.int64)
    for r in known:
        df[r.terms], most[r.terms] = r.df, r.most
    weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)
    bounds = weights * most

    # each item's terms, rarest first, and what the terms from a place on can add at most
    alive = df[block.pair_term] > 0
    item, term = block.pair_item[alive], block.pair_term[alive]
    order = np.lexsort((term, df[term], item))
    item, term = item[order], term[order]
    if not len(item):
        return spark.createDataFrame([], "item int, doc_id long, score long, rank int")
    firsts = np.searchsorted(item, np.arange(len(block.items) + 1))
    place = np.arange(len(item)) - firsts[item]
    by_term = np.lexsort((item, term))
    scan = _Scan(np.searchsorted(term[by_term], np.arange(len(block.vocabulary) + 1)), item[by_term], place[by_term],
                 weights, n_docs, n_terms, k)
    n_places = np.diff(firsts)
    sums = np.concatenate([[0], np.cumsum(bounds[term])])
    stop = np.where(n_places > 0, -1, 0)        # terms that create accumulators; -1: not known yet
    taken = FIRST_SLICE
    while (stop < 0).any():
        done = np.minimum(taken, n_places)
        remaining = sums[firsts[1:]] - sums[firsts[:-1] + done]
        open_item = stop < 0
        inside = open_item[scan.entry_item] & (scan.entry_place < taken)
        kth = np.ones(len(block.items), np.int64)     # fewer than k accumulators: only a score of 0 is out of reach
        full = (done == n_places) & open_item
        if not full[open_item].all():
            partial = _ranked(_best(scan, inside, inside, forward), k).where(F.col("rank") == k)
            for r in partial.select("item", "score").collect():
                kth[r.item] = r.score
        ends = open_item & (full | (remaining < kth))
        stop[ends] = done[ends]
        taken += 2 * taken
    everything = np.ones(len(scan.entry_item), bool)
    return _ranked(_best(scan, scan.entry_place < stop[scan.entry_item], everything, forward), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text",
                   item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``k`` highest-scoring documents: ``item_id``, ``rank`` (from 1),
    ``doc_id``, ``score``; only scores above 0, equal scores by ascending ``doc_id``.

    Null and empty texts have no terms: such a document is not counted, such an
    item has no rows. Rows with one item id are one item with the terms of all of
    them, a null item id included. Repeated documents are documents each; a null
    ``doc_id`` stands behind all others of its score. Other columns are ignored.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_column].dataType
    pairs, places, length = _numbered_items(items, item_column, item_text)
    stats, out = None, None
    for number in range(-(-length // MAX_PAIRS)):
        block = _block(pairs, places, number)
        if not block.items:                       # an item longer than a block leaves places empty
            continue
        forward = _forward(docs, block, id_column, text_column, f"lexical-{number}")
        stats = stats or forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not stats.docs:
            break
        ranked = _block_ranks(spark, forward, block, stats.docs, stats.terms, k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.items)), "item int, item_id " + item_type.simpleString()))
        found = materialize(ranked.join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"),
                            f"lexical-ranks-{number}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id long, score long")
    return out
