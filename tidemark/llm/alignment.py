"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text with a blank before it is encoded by a byte-level tokenizer (A) and by a
piece tokenizer (B, which adds that blank itself). Byte offsets where tokens of
both end are found as the intersection of two dictionaries from cumulative end
to token index; the sorted common ends cut both id lists into groups, and each
group is expanded into its links (overlapping token pairs).

Neither tokenizer joins a blank to the character before it (A cuts its words
there, no piece of B holds a blank behind another character; the vocabulary is
checked), so the start of a run of blanks behind a visible character is always
a common end. So is the start of a run of white space that begins with a line
feed, and the place between a letter and a full stop, comma or the like (both are
checked too). Texts are cut at blanks; chunks that a worker has not met are cut at
those places as well, what is new of them is put together into one text, aligned as
above and remembered (a bounded number).

Links are counted corpus-wide in two steps: the pairs that hold at least
1 / ``HOT`` of all links (so ``HOT`` at most) go to every task, all others are
joined by shuffle on the pair, of which none is then a hot key.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm.shared import batches, column, map_batches, materialize, worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

HOT = 65_536                 # pairs that are sent to every task at most
SLICE_BYTES = 3_000_000      # text that a worker aligns at a time
_TOGETHER = 65_536           # characters of unmet chunks aligned as one text
_REMEMBERED = 400_000        # chunks a worker remembers at most, in two generations
_LONG = 64                   # characters of a chunk that is not worth remembering
_CUT = re.compile(r"(?<=\S)(?= )")
_UNEVEN = re.compile(r"\s ")
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_PARTS = re.compile(rf"(?<=\S)(?=\n)|(?<={_LETTER})(?=[.,!?;:]+(?:\n|$))")
_BLANK_PIECE = "▁"
_BEFORE = " a"               # stands before a part that no text can start with

SCHEMA = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
          "pairs array<long>, pair_links array<int>")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself where it is visible in Latin-1, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _chunks(text: str) -> list[str]:
    """``text`` (which starts with a blank) cut where a run of blanks follows a
    visible character; blanks at the end stay with the chunk before them."""
    if not _UNEVEN.search(text) and text[-1] != " ":
        return [" " + word for word in text[1:].split(" ")]
    found = _CUT.split(text)
    if len(found) > 1 and not found[-1].strip(" "):
        found[-2:] = [found[-2] + found[-1]]
    return found


class Aligner:
    """Two tokenizers and the chunks met so far; built once in a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_symbols()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, piece))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_BLANK_PIECE, " ").encode()
                        for i, p in enumerate(pieces)]
        if any(_BLANK_PIECE in p.lstrip(_BLANK_PIECE) for p in pieces):
            raise ValueError("a piece holds a blank behind another character: texts cannot be cut at blanks")
        if any("\n" in p or re.search(_LETTER + "[.,!?;:]", p) for i, p in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError("a piece joins a letter and what ends a word: chunks cannot be cut there")
        self.lengths_a, self.lengths_b = (np.array(list(map(len, held)), np.int64) for held in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B, or None where the joined bytes of either are not the text."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1)
        whole = text.encode("utf-8")
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        return a, b

    def align(self, text: str, ends: list[int]) -> list[tuple] | None:
        """One (n_a, n_groups, groups, links) for each stretch of ``text`` that ends
        at one of ``ends`` (byte offsets, the last one the text's), or None where the
        text has no tokens."""
        ids = self._ids(text)
        if ids is None:
            return None
        a, b = (np.array(i, np.int64) for i in ids)
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        index_a = dict(zip(ends_a.tolist(), range(1, len(a) + 1)))
        index_b = dict(zip(ends_b.tolist(), range(1, len(b) + 1)))
        common = sorted(index_a.keys() & index_b.keys())
        cuts_a, cuts_b = [index_a[e] for e in common], [index_b[e] for e in common]
        said_a, said_b = list(map(str, ids[0])), list(map(str, ids[1]))
        groups = [said_a[i] + "|" + said_b[j] if p - i == 1 and q - j == 1
                  else ",".join(said_a[i:p]) + "|" + ",".join(said_b[j:q])
                  for i, p, j, q in zip([0, *cuts_a], cuts_a, [0, *cuts_b], cuts_b)]
        # inside a slice each end of either side closes one link: that of the two tokens before it
        every = np.union1d(ends_a, ends_b)
        links = (a[np.searchsorted(ends_a, every)] * self.width + b[np.searchsorted(ends_b, every)]).tobytes()
        link_ends = (8 * np.searchsorted(every, np.array(common, np.int64), "right")).tolist()
        group_at = dict(zip(common, range(1, len(common) + 1)))
        out, g, n_a, n_links = [], 0, 0, 0
        for end in ends:
            stop = group_at[end]
            p, last = cuts_a[stop - 1], link_ends[stop - 1]
            out.append((p - n_a, stop - g, ";".join(groups[g:stop]), links[n_links:last]))
            g, n_a, n_links = stop, p, last
        return out

    def _alone(self, part: str) -> tuple | None:
        before = "" if part[0] == " " else _BEFORE
        found = self.align(before + part, ([len(before)] if before else []) + [len((before + part).encode())])
        return found and found[-1]

    def _learn(self, parts: list[str]) -> None:
        """Remember parts aligned many at a time; None for one without tokens of its own."""
        known = self.known
        even = [p for p in parts if p[0] in " \n" and not p[-1].isspace() and _BLANK_PIECE not in p]
        known.update((p, self._alone(p)) for p in set(parts).difference(even))
        at = 0
        while at < len(even):
            size, stop = 0, at
            while stop < len(even) and (stop == at or size + len(even[stop]) <= _TOGETHER):
                size += len(even[stop])
                stop += 1
            few = even[at:stop]
            found = self.align(_BEFORE + "".join(few), np.cumsum([len(_BEFORE), *(len(p.encode()) for p in few)]).tolist())
            known.update(zip(few, found[1:] if found else map(self._alone, few)))
            at = stop

    def _meet(self, chunks: set[str]) -> None:
        """Remember chunks, each from its parts."""
        known, older = self.known, self.older
        parts = {c: _PARTS.split(c) for c in chunks}
        new = {p for own in parts.values() for p in own if p not in known}
        known.update((p, older[p]) for p in new if p in older)
        self._learn([p for p in new if p not in known])
        for c, own in parts.items():
            if len(own) > 1:
                found = [known[p] for p in own]
                if None in found:
                    known[c] = None
                else:
                    n_a, n_groups, groups, links = zip(*found)
                    known[c] = sum(n_a), sum(n_groups), ";".join(groups), b"".join(links)

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, links) of each text; zeros where it has no
        tokens. Arrow cuts most texts and numbers their different chunks; what those
        hold is then gathered in the order of the texts."""
        if len(self.known) > _REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        even = [i for i, t in enumerate(texts) if t and t[-1] != " " and not _UNEVEN.search(" " + t)]
        words = pc.split_pattern(pa.array([texts[i] for i in even], pa.string()), " ")
        coded = words.values.dictionary_encode()
        met = [" " + w for w in coded.dictionary.to_pylist()]
        odd = {i: _chunks(" " + t) for i, t in enumerate(texts) if t and i not in set(even)}
        missing = set(chain(met, *odd.values())).difference(known)
        known.update((c, older[c]) for c in missing if c in older)
        self._meet(missing.difference(known))
        out: list[tuple] = [(0, 0, 0, "", np.zeros(0, np.int64))] * len(texts)
        for i, chunks in odd.items():
            found = list(map(known.__getitem__, chunks))
            if None not in found:
                n_a, n_groups, groups, links = zip(*found)
                out[i] = self._document(sum(n_a), sum(n_groups), ";".join(groups), np.frombuffer(b"".join(links), np.int64))
            else:
                out[i] = self._whole(texts[i])
        if even:
            found = [known[c] or (-1, 0, "", b"") for c in met]
            n_a, n_groups, groups, links = zip(*found)
            n_a, n_groups = np.array(n_a), np.array(n_groups)
            sizes = np.fromiter(map(len, links), np.int64, len(links)) // 8
            flat, starts = np.frombuffer(b"".join(links), np.int64), np.cumsum(sizes) - sizes
            at, cuts = coded.indices.to_numpy(), words.offsets.to_numpy()
            own = sizes[at]
            ends = np.concatenate([[0], np.cumsum(own)])
            links = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], own)]
            said = pc.binary_join(pa.ListArray.from_arrays(words.offsets, pa.array(groups, pa.string()).take(coded.indices)), ";")
            bad = np.add.reduceat(n_a[at] < 0, cuts[:-1])
            a, g = np.add.reduceat(n_a[at], cuts[:-1]).tolist(), np.add.reduceat(n_groups[at], cuts[:-1]).tolist()
            span = ends[cuts].tolist()
            for n, (i, text) in enumerate(zip(even, said.to_pylist())):
                out[i] = self._whole(texts[i]) if bad[n] else self._document(a[n], g[n], text, links[span[n]:span[n + 1]])
        for c in missing:
            if len(c) > _LONG:
                del known[c]
        return out

    @staticmethod
    def _document(n_a: int, n_groups: int, groups: str, links: np.ndarray) -> tuple:
        return n_a, len(links) + n_groups - n_a, n_groups, groups, links        # a group has a + b - 1 links

    def _whole(self, text: str) -> tuple:
        """A text that a chunk without tokens of its own does not settle, aligned at once."""
        found = self.align(" " + text, [len(text.encode()) + 1])
        if found is None:
            return 0, 0, 0, "", np.zeros(0, np.int64)
        n_a, n_groups, groups, links = found[0]
        return self._document(n_a, n_groups, groups, np.frombuffer(links, np.int64))


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of every document, lazily: ``row`` (a number of its own),
    ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (decimal ids
    of A and B, ``a1,a2|b1;a3|b2,b3``) and the different links as ``pairs``
    (A id x vocabulary of B + B id) with their numbers ``pair_links``.

    ``path_a`` is a byte-level file of the tokenizers library, ``path_b`` a
    sentencepiece model. Strings of special tokens are plain text. Texts that are
    null or empty, or whose tokens do not join to the text, have no tokens: zeros
    and ''. Repeated rows stay; a null ``doc_id`` stays null; other columns are ignored.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"),
                         column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_state(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches(stream, 2, SLICE_BYTES):
            counts, groups, pairs, numbers = [], [], [], []
            for n_a, n_b, n_groups, text, links in aligner.documents(batch.column(2).to_pylist()):
                own, n = np.unique(links, return_counts=True)
                counts.append((n_a, n_b, n_groups, len(links)))
                groups.append(text)
                pairs.append(own)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*counts)),
                 pa.array(groups, pa.string()), _list_array(pairs, pa.int64()), _list_array(numbers, pa.int32())],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"])

    return map_batches(source, run, SCHEMA)


def link_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, links, best): how many links hold each id pair corpus-wide, and
    whether no other pair with its B id holds more. ``width`` is the vocabulary size of B."""
    counts = materialize(aligned.select(F.inline(F.arrays_zip("pairs", "pair_links"))).groupBy("pairs").agg(
        F.sum("pair_links").alias("links")).withColumnRenamed("pairs", "pair"), "align-counts")
    # one row per id of B, so the broadcast is bounded by its vocabulary
    most = F.broadcast(counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("links").alias("most")))
    return counts.join(most, counts.pair % width == most.b).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def with_link_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (a written table of :func:`alignments`) with ``n_best`` (links
    whose count is the highest of their B id) and ``count_sum`` (counts over the links)."""
    spark = aligned.sparkSession
    total = counts.agg(F.sum("links")).first()[0] or 0
    hot = counts.where(F.col("links") * HOT >= total).toPandas().sort_values("pair")   # HOT rows at most
    sent = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["links"].to_numpy(np.int64),
                                         hot["best"].to_numpy(bool)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_pairs, hot_links, hot_best = sent.value
        for batch in stream:
            pairs, numbers = batch.column(1), batch.column(2)
            lengths = np.diff(pairs.offsets.to_numpy())
            flat = pairs.flatten().to_numpy(zero_copy_only=False)
            many = numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(hot_pairs, flat), max(len(hot_pairs) - 1, 0))
            here = hot_pairs[at] == flat if len(hot_pairs) else np.zeros(len(flat), bool)
            sums, best = np.zeros(len(flat) + 1, np.int64), np.zeros(len(flat) + 1, np.int64)
            if len(hot_pairs):
                np.cumsum(np.where(here, many * hot_links[at], 0), out=sums[1:])
                np.cumsum(np.where(here & hot_best[at], many, 0), out=best[1:])
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(lengths)), lengths)[~here]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums[ends] - sums[ends - lengths]), pa.array(best[ends] - best[ends - lengths]),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat[~here])),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(many[~here]))],
                names=["row", "count_sum", "n_best", "rest", "rest_links"])

    cut = materialize(map_batches(aligned.select("row", "pairs", "pair_links"), run,
                                  "row long, count_sum long, n_best long, rest array<long>, rest_links array<long>"),
                      "align-hot")
    rest = cut.select("row", F.inline(F.arrays_zip("rest", "rest_links"))).join(counts, F.col("rest") == F.col("pair")) \
        .select("row", (F.col("rest_links") * F.col("links")).alias("count_sum"),
                F.when(F.col("best"), F.col("rest_links")).otherwise(0).alias("n_best"))
    sums = cut.select("row", "count_sum", "n_best").unionByName(rest).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "pair_links").join(sums, "row").drop("row")


def align_documents(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """Every document's alignment with its corpus-wide counts: ``doc_id``, ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``groups`` (with ``digest``: ``groups_sha256`` in its
    place, '' without tokens), ``n_best``, ``count_sum``. An empty table gives no rows;
    for other odd rows see :func:`alignments`."""
    found = alignments(docs, path_a, path_b)
    if digest:
        hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
        found = found.withColumn("groups", hashed).withColumnRenamed("groups", "groups_sha256")
    aligned = materialize(found, "align")
    width = SentencePieceProcessor(model_file=path_b).get_piece_size()
    return with_link_counts(aligned, materialize(link_counts(aligned, width), "align-values"))
