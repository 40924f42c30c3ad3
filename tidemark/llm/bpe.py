"""Byte-level BPE: encode whole texts to ids, decode ids to bytes.

Texts are cut into words by the tokenizer's pattern. Words repeat, so the
merges of each distinct word are folded once in a batch of documents and
remembered (a bounded number) by the worker. The fold runs over all new words
together, as a matrix of their bytes' ids: a step merges, in every word, the
leftmost adjacent pair of lowest rank, until no pair has a rank. Ranks come
from a literal rank map. Decoding concatenates the binary pieces of the ids.
Nothing is shuffled, and no vocabulary of the corpus is kept anywhere.

The fold was first written with Spark's higher-order functions over the same
arrays; see the README for its figures.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.shared import batches, column, map_batches, worker_state

REMEMBERED = 400_000         # words a worker remembers at most
_ROWS_AT_ONCE = 256          # documents of one output batch of decoding
_WORDS_AT_ONCE = 8_192       # words of one matrix
_LONG = 64                   # bytes of a word that is folded alone and not remembered
_IDS = 1 << 16               # ids are below this, so a pair of ids fits one long
_NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def rank_map(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, entries): the pair (a, b) has rank r if entries[places[a] + b]
    is a * 2^16 + r. Rows of the sparse pair matrix are laid over each other
    where they leave room (fullest row first, places tried at random)."""
    followers: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                followers.setdefault(a, []).append((b, rank))
    top = max(ranks.values()) + 1
    room = 3 * sum(map(len, followers.values()))
    places = np.zeros(top, np.int64)
    entries = np.full(room + top, -1, np.int64)
    tries = np.random.default_rng(0)
    for a, row in sorted(followers.items(), key=lambda x: -len(x[1])):
        after, value = np.array([b for b, _ in row]), a * _IDS + np.array([r for _, r in row])
        fits = np.empty(0, np.int64)
        while not len(fits):
            at = tries.integers(0, room, 256)
            fits = at[(entries[at[:, None] + after] < 0).all(axis=1)]
        places[a] = fits[0]
        entries[fits[0] + after] = value
    return places, entries


class Encoder:
    """Encodes words with one rank file and pattern; built once in a worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.places, self.entries = rank_map(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.words = regex.compile(pattern).findall
        # on ASCII texts the character classes are plain ranges, which the standard library matches faster
        plain = re.sub(r"\\p\{(L|N)\}\+", lambda m: {"L": "[A-Za-z]+", "N": "[0-9]+"}[m[1]], pattern) \
            .replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")
        self.ascii_words = None if r"\p" in plain else re.compile(plain, re.ASCII).findall
        self.known: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); none where either is negative."""
        entry = self.entries[self.places[a] + b]
        return np.where((entry >> 16 == a) & (a >= 0) & (b >= 0), entry & (_IDS - 1), _NONE)

    def _fold(self, words: tuple[bytes, ...]) -> list[bytes]:
        """Merge all pairs of words of at most ``_LONG`` bytes; their ids as 32-bit numbers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max()) + 1
        ids = np.full((len(words), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(ids.shape, _NONE)
        ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        todo, places = np.arange(len(words)), np.arange(width)
        while len(todo):
            at = ranks[todo].argmin(axis=1)
            low = ranks[todo, at]
            some = low < _NONE
            todo, at, low = todo[some], at[some], low[some]
            if not len(todo):
                break
            own, line = ids[todo], np.arange(len(todo))
            own[line, at] = low
            moved = np.minimum(places + (places > at[:, None]), width - 1)       # the last place is always empty
            own = np.take_along_axis(own, moved, 1)
            new = np.take_along_axis(ranks[todo], moved, 1)
            new[line, at] = self._rank(low, own[line, at + 1])
            before = np.maximum(at - 1, 0)
            new[line, before] = np.where(at > 0, self._rank(own[line, before], low), new[line, before])
            ids[todo], ranks[todo] = own, new
        flat = ids[ids >= 0].astype(np.int32).tobytes()
        ends = (4 * np.cumsum((ids >= 0).sum(axis=1))).tolist()
        return [flat[s:e] for s, e in zip([0, *ends], ends)]

    def _fold_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, with a heap of its pairs."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int, j: int) -> int:
            entry = int(self.entries[self.places[ids[i]] + ids[j]])
            return entry & (_IDS - 1) if entry >> 16 == ids[i] else -1

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(i, i + 1)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue                                     # one of the two was merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := pair(i, after[i])) >= 0:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := pair(before[i], i)) >= 0:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit numbers; a null text has none."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, alone = self.known, {}
        cut = []
        for text in texts:
            find = self.ascii_words if self.ascii_words and (text or "").isascii() else self.words
            cut.append(find(text or ""))
        missing = set().union(*cut).difference(known)
        fold = []
        for word in missing:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known[word] = np.int32(rank).tobytes()
            elif len(raw) > _LONG:
                alone[word] = self._fold_long(raw).astype(np.int32).tobytes()
            else:
                fold.append((len(raw), raw, word))
        fold.sort()
        for i in range(0, len(fold), _WORDS_AT_ONCE):
            _, raw, words = zip(*fold[i:i + _WORDS_AT_ONCE])
            known.update(zip(words, self._fold(raw)))
        if alone:
            return [b"".join([alone[w] if w in alone else known[w] for w in words]) for words in cut]
        return [b"".join([known[w] for w in words]) for words in cut]


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int). Null and empty texts
    have no ids; repeated and null ids keep a row each. Other columns are not
    read. Ids stay below 2^16."""
    data = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_state(("bpe", ranks), dict)        # one for both directions, as a worker may serve either
        encoder = held.get(pattern) or held.setdefault(pattern, Encoder(ranks, pattern))
        for batch in batches(stream, 1, 4 << 20):
            ids = encoder.encode(batch.column(1).to_pylist())
            starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts), flat)],
                                             ["doc_id", "ids"])

    return map_batches(data, run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _pieces(ranks: str) -> list[bytes]:
    table = read_ranks(ranks)
    out = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        out[rank] = piece
    return out


def decode(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids, as last column. Null
    ids give null, an empty array no bytes."""
    at = encoded.columns.index(ids)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_state(("bpe", ranks), dict)
        pieces = held.get(None) or held.setdefault(None, _pieces(ranks))
        for whole in stream:
            for start in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(start, _ROWS_AT_ONCE)
                lists = batch.column(at)
                texts = [b"".join([pieces[i] for i in x.values.to_pylist()]) if x.is_valid else None for x in lists]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())],
                                                 [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_batches(encoded, run, f"{kinds}, decoded binary")
