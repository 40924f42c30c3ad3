"""Token ids of whole texts by a public tokenizer file, chunk by chunk.

The word tokenizer drops white space and never joins what stands on both sides
of it, so a text's ids are the ids of its blank-separated chunks in order.
Workers remember the ids of chunks they have met (a bounded number), which
saves most of the encoding. Chunks are cut at ASCII blanks and A-Z is
lower-cased first, as the tokenizer does itself; a chunk also ends between a
lower-case letter and an ASCII mark, where the tokenizer always ends a word.
Strings of special tokens get their own ids, as by default in the library, so a
text is first cut at them.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from tidemark.llm.shared import worker_state

# a task has one core; the library's own thread pool in every worker would only compete with the others
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

REMEMBERED = 500_000         # chunks a worker remembers at most, in two generations
SLICE_BYTES = 2 << 20        # text to encode at a time; the arrays of a slice are several times its size
_LONG = 64                   # bytes of a chunk that is not worth remembering
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")         # in UTF-8: a-z and U+00DF to U+00FF but U+00F7
# such a letter and an ASCII mark behind it (Arrow's syntax); an apostrophe may begin a word, so it is not cut off
_WORD_END = r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~])"
_JOINED = 1_000              # chunks of letters encoded as one text


class ChunkEncoder:
    """Encodes chunks with one tokenizer file; built once in a worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        # longest first; the groups keep the strings in what split() returns
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokenizer.encode_special_tokens = True      # what is left between special strings is ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # words of letters that the tokenizer leaves as they are need its model only, not its rules
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain = self._keeps_words()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}      # chunks met again move back to ``known``

    def _keeps_words(self) -> bool:
        """Whether the tokenizer leaves the letters of _WORD as they are and ends a
        word before a mark; a file with other rules encodes every chunk by them."""
        letters = [c for c in map(chr, range(256)) if _WORD.fullmatch(c.encode())]
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"]
        pairs = [("".join(letters), "".join(marks)), *((x, y) for x in letters for y in marks)]
        return self.words.encode(" ".join([f"{x} {y}" for x, y in pairs])).ids == self.tokenizer.encode(
            " ".join([x + y for x, y in pairs])).ids

    def _encode_joined(self, tokenizer: Tokenizer, chunks: list[bytes], into: dict[bytes, bytes]) -> list[bytes]:
        """Chunks of letters alone are one word each; they are encoded many at a
        time, as one text, and cut where a word ends. Returns those of texts in
        which the tokenizer sees more words than chunks."""
        rest = []
        joined = [chunks[at:at + _JOINED] for at in range(0, len(chunks), _JOINED)]
        encoded = tokenizer.encode_batch_fast([b" ".join(few).decode("utf-8", "replace") for few in joined],
                                              add_special_tokens=False)
        for few, found in zip(joined, encoded):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(few) and ends[-1] == len(ids):
                flat, cuts = ids.tobytes(), (4 * ends).tolist()
                into.update(zip(few, [flat[s:e] for s, e in zip([0, *cuts], cuts)]))
            else:
                rest += few
        return rest

    def _encode(self, chunks: list[bytes], into: dict[bytes, bytes]) -> None:
        """Chunks of letters alone many at a time, the others one by one."""
        letters, others = [], []
        for chunk in chunks:
            (letters if chunk.decode("utf-8", "replace").isalpha() else others).append(chunk)
        others += self._encode_joined(self.tokenizer, letters, into)
        for at in range(0, len(others), 20_000):
            few = others[at:at + 20_000]
            encoded = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in few], add_special_tokens=False)
            into.update((chunk, array("I", e.ids).tobytes()) for chunk, e in zip(few, encoded))

    def _ids_of(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not in ``known``."""
        older = self.older
        new = {c: older[c] for c in missing if c in older}
        words, others = [], []
        for chunk in missing:
            if chunk not in new:
                (words if self.plain and (chunk.isalpha() or _WORD.fullmatch(chunk)) else others).append(chunk)
        others += self._encode_joined(self.words, words, new)
        self._encode(others, new)
        return new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = {i: self.cut.split(t) for i, t in enumerate(texts) if t and any(x in t for x in self.special)}
        if not parts:
            return self._plain(texts)
        # special strings stand at the odd places of a text's parts
        whole = [None if i in parts else t for i, t in enumerate(texts)]
        out = self._plain(whole + [p for own in parts.values() for p in own[::2]])
        rest = iter(out[len(texts):])
        for i, own in parts.items():
            out[i] = b"".join([self.special[p] if n % 2 else next(rest) for n, p in enumerate(own)])
        return out[:len(texts)]

    def _plain(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts without special strings. Arrow cuts the texts and numbers their
        different chunks; the ids of those are then gathered in the order of the texts."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        lower = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
        if self.plain:
            lower = pc.replace_substring_regex(lower, _WORD_END, r"\1 \2")
        parts = pc.ascii_split_whitespace(lower)
        coded = parts.values.dictionary_encode()
        chunks = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, chunks))
        unknown = [i for i, own in enumerate(ids) if own is None]
        new = self._ids_of([chunks[i] for i in unknown])
        for i in unknown:
            ids[i] = new[chunks[i]]
        self.known.update(new)
        for c in new:
            if len(c) > _LONG:
                del self.known[c]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        counts = sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        place = np.repeat(starts[at] - ends[:-1], counts)
        place += np.arange(len(place))
        tokens = flat[place]
        cuts = ends[parts.offsets.to_numpy()].tolist()
        return [tokens[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, without
    special tokens around it; strings of special tokens in a text have their ids."""
    return worker_state(("tokens", path), lambda: ChunkEncoder(path)).encode(texts)
