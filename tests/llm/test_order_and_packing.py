import os
import random
import zlib
from glob import glob

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens
from tidemark.llm.feistel import permuted
from tidemark.llm.packing import best_fit_decreasing, lower_bound, pack_documents
from tidemark.llm.sharding import shard_rows
from tidemark.llm.tokens import ChunkEncoder, token_bytes
from tidemark.llm.training_order import read_training_order, write_training_order

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world. It's", "", None, " \n", "a" * 5000, "Ünïcödé ΑΣ Σ. x\u00a0y\u2028z 12ab", "<|endoftext|> don't",
         "e\u0301 e\u0301, \u1e9b\u0323", "word " * 3000,
         "a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> z", "<|endoftext|><|endoftext|>.", "\u00c9<|endoftext|>e\u0301",
         "<|startoftext|", "one <|endoftext|>\n<|startoftext|> two <|endoftext|", "x.y, (z). a., b.. c,"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10 ** 9))
def test_permutation_is_a_bijection(n, key):
    assert sorted(permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_permutation_shuffles():
    moved = permuted(np.arange(10_000), 10_000, 1)
    assert (moved == np.arange(10_000)).sum() < 20 and abs(np.corrcoef(np.arange(10_000), moved)[0, 1]) < 0.05
    assert (moved != permuted(np.arange(10_000), 10_000, 2)).mean() > 0.99


def test_shards(spark):
    rows = [(i if i % 7 else None, TEXTS[i % len(TEXTS)], "z") for i in range(333)] + [(1, "same", "z")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = shard_rows(docs, 16).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(
        str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert set(slots) == set(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    for r in got:                                       # the place follows from the number alone
        place = int(permuted(np.array([r.row_number]), len(rows), 1)[0])
        assert (place % 16, place // 16) == (r.shard, r.slot)
    again = shard_rows(docs.repartition(5), 16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shard_rows(docs.limit(0), 16).collect() == []


def test_token_bytes_match_the_tokenizer():
    tokenizer = Tokenizer.from_file(WORDS)
    rng = random.Random(8)
    alphabet = "ab .,'st\n\t\x0b\x0c\x1c\x85\u00a0\u2028éÉßΑΣ漢👍\u0301٣½12'll"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(1500)]
    parts = [*alphabet, "<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(500)]
    for text, got in zip(texts, token_bytes(texts, WORDS)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, ascii(text)


class _Seen:
    """The tokenizer of an encoder; ``texts`` lists what went through all of its rules."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_go_to_the_model_alone():
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefstlz\u00df\u00e4\u00e9\u00f1\u00ff", k=rng.randint(3, 12))) for _ in range(3000)]
    texts = [" ".join([w + rng.choice(["", ".", ",", ")", "...", "?!", " -"]) for w in words[at:at + 100]])
             for at in range(0, len(words), 100)]
    encoder = ChunkEncoder(WORDS)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.tokenizer = _Seen(encoder.tokenizer)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert sum(map(len, encoder.tokenizer.texts)) < 50          # a few runs of marks; the words were 25,000 letters before


@pytest.mark.parametrize("plain", [True, False])
def test_marks_behind_words_match_the_tokenizer(plain):
    encoder = ChunkEncoder(WORDS)
    assert encoder.plain
    encoder.plain = plain
    rng = random.Random(11)
    parts = [*map(chr, range(33, 127)), *"a\u00df\u00e9\u00f1\u00f7\u00d7\u00c9\u00ff\u0130\u03a3\u0301\u0338\u200d\u00b7\u3002\U0001f44d\u0000\u00aa",
             "'s", "'ll", "don't", "...", "caf\u00e9", "b.", "<|endoftext|>", " ", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(3000)] + [x + y for x in parts for y in parts]
    tokenizer = Tokenizer.from_file(WORDS)
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_after_the_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    encoder, tokenizer, rng = ChunkEncoder(WORDS), Tokenizer.from_file(WORDS), random.Random(12)
    for _ in range(200):
        texts = [" ".join(["".join(rng.choices("ab\u00e9x1.", k=rng.choice([1, 2, 3, 70]))) for _ in range(6)]) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert max(map(len, encoder.known), default=0) <= 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_is_a_packing_above_the_bound(lengths):
    lengths = np.array(lengths, np.int64)
    sequence, offset, space = best_fit_decreasing(lengths, 40)
    used = np.zeros((len(space), 40), int)
    for s, o, n in zip(sequence, offset, lengths):
        used[s, o:o + n] += 1
    assert (used <= 1).all() and (40 - used.sum(axis=1) == space).all()
    assert all((np.diff(row) <= 0).all() for row in used)              # no gaps
    assert lower_bound(lengths, 40) <= len(space)


def test_bound_beats_the_sum_of_lengths():
    assert lower_bound(np.array([51] * 10), 100) == 10                  # the sum alone says 6
    assert lower_bound(np.array([34] * 9), 100) == 5                    # two fit a sequence


@pytest.mark.parametrize("at_once", [20_000, 40])
def test_packing(spark, monkeypatch, at_once):
    monkeypatch.setattr(packing, "PIECES_AT_ONCE", at_once)
    rng = random.Random(9)
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else " ".join(["pack"] * rng.randint(1, 900))) for i in range(120)]
    rows += [(None, "null id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int")
    got = pack_documents(docs, WORDS, 512).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [str((i, p, s, len(ids[s:s + 512]), zlib.crc32(ids[s:s + 512].tobytes())))
                 for p, s in enumerate(range(0, len(ids), 512))]
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    bound = lower_bound(np.array([r.length for r in got]), 512)
    assert len(sequences) <= bound + (1 if at_once > 1000 else 3)
    assert pack_documents(docs.limit(0), WORDS, 512).collect() == []


def test_training_order_round_trip(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "no id"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, slot string").repartition(3)
    path = str(tmp_path / "order")
    length, per_shard, stride = 32, 10, 65
    got = write_training_order(docs, path, WORDS, length, per_shard).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got)))
    for r in got:                                       # plain file access finds every record by its place
        files = glob(f"{path}/shard={r.shard}/part-*")
        assert len(files) == 1
        with open(files[0], "rb") as f:
            f.seek(r.byte_offset)
            record = f.read(stride)
        assert zlib.crc32(record[:-1]) == r.ids_crc32 and record[-1:] == b"\n"
    sizes = [os.path.getsize(f) for f in glob(f"{path}/shard=*/part-*")]
    assert sum(sizes) == stride * len(got) and all(s % stride == 0 for s in sizes)
    rest = read_training_order(spark, path, length, 2, per_shard, first_slot=13).orderBy("slot").collect()
    assert [r.slot for r in rest] == list(range(13, len(got)))
    assert [zlib.crc32(bytes(r.ids)) for r in rest] == [r.ids_crc32 for r in got[13:]]
    ids = token_bytes([t for _, t in rows], WORDS)
    assert sum(r.n_tokens for r in got) == sum(len(x) // 4 + 1 for x in ids)
    assert {d for r in got for d in r.doc_ids} == {i for i, _ in rows}
    assert write_training_order(docs.limit(0), str(tmp_path / "none"), WORDS).collect() == []
