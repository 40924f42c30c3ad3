import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from tidemark.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS),
                             special_tokens={})


def test_ids_match_the_library():
    rng = random.Random(3)
    alphabet = "ab .,'st\n\t\x1c\x1f\x85\u00a0\u1680\u180e\u200b\u2028éñßΑΣ漢字한\u0301👍٣½Ⅷ12'll're"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, "=" * 777, " " * 300, "x" * 65 + "é" * 100, "<|endoftext|>", "", None,
              "".join(rng.choices("abcdefghij", k=20_000))]
    own, encoder = _reference(), bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(2):                                   # remembered words give the same
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, np.int32).tolist() == own.encode_ordinary(text or ""), ascii(text)
        encoder.known = dict(list(encoder.known.items())[::2])


def test_round_trip_and_odd_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "\u00a0x"), (3, None), (4, ""), (5, "漢字 " * 5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(str((r.doc_id, bytes(r.decoded))) for r in got) == sorted(str((i, (t or "").encode())) for i, t in rows)
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert sorted(str(r.decoded) for r in bpe.decode(nulls, RANKS).collect()) == ["None", "b''"]


def test_query_digests(spark):
    own = _reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.QUERIES["op9_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
