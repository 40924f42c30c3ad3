"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.alignment import align_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the thing of the other", "the thing of the other", "", None, " ", "  ", "a ", " a", "a  b\n\tc  ", "x \n y\n  z",
    "tab\t tab \t", "naïve café \U0001f600 \U0001f600ok", "▁", "a▁b c", "x▁ y", "<|endoftext|> <s></s><unk> <0x0A>",
    "no break 　 wide  end", "don't we'll IT'S", "1234567 89,000.50!!! ...", "你好 世界", "\x00 nul \x1c sep \x85 nel", "\r\n\r\n a\r\n",
    "word " * 3000 + "tail", "z" * 5000, "one.\ntwo, three!!\n four;:\n\n  five.\n", "\nfirst", ".\n", "², x².y 3. a3.", "end.\x85 é. ß,\n",
    "a▁.\nb", "x.\n\ty", "IT!! it!!", "don't. rock'n'roll's, 'tis",
]


def plain(texts):
    """Every link by comparing byte ranges of whole texts."""
    t, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    symbol = alignment._byte_symbols()
    vocab = {i: bytes(symbol[c] for c in p) for p, i in t.get_vocab(with_added_tokens=False).items()}
    rows, pairs = [], Counter()
    for text in texts:
        a_ids, b_ids, links, groups = [], [], [], ""
        if text:
            whole = (" " + text).encode()
            a_ids = t.encode(" " + text, add_special_tokens=False).ids
            b_ids = sp.encode(text)
            a_bytes = [vocab[i] for i in a_ids]
            b_bytes = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i)
                       else sp.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
            if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
                a_ids, b_ids = [], []
            else:
                def spans(parts):
                    at = 0
                    for p in parts:
                        yield at, at + len(p)
                        at += len(p)
                sa, sb = list(spans(a_bytes)), list(spans(b_bytes))
                j0 = 0
                for i, (s, e) in enumerate(sa):
                    while sb[j0][1] <= s:
                        j0 += 1
                    j = j0
                    while j < len(sb) and sb[j][0] < e:
                        links.append((a_ids[i], b_ids[j]))
                        j += 1
                out, i, j = [], 0, 0
                for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
                    i2, j2 = i, j
                    while i2 < len(sa) and sa[i2][1] <= cut:
                        i2 += 1
                    while j2 < len(sb) and sb[j2][1] <= cut:
                        j2 += 1
                    out.append(",".join(map(str, a_ids[i:i2])) + "|" + ",".join(map(str, b_ids[j:j2])))
                    i, j = i2, j2
                groups = ";".join(out)
        pairs.update(links)
        rows.append((a_ids, b_ids, links, groups))
    best = Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
             sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups) for a, b, links, groups in rows]


def as_rows(df, last):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r[last]) for r in df.collect()}


@pytest.mark.parametrize("hot", [65_536, 3, 0])
def test_every_text_as_the_plain_version(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, pairs string")
    want = plain(TEXTS)
    assert as_rows(align_documents(docs, A, B, digest=True), "groups_sha256") == {i: w[:7] for i, w in enumerate(want)}
    if hot == 3:
        assert as_rows(align_documents(docs, A, B), "groups") == {i: (*w[:6], w[7]) for i, w in enumerate(want)}


def test_table_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain(list(texts.values()))
    assert as_rows(align_documents(docs, A, B, digest=True), "groups_sha256") == {i: w[:7] for i, w in zip(texts, want)}


def test_empty_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    out = align_documents(docs, A, B).collect()
    assert sorted((r.doc_id or 0, r.n_a) for r in out) == [(0, 1), (1, 2), (1, 2)]
    assert align_documents(docs.limit(0), A, B).count() == 0


def test_odd_joins_of_marks_and_letters():
    rng = random.Random(11)
    parts = [" ", " ", "  ", "\n", "\t", "a", "B", "é", "²", "3", "ñn", ".", ",", "!", "'s", "'", "-", "word", "▁", "\xa0", "漢", "\U0001f600", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)]
    aligner = alignment.Aligner(A, B)
    for (n_a, n_b, n_groups, groups, links), w, text in zip(aligner.documents(texts), plain(texts), texts):
        assert (n_a, n_b, n_groups, len(links), groups) == (*w[:4], w[7]), ascii(text)


def test_remembered_chunks_change_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "_REMEMBERED", 4)
    monkeypatch.setattr(alignment, "_TOGETHER", 5)
    aligner = alignment.Aligner(A, B)
    want = plain(TEXTS)
    for _ in range(2):
        for text, w in zip(TEXTS, want):
            n_a, n_b, n_groups, groups, links = aligner.documents([text])[0]
            assert (n_a, n_b, n_groups, len(links), groups) == (*w[:4], w[7])
