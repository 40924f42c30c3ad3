"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical
from tidemark.llm.lexical import rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(words(t))
    out = set()
    for i, terms in by_item.items():
        scored = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out |= {(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def rows(df):
    found = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(found) == len(set(found))
    return set(found)


def _texts(rng, n, length):
    vocabulary = [f"w{int(x)}" for x in np.random.default_rng(3).zipf(1.3, 4000) % 1500]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, length))) for _ in range(n)]


@pytest.mark.parametrize("pairs,expanded,k", [(250_000, 2_000_000, 10), (64, 50, 3)])
def test_same_as_all_scores(spark, monkeypatch, pairs, expanded, k):
    monkeypatch.setattr(lexical, "MAX_PAIRS", pairs)
    monkeypatch.setattr(lexical, "_EXPANDED", expanded)
    rng = random.Random(5)
    docs = list(enumerate(_texts(rng, 600, 60))) + [(1000 + i, "w1 w2 w3") for i in range(200)]   # many ties
    docs += [(5000, None), (5001, ""), (5002, " .,- "), (None, "w1 w2 w3"), (5003, "w7 " * 50_000), (5004, "ÀÉ W1 İx É_é"), (7, "w1 w2")]
    items = list(enumerate(_texts(rng, 12, 40))) + [(20, ""), (21, None), (None, "w3 w9"), (22, "W1! à É x"), (3, "w5 w5"), (23, "none here")]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n int, terms string").repartition(5)
    i = spark.createDataFrame([(*r, "q") for r in items], "item_id int, text string, place string")
    assert rows(rank_documents(d, i, k)) == plain(docs, items, k)


def test_items_stop_creating_accumulators(spark, monkeypatch):
    made = []
    scores = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda scan, creates, uses, forward:
                        made.append((int(creates.sum()), int(uses.sum()))) or scores(scan, creates, uses, forward))
    docs = [(i, f"rare{i % 40} " + "the of and to in is it on " * 3) for i in range(400)]
    items = [(1, "rare1 rare2 the of and to in is it on")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert rows(rank_documents(d, i, 5)) == plain(docs, items, 5)
    assert made[-1] == (2, 10)       # the last scan creates by two rare terms and updates with all ten


def test_given_tables_and_empty_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    i = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows(rank_documents(d, i))
    assert got == plain([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()], 50)
    assert rank_documents(d.limit(0), i).count() == 0 and rank_documents(d, i.limit(0)).count() == 0
