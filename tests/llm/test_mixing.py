"""Mixing to target weights: targets, rates and copies against plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import mixing
from tidemark.llm.mixing import balanced, mix_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = share * total - cap * sum(sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full) or 1
        out = {s: cap * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and out[s] > cap * sizes[s]}
        if not above:
            return out
        full |= above


def checked(spark, docs, near=None):
    table = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, source string, size string")
    got = mix_documents(table.repartition(4)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    sources = defaultdict(int)
    for i, t, s in docs:
        sources[s] += len(WORD.findall(t or ""))
    want = plain_targets(sources)
    of = {i: s for i, _, s in docs}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in docs)
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sources[of[r.doc_id]]
        assert math.isclose(r.target, want[of[r.doc_id]], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[of[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= (near or 1), (s, taken[s], t)
    again = mix_documents(table.repartition(7, "text")).collect()
    assert sorted(again, key=str) == sorted(got, key=str)
    return got


def test_targets_are_met_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 8)
    rng = random.Random(1)
    docs = []
    for n, (source, many) in enumerate([("b", 300), ("a", 80), ("é", 500), (None, 200), ("z", 40), ("\U0001f600", 30), ("", 60)]):
        docs += [(1000 * n + i, " ".join(["w"] * max(1, int(rng.paretovariate(1.2)))), source) for i in range(many)]
    docs += [(9000, "long " * 3000, "é"), (9001, "", "é"), (9002, None, None), (9003, " \t\x0b ", "empty"), (9004, "x\x1cy\x85z  v\r\nw", "b")]
    checked(spark, docs)


def test_hot_size_and_repeated_rows(spark):
    docs = [(i, "a b c", "x") for i in range(4000)] + [(5000 + i, "d e", "y") for i in range(700)] + [(9000 + i, "f", "z") for i in range(50)]
    checked(spark, docs, near=3)
    same = spark.createDataFrame([(1, "a b", "s")] * 60 + [(None, "c", "t")] * 60, "doc_id long, text string, source string")
    got = mix_documents(same).collect()
    assert len(got) == 120 and abs(sum(r.taken for r in got) - 1.5 * 180) <= 2


def test_rates_are_tilted_exponentially_and_optimal(spark):
    """log(rate / base) is proportional to the size below the cap, and the words meet the target."""
    classes = spark.createDataFrame([(0, s, n) for s, n in [(1, 50), (3, 40), (10, 20), (200, 2)]]
                                    + [(1, s, n) for s, n in [(2, 30), (7, 9)]] + [(2, 5, 10)], "source_no long, size long, n long")
    goals = spark.createDataFrame([(0, 770, 900.0), (1, 123, 40.0), (2, 50, 100.0)], "source_no long, source_size long, target double")
    got = balanced(classes, goals, 1.5, 2).collect()
    for source, target in ((0, 900.0), (1, 40.0), (2, 100.0)):
        own = [r for r in got if r.source_no == source]
        assert abs(sum(r.n * r.size * r.rate for r in own) - target) <= 0.5
        slopes = [math.log(r.rate / 1.5) / r.size for r in own if r.rate < 2]
        assert all(math.isclose(s, slopes[0], rel_tol=1e-6) for s in slopes)


def test_given_table_and_empty_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = checked(spark, [(r.doc_id, r.text, r.source) for r in d.collect()], near=40)
    assert got
    assert mix_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["a b c"], [""], [None]])
def test_single_document(spark, texts):
    got = mix_documents(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert [r.taken for r in got] == [r.copies * r.size for r in got]
