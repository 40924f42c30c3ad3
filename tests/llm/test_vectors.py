import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup
from tidemark.llm.ann import nearest
from tidemark.llm.embedding_dedup import embedding_components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, score double"
ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1),
       (904, [float("inf")] * 16, 1), (905, [], 1), (906, [1.0] * 3, 1), (907, [2.0] * 3, 1)]


def _vectors(copies=60):
    rng = np.random.default_rng(4)
    center = rng.standard_normal((3, 16))
    rows = [(i, (center[i % 3] + 0.05 * rng.standard_normal(16)).astype("f4").tolist(), i % 2) for i in range(copies)]
    rows += [(100 + i, rng.standard_normal(16).astype("f4").tolist(), None if i % 5 == 0 else 1) for i in range(40)]
    rows += [(200 + i, rows[0][1], 0) for i in range(20)] + [rows[1], rows[1], (None, rows[1][1], 1)]
    return rows + ODD


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 0.5) for i, v, label in rows], SCHEMA)


def _ok(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("tile, window", [(512, 64), (8, 4)])
def test_components_match_brute_force(spark, monkeypatch, tile, window):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = _vectors()
    n = len(rows)
    units = [np.array(v, float) / np.linalg.norm(v) if _ok(v) else None for _, v, _ in rows]
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
             and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
             and units[i] @ units[j] >= 0.98] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    low = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(str((rows[i][0], len(near[i]), low[root[i]], rows[i][0] == low[root[i]])) for i in range(n))
    got = embedding_components(_frame(spark, rows), window=window, passes=4).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want


def _around(rng, middle, cosine, count):                 # unit vectors at a cosine of a middle
    r = rng.standard_normal((count, middle.shape[1]))
    r -= (r * middle).sum(axis=1, keepdims=True) * middle
    return cosine * middle + math.sqrt(1 - cosine ** 2) * r / np.linalg.norm(r, axis=1, keepdims=True)


def _sparse(spark, n=6000, pairs=400):
    """Even directions in two labels (texts), with planted pairs close to the threshold."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n - pairs:] = np.concatenate([_around(rng, v[i:i + 1], 0.981, 1) for i in range(pairs)])
    return spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string")


def test_passes_alone_find_the_links_of_even_directions(spark, monkeypatch):
    table = _sparse(spark)
    dense, exact = [], embedding_dedup._exact_links
    monkeypatch.setattr(embedding_dedup, "_exact_links", lambda nodes, d, *more: dense.append(d.count()) or exact(nodes, d, *more))
    links = {p: sum(r.n_links for r in embedding_components(table, passes=p).collect()) for p in (12,)}
    assert links[12] >= 0.97 * 800 and sum(dense) <= 600         # a tenth of the vectors at most is compared exactly
    monkeypatch.setattr(embedding_dedup, "OPEN_SHARE", 0.0)
    dense.clear()
    only = sum(r.n_links for r in embedding_components(table).collect())
    assert only >= 0.97 * 800 and sum(dense) <= 60               # passes alone; the pairs lie at the threshold itself
    monkeypatch.setattr(embedding_dedup, "MISS", 1.0)            # no exact way: the first pass alone
    few = sum(r.n_links for r in embedding_components(table, passes=1, window=16).collect())
    assert 0 < few < 0.9 * 800


def test_links_of_a_pass_follow_from_its_bits(spark):
    table = _sparse(spark, 2000, 100)
    nodes = table.select(F.xxhash64("label").alias("label"), F.col("embedding").alias("vec"), F.lit(64).cast("long").alias("size"),
                         F.col("vec_id").alias("node"))
    seen = embedding_dedup._window_pass(nodes.coalesce(1), 0, 0.98, 32, 5).collect()
    assert len([r for r in seen if r.kind == 2]) == 2000 and all(-1 <= r.bits <= 65 for r in seen if r.kind == 2)
    assert {abs(r.a - r.b) for r in seen if r.kind == 0} == {1900}


@pytest.mark.parametrize("n, window", [(3_000, 2), (100_000, 256)])
def test_pairs_in_a_dense_label_are_all_found(spark, tmp_path, n, window):
    rng = np.random.default_rng(8)

    vectors = _around(rng, np.eye(64)[:1], math.sqrt(0.9), n)
    vectors[300:600] = _around(rng, vectors[:300], 0.985, 300)
    path = str(tmp_path / "v.parquet")
    pq.write_table(pa.table({"vec_id": np.arange(n), "label": np.zeros(n, np.int32), "embedding":
                             pa.ListArray.from_arrays(np.arange(0, 64 * n + 1, 64, dtype=np.int32), vectors.ravel())}), path)
    got = {r.vec_id: r for r in embedding_components(spark.read.parquet(path), window=window).where("vec_id < 600").collect()}
    assert [got[300 + i].component_id for i in range(300)] == list(range(300))
    assert all(r.n_links == 1 and r.kept == (i < 300) for i, r in got.items())


def test_nearest_is_exact_on_few_rows_and_recalls_most(spark):
    rng = np.random.default_rng(6)
    scale = rng.uniform(0.2, 3, 600)                     # largest inner product, not smallest angle
    rows = [(i, (scale[i] * rng.standard_normal(16)).astype("f4").tolist(), 0) for i in range(600)]
    rows += [(700, rows[5][1], 0), (5, rows[5][1], 0), *ODD]
    got = nearest(_frame(spark, rows), F.col("vec_id") % 20 == 0, k=10).collect()
    found, total = 0, 0
    own = {}
    for r in got:
        own.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    values = {i: np.array(v, float) for i, v, _ in rows if _ok(v)}
    for q, hits in own.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
        scored = sorted(((-float(values[q] @ values[i]), i) for i, v, _ in rows
                         if _ok(v) and len(v) == len(values[q]) and i != q))[:10]
        total += len(scored)
        found += len({h[1] for h in hits} & {i for _, i in scored})
        for _, i, s in hits:
            assert s == pytest.approx(float(values[q] @ values[i]), abs=1e-9)
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)
    assert set(own) == {i for i in range(0, 600, 20)} | {700}
    assert found / total >= 0.9


def test_few_candidates_are_all_returned(spark):
    rows = [(i * 20, [1.0, float(i)], 0) for i in range(5)] + [(7, [1.0, 2.0, 3.0], 0), (40, None, 0)]
    got = nearest(_frame(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    assert len(got) == 5 * 4


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_components(empty).collect() == [] and nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    odd = _frame(spark, ODD[:6])
    assert {(r.n_links, r.kept) for r in embedding_components(odd).collect()} == {(0, True)}
    assert nearest(odd, F.lit(True)).collect() == []
