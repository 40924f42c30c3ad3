import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import anchors, drop_near_duplicates, fingerprint, simhash_components


def _plain(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    words = ["Alpha", "béta", "g\u00a0a", "dé", "x" * 300, "Σ"]
    texts = ["", " \n", "one", "one two", None] + [" ".join(rng.choices(words, k=k)) for k in (3, 4, 70, 700)]
    for t in texts:
        assert fingerprint(t) == _plain(t)


def test_long_text_runs_in_pieces(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 300)
    assert fingerprint(text) == whole == _plain(text)


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    for flips in range(4):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        met = np.zeros(len(base), bool)
        for s in range(2):
            mine, theirs = [dict() for _ in base], [dict() for _ in base]
            for fps, held in ((base, mine), (other, theirs)):
                at, anchor = anchors(fps, s, 2, 3)
                for i, a in zip(at, anchor):
                    held[i][int(a)] = True
            met |= np.array([bool(m.keys() & t.keys()) for m, t in zip(mine, theirs)])
        assert met.all()


def _components(fps, bits):
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= bits) for i in range(len(fps))]
        if new == label:
            break
        label = new
    return label


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    stem = [" ".join(rng.choices("abcdefghijklmnop", k=120)).split() for _ in range(4)]
    rows = []
    for i in range(90):
        words = list(rng.choice(stem))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "  "), (None, rows[0][1]), (3, rows[3][1]), (300, "word")]
    docs = spark.createDataFrame([(i, t, 1, "fp") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    fps = [_plain(t) for _, t in rows]
    label = _components(fps, 3)
    low = {}
    for (i, _), root in zip(rows, label):
        low[root] = min([x for x in (low.get(root), i) if x is not None], default=None)
    want = sorted(str((i, f"{f:016x}", low[root])) for (i, _), f, root in zip(rows, fps, label))
    for block in (4096, 8):                      # the second run splits nearly every anchor
        monkeypatch.setattr(simhash, "ANCHOR_BLOCK", block)
        got = simhash_components(docs).collect()
        assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))


def test_a_crowded_anchor_is_dealt_by_its_other_half(spark, monkeypatch):
    """Fingerprints that share one half and differ in the other: few land in one comparison."""
    monkeypatch.setattr(simhash, "ANCHOR_BLOCK", 16)
    rng = np.random.default_rng(7)
    fps = np.unique(np.uint64(0x12345678) << np.uint64(32) | rng.integers(0, 1 << 32, 300, dtype=np.uint64))
    near = fps[:40] ^ (np.uint64(1) << rng.integers(0, 32, 40, dtype=np.uint64))
    all_fps = np.unique(np.concatenate([fps, near]))
    table = spark.createDataFrame([(int(f),) for f in all_fps.view(np.int64)], "fp long")
    sizes, compare = [], simhash._compare

    def counted(groups, bits):
        if "slice" in groups.columns:
            sizes.append(groups.groupBy(*groups.columns[:-1]).count().agg({"count": "max"}).first()[0])
        return compare(groups, bits)

    monkeypatch.setattr(simhash, "_compare", counted)
    edges = {(r.a, r.b) for r in simhash._links(table, 3, 2).collect()}
    linked = connected_components(spark.createDataFrame(list(edges), "a long, b long"), "a", "b", "crowded")
    roots = {r.node: r.root for r in linked.collect()}
    want = _components(all_fps.tolist(), 3)
    groups = {}
    for f, label in zip(all_fps.view(np.int64).tolist(), want):
        groups.setdefault(label, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert sizes and sizes[0] <= 40


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).collect() == [] and drop_near_duplicates(docs).collect() == []


def test_connected_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (5000, 5000), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "path")
    roots = {r.node: r.root for r in got.collect()}
    assert all(roots[i] == 0 for i in range(200)) and roots[1001] == 1000 and 5000 not in roots
