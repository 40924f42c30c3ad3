"""Toxicity: a linear-chain conditional random field over the words of a text.

Documents are labelled, words are not. Words are first labelled from a bounded
sample: cues are words, or first letters of words, that toxic documents hold
surely more often than others do, or several times where others hold them once,
and the words of toxic documents that show a cue are the toxic ones. The field learns to tag them from each word's own features and its neighbours'
tags. Scoring computes every word's exact marginal by forward and backward
passes; a document's score is a logistic function of its largest marginal and
its number of toxic words, and the runs of toxic words are its spans.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Collection, Container, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import batches, column, held_out, map_batches, worker_state

MAX_FIT_DOCS = 1_000         # labelled documents of each class a model is fitted on at most
MAX_FIT_BYTES = 20_000       # longer documents are used for fitting where shorter ones are too few (all are scored whole)
THRESHOLD = 0.5
REMEMBERED = 250_000         # words a worker remembers at most
SLICE_BYTES = 2 << 20        # text that a worker tags at a time
_WORD = re.compile(r"\w+")
_PREFIXES = (3, 4, 5)
_CHUNK = 64
_LEVELS = (1, 2, 3, 4)       # words of a document with the same feature, at least, that are judged as a cue
_LEAST_ODDS = 4              # times the odds of the other documents that a cue must surely have (by two errors)


def _words(text: str) -> list[str]:
    """The lower-cased words of a text; where lower case is longer than the text, word by word."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def _features(word: str) -> list[str]:
    return ["=" + word, *["^" + word[:n] for n in _PREFIXES if len(word) >= n], "$" + word[-3:]]


@dataclass
class CrfModel:
    """Weights of the toxic tag (the other tag has weight 0), log weights of tag
    changes, and the coefficients of the document score."""

    bias: float
    weights: dict[str, float]
    change: np.ndarray                       # log weights [from, to]
    score: tuple[float, float, float]        # intercept, largest marginal's log odds, log(1 + toxic words)
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        known, weights = self.known, self.weights
        for word in set(words).difference(known):
            known[word] = self.bias + sum(weights.get(f, 0.0) for f in _features(word))
        return np.array([known[w] for w in words], float)


def marginals(emission: np.ndarray, starts: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, ...]:
    """(p, alpha, beta): each word's probability of the toxic tag, and the
    normalised forward and backward messages. ``starts`` marks the first words
    of texts, where the chain begins anew.

    The words lie in rows of ``_CHUNK``; the product of each row's 2 x 2
    matrices carries messages over whole rows, so the passes inside rows run for
    all rows at once.
    """
    n = len(emission)
    rows = -(-n // _CHUNK)
    x = np.ones(rows * _CHUNK)
    x[:n] = np.exp(np.clip(emission, -30, 30))
    begin = np.ones(rows * _CHUNK, bool)
    begin[:n] = starts
    x, begin = x.reshape(rows, _CHUNK).T.copy(), begin.reshape(rows, _CHUNK).T.copy()
    (a, b), (c, d) = np.exp(change)

    def onward(m0, m1, t):                           # one forward step for messages (m0, m1)
        first = begin[t] if m0.ndim == 1 else begin[t][:, None]
        factor = x[t] if m0.ndim == 1 else x[t][:, None]
        total = m0 + m1
        n0 = np.where(first, total, m0 * a + m1 * c)
        n1 = np.where(first, total, m0 * b + m1 * d) * factor
        size = n0 + n1
        return n0, n1, size

    p0, p1 = np.tile([1.0, 0.0], (rows, 1)), np.tile([0.0, 1.0], (rows, 1))      # products, one line per start tag
    for t in range(_CHUNK):
        p0, p1, size = onward(p0, p1, t)
        size = size.max(axis=1, keepdims=True)
        p0, p1 = p0 / size, p1 / size
    product = np.stack([p0, p1], axis=2).tolist()
    into, state = [], (0.5, 0.5)
    for (k00, k01), (k10, k11) in product:
        into.append(state)
        s0, s1 = state[0] * k00 + state[1] * k10, state[0] * k01 + state[1] * k11
        state = s0 / (s0 + s1), s1 / (s0 + s1)
    back, state = [], (0.5, 0.5)
    for (k00, k01), (k10, k11) in reversed(product):
        back.append(state)
        s0, s1 = k00 * state[0] + k01 * state[1], k10 * state[0] + k11 * state[1]
        state = s0 / (s0 + s1), s1 / (s0 + s1)
    alpha, beta = np.empty((_CHUNK, rows, 2)), np.empty((_CHUNK, rows, 2))
    m0, m1 = np.array(into).reshape(rows, 2).T
    for t in range(_CHUNK):
        m0, m1, size = onward(m0, m1, t)
        m0, m1 = m0 / size, m1 / size
        alpha[t, :, 0], alpha[t, :, 1] = m0, m1
    b0, b1 = np.array(back[::-1]).reshape(rows, 2).T
    for t in range(_CHUNK - 1, -1, -1):
        beta[t, :, 0], beta[t, :, 1] = b0, b1
        toxic = x[t] * b1
        n0 = np.where(begin[t], b0 + toxic, a * b0 + b * toxic)
        n1 = np.where(begin[t], b0 + toxic, c * b0 + d * toxic)
        b0, b1 = n0 / (n0 + n1), n1 / (n0 + n1)
    both = alpha * beta
    p = both[:, :, 1] / both.sum(axis=2)
    flat = [m.swapaxes(0, 1).reshape(rows * _CHUNK, *m.shape[2:])[:n] for m in (p, alpha, beta)]
    return tuple(flat)


def _hits(own: list[str], found: dict[str, tuple[str, ...]], cues: dict[str, int]) -> np.ndarray:
    """Which words of a text carry a cue that the text holds often enough.
    ``found`` has the cues of every word that carries any."""
    often = Counter(f for w in own for f in found.get(w, ()))
    held = {f for f, n in often.items() if n >= cues[f]}
    return np.array([not held.isdisjoint(found.get(w, ())) for w in own], bool)


def _carriers(words: Iterable[str], wanted: Container[str]) -> dict[str, tuple[str, ...]]:
    """The wanted features of every word that has any."""
    pairs = ((w, tuple(f for f in _features(w)[:-1] if f in wanted)) for w in words)
    return {w: own for w, own in pairs if own}


def _cues(docs: list[list[str]], toxic: np.ndarray, vocabulary: Collection[str]) -> dict[str, int]:
    """Word and prefix features that mark toxic documents, and how many words of
    a document must have the feature.

    A feature is judged at every count of ``_LEVELS`` by the documents that
    reach it, and by two tests: so many of them are toxic that chance does not
    explain it in any of all the judgements made, and the odds are surely
    ``_LEAST_ODDS`` times those of the others. Toxic documents that no cue
    explains are judged again on their own, until they yield none, so a kind of
    them does not have to be common among all.
    """
    n0 = int((~toxic).sum())
    unlikely = np.log(0.01 / max(2, len(_LEVELS) * (1 + len(_PREFIXES)) * len(vocabulary)))
    cues: dict[str, int] = {}
    left = [d for d, bad in zip(docs, toxic) if bad]
    while left:
        n1, share = len(left), len(left) / (len(left) + n0)
        least = unlikely / np.log(share)             # fewer toxic documents than this are chance even without others
        once = Counter(f for d in left for f in {f for w in set(d) for f in _features(w)[:-1]})
        found = _carriers(vocabulary, {f for f, n in once.items() if n >= least})
        hits, misses = _reach(left, found), _reach((d for d, bad in zip(docs, toxic) if not bad), found)
        new: dict[str, int] = {}
        for (f, level), a in sorted(hits.items()):
            b = misses[f, level]
            part = a / (a + b)
            if a < least or part <= share:
                continue
            # Chernoff's bound of the binomial tail
            tail = -a * np.log(part / share) - (b * np.log((1 - part) / (1 - share)) if b else 0.0)
            odds = np.log((a + 0.5) * (n0 - b + 0.5) / ((n1 - a + 0.5) * (b + 0.5)))
            error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
            if tail <= unlikely and odds - 2 * error >= np.log(_LEAST_ODDS):
                new[f] = min(level, new.get(f, level))
        new = {f: n for f, n in new.items() if n < cues.get(f, n + 1)}
        if not new:
            break
        cues.update(new)
        carried = _carriers(vocabulary, cues)
        left = [d for d in left if not _hits(d, carried, cues).any()]
    return cues


def _reach(docs: Iterable[list[str]], found: dict[str, tuple[str, ...]]) -> Counter[tuple[str, int]]:
    """How many documents hold at least so many words with a feature, for each level."""
    out: Counter[tuple[str, int]] = Counter()
    for own in docs:
        often = Counter(f for w in own for f in found.get(w, ()))
        out.update((f, level) for f, n in often.items() for level in _LEVELS if n >= level)
    return out


def fit_crf(texts: list[str], toxic: np.ndarray) -> CrfModel:
    """Fit on whole texts and their labels (booleans)."""
    same: dict[str, str] = {}                      # one object for each different word
    docs = [[same.setdefault(w, w) for w in _words(t)] for t in texts]
    cues = _cues(docs, toxic, same) if toxic.any() and not toxic.all() else {}
    rate = (toxic.sum() + 1) / (len(toxic) + 2)
    if not cues:
        return CrfModel(-30.0, {}, np.zeros((2, 2)), (float(np.log(rate / (1 - rate))), 0.0, 0.0))
    words, tags, starts = [], [], []
    draw = np.random.default_rng(0)
    carried = _carriers(same, cues)
    for own, bad in zip(docs, toxic):
        if bad:                                          # around each toxic word
            hit = _hits(own, carried, cues)
            near = np.convolve(hit, np.ones(41))[20:20 + len(own)] > 0.5 if len(own) else hit
        else:                                            # a stretch from anywhere, and the words that carry cues
            hit, near = np.zeros(len(own), bool), np.array([w in carried for w in own], bool)
            if own:
                at = int(draw.integers(0, max(1, len(own) - 99)))
                near[at:at + 100] = True
        at = np.flatnonzero(near)
        words += [own[i] for i in at]
        tags += hit[at].tolist()
        starts += (np.diff(at, prepend=-2) > 1).tolist()
    tag, start = np.array(tags, float), np.array(starts, bool)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    word = np.array([vocabulary[w] for w in words])
    index: dict[str, int] = {}
    pairs = [(i, index.setdefault(f, len(index))) for w, i in vocabulary.items() for f in _features(w)]
    of_word, of_feature = np.array(pairs).T
    size = len(index)
    theta = np.zeros(size + 1 + 4)                       # features, bias, tag changes
    theta[size] = -2.0
    square = np.full(len(theta), 1e-8)
    old, new = tag[:-1].astype(int), tag[1:].astype(int)
    inside = ~start[1:]
    seen = np.bincount((old * 2 + new)[inside], minlength=4).astype(float)
    for _ in range(80):                                  # Adagrad on the whole sample
        per_word = np.bincount(of_word, theta[of_feature], len(vocabulary))
        emission, change = per_word[word] + theta[size], theta[size + 1:].reshape(2, 2)
        p, alpha, beta = marginals(emission, start, change)
        error = p - tag
        gradient = np.empty(len(theta))
        gradient[:size] = np.bincount(of_feature, np.bincount(word, error, len(vocabulary))[of_word], size)
        gradient[size] = error.sum()
        x = np.stack([np.ones(len(word)), np.exp(np.clip(emission, -30, 30))], axis=1)
        joint = alpha[:-1, :, None] * np.exp(change)[None] * (x * beta)[1:, None, :]
        joint = joint[inside] / joint[inside].sum(axis=(1, 2), keepdims=True)
        gradient[size + 1:] = joint.sum(axis=0).ravel() - seen
        gradient += 0.5 * theta * np.r_[np.ones(size), 0, np.ones(4)]
        square += gradient ** 2
        theta -= 0.5 * gradient / np.sqrt(square)
    weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}
    model = CrfModel(float(theta[size]), weights, theta[size + 1:].reshape(2, 2).copy(), (0.0, 1.0, 0.0))
    seen_docs = np.array([_summary(p) for p in _by_text(model, docs)])
    return CrfModel(model.bias, weights, model.change, _logistic(seen_docs, toxic.astype(float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + [0, 0.1 * w[1], 0.1 * w[2]]
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 0.1, 0.1])
        w -= np.linalg.solve(hessian, gradient)
    return tuple(float(v) for v in w)


def _by_text(model: CrfModel, docs: list[list[str]]) -> list[np.ndarray]:
    """Each text's word marginals."""
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return [np.empty(0)] * len(docs)
    starts = np.zeros(int(sizes.sum()), bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    p = marginals(model.emissions([w for d in docs for w in d]), starts, model.change)[0]
    return np.split(p, np.cumsum(sizes)[:-1])


def _summary(p: np.ndarray) -> tuple[float, float]:
    top = float(np.clip(p.max(), 1e-9, 1 - 1e-9)) if len(p) else 1e-9
    return float(np.log(top / (1 - top))), float(np.log1p((p >= 0.5).sum()))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of toxic words as character offsets of the text, with the largest marginal of each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, last = [], -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i == last + 1:
            out[-1]["end"], out[-1]["score"] = places[i][1], max(out[-1]["score"], float(p[i]))
        else:
            out.append({"start": places[i][0], "end": places[i][1], "score": float(p[i])})
        last = i
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id",
                 text: str = "text", max_docs: int = MAX_FIT_DOCS) -> CrfModel:
    """Fit on at most ``max_docs`` toxic and as many other labelled documents
    that are not held out: those of the smallest hashed ids among documents of at
    most ``MAX_FIT_BYTES``, then the shortest of the longer ones, whole, while a
    class has at most ``max_docs * MAX_FIT_BYTES`` in all. Rows without a label
    or id teach nothing."""
    known = labels.select(column(labels, doc_id).alias("id"), column(labels, label).alias("y")) \
        .where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))) \
        .groupBy("id").agg(F.max("y").alias("y"))
    bodies = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("body")).where("body IS NOT NULL")
    sized = bodies.select("id", F.octet_length("body").cast("long").alias("size")).join(known, "id") \
        .groupBy("id", "y").agg(F.sum("size").alias("size"))
    order = (F.greatest("size", F.lit(MAX_FIT_BYTES)), F.xxhash64("id"), "id")
    few = sized.where("y = 1").orderBy(*order).limit(max_docs).unionByName(
        sized.where("y = 0").orderBy(*order).limit(max_docs)).collect()           # at most 2 * max_docs ids
    total, chosen = Counter(), []
    for r in sorted(few, key=lambda r: r.size):
        total[r.y] += r.size
        if total[r.y] <= max_docs * MAX_FIT_BYTES:
            chosen.append((r.id, r.y))
    own = docs.sparkSession.createDataFrame(chosen, sized.select("id", "y").schema)
    rows = bodies.join(F.broadcast(own), "id").select("body", "y").limit(2 * max_docs).collect()
    rows.sort(key=lambda r: (r.y, r.body))
    return fit_crf([r.body for r in rows], np.array([r.y == 1 for r in rows], bool))


def with_toxicity(rows: DataFrame, model: CrfModel, text: str) -> DataFrame:
    """``rows`` with ``score`` (0 to 1) and ``spans`` (array of start, end,
    score: character offsets of toxic words) as last columns. Null and empty
    texts have no words, hence no spans, and the score of no finding."""
    packed = pickle.dumps(model)                     # its bytes name the model, so a worker keeps its word memory
    at = rows.columns.index(text)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state(("toxicity", packed), lambda: pickle.loads(packed))
        for batch in batches(stream, at, SLICE_BYTES):
            if len(own.known) > REMEMBERED:
                own.known.clear()
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = _by_text(own, [_words(t) for t in texts])
            seen = np.array([_summary(p) for p in found])
            score = 1 / (1 + np.exp(-np.clip(own.score[0] + seen @ np.array(own.score[1:]), -700, 700)))
            spans = [_spans(t, p) if (p >= 0.5).any() else [] for t, p in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, _SPAN)],
                                             [*batch.schema.names, "score", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_batches(rows, run, f"{kinds}, score double, spans array<struct<start int, end int, score double>>")


def toxicity_scores(docs: DataFrame, model: CrfModel, doc_id: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans. Null and
    empty texts have no spans and the score of no finding; repeated and null ids
    keep a row each; other columns are not read."""
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    return with_toxicity(rows, model, "text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: CrfModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below ``threshold``, with the columns they came
    with. Null and empty texts have the score of no finding; repeated rows and rows
    with null ids are judged each."""
    names = docs.columns
    carried = docs.select(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(names)])
    scored = with_toxicity(carried, model, f"c{names.index(text)}")
    return scored.where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
