import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import quality, queries
from tidemark.llm.quality import fit_quality, fit_rules, keep_quality, quality_scores
from tidemark.llm.toxicity import CrfModel, _by_text, _summary, drop_toxic, fit_crf, fit_toxicity, marginals, toxicity_scores

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label", [("op6_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert len(held) > 30 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality",
                                "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert fit_quality(docs, labels) == fit_quality(docs, flipped)
    a, b = fit_toxicity(docs, labels), fit_toxicity(docs, flipped)
    assert (a.bias, a.weights, a.score) == (b.bias, b.weights, b.score)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    for sizes in ([1], [5, 1, 3], [2, 4]):
        emission, change = rng.normal(0, 2, sum(sizes)), rng.normal(0, 1, (2, 2))
        starts = np.zeros(sum(sizes), bool)
        starts[np.cumsum([0, *sizes[:-1]])] = True
        want = []
        for own in np.split(emission, np.cumsum(sizes)[:-1]):
            total, hit = 0.0, np.zeros(len(own))
            for tags in itertools.product((0, 1), repeat=len(own)):
                w = np.exp(sum(e * t for e, t in zip(own, tags)) + sum(change[a, b] for a, b in zip(tags, tags[1:])))
                total += w
                hit += w * np.array(tags)
            want += (hit / total).tolist()
        assert np.allclose(marginals(emission, starts, change)[0], want)


def test_marginals_of_long_texts_equal_a_plain_pass():
    rng = np.random.default_rng(2)
    n, change = 1000, np.array([[0.4, -0.3], [-0.2, 0.9]])
    emission, starts = rng.normal(-1, 2, n), rng.random(n) < 0.01
    starts[0] = True
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    for t in range(n):
        m = np.array([1, np.exp(emission[t])]) * (1 if starts[t] else alpha[t - 1] @ np.exp(change))
        alpha[t] = m / m.sum()
    for t in range(n - 2, -1, -1):
        if not starts[t + 1]:
            m = np.exp(change) @ (np.array([1, np.exp(emission[t + 1])]) * beta[t + 1])
            beta[t] = m / m.sum()
    want = (alpha * beta)[:, 1] / (alpha * beta).sum(axis=1)
    assert np.allclose(marginals(emission, starts, change)[0], want)


def _plain_statistics(text):
    """The statistics of one text, counted character by character."""
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    some, n = max(len(text), 1), max(len(words), 1)
    share = lambda marks: sum(c in marks for c in text) / some
    return {"q_chars": len(text), "q_n": len(words), "q_word_length": len(text) / n, "q_distinct": len(set(words)) / n,
            "q_symbols": share(quality._SYMBOLS), "q_upper": share(quality._UPPER), "q_digits": share("0123456789"),
            "q_exclaim": share("!"), "q_bars": share("|"), "q_stops": share("."), "q_commas": share(","), "q_lines": share("\n")}


def test_rule_scores_match_plain_python(spark):
    rng = random.Random(12)
    parts = ["word", "Word", "ÀÉ", "ß", "\U0001f600", " ", "  ", "\n", "\t", "\x0b", "\u00a0", "!", "!!", "|", ".", ",", "#$%", "12", "\x00", "e\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "a" * 50_000, "x y " * 20_000]
    rows = [(i if i % 9 else None, t, rng.random()) for i, t in enumerate(texts)] + [(1, "Word."), (1, "Word.")]
    docs = spark.createDataFrame([(*r[:2], 0.5, "q") for r in rows], "doc_id long, text string, q_chars double, score string")
    x = np.array([list(_plain_statistics(t).values()) for _, t, *_ in rows], float)
    y = (x[:, 10] + 3 * x[:, 5] + 0.2 * np.sin(x[:, 0]) > 0.1).astype(float)
    model = fit_rules(x, y, list(_plain_statistics("")))
    assert len(model.rules) > 3

    def plain_score(text):
        found = _plain_statistics(text)
        total = model.intercept
        for weight, conditions in model.rules:
            total += weight * all((found[name] > cut) == above for name, above, cut in conditions)
        return 1 / (1 + np.exp(-total))

    got = sorted((str(r.doc_id), round(r.score, 9), r.held_out, r.predicted) for r in quality_scores(docs, model).collect())
    want = sorted((str(i), round(float(plain_score(t)), 9), zlib.crc32(str("" if i is None else i).encode()) % 5 == 0,
                   int(plain_score(t) >= 0.3)) for i, t, *_ in rows)
    assert got == want
    kept = keep_quality(docs, model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t, *_ in rows if plain_score(t) >= 0.3)


def test_toxicity_score_is_the_logistic_of_its_marginals(spark):
    """Whole scores recomputed from exact marginals by enumeration of all tag sequences."""
    change = np.array([[0.3, -0.8], [-0.2, 0.6]])
    model = CrfModel(-1.5, {"=vile": 2.5, "^vil": 0.7, "$ile": 0.4, "=fine": -0.6}, change, (-2.0, 1.1, 0.8))
    texts = ["", None, "fine", "vile", "A vile, VILELY fine day", "x vile vile y", "fine fine \u0130 vilex"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(text):
        words = [w.lower() for w in re.findall(r"\w+", text or "")]
        emission = [model.bias + sum(model.weights.get(f, 0) for f in {f"={w}", f"^{w[:3]}" if len(w) >= 3 else "", f"^{w[:4]}" if len(w) >= 4 else "",
                                                                       f"^{w[:5]}" if len(w) >= 5 else "", f"${w[-3:]}"}) for w in words]
        total, hit = 0.0, np.zeros(len(words))
        for tags in itertools.product((0, 1), repeat=len(words)):
            weight = np.exp(sum(e * t for e, t in zip(emission, tags)) + sum(change[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            hit += weight * np.array(tags)
        p = hit / total
        top = min(max(p.max(initial=0.0), 1e-9), 1 - 1e-9)
        return 1 / (1 + np.exp(-(-2.0 + 1.1 * np.log(top / (1 - top)) + 0.8 * np.log1p((p >= 0.5).sum()))))

    got = {r.doc_id: r.score for r in toxicity_scores(docs, model).collect()}
    assert all(got[i] == pytest.approx(plain(t), abs=1e-9) for i, t in enumerate(texts))


def _odd_docs(spark, kind="long"):
    rows = [(1, "a fine text here."), (1, "a fine text here."), (None, "x"), (2, None), (3, ""), (4, "word " * 60_000)]
    return spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], f"doc_id {kind}, text string, spans string, score double")


def test_odd_rows(spark):
    docs, labels = _odd_docs(spark), spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rules, field = fit_quality(docs, labels), fit_toxicity(docs, labels)          # nothing to learn from
    for got in (quality_scores(docs, rules).collect(), toxicity_scores(docs, field).collect()):
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "None"]
        assert all(0 <= r.score <= 1 for r in got)
    assert keep_quality(docs, rules).columns == docs.columns == drop_toxic(docs, field).columns
    assert quality_scores(docs.limit(0), rules).collect() == [] == toxicity_scores(docs.limit(0), field).collect()


def test_spans_are_offsets_of_toxic_words(spark):
    rng = random.Random(4)
    plain = ["alpha", "beta", "gamma", "delta", "omega"]
    texts, toxic = [], []
    for i in range(300):
        words = rng.choices(plain, k=30)
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["vileman", "vilely"])
        texts.append(" ".join(words))
        toxic.append(i % 3 == 0)
    model = fit_crf(texts, np.array(toxic))
    docs = spark.createDataFrame([(1, "Beta Vileness vilely, gamma. VILEMAN"), (2, "alpha beta " * 4000),
                                  (3, "\u0130 vileman x"), (4, "\u0130\u0130 beta, \u0130VILELY \u1e9e vilely")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity_scores(docs, model).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(5, 20), (29, 36)] and got[1].predicted == 1
    assert got[2].spans == [] and got[2].predicted == 0
    assert [(s.start, s.end) for s in got[3].spans] == [(2, 9)]           # offsets of the text, not of its lower case
    assert (19, 25) in [(s.start, s.end) for s in got[4].spans]


def test_rules_of_one_class_are_its_rate():
    model = fit_rules(np.zeros((8, 1)), np.ones(8), ["q"])
    assert model.rules == () and model.intercept == pytest.approx(np.log(9))


def test_model_without_words():
    assert isinstance(fit_crf(["", "a b"], np.array([True, False])), CrfModel)


def test_cues_that_toxic_documents_repeat_and_others_hold_once():
    rng = random.Random(5)
    plain = [a + b for a in ("ka", "lo", "mi", "nu") for b in ("ra", "so", "te", "vi", "wum")]
    texts, toxic = [], []
    for i in range(900):
        words = rng.choices(plain, k=60)
        kind = "plain" if i >= 200 else "rare" if i < 30 else "usual"
        if kind == "usual":
            words[rng.randrange(60)] = rng.choice(["vileman", "vilely"])
        elif kind == "rare" or rng.random() < 0.03:      # different words of one prefix: several, or one
            for at in rng.sample(range(60), 4 if kind == "rare" else 1):
                words[at] = "grumm" + rng.choice(plain) + rng.choice(plain)
        texts.append(" ".join(words))
        toxic.append(kind != "plain")
    model = fit_crf(texts[::2], np.array(toxic[::2]))
    docs = [t.split() for t in texts[1::2]]
    score = np.array([model.score[0] + np.dot(model.score[1:], _summary(p)) for p in _by_text(model, docs)])
    assert np.mean((score >= 0) == toxic[1::2]) >= 0.98
    assert (score[:15] >= 0).mean() >= 0.9               # the rare kind


def test_recall_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = {}
    for r in queries.QUERIES["op10_toxicity"](spark, sf).collect():
        if r.held_out and labels.get(r.doc_id) == 1:
            found.setdefault(lang[r.doc_id], []).append(r.predicted)
    assert set(found) == {"de", "en", "es", "fr"} and all(np.mean(p) >= 0.75 for p in found.values())


def test_long_documents_are_learned_from_where_short_ones_are_few(spark):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=5_000 if i % 4 == 0 else 30)
        if i % 4 == 0:
            words[7] = "vileman"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity_scores(docs, fit_toxicity(docs, docs)).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
