"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown over statistics of a bounded sample of labelled
documents; every path from a root to a node is a conjunctive rule. A logistic
regression with a lasso penalty keeps few of the rules. The rules that are left
and the statistics they use are Spark column expressions, so scoring is one
projection over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import column, held_out

MAX_FIT_ROWS = 20_000        # labelled documents a model is fitted on at most
THRESHOLD = 0.3
_SYMBOLS = "#$%&*@^_=+<>/\\|~`{}[]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÎÏÍÌÔÖÓÒÙÛÜÚÑ"
_CUTS, _TREES, _DEPTH, _RATE, _LASSO = 24, 40, 3, 0.3, 0.002


def with_statistics(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with one double column per statistic of the whole text (null: empty), and their names."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn("q_text", body) \
        .withColumn("q_words", F.filter(F.split("q_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")) \
        .withColumn("q_chars", F.length("q_text").cast("double")).withColumn("q_n", F.size("q_words").cast("double"))
    some, words = F.greatest("q_chars", F.lit(1.0)), F.greatest("q_n", F.lit(1.0))

    def share(without: Column) -> Column:
        return (F.col("q_chars") - F.length(without)) / some

    found = {
        "q_chars": F.col("q_chars"),
        "q_n": F.col("q_n"),
        "q_word_length": F.col("q_chars") / words,
        "q_distinct": F.size(F.array_distinct("q_words")) / words,
        "q_symbols": share(F.translate("q_text", _SYMBOLS, "")),
        "q_upper": share(F.translate("q_text", _UPPER, "")),
        "q_digits": share(F.translate("q_text", "0123456789", "")),
        "q_exclaim": share(F.replace("q_text", F.lit("!"), F.lit(""))),
        "q_bars": share(F.replace("q_text", F.lit("|"), F.lit(""))),
        "q_stops": share(F.replace("q_text", F.lit("."), F.lit(""))),
        "q_commas": share(F.replace("q_text", F.lit(","), F.lit(""))),
        "q_lines": share(F.replace("q_text", F.lit("\n"), F.lit(""))),
    }
    others = [column(base, c) for c in docs.columns]
    return base.select(*others, *[v.cast("double").alias(k) for k, v in found.items()]), list(found)


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]     # (weight, ((statistic, above, cut), ...))

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, above, cut in conditions:
                holds = holds & ((F.col(name) > cut) if above else (F.col(name) <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray,
          path: tuple, depth: int, paths: set, out: np.ndarray) -> None:
    """One boosted tree: writes its values into ``out`` and its paths into ``paths``."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None)
    if depth:
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            slot = np.searchsorted(own, x[rows, j], side="left")           # x <= own[i] for slots up to i
            gl = np.cumsum(np.bincount(slot, gradient[rows], len(own) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, hessian[rows], len(own) + 1))[:-1]
            gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
            gain[(hl < 1) | (h - hl < 1)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (j, float(own[i])))
    if best[1] is None:
        out[rows] += -_RATE * g / (h + 1)
        return
    j, cut = best[1]
    above = x[rows, j] > cut
    for side in (False, True):
        branch = (*path, (j, side, cut))
        paths.add(tuple(sorted(branch)))
        _grow(x, gradient, hessian, cuts, rows[above == side], branch, depth - 1, paths, out)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Fit the ensemble on statistics ``x`` and labels ``y`` (0 or 1). With one
    class only the model is that class's smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return RuleModel(start, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, _CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    # halves of the classes' own quantiles find cuts that a rare class needs
    cuts = [np.unique(np.concatenate([c, *[np.quantile(x[y == v, j], [0.01, 0.05, 0.5, 0.95, 0.99]) for v in (0, 1)]]))
            for j, c in enumerate(cuts)]
    margin, paths = np.full(len(y), start), set()
    for _ in range(_TREES):
        p = _sigmoid(margin)
        step = np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), (), _DEPTH, paths, step)
        margin += step
    rules, held, seen = [], [], set()
    for path in sorted(paths):
        holds = np.logical_and.reduce([(x[:, j] > cut) == side for j, side, cut in path])
        if 0 < holds.sum() < len(y) and (mark := holds.tobytes()) not in seen:
            seen.add(mark)
            rules.append(path)
            held.append(holds)
    z = np.array(held, float).T
    weight, intercept, ahead, t = np.zeros(z.shape[1]), start, np.zeros(z.shape[1]), 1.0
    rate_of = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + len(y))
    for _ in range(400):                                                   # proximal gradient with momentum
        error = (_sigmoid(z @ ahead + intercept) - y) / len(y)
        new = ahead - rate_of * (z.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - rate_of * _LASSO, 0)
        intercept -= rate_of * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, weight, t = new + (t - 1) / t_new * (new - weight), new, t_new
    return RuleModel(float(intercept), tuple(
        (float(w), tuple((names[j], side, cut) for j, side, cut in rule)) for w, rule in zip(weight, rules) if w))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
                text: str = "text", max_rows: int = MAX_FIT_ROWS) -> RuleModel:
    """Fit on at most ``max_rows`` labelled documents that are not held out
    (those of the smallest hashed ids). Rows without a label or id teach nothing."""
    chosen = labels.select(column(labels, doc_id).alias("q_id"), column(labels, label).alias("q_label")) \
        .where(F.col("q_label").isin(0, 1) & F.col("q_id").isNotNull() & ~held_out(F.col("q_id"))) \
        .groupBy("q_id").agg(F.min("q_label").alias("q_label")).orderBy(F.xxhash64("q_id"), "q_id").limit(max_rows)
    rows = docs.select(column(docs, doc_id).alias("q_id"), column(docs, text).alias("q_body")) \
        .join(F.broadcast(chosen), "q_id").select("q_label", "q_body")     # at most max_rows ids
    measured, names = with_statistics(rows, "q_body")
    got = measured.select("q_label", *names).limit(max_rows).toPandas()
    return fit_rules(got[names].to_numpy(float), got["q_label"].to_numpy(float), names)


def quality_scores(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null texts
    count as empty; repeated and null ids keep a row each."""
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("q_body"))
    measured, _ = with_statistics(rows, "q_body")
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns they came with."""
    names = docs.columns
    carried = docs.select(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(names)])
    measured, _ = with_statistics(carried, f"c{names.index(text)}")
    return measured.where(model.score() >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
