"""Quality classifier: a sparse ensemble of rules.

Small boosted trees over document statistics are grown on a bounded labelled sample; every path in
them is a conjunctive rule.  A lasso logistic regression weighs the rules and drops most.  What is left is compiled
into one Spark column expression, so that scoring runs in the JVM over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

WORD = r"[^\x20\x09-\x0D]+"
SAMPLE_ROWS = 8000
RAW = ("n_chars", "n_words", "n_symbols", "n_upper", "n_caps", "n_digits", "n_bangs", "n_stops", "n_lines", "n_own_lines", "n_own_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "upper_share", "caps_share", "digit_share", "bang_share", "stop_share", "line_words", "line_repeats", "word_repeats")


def _with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    lines = F.split(t, "\n")
    return docs.select(
        F.struct(*keep).alias("_kept"),
        # The counter keeps filters on the score above this projection; below it, each rule would count anew.
        F.when(F.monotonically_increasing_id() >= 0, F.length(t).cast("double")).alias("n_chars"),
        count(WORD).alias("n_words"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{Lu}{2,}").alias("n_caps"),
        count(r"[0-9]").alias("n_digits"),
        count(r"!").alias("n_bangs"),
        count(r"[.?,;:]").alias("n_stops"),
        F.size(lines).cast("double").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("double").alias("n_own_lines"),
        F.size(F.array_distinct(F.split(t, "[ \n]"))).cast("double").alias("n_own_words"),
    )


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``_kept`` (a struct of the columns ``keep``, whose names may be any) and FEATURES of every row (text).

    A null text counts as empty, shares of nothing are 0.
    """
    c = F.col
    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_chars"), F.lit(1.0))
    values = (
        F.log1p(c("n_words")), c("n_chars") / words, c("n_symbols") / words, c("n_upper") / chars, c("n_caps") / words, c("n_digits") / chars,
        c("n_bangs") / words, c("n_stops") / words, c("n_words") / c("n_lines"), 1 - c("n_own_lines") / c("n_lines"), 1 - c("n_own_words") / F.greatest(words, c("n_own_words")),
    )
    return _with_counts(docs, *keep).select("_kept", *(v.alias(f) for v, f in zip(values, FEATURES, strict=True)))


Condition = tuple[int, bool, float]  #: feature, whether at most, threshold


@dataclass
class RuleModel:
    bias: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as a column expression over FEATURES."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            test = F.lit(True)
            for f, low, at in conditions:
                test = test & ((F.col(FEATURES[f]) <= at) if low else (F.col(FEATURES[f]) > at))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same scores by numpy."""
        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, at in conditions:
        out &= (x[:, f] <= at) if low else (x[:, f] > at)
    return out


def _grow(x, bins, edges, g, h, rows, path, depth, rules, least):
    """Split ``rows`` where the logistic gain is best; adds each node's path to rules and returns the leaves' values."""
    if path:
        rules.append(path)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        gs, hs = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            n = len(edges[f]) + 1
            b = bins[rows, f]
            cg, ch, cn = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            ok = (cn >= least) & (len(rows) - cn >= least)
            gain = np.where(ok, cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1), -1)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        return [(rows, g[rows].sum() / (h[rows].sum() + 1))]
    f, k = best[1]
    low = bins[rows, f] <= k
    at = float(edges[f][k])
    return _grow(x, bins, edges, g, h, rows[low], path + ((f, True, at),), depth - 1, rules, least) + _grow(x, bins, edges, g, h, rows[~low], path + ((f, False, at),), depth - 1, rules, least)


def _simplified(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound of a kind for each feature."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, low, at in path:
        was = bounds.get((f, low))
        bounds[f, low] = at if was is None else min(was, at) if low else max(was, at)
    return tuple(sorted((f, low, at) for (f, low), at in bounds.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, penalty: float = 0.002, steps: int = 600) -> RuleModel:
    """Grow the trees, extract their paths, and fit the lasso logistic weights.  All is deterministic."""
    if not len(x):
        return RuleModel()
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    draw, margin, paths = np.random.default_rng(7), np.full(len(x), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(draw.random(len(x)) < 0.7)
        for members, value in _grow(x, bins, edges, y - p, p * (1 - p), rows, (), depth, paths, max(2, len(x) // 200)):
            margin[members] += 0.4 * value
    rules = list(dict.fromkeys(map(_simplified, paths)))
    if not rules:
        return RuleModel(bias)
    r = np.stack([holds(x, c) for c in rules], 1).astype(float)
    mean, scale = r.mean(0), r.std(0)
    use = scale > 0.03
    rules, r = [c for c, u in zip(rules, use, strict=True) if u], (r[:, use] - mean[use]) / scale[use]
    mean, scale = mean[use], scale[use]
    w, v, b, t = np.zeros(r.shape[1]), np.zeros(r.shape[1]), bias, 1.0
    step = 4 * len(x) / max(np.linalg.norm(r, 2) ** 2, 1e-9)
    for _ in range(steps):  # accelerated proximal gradient
        gap = 1 / (1 + np.exp(-(b + r @ v))) - y
        new = v - step * (r.T @ gap) / len(x)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 1.0 * gap.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - (w * mean / scale).sum()), [(rules[i], float(w[i] / scale[i])) for i in kept])


def train_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents that aren't held out: those with the smallest hashed doc_id.

    Rows with a null doc_id or quality teach nothing; a doc_id with several labels counts by its largest.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "quality").select("_kept.*", *FEATURES).orderBy("doc_id", *FEATURES).collect()  # sample_rows at most
    return fit_rules(np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES)), np.array([float(r.quality >= 1) for r in rows]))


def score_quality(docs: DataFrame, model: RuleModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and the columns ``keep``) for every row of ``docs`` (doc_id, text).

    A null text is scored as an empty one.  A null doc_id is kept and is not held out.  Repeated rows repeat.  A score
    of just 0.5 is predicted 1.  An empty table gives no rows; without any training row every score is 0.5.  Other columns are ignored.
    """
    stats = with_statistics(docs, "doc_id", *keep).withColumn("score", model.column())
    doc_id = F.col("_kept.doc_id")
    return stats.select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(f"_kept.`{c}`") for c in keep))
