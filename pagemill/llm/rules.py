"""Quality by a sparse rule ensemble, scored as Spark column expressions.

Statistics of a text are column expressions. Small trees are boosted on the statistics of a labelled sample; every path
from a root to a node is a rule, a conjunction of bounds on statistics. Logistic weights of the rules are fitted under
an L1 penalty, which leaves few; those become one column expression, so that scoring runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import labelled_ids

#: Bound of the labelled sample, in documents (twice that may be read).
SAMPLE_DOCS = 20_000
TREES, DEPTH, BINS, SHRINK = 40, 3, 64, 0.3
#: L1 penalty as a share of the least one that leaves no rule.
PENALTY = 0.01


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text as expressions; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    length = lambda c: F.length(c).cast("double")
    kept = lambda pattern: length(F.regexp_replace(t, pattern, ""))
    n = F.greatest(length(t), F.lit(1.0))
    words = F.split(F.trim(t), r"\s+")
    lines = F.split(t, "\n")
    nw, nl = F.size(words).cast("double"), F.size(lines).cast("double")
    return {
        "log_chars": F.log1p(length(t)),
        "chars_a_word": n / nw,
        "upper": kept(r"[^\p{Lu}]+") / n,
        "letters": kept(r"[^\p{L}]+") / n,
        "digits": kept(r"[^0-9]+") / n,
        "commas_stops": kept(r"[^.,]+") / n,
        "bangs": kept(r"[^!?]+") / n,
        "bars": kept(r"[^|]+") / n,
        "symbols": kept(r"[\p{L}0-9\s.,!?|]+") / n,
        "words_once": F.size(F.array_distinct(words)).cast("double") / nw,
        "lines_once": F.size(F.array_distinct(lines)).cast("double") / nl,
        "words_a_line": nw / nl,
    }


NAMES = (
    "log_chars", "chars_a_word", "upper", "letters", "digits", "commas_stops", "bangs", "bars", "symbols", "words_once", "lines_once", "words_a_line",
)

#: A rule: bounds (statistic, whether above, bound) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def column(self, stats: list[Column]) -> Column:
        """The score, 0 to 1. A statistic that is null or not a number meets no bound from above or below."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = None
            for s, above, bound in rule:
                one = stats[s] > bound if above else stats[s] <= bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, above, bound in rule:
        out &= x[:, s] > bound if above else x[:, s] <= bound
    return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """A tree by Newton gain: the rules of all its nodes, and the value of each row's leaf."""
    rules: list[Rule] = []
    value = np.zeros(len(g))

    def grow(rows: np.ndarray, rule: Rule, left: int) -> None:
        sg, sh = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if left and len(rows) >= 10:
            for s in range(binned.shape[1]):
                bg = np.cumsum(np.bincount(binned[rows, s], g[rows], BINS + 1))[:-1]
                bh = np.cumsum(np.bincount(binned[rows, s], h[rows], BINS + 1))[:-1]
                bn = np.cumsum(np.bincount(binned[rows, s], minlength=BINS + 1))[:-1]
                gain = bg**2 / (bh + 1) + (sg - bg) ** 2 / (sh - bh + 1) - sg**2 / (sh + 1)
                gain[(bn < 5) | (bn > len(rows) - 5)] = 0
                gain = gain[: len(edges[s])]
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), s, int(gain.argmax()))
        if best[1] < 0:
            value[rows] = sg / (sh + 1)
            return
        _, s, k = best
        low = binned[rows, s] <= k
        for part, above in ((rows[low], False), (rows[~low], True)):
            new = (*rule, (s, above, float(edges[s][k])))
            rules.append(new)
            grow(part, new, left - 1)

    grow(np.arange(len(g)), (), depth)
    return rules, value


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Ensemble:
    """Without labels of both kinds there is no rule and the score is the share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Ensemble(base, [], [])
    x = np.nan_to_num(x)
    edges = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, s]) for s, e in enumerate(edges)], 1)
    rng = np.random.default_rng(seed)
    z, found = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        g, h = np.zeros(len(y)), np.zeros(len(y))
        g[rows], h[rows] = (y - p)[rows], (p * (1 - p))[rows]
        rules, value = _tree(binned, edges, g, h, DEPTH)
        z += SHRINK * value
        found.update(dict.fromkeys(rules))
    rules = list(found)
    if not rules:
        return Ensemble(base, [], [])
    r = np.stack([_holds(rule, x) for rule in rules], 1).astype(np.float32)
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows count once
    first = np.sort(first)
    first = first[(r[:, first].mean(0) > 0) & (r[:, first].mean(0) < 1)]
    weights, intercept = _lasso(r[:, first], y, base)
    keep = np.flatnonzero(np.abs(weights) > 1e-4)
    return Ensemble(float(intercept), [rules[first[k]] for k in keep], [float(weights[k]) for k in keep])


def _lasso(r: np.ndarray, y: np.ndarray, base: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the L1-penalised logistic loss; the intercept is not penalised."""
    n = len(y)
    grad0 = r.T @ (1 / (1 + np.exp(-base)) - y) / n
    lam = PENALTY * np.abs(grad0).max()
    v = np.ones(r.shape[1], np.float32)
    for _ in range(20):
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * (np.linalg.norm(r @ v) ** 2 + n) / n + 1e-9)
    w, b, wy, by, t = np.zeros(r.shape[1]), base, np.zeros(r.shape[1]), base, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ wy.astype(np.float32) + by))) - y
        step = wy - rate * (r.T @ e.astype(np.float32) / n)
        w2 = np.sign(step) * np.maximum(np.abs(step) - rate * lam, 0)
        b2 = by - rate * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS) -> Ensemble:
    """The ensemble fitted to labelled rows for which ``usable`` holds; the sample's statistics reach the driver, not its
    texts. Of an id with several texts the least statistics count.
    """
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(labelled_ids(labels, "quality", usable, sample_docs)), "doc_id")
    stats = F.struct(*(c.alias(k) for k, c in statistics(F.col("text")).items()))
    got = sorted(rows.select("doc_id", "y", stats.alias("s")).groupBy("doc_id", "y").agg(F.min("s").alias("s")).collect())
    x = np.array([list(r.s) for r in got], np.float64).reshape(-1, len(NAMES))
    return train(x, np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc_id, score) of every row. Null texts count as empty; ties and repeated rows get equal scores.

    Statistics are computed once for each row and the rules refer to them.
    """
    stats = statistics(F.col("text"))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array(*stats.values()).alias("stats"))
    return found.select("doc_id", model.column([F.col("stats")[i] for i in range(len(stats))]).alias("score"))
