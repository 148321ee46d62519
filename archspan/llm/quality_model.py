"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Boosted trees are grown on statistics of labelled texts; every path from a root
to a node is a conjunctive rule. A logistic model with an L1 penalty is fitted
over all rules (lasso), its penalty chosen on held-back training rows, and the rules
that keep a weight are compiled into one Column expression, so scoring a table is
a narrow pass inside the JVM.

The fit takes at most ``FIT_ROWS`` labelled rows, those with the least hash of
doc_id, and happens on the driver: a bounded matrix of a few numbers a row.

Null text counts as empty. Null labels are not learned from. Without two classes
among the labels the score is their share (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without
from .quality_rules import ADDED, with_statistics

#: Bound of the sample that the model is fitted on.
FIT_ROWS = 20_000
TREES, LEAVES_DEPTH, SHRINK, BINS = 40, 3, 0.2, 32
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
STEPS = 400


def _features() -> dict[str, Column]:
    one = F.lit(1.0)
    words = F.greatest(F.col("n_words").cast("double"), one)
    chars = F.greatest(F.col("word_chars").cast("double"), one)
    lines = F.greatest(F.col("n_lines").cast("double"), one)
    letters = F.greatest(F.col("n_letters").cast("double"), one)
    return {
        "n_words": F.col("n_words").cast("double"),
        "n_lines": F.col("n_lines").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "symbols_a_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "letter_share": F.col("n_letters") / chars,
        "capital_share": F.col("n_capitals") / letters,
        "words_a_line": F.col("n_words") / lines,
        "mark_share": F.col("_marks") / words,
        "digit_share": F.col("_digits") / chars,
    }


def _counted(pattern: str) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_features(df: DataFrame) -> DataFrame:
    """``df`` plus ``f_*`` columns, all finite doubles."""
    df = with_statistics(without(df, *ADDED, "_marks", "_digits"))
    df = df.withColumns({"_marks": _counted(r"[.,;:!?]+"), "_digits": _counted("[0-9]+")})
    return df.withColumns({f"f_{k}": v for k, v in _features().items()})


@dataclass
class RuleModel:
    names: list[str]
    rules: list[list[tuple[int, bool, float]]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def score(self) -> Column:
        """Probability of label 1 from the ``f_*`` columns."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for j, above, cut in rule:
                value = F.col(f"f_{self.names[j]}")
                holds = holds & ((value > F.lit(cut)) if above else (value <= F.lit(cut)))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + _holds(x, self.rules) @ np.array(self.weights)))) if self.rules else np.full(len(x), 1 / (1 + np.exp(-self.bias)))


def _holds(x: np.ndarray, rules: list[list[tuple[int, bool, float]]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, cut in rule:
            out[:, k] *= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def _grow(x, cuts, codes, gradient, hessian, rows, path, found) -> np.ndarray:
    """Leaf values of one regression tree for ``rows``; its paths go to ``found``."""
    g, h = gradient[rows], hessian[rows]
    value = np.full(len(rows), g.sum() / (h.sum() + 1))
    if len(path) == LEAVES_DEPTH or len(rows) < 40:
        return value
    best = (1e-6, None)
    for j in range(x.shape[1]):
        n = len(cuts[j])
        if not n:
            continue
        sg = np.cumsum(np.bincount(codes[rows, j], g, n + 1))[:-1]
        sh = np.cumsum(np.bincount(codes[rows, j], h, n + 1))[:-1]
        count = np.cumsum(np.bincount(codes[rows, j], minlength=n + 1))[:-1]
        gain = sg**2 / (sh + 1) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(count < 10) | (count > len(rows) - 10)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (j, k))
    if best[1] is None:
        return value
    j, k = best[1]
    for above in (False, True):
        side = (codes[rows, j] > k) == above
        step = [*path, (j, above, float(cuts[j][k]))]
        found.append(step)
        value[side] = _grow(x, cuts, codes, gradient, hessian, rows[side], step, found)
    return value


def _paths(x: np.ndarray, y: np.ndarray) -> list[list[tuple[int, bool, float]]]:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T, strict=True)], 1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: list = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        margin += SHRINK * _grow(x, cuts, codes, y - p, p * (1 - p) + 1e-6, np.arange(len(y)), [], found)
    unique: dict = {}
    for rule in found:
        unique.setdefault(tuple(sorted(rule)), rule)
    return [unique[k] for k in sorted(unique)]


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps."""
    n, r = a.shape
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2 + n, 1e-9)
    w, z, b, c, t = np.zeros(r), np.zeros(r), 0.0, 0.0, 1.0
    for _ in range(STEPS):
        e = 1 / (1 + np.exp(-(a @ z + c))) - y
        fresh = z - step * (a.T @ e) / n
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * penalty, 0)
        bias = c - step * e.mean()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = fresh + (t - 1) / u * (fresh - w), bias + (t - 1) / u * (bias - b)
        w, b, t = fresh, bias, u
    return w, b


def fit_matrix(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    share = float(y.mean()) if len(y) else 0.5
    flat = RuleModel(names, bias=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(y) < 50 or share in (0.0, 1.0):
        return flat
    rules = _paths(x, y)
    if not rules:
        return flat
    a = _holds(x, rules)
    back = np.arange(len(y)) % 5 == 0
    if len(set(y[~back])) < 2:
        return flat
    losses = []
    for penalty in PENALTIES:
        w, b = _lasso(a[~back], y[~back], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[back] @ w + b))), 1e-6, 1 - 1e-6)
        losses.append(-(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)).mean())
    w, b = _lasso(a, y, PENALTIES[int(np.argmin(losses))])
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(names, [rules[k] for k in kept], w[kept].tolist(), float(b))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleModel:
    """Model of labels (doc_id, label 0/1) on at most ``rows`` of them."""
    names = list(_features())
    chosen = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    got = with_features(sample).select("_id", "_label", *[f"f_{n}" for n in names]).orderBy(F.xxhash64("_id"), "_id", *[f"f_{n}" for n in names]).limit(rows).collect()
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(names))
    return fit_matrix(x, np.array([float(r[1]) for r in got]), names)


def scored(df: DataFrame, model: RuleModel) -> DataFrame:
    """``df`` with score (double) and predicted (int); clashing columns are replaced."""
    rows = with_features(without(df, "score", "predicted"))
    rows = rows.withColumn("score", model.score())
    columns = [c for c in df.columns if c.lower() not in ("score", "predicted", *ADDED)]
    return rows.select(*[f"`{c}`" for c in columns], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
