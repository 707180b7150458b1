"""Quality classifier: a sparse ensemble of rules on text statistics.

Statistics of a text are Spark columns. On a bounded sample of labelled rows shallow trees are grown
(bootstrapped rows, some statistics each); every path from a root is a rule, a conjunction of
thresholds. An L1-penalised logistic regression keeps few of them. The rules that keep a weight are
compiled back into one Spark column expression, which scores all documents.

Learning takes at most `max_rows` labelled rows, those of smallest hash of doc_id, each doc_id once. Null and empty
texts have zero statistics and get a score like any other. Labels that are null are left out; without
both classes every text gets the share of label 1. Rows are scored one by one, so ties, repeated rows
and extra columns have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.labelled import chosen_labels, with_texts

SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


STATISTICS = ("words", "word_length", "distinct", "symbols", "pipes", "shouts", "stops", "lines", "capitals", "digits")


def statistics() -> Column:
    """A struct of STATISTICS of the column text, all of them doubles without nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    octets = F.greatest(F.octet_length(text), F.lit(1)).cast("double")

    def share(what: str) -> Column:
        return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))) / octets

    def of(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1)).cast("double")
        values = {
            "words": n,
            "word_length": octets / n,
            "distinct": F.size(F.array_distinct(words)) / n,
            "symbols": sum((share(c) for c in SYMBOLS[1:]), share(SYMBOLS[0])),
            "pipes": share("|"),
            "shouts": share("!"),
            "stops": share(".") + share(","),
            "lines": share("\n"),
            "capitals": F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) / octets,
            "digits": F.octet_length(F.regexp_replace(text, "[^0-9]+", "")) / octets,
        }
        return F.struct(*(values[k].cast("double").alias(k) for k in STATISTICS))

    return let(F.split(F.trim(text), "[\\x20\\x09-\\x0D]+"), of)


#: A rule: (statistic, whether it must be above, threshold), all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self, stats: Column) -> Column:
        """The score of a struct of statistics, 0 to 1."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, at in rule:
                x = stats.getField(name)
                holds = holds & ((x > at) if above else (x <= at))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, depth: int, tried: np.ndarray, cuts: list[np.ndarray], least: int) -> list[tuple]:
    """Paths of one tree, inner ones too, as tuples of (statistic number, above, threshold)."""
    best = None
    parent = len(y) * y.mean() * (1 - y.mean())
    for k in tried:
        at = np.searchsorted(cuts[k], x[:, k], side="left")  # x <= cuts[j] for j >= at
        n = np.cumsum(np.bincount(at, minlength=len(cuts[k]) + 1))[:-1]
        ones = np.cumsum(np.bincount(at, y, len(cuts[k]) + 1))[:-1]
        m, rest = len(y) - n, y.sum() - ones
        fine = (n >= least) & (m >= least)
        if fine.any():
            impurity = np.where(fine, ones * (1 - ones / np.maximum(n, 1)) + rest * (1 - rest / np.maximum(m, 1)), np.inf)
            j = int(np.argmin(impurity))
            if impurity[j] < parent - 1e-9 and (best is None or impurity[j] < best[0]):
                best = (impurity[j], k, cuts[k][j])
    if best is None:
        return []
    _, k, at = best
    out = []
    for above in (False, True):
        side = (x[:, k] > at) == above
        step = (int(k), above, float(at))
        out.append((step,))
        if depth > 1 and 0 < y[side].mean() < 1:
            out += [(step, *path) for path in _grow(x[side], y[side], depth - 1, tried, cuts, least)]
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression with a free bias, classes balanced: accelerated proximal gradient steps."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    a = np.hstack([z, np.ones((len(z), 1))])
    rate = 4 / max(1e-9, np.linalg.norm(a.T @ (a * weight[:, None]), 2))
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        g = a.T @ (weight * (1 / (1 + np.exp(-(a @ v))) - y))
        new = v - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (was - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def learn_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> RuleModel:
    """x: rows of statistics, y: 0 or 1."""
    if not len(y) or not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    random = np.random.RandomState(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 99))) for c in x.T]
    paths: dict[tuple, None] = {}
    for _ in range(trees):
        rows = random.randint(0, len(y), min(len(y), 4000))
        tried = np.sort(random.permutation(len(names))[: max(2, len(names) // 2)])
        if 0 < y[rows].sum() < len(rows):
            for path in _grow(x[rows], y[rows].astype(float), depth, tried, cuts, max(5, len(rows) // 200)):
                paths.setdefault(path)
    rules = list(paths)
    holds = np.ones((len(y), len(rules)))
    for j, rule in enumerate(rules):
        for k, above, at in rule:
            holds[:, j] *= (x[:, k] > at) == above
    w, bias = _lasso(holds, y, penalty)
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel([tuple((names[k], above, at) for k, above, at in rules[j]) for j in used], [float(w[j]) for j in used], bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 8000) -> RuleModel:
    """learn: a condition on doc_id that says which labels may be learnt from."""
    rows = with_texts(chosen_labels(labels, "quality", learn, max_rows), docs).select("doc_id", "y", F.inline(F.array(statistics())))
    names = list(STATISTICS)
    rows = rows.toPandas().sort_values(["doc_id", *names], ignore_index=True)
    return learn_rules(rows[names].to_numpy(float), rows["y"].to_numpy(), names)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, score, predicted, for each row of docs."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(statistics(), model.column).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
