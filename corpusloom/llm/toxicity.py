"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Lower-cased texts give the n-grams of 4, 6 and 7 code points, hashed into 2**BITS features that count
once a text. Over the training rows the smoothed shares of each class's texts that have a feature give
its log-count ratio r, and r over its standard error is the evidence for it. The features of most
evidence stay, and a logistic regression is fitted on x * r, with an L2 penalty and balanced classes.
A text's score is the logistic of slope * (bias + sum of w * r over its features) + offset.

How many features stay and how strong the penalty is, `GRID` says; each of its settings is tried by
`FOLDS` folds of at most `fold_rows` training rows, features chosen anew without the fold left out, and
the one of least log loss on the rows left out is taken. These rows' sums also give slope and offset,
so that few false alarms remain where training rows are few. `Model.report` has what they say.

Learning takes at most `max_rows` labelled rows, those of smallest hash of doc_id, each doc_id once; their
texts and all others are read whole. Null and empty texts get the score of
no features. Training rows whose label is null are left out; without both classes every text gets the share of label 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.labelled import chosen_labels, with_texts
from corpusloom.session import drop_table, write_table

SIZES = (4, 6, 7)
BITS = 20
#: Code points hashed together.
CHUNK = 1 << 20
FOLDS = 4
#: Settings tried: (features, ridge).
GRID = ((1000, 0.1), (4000, 0.03), (4000, 0.1), (4000, 1.0))
#: A feature must be in so many texts; added to its counts.
LEAST, SMOOTHING = 3, 0.5


def _hashed(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram size the features at every place of the code points."""
    h = codes.astype(np.uint32)
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in SIZES:
            yield ((h * np.uint32(0x9E3779B1)) ^ (h >> np.uint32(13)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features of one text."""
    if not text:
        return np.empty(0, np.int64)
    codes, over, got = _codes(text), max(SIZES) - 1, []
    for at in range(0, len(codes), CHUNK):
        got.append(np.unique(np.concatenate(list(_hashed(codes[at : at + CHUNK + over])))))
    return np.unique(np.concatenate(got)).astype(np.int64)


@dataclass
class Model:
    """weight: of each feature, 0 for those left out; report: the setting taken and its figures on rows left out."""

    weight: np.ndarray
    bias: float
    report: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Texts are hashed together, up to about CHUNK code points; what the weights leave out is dropped at once."""
        out = np.full(len(texts), self.bias)
        used = self.weight != 0
        rows, held, size = [], [], 0

        def flush() -> None:
            codes = np.concatenate(held)
            owner = np.repeat(np.asarray(rows), [len(x) for x in held])
            hits = [np.empty(0, np.int64)]
            for n, h in zip(SIZES, _hashed(codes), strict=True):
                at = np.flatnonzero(used[h])
                at = at[owner[at] == owner[at + n - 1]]
                hits.append((owner[at].astype(np.int64) << BITS) | h[at])
            hit = np.unique(np.concatenate(hits))
            np.add.at(out, hit >> BITS, self.weight[hit & ((1 << BITS) - 1)])

        for k, text in enumerate(texts):
            if not text:
                continue
            codes = _codes(text)
            if len(codes) > CHUNK:
                out[k] += self.weight[features(text)].sum()
                continue
            rows.append(k)
            held.append(codes)
            size += len(codes)
            if size > CHUNK:
                flush()
                rows, held, size = [], [], 0
        if held:
            flush()
        return 1 / (1 + np.exp(-out))


BLOCK = 4096


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task with each feature, by fold and class, in compressed blocks of features."""
    held = np.zeros((FOLDS + 1, 2, 1 << BITS), np.int32)
    for batch in batches:
        for text, y, fold in zip(*(batch[c].to_pylist() for c in ("text", "y", "fold")), strict=True):
            held[fold, y, features(text)] += 1
    blocks = range(0, 1 << BITS, BLOCK)
    packed = [zlib.compress(np.ascontiguousarray(held[:, :, at : at + BLOCK]).tobytes(), 1) for at in blocks]
    yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK for at in blocks], pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])


def _summed(pdf):
    import pandas as pd

    total = np.zeros((FOLDS + 1) * 2 * BLOCK, np.int32)
    for counts in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(counts), np.int32)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def class_counts(rows: DataFrame) -> np.ndarray:
    """For each fold and class (y: 0, 1) the number of rows with each feature: 40 MB, whatever the number of rows."""
    out = np.zeros((FOLDS + 1, 2, 1 << BITS), np.int32)
    for block, counts in rows.mapInArrow(_count, "block int, counts binary").groupBy("block").applyInPandas(_summed, "block int, counts binary").collect():
        out[:, :, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zlib.decompress(counts), np.int32).reshape(FOLDS + 1, 2, -1)
    return out


def chosen_features(seen: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of most evidence, best first, and their log-count ratios. seen: rows of each class with each feature; n: rows of each class."""
    p = seen + SMOOTHING
    ratio = np.log(p[1] / (n[1] + 2 * SMOOTHING)) - np.log(p[0] / (n[0] + 2 * SMOOTHING))
    evidence = np.where(seen.sum(axis=0) >= LEAST, np.abs(ratio) / np.sqrt(1 / p[0] + 1 / p[1]), 0)
    best = np.argsort(-evidence, kind="stable")[:most]
    best = best[evidence[best] > 0]
    return best, ratio[best]


def _bags(kept: np.ndarray):
    """For each row one bit for each kept feature."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.packbits(np.isin(kept, features(t), assume_unique=True)).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], batch["fold"], pa.array(got, pa.binary())], ["doc_id", "y", "fold", "bag"])

    return bags


@dataclass
class Bags:
    """Sparse 0/1 rows, in order of row."""

    row: np.ndarray
    col: np.ndarray
    n: int

    def only(self, rows: np.ndarray, place: np.ndarray) -> Bags:
        """The marked rows, numbered anew, with the columns that have a place."""
        number = np.where(rows, np.cumsum(rows) - 1, -1)
        held = (number[self.row] >= 0) & (place[self.col] >= 0)
        return Bags(number[self.row[held]], place[self.col[held]], int(rows.sum()))

    def sums(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.col], self.n)


def logistic(bags: Bags, scale: np.ndarray, y: np.ndarray, ridge: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias on the bags times scale: Adam on the full batch, classes balanced."""
    n, k = len(y), len(scale)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(k + 1)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = bags.sums(w[:k] * scale) + w[k]
        g = balance * (1 / (1 + np.exp(-z)) - y) / n
        grad = np.append(np.bincount(bags.col, g[bags.row], k) * scale + ridge * w[:k] / n, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:k], float(w[k])


def calibrated(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic of z that fits y best: Newton's method, with a weak pull of the slope to 0."""
    size = float(z.std()) or 1.0
    a, theta, pull = np.stack([z / size, np.ones(len(z))], axis=1), np.zeros(2), np.asarray([1e-3, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        theta -= np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(pull + 1e-9), a.T @ (p - y) + pull * theta)
    return (float(theta[0] / size), float(theta[1])) if np.isfinite(theta).all() and theta[0] > 0 else (1.0, 0.0)


def area(z: np.ndarray, y: np.ndarray) -> float:
    """Share of (label 1, label 0) pairs that z has in the right order, ties by half."""
    _, inverse, count = np.unique(z, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    ones = y.sum()
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))


def _figures(z: np.ndarray, y: np.ndarray) -> dict[str, float]:
    p, said = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9), z >= 0
    recall = [float((said == y)[y == c].mean()) for c in (0, 1)]
    return {"log_loss": float(-np.where(y == 1, np.log(p), np.log(1 - p)).mean()), "accuracy": float((said == y).mean()), "balanced_accuracy": sum(recall) / 2, "recall": recall[1], "area": area(z, y)}


def _tried(bags: Bags, y: np.ndarray, fold: np.ndarray, choices: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[int, tuple[float, float], dict[str, float]]:
    """The best setting of GRID by the rows left out, its slope and offset, and its figures. choices: of each fold's complement the columns and their ratios, best first."""
    inside, best = fold < FOLDS, None
    for setting, (most, ridge) in enumerate(GRID):
        z = np.zeros(len(y))
        for k, (columns, ratio) in enumerate(choices):
            place = np.full(width, -1)
            place[columns[:most]] = np.arange(len(columns[:most]))
            scale = ratio[:most] / max(1e-9, np.abs(ratio[:most]).max(initial=0))
            learnt, out = inside & (fold != k), fold == k
            w, bias = logistic(bags.only(learnt, place), scale, y[learnt], ridge)
            z[out] = bags.only(out, place).sums(w * scale) + bias
        slope, offset = calibrated(z[inside], y[inside])
        figures = _figures(slope * z[inside] + offset, y[inside])
        if best is None or figures["log_loss"] < best[2]["log_loss"]:
            best = setting, (slope, offset), figures
    return best


def fit(docs: DataFrame, labels: DataFrame, learn, max_rows: int = 12_000, fold_rows: int = 3000) -> Model:
    """learn: a condition on doc_id that says which labels may be learnt from."""
    weight = np.zeros(1 << BITS, np.float32)
    # At most max_rows rows, so that these windows are small whatever the input.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = chosen_labels(labels, "toxic", learn, max_rows).withColumn("place", F.row_number().over(order))
    folds = (F.row_number().over(Window.partitionBy("y").orderBy("place")) % FOLDS).cast("int")
    chosen = chosen.select("doc_id", "y", F.when(F.col("place") <= fold_rows, folds).otherwise(F.lit(FOLDS)).alias("fold"))
    rows = write_table(with_texts(chosen, docs), "toxicity-rows")
    n = np.zeros((FOLDS + 1, 2), np.int64)
    for fold, y, count in rows.groupBy("fold", "y").count().collect():
        n[fold, y] = count
    if not n.sum(axis=0).all():
        share = (n[:, 1].sum() + 0.5) / (n.sum() + 1)
        drop_table(rows)
        return Model(weight, float(np.log(share / (1 - share))))
    seen, most = class_counts(rows), max(m for m, _ in GRID)
    final, ratio = chosen_features(seen.sum(axis=0), n.sum(axis=0), most)
    inside, n_inside = seen[:FOLDS].sum(axis=0), n[:FOLDS].sum(axis=0)
    can_try = bool((n_inside - n[:FOLDS] > 0).all() and (n_inside > 1).all())
    parts = [chosen_features(inside - seen[k], n_inside - n[k], most) for k in range(FOLDS)] if can_try else []
    kept = np.unique(np.concatenate([final, *(p for p, _ in parts)]))
    got = rows.mapInArrow(_bags(kept), "doc_id long, y int, fold int, bag binary").toPandas().sort_values("doc_id")
    drop_table(rows)
    y, fold = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    bits = np.unpackbits(np.frombuffer(b"".join(got["bag"]), np.uint8).reshape(len(y), -1), axis=1, count=len(kept)) if len(kept) else np.zeros((len(y), 0), np.uint8)
    bags = Bags(*np.nonzero(bits), len(y))
    setting, (slope, offset), report = 2, (1.0, 0.0), {}
    if can_try:
        setting, (slope, offset), report = _tried(bags, y, fold, [(np.searchsorted(kept, p), r) for p, r in parts], len(kept))
    most, ridge = GRID[setting]
    final, ratio = final[:most], ratio[:most]
    place = np.full(len(kept), -1)
    place[np.searchsorted(kept, final)] = np.arange(len(final))
    scale = ratio / max(1e-9, np.abs(ratio).max(initial=0))
    w, bias = logistic(bags.only(np.ones(len(y), bool), place), scale, y, ridge)
    weight[final] = (slope * w * scale).astype(np.float32)
    return Model(weight, slope * bias + offset, {"features": most, "ridge": ridge} | report)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted, for each row of docs. The model has a fixed size (4 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, predicted int")
