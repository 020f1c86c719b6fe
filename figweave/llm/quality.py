"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
#: Levels for the share of adjacent equal words and the features behind the hashed n-grams: one bias, then the levels.
LEVELS = (0.02, 0.08, 0.2, 0.5)
BIAS = 2 << BITS
SIZE = BIAS + 2 + len(LEVELS)
#: Packed feature numbers of rows.
Rows = Sequence[bytes | memoryview]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def features(text: str | None) -> np.ndarray:
    """Ascending feature numbers that a text has: byte 3-grams and 5-grams (hashed), how often a word repeats the one before, and a bias."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    seen = np.zeros(SIZE, dtype=bool)
    seen[BIAS] = True
    b = raw.astype(np.uint32)
    for k, (base, n) in enumerate(((0, 3), (1 << BITS, 5))):
        if len(b) >= n:
            code = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                code *= np.uint32(0x01000193)
                code ^= b[i : len(b) - n + 1 + i]
            code *= np.uint32(0x9E3779B1)
            seen[base + (code >> np.uint32(32 - BITS))] = True
    inside = ~_BLANK[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(raw) else np.zeros(0, int)
    if len(starts) > 1:
        sums = np.add.reduceat(np.where(inside, raw, 0).astype(np.int64), starts)
        sizes = np.add.reduceat(inside.astype(np.int64), starts)
        share = float(np.mean((sums[1:] == sums[:-1]) & (sizes[1:] == sizes[:-1])))
        seen[BIAS + 1 + sum(share >= x for x in LEVELS)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def packed(found: np.ndarray) -> bytes:
    """Ascending feature numbers as one byte for each step to the next; 255 stands for 255 more without a number. About a quarter of the numbers' own size."""
    far, near = np.divmod(np.diff(found.astype(np.int64), prepend=-1), 255)
    out = np.full(len(found) + int(far.sum()), 255, dtype=np.uint8)
    out[np.cumsum(far + 1) - 1] = near
    return out.tobytes()


def unpacked(steps: bytes | memoryview) -> np.ndarray:
    """The feature numbers that packed() was given."""
    raw = np.frombuffer(steps, dtype=np.uint8)
    return (np.cumsum(raw, dtype=np.int64) - 1)[raw < 255]


def log_count_ratios(rows: Rows, labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of each feature's smoothed share of indicators in label 1 over that in label 0."""
    p, q = (np.full(SIZE, smooth) for _ in range(2))
    for x, y in zip(map(unpacked, rows), labels):
        (p if y else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: Rows, labels: np.ndarray, ratios: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights of the hinge-loss linear model over indicators scaled by `ratios` and by the root of their number, one dual variable at a time."""
    y = np.where(labels, 1.0, -1.0)
    w, alpha, rng = np.zeros(SIZE), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = unpacked(rows[i])  # made anew each time: all rows' numbers and values would take many times the memory of the packed rows
            value = ratios[x] / np.sqrt(len(x))
            norm = float(value @ value)
            if norm:
                grad = y[i] * float(w[x] @ value) - 1
                new = min(max(alpha[i] - grad / norm, 0.0), c)
                if new != alpha[i]:
                    w[x] += (new - alpha[i]) * y[i] * value
                    alpha[i] = new
    return w * ratios


def _margins(rows: Rows, weights: np.ndarray) -> np.ndarray:
    return np.array([float(weights[x].sum()) / np.sqrt(len(x)) for x in map(unpacked, rows)])


def _calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve 1 / (1 + exp(-(a m + b))) that fits best, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([np.sum((labels - p) * margins) - 1e-2 * a, np.sum(labels - p) - 1e-2 * b])
        v = p * (1 - p) + 1e-9
        h = np.array([[np.sum(v * margins**2) + 1e-2, np.sum(v * margins)], [np.sum(v * margins), np.sum(v) + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


class NbsvmModel:
    """Weights and calibration; picklable, of one fixed size."""

    def __init__(self, weights: np.ndarray, a: float, b: float, constant: float | None = None):
        self.weights, self.a, self.b, self.constant = weights.astype(np.float32), a, b, constant

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        x = features(text)
        m = self.a * float(self.weights[x].sum()) / np.sqrt(len(x)) + self.b
        return float(1 / (1 + np.exp(-min(max(m, -30.0), 30.0))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12_000) -> NbsvmModel:
    """Fits on the labelled ids with the max_rows smallest hashes, a documented bound: these ids are broadcast, and only their
    packed feature numbers (not texts) reach the driver, 2 to 3 KB an id. They stay packed there. Three quarters train, one quarter calibrates.
    An id that docs or labels repeat is one row: the text and the label with the smallest hash, so that the bound holds whatever repeats.

    Labels other than 0 and 1 and null ids are left out. With one class only, or none, there is nothing to tell apart: the
    score is 1, or 0 if all labels are 0.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.groupBy("id").agg(F.min_by("y", F.xxhash64("y")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [packed(features(t)) for t in b["text"]]})

    found = rows.select("id", "y", "text").mapInPandas(extract, "id long, y int, x binary").toArrow()
    y = found["y"].to_numpy().astype(bool)
    if not len(y) or y.all() or not y.any():
        return NbsvmModel(np.zeros(1), 1.0, 0.0, 1.0 if not len(y) or y.all() else 0.0)
    order = np.lexsort((y, found["id"].to_numpy()))[np.random.default_rng(7).permutation(len(y))]
    held = [v.as_buffer() for chunk in found["x"].chunks for v in chunk]  # views of the one copy that came in
    x, y = [held[i] for i in order], y[order]
    n = max(2, len(x) * 3 // 4)
    if y[:n].all() or not y[:n].any() or n == len(x) or y[n:].all() or not y[n:].any():
        n, held = len(x), slice(0, len(x))
    else:
        held = slice(n, len(x))
    ratios = log_count_ratios(x[:n], y[:n])
    weights = dual_coordinate_descent(x[:n], y[:n], ratios)
    a, b = _calibrate(_margins(x[held], weights), y[held].astype(float))
    return NbsvmModel(weights, a, b)


def score(docs: DataFrame, model: NbsvmModel, text_col: str = "text") -> DataFrame:
    """docs as (`doc` struct of all columns, `score`): one pass, no shuffle, whole texts. Null or empty text has only the bias feature."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return rows.select("doc", scored(F.col("doc").getField(text_col)).alias("score"))
