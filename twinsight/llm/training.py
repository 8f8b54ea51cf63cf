"""Bounded labelled samples and small linear models, fitted on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_batches, stage

#: Labelled rows of each class that a classifier is fitted on.
PER_CLASS = 2500


@dataclass
class Sample:
    """`frame` has (at, label) and the columns asked for, a row for each document of the sample; labels and weights are in order of `at`."""

    frame: DataFrame
    labels: np.ndarray
    weights: np.ndarray
    known: DataFrame | None = None

    def collect(self, fn: Callable[[pa.RecordBatch], list[pa.Array]], columns: list[str], schema: str, slice_bytes: int) -> pa.Table:
        """What fn makes of the given columns, worked out by executors, in order of `at`: no text comes to the driver."""
        names = ["at", *(field.split()[0] for field in schema.split(", "))]
        run = lambda batch: pa.RecordBatch.from_arrays([batch.column(0), *fn(batch.select(columns))], names)
        return map_batches(self.frame.select("at", *(c for c in columns if c != "at")), run, f"at long, {schema}", slice_bytes).toArrow().sort_by("at")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], usable: Callable[[Column], Column] | None = None, per_class: int = PER_CLASS) -> Sample:
    """Up to `per_class` labelled documents of each class, with the given columns, staged.

    Chosen by a hash of doc_id alone, hence the same on every run and of all
    sizes; weights restore the classes' true proportions. Only ids are sorted;
    the documents are read once, against at most 2 x per_class ids. Labels
    that are null, or that contradict another row of the same document, are
    not used; the sample's `known` has (doc_id, label) of all that could be.
    Of rows that repeat a doc_id one takes part.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if usable is not None:
        known = known.where(usable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    known = stage(known, "labels")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = sorted((r["doc_id"], r["label"]) for r in chosen.collect())  # at most 2 x per_class
    ids = docs.sparkSession.createDataFrame([(i, at, y) for at, (i, y) in enumerate(ids)], "_id long, at long, label int")
    own = docs.select(F.col("doc_id").alias("_id"), F.struct(*columns).alias("own"))
    found = own.join(F.broadcast(ids), "_id").groupBy("at", "label").agg(F.max_by("own", F.xxhash64("own")).alias("own"))
    frame = stage(found.select("at", "label", "own.*"), "sample")
    y = np.array([r["label"] for r in frame.select("at", "label").orderBy("at").collect()], np.int64)
    return Sample(frame, y, class_weights(y, sizes), known)


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give the classes their true proportions, one on average."""
    weights = np.array([sizes.get(int(k), 0) / max(1, int((y == k).sum())) for k in y], float)
    return weights / weights.mean() if len(weights) else weights


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (w * (y - p)) - penalty * beta
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return beta


class Sparse:
    """Rows of (feature, value) pairs, for products with a weight vector."""

    def __init__(self, features: list[np.ndarray], values: list[np.ndarray], width: int):
        self.n, self.width = len(features), width
        self.row = np.repeat(np.arange(self.n), [len(f) for f in features])
        self.col = np.concatenate(features) if features else np.zeros(0, np.int64)
        self.val = np.concatenate(values) if values else np.zeros(0)

    def dot(self, beta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, beta[self.col] * self.val, self.n)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.val, self.width)


class AdaGrad:
    """A ridge logistic regression's weights and intercept, and what its steps have accumulated."""

    def __init__(self, width: int, ridge: float, rate: float = 0.5):
        self.beta, self.bias, self.ridge, self.rate = np.zeros(width), 0.0, ridge, rate
        self.seen, self.seen_bias = np.full(width, 1e-8), 1e-8

    def step(self, gradient: np.ndarray, of_bias: float) -> None:
        g = gradient + self.ridge * self.beta
        self.seen += g * g
        self.seen_bias += of_bias * of_bias
        self.beta -= self.rate * g / np.sqrt(self.seen)
        self.bias -= self.rate * of_bias / math.sqrt(self.seen_bias)


def sparse_logistic(x: Sparse, y: np.ndarray, w: np.ndarray, ridge: float, rounds: int = 150, rate: float = 0.5) -> AdaGrad:
    """A ridge logistic regression by AdaGrad over all rows."""
    fitted = AdaGrad(x.width, ridge, rate)
    total = max(w.sum(), 1e-9)
    for _ in range(rounds):
        r = w * (sigmoid(x.dot(fitted.beta) + fitted.bias) - y) / total
        fitted.step(x.t_dot(r), r.sum())
    return fitted


def platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn held-out scores into probabilities; targets are smoothed."""
    if len(z) == 0:
        return 1.0, 0.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = logistic(z[:, None], target, w, ridge=1e-3)
    return float(max(a, 1e-3)), float(b)


def per_worker(shared, make: Callable):
    """What a worker derives from a broadcast model, made once; only the latest model's is held."""
    if not _held or _held[0] is not shared.value:
        _held[:] = [shared.value, make(shared.value)]
    return _held[1]


_held: list = []


def folds(n: int, k: int) -> np.ndarray:
    return np.arange(n) % k
