"""Weighted distances between vectors: Column builders and the same as NumPy kernels, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _gap(a: Column, b: Column, f: Callable[[Column], Column], w: Column | None) -> Column:
    parts = F.zip_with(a, b, lambda x, y: f(x.cast("double") - y.cast("double")))
    return _sum(parts if w is None else F.zip_with(parts, w, lambda p, q: p * q))


@dataclass(frozen=True)
class Metric:
    """A distance that sums a part for each component; ``root`` takes the square root of the sum.

    column and array say what a gap between two components adds, as a Column and as NumPy; square says
    that this is the square of the gap, for which matrix products can be used.
    """

    column: Callable[[Column], Column]
    array: Callable[[np.ndarray], np.ndarray]
    root: bool = False
    square: bool = False

    def __call__(self, a: Column, b: Column, w: Column | None = None) -> Column:
        total = _gap(a, b, self.column, w)
        return F.sqrt(total) if self.root else total


_SQUARE = (lambda d: d * d, lambda d: d * d)
#: Metric by name, for Columns, kernels and training alike. Register own ones here.
METRICS: dict[str, Metric] = {"squared_euclidean": Metric(*_SQUARE, square=True), "euclidean": Metric(*_SQUARE, root=True, square=True), "manhattan": Metric(F.abs, np.abs)}


def metric_of(name: str) -> Metric:
    """A registered metric; an unknown name is an error."""
    if name not in METRICS:
        raise ValueError(f"no metric {name!r}; known are {', '.join(sorted(METRICS))}")
    return METRICS[name]


def squared_euclidean(a: Column, b: Column, w: Column | None = None) -> Column:
    return METRICS["squared_euclidean"](a, b, w)


def euclidean(a: Column, b: Column, w: Column | None = None) -> Column:
    return METRICS["euclidean"](a, b, w)


def manhattan(a: Column, b: Column, w: Column | None = None) -> Column:
    return METRICS["manhattan"](a, b, w)


def positive_weights(w: Column) -> Column:
    """Learned parameters to weights: exp of each, so zeros weigh 1."""
    return F.transform(w, lambda x: F.exp(x))


def hinge(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def row_pairs(metric: str, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distance of each row of a to the same row of b, from the differences, so that equal vectors are exactly 0 apart."""
    m = metric_of(metric)
    total = (m.array(a - b) * w).sum(1)
    return np.sqrt(total) if m.root else total


def kernel(metric: str, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact distances of all rows of a to all rows of b under weights w."""
    m, out = metric_of(metric), np.empty((len(a), len(b)))
    for i in range(len(a)):
        out[i] = (m.array(b - a[i]) * w).sum(1)
    return np.sqrt(out) if m.root else out


def sums(metric: str, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums before any root of all rows of a to all rows of b, how far off each may be by row of a).

    Squares go through one matrix product; other metrics are exact.
    """
    m = metric_of(metric)
    if not m.square:
        return kernel(metric, a, b, w) ** (2 if m.root else 1), np.zeros(len(a))
    x, y = a * np.sqrt(w), b * np.sqrt(w)
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    return np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0.0), 1e-9 * (1.0 + xx + (yy.max() if len(yy) else 0.0))
