"""Ridge regression from sums of products, so that many fits over nested rows read the rows once.

A Gram matrix holds the sums of products of ``[1, x, y]`` over some rows. Matrices of disjoint rows add up:
the fit of a fold, or of everything before a step, comes from matrices of parts, not from the rows again.
Values are taken relative to one row of the table, which keeps the sums well conditioned and constant columns
exactly zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REG = 0.01
HELD = 256  # matrices that one task adds up at a time


@dataclass(frozen=True)
class Frame:
    """The row that values are relative to: flattened ``x``, then ``y``."""

    origin: np.ndarray

    @classmethod
    def of(cls, sequences: DataFrame) -> "Frame":
        row = sequences.filter("y is not null").select(F.flatten("x").alias("x"), "y").first()
        values = [*row["x"], row["y"]] if row else [0.0]
        return cls(np.nan_to_num(np.array([0.0 if v is None else v for v in values], np.float64)))

    @property
    def width(self) -> int:
        """Side of a Gram matrix."""
        return len(self.origin) + 1

    def rows(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        """``[1, x, y]`` of a batch with ``x`` and ``y``, relative to the origin; nulls become NaN."""
        x, y = batch["x"], batch["y"]
        if isinstance(x, pa.ChunkedArray):
            x, y = x.combine_chunks(), y.combine_chunks()
        out = np.ones((len(y), self.width))
        if len(y):
            out[:, 1:-1] = x.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(y), -1)
        out[:, -1] = y.to_numpy(zero_copy_only=False)
        out[:, 1:] -= self.origin
        return out

    def packed(self, matrix: np.ndarray) -> np.ndarray:
        return matrix[np.triu_indices(self.width)]

    def unpacked(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, self.width))
        out[np.triu_indices(self.width)] = values
        return out + np.triu(out, 1).T


def product(rows: np.ndarray) -> np.ndarray:
    """The Gram matrix of the rows that are whole."""
    good = rows[np.isfinite(rows).all(1)]
    return good.T @ good


def solve(gram: np.ndarray, reg: float = REG) -> np.ndarray | None:
    """Weights of ``[1, x]`` (relative values) of the ridge fit, or None without rows.

    The penalty is on standardised columns and label, as in ``pyspark.ml``'s LinearRegression with
    ``standardization``: with unit deviations it is ``reg`` over the label's deviation. A column
    without spread has weight 0; a label without spread is predicted by its mean.
    """
    n = gram[0, 0]
    if n == 0:
        return None
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    # What rounding leaves of a spread that is none.
    spread[spread <= 1e-9 * np.sqrt(np.maximum(np.diag(gram)[1:] / n, 0.0))] = 0.0
    weights = np.zeros(len(mean))
    used, label = spread[:-1] > 0, spread[-1]
    if label > 0 and used.any():
        scale = spread[:-1][used]
        inner = cov[:-1, :-1][np.ix_(used, used)] / np.outer(scale, scale)
        inner[np.diag_indices_from(inner)] += reg / label
        weights[1:][used] = np.linalg.solve(inner, cov[:-1, -1][used] / (scale * label)) * label / scale
    weights[0] = mean[-1] - weights[1:] @ mean[:-1]
    return weights


def grams(rows: DataFrame, key: str, frame: Frame) -> DataFrame:
    """``key, entry, value``: the packed Gram matrix of each whole-number ``key``.

    Every task adds up its rows per key before the shuffle, so a key may hold any share of the rows.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for k in sums:
                yield pa.RecordBatch.from_pydict({key: pa.array([k], pa.int64()), "g": pa.array([frame.packed(sums[k]).tolist()], pa.list_(pa.float64()))})
            sums.clear()

        for batch in batches:
            keys, z = batch[key].to_numpy(zero_copy_only=False), frame.rows(batch)
            for k in np.unique(keys).tolist():
                part = product(z[keys == k])
                sums[k] = sums[k] + part if k in sums else part
                if len(sums) >= HELD:
                    yield from told()
        yield from told()

    parts = rows.select(F.col(key).cast("long").alias(key), "x", "y").mapInArrow(add_up, f"{key} long, g array<double>")
    return parts.select(key, F.posexplode("g").alias("entry", "value")).groupBy(key, "entry").agg(F.sum("value").alias("value"))


def running(parts: DataFrame, key: str) -> DataFrame:
    """``key, g``: for each key the matrix of all smaller keys. Every entry is a running sum of its own."""
    earlier = Window.partitionBy("entry").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("value", F.coalesce(F.sum("value").over(earlier), F.lit(0.0)))
    entries = F.array_sort(F.collect_list(F.struct("entry", "value")))
    return summed.groupBy(key).agg(F.transform(entries, lambda e: e["value"]).alias("g"))


def collected(parts: DataFrame, key: str, frame: Frame) -> dict[int, np.ndarray]:
    """Matrices of a few keys on the driver."""
    found: dict[int, np.ndarray] = {}
    for r in parts.collect():
        found.setdefault(r[key], np.zeros(frame.width * (frame.width + 1) // 2))[r["entry"]] = r["value"]
    return {k: frame.unpacked(v) for k, v in found.items()}


def predicted(weights: np.ndarray, rows: np.ndarray, frame: Frame) -> np.ndarray:
    """Predictions in the label's own units; NaN where ``x`` is not whole."""
    return rows[:, :-1] @ weights + frame.origin[-1]


def nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))
