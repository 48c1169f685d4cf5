"""The factorisation machine of FMClassifier, fitted over blocks: the same start, gradients and steps (AdamW on all rows), so
that the model is the same but for rounding.

Rows are packed once, with a place for each category and the numbers as they are; a step is one pass over the blocks, which
adds up gradients for each partition. Only the sums, as many as there are parameters, reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from .codes import ScaledCodes, ScaledCodesModel


def _score(places: np.ndarray, x: np.ndarray, scales: np.ndarray, v: np.ndarray, w: np.ndarray, w0: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and sums of factors by features, of rows given by the places of their categories and scaled numbers."""
    first, k = len(scales) - x.shape[1], v.shape[1]
    t = v[:first] * scales[:first, None]
    table = np.column_stack([t, scales[:first] * w[:first], (t * t).sum(1)])
    s = np.column_stack([x @ v[first:], x @ w[first:], (x * x) @ (v[first:] ** 2).sum(1)])
    for at in places:
        s += table.take(at, 0)
    return w0 + s[:, k] + 0.5 * (np.einsum("ij,ij->i", s[:, :k], s[:, :k]) - s[:, k + 1]), s[:, :k]


def _probability(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # the exponential of a very low score is infinite, its probability 0
        return 1 / (1 + np.exp(-z))


def _gradient(places: np.ndarray, x: np.ndarray, y: np.ndarray, scales: np.ndarray, v: np.ndarray, w: np.ndarray, w0: float) -> np.ndarray:
    """The sum of the log loss's gradients by factors, weights and the constant."""
    first = len(scales) - x.shape[1]
    z, s = _score(places, x, scales, v, w, w0)
    q = _probability(z) - y
    each = [q, *(s * q[:, None]).T]
    by_place = np.zeros((1 + v.shape[1], first))
    for at in places:
        by_place += [np.bincount(at, e, first) for e in each]
    once = np.concatenate([by_place[0] * scales[:first], x.T @ q])
    squares = np.concatenate([by_place[0] * scales[:first] ** 2, (x * x).T @ q])
    with_sums = np.vstack([by_place[1:].T * scales[:first, None], x.T @ (s * q[:, None])])
    return np.concatenate([(with_sums - v * squares[:, None]).ravel(), once, [q.sum()]])


def _parts(p: np.ndarray, width: int, factors: int) -> tuple[np.ndarray, np.ndarray, float]:
    return p[: width * factors].reshape(width, factors), p[width * factors : -1], p[-1]


class Factorised(Estimator):
    """Fits on categories and numbers, scaled as ScaledCodes does; labels are 0 and 1."""

    def __init__(self, categorical: Sequence[str], numeric: Sequence[str], label: str, factors: int, steps: int, seed: int, rate: float = 1.0, spread: float = 0.01, tolerance: float = 1e-6):
        super().__init__()
        self.categorical, self.numeric, self.label = list(categorical), list(numeric), label
        self.factors, self.steps, self.seed = factors, steps, seed
        self.rate, self.spread, self.tolerance = rate, spread, tolerance

    def _start(self, df: DataFrame, width: int) -> np.ndarray:
        draws = df.sparkSession._jvm.java.util.Random(self.seed)  # as FMClassifier draws its factors
        return np.array([draws.nextGaussian() * self.spread for _ in range(width * self.factors)] + [0.0] * (width + 1))

    def _fit(self, df: DataFrame) -> FactorisedModel:
        codes = ScaledCodes(self.categorical, self.numeric).fit(df)
        scales, many, factors = np.array(codes.scales), len(self.categorical), self.factors
        width = len(scales)
        numbers = scales[width - len(self.numeric) :]

        def pack(batches):
            for b in batches:
                if any(c.null_count for c in b.columns):
                    raise ValueError("A label or a number is null")
                y, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                x = np.column_stack([np.zeros((b.num_rows, 0)), *columns[many:]])
                if not np.isin(y, (0.0, 1.0)).all() or np.isnan(x).any():
                    raise ValueError("A label is neither 0 nor 1, or a number is NaN")
                places = np.array(columns[:many], np.int32).reshape(many, b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (y, places, x)], ["y", "places", "x"])

        blocks = saved(df.select(F.col(self.label).cast("double"), *codes.places(), *codes.numbers()).mapInArrow(pack, "y binary, places binary, x binary"))  # read by every step

        def step(p: np.ndarray) -> tuple[np.ndarray, int]:
            parts = _parts(p, width, factors)

            def run(batches):
                total, n = np.zeros(len(p)), 0
                for b in batches:
                    for cells in zip(*(c for c in b.columns)):
                        y, x = (np.frombuffer(cells[i].as_buffer()) for i in (0, 2))
                        places = np.frombuffer(cells[1].as_buffer(), np.int32).reshape(many, len(y))
                        total += _gradient(places, x.reshape(len(y), len(numbers)) * numbers, y, scales, *parts)
                        n += len(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p) + 1, dtype=np.int32)), pa.array(np.append(total, float(n)))], ["k", "v"])

            sums = np.zeros(len(p) + 1)
            for r in blocks.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row for each parameter
                sums[r.k] = r.v
            return sums[:-1], sums[-1]

        p = self._start(df, width)
        mean, square = np.zeros(len(p)), np.zeros(len(p))
        for i in range(1, self.steps + 1):
            g, n = step(p)
            if not n:
                raise ValueError("There are no rows to fit on")
            mean, square = 0.9 * mean + 0.1 * g / n, 0.999 * square + 0.001 * (g / n) ** 2
            move = self.rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
            p = p - move
            if i > 1 and np.linalg.norm(move) < self.tolerance * max(np.linalg.norm(p), 1.0):
                break
        return FactorisedModel(codes, p, factors)


class FactorisedModel(Model):
    def __init__(self, codes: ScaledCodesModel, parameters: np.ndarray, factors: int):
        super().__init__()
        self.codes, self.parameters, self.factors = codes, parameters, factors

    def _transform(self, df: DataFrame) -> DataFrame:
        scales, many = np.array(self.codes.scales), len(self.codes.values)
        parts = _parts(self.parameters, len(scales), self.factors)
        numbers = scales[len(scales) - len(self.codes.numeric) :]

        @F.pandas_udf("double")
        def score(columns: pd.DataFrame) -> pd.Series:
            x = columns.iloc[:, many:].to_numpy(float)
            if np.isnan(x).any():
                raise ValueError("A number is null or NaN")
            return pd.Series(_probability(_score(columns.iloc[:, :many].to_numpy(np.int32).T, x * numbers, scales, *parts)[0]))

        p = score(F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*self.codes.places(), *self.codes.numbers()])]))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))
