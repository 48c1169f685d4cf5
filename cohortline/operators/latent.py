"""Learned vectors of hashed categories: field-aware factors and a perceptron over embeddings, fitted in batches.

A row is the hashed numbers of its categories, one for each field, and standardised numbers. The parameters are tables of a
fixed size, whatever the number of values: hashing bounds them. A step is one job over a batch of the rows: partitions add up
their rows' gradients as whole multiples of 2^-24, so that the sums, and the model, are equal for any number of partitions;
only the sums, no more than there are parameters, reach the driver. All folds' models are fitted together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved

#: Units of a row's gradient.
UNITS = float(1 << 24)


def hashed_rows(df: DataFrame, fields: Sequence[str], numeric: Sequence[str] = (), *, bits: int, batches: int, id_column: str = "id", target: str = "target", fold: str | None = "fold") -> DataFrame:
    """id, fold (-1 without one), y, codes, numbers and batch. A null category is a value of its own; a null or NaN number is
    the mean, 0 after scaling; rows without a target keep a null y and aren't learned from."""
    codes = [F.pmod(F.xxhash64(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("__null__"))), F.lit(1 << bits)).cast("int") for c in fields]
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    if numeric:
        aggregates = [f(e).alias(f"{n}{i}") for i, e in enumerate(x.values()) for n, f in (("a", F.avg), ("s", F.stddev_pop))]
        m = df.agg(*aggregates).first()  # one row
        scaled = [F.coalesce((e - F.lit(float(m[f"a{i}"] or 0.0))) / F.lit(float(m[f"s{i}"] or 1.0)), F.lit(0.0)) for i, e in enumerate(x.values())]
    else:
        scaled = []
    numbers = F.array(*scaled).cast("array<double>")
    of = (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold")
    batch = F.pmod(F.xxhash64(id_column), F.lit(batches)).cast("int").alias("batch")
    return df.select(F.col(id_column).alias("id"), of, F.col(target).cast("double").alias("y"), F.array(*codes).alias("codes"), numbers.alias("numbers"), batch)


@dataclass(frozen=True)
class FieldAware:
    """w0 + sum of w[f] + sum over pairs of fields i < j of <V[f_i, j], V[f_j, i]>."""

    fields: int
    values: int
    factors: int = 4
    numbers: int = 0

    @property
    def size(self) -> int:
        return 1 + self.values + self.values * self.fields * self.factors + self.numbers

    def initial(self, seed: int) -> np.ndarray:
        out = np.zeros(self.size)
        n = self.values * self.fields * self.factors
        out[1 + self.values : 1 + self.values + n] = np.random.default_rng(seed).normal(size=n) * 0.1
        return out

    def _parts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = 1 + self.values + self.values * self.fields * self.factors
        return p[1 : 1 + self.values], p[1 + self.values : n].reshape(self.values, self.fields, self.factors), p[n:]

    def scores(self, p: np.ndarray, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, v, b = self._parts(p)
        z = p[0] + w[codes].sum(1) + x @ b
        for i in range(self.fields):
            for j in range(i + 1, self.fields):
                z = z + (v[codes[:, i], j] * v[codes[:, j], i]).sum(1)
        return z

    def gradients(self, p: np.ndarray, codes: np.ndarray, x: np.ndarray, rest: np.ndarray, add) -> None:
        """add(places, values): what each row, whose loss has the derivative `rest` by its score, adds to the gradient."""
        _, v, _ = self._parts(p)
        first, last = 1 + self.values, 1 + self.values + self.values * self.fields * self.factors
        add(np.zeros(len(rest), np.int64), rest)
        add(1 + codes, np.broadcast_to(rest[:, None], codes.shape))
        k = np.arange(self.factors)
        for i in range(self.fields):
            for j in range(self.fields):
                if i != j:
                    places = first + (codes[:, i, None] * self.fields + j) * self.factors + k
                    add(places, rest[:, None] * v[codes[:, j], i])
        add(np.broadcast_to(last + np.arange(self.numbers), x.shape), rest[:, None] * x)


@dataclass(frozen=True)
class EmbeddingPerceptron:
    """Vectors of categories next to numbers, one hidden layer that drops negative values, and a weighted sum."""

    fields: int
    values: int
    width: int = 4
    hidden: int = 8
    numbers: int = 0

    @property
    def _shapes(self) -> list[tuple[int, ...]]:
        return [(self.values, self.width), (self.fields * self.width + self.numbers, self.hidden), (self.hidden,), (self.hidden,), (1,)]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self._shapes)

    def initial(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        wide = self.fields * self.width + self.numbers
        scales = (0.3, np.sqrt(2.0 / wide), 0.0, np.sqrt(1.0 / self.hidden), 0.0)
        return np.concatenate([(rng.normal(size=s) * c).ravel() for s, c in zip(self._shapes, scales)])

    def _parts(self, p: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in self._shapes])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(p, cuts), self._shapes)]

    def _layers(self, p, codes, x):
        e, w, b, v, c = self._parts(p)
        into = np.hstack([e[codes].reshape(len(codes), self.fields * self.width), x])  # of no rows too
        h = np.maximum(into @ w + b, 0.0)
        return into, h, h @ v + c[0]

    def scores(self, p: np.ndarray, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._layers(p, codes, x)[2]

    def gradients(self, p: np.ndarray, codes: np.ndarray, x: np.ndarray, rest: np.ndarray, add) -> None:
        _, w, _, v, _ = self._parts(p)
        into, h, _ = self._layers(p, codes, x)
        d = rest[:, None] * v * (h > 0)
        back = d @ w.T
        n, wide = self.values * self.width, into.shape[1]
        places = codes[:, :, None] * self.width + np.arange(self.width)
        add(places, back[:, : self.fields * self.width].reshape(places.shape))
        outer = into[:, :, None] * d[:, None, :]
        add(np.broadcast_to(n + np.arange(wide * self.hidden).reshape(wide, self.hidden), outer.shape), outer)
        n += wide * self.hidden
        add(np.broadcast_to(n + np.arange(self.hidden), d.shape), d)
        add(np.broadcast_to(n + self.hidden + np.arange(self.hidden), h.shape), rest[:, None] * h)
        add(np.full(len(rest), n + 2 * self.hidden, np.int64), rest)


def _rows(b: pa.RecordBatch, model: FieldAware | EmbeddingPerceptron) -> tuple[np.ndarray, ...]:
    c = {n: v for n, v in zip(b.schema.names, b.columns)}
    fold, y = (c[n].to_numpy(zero_copy_only=False).astype(float) for n in ("fold", "y"))
    codes = c["codes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, model.fields)
    return fold, y, codes, c["numbers"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, model.numbers)


def batch_gradient(rows: DataFrame, model: FieldAware | EmbeddingPerceptron, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log loss's gradients (models by parameters) and numbers of rows, over the rows of other folds each."""
    models, size = parameters.shape

    def run(batches):
        total, n = np.zeros((models, size), np.int64), np.zeros(models, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                fold, y, codes, x = _rows(b.slice(a, 2048), model)
                for m in range(models):
                    use = np.flatnonzero((fold != m) & ~np.isnan(y))
                    p = parameters[m]
                    rest = 1 / (1 + np.exp(-model.scores(p, codes[use], x[use]))) - y[use]
                    n[m] += len(use)

                    def add(places, values, m=m):
                        units = np.rint(np.ascontiguousarray(values).ravel() * UNITS).astype(np.int64)
                        np.add.at(total[m], np.ascontiguousarray(places).ravel(), units)

                    model.gradients(p, codes[use], x[use], rest, add)
        k = np.flatnonzero(total)
        both = np.concatenate([k, models * size + np.arange(models)])
        yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(np.concatenate([total.ravel()[k], n]))], ["k", "v"])

    out = np.zeros(models * size + models)
    for r in rows.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row for each parameter
        out[r.k] = r.v
    return out[: models * size].reshape(models, size) / UNITS, out[models * size :]


@dataclass
class Fitted:
    model: FieldAware | EmbeddingPerceptron
    parameters: np.ndarray

    def predict(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """id, fold, y and the probability by the model of the row's fold, or by the first for fold -1."""
        model, parameters = self.model, self.parameters

        def run(batches):
            for b in batches:
                fold, _, codes, x = _rows(b, model)
                z = np.zeros(b.num_rows)
                for m in range(len(parameters)):
                    at = np.flatnonzero(np.maximum(fold, 0) == m)
                    z[at] = model.scores(parameters[m], codes[at], x[at])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(1 / (1 + np.exp(-z)))], ["id", "fold", "y", name])

        kept = rows.select("id", "fold", "y", "codes", "numbers")
        kind = dict(kept.dtypes)["id"]
        return kept.mapInArrow(run, f"id {kind}, fold int, y double, {name} double")


def fit(rows: DataFrame, model: FieldAware | EmbeddingPerceptron, *, models: int = 1, epochs: int = 3, batches: int = 4, rate: float = 0.2, l2: float = 1e-3, seed: int = 7) -> Fitted:
    """One model for each fold, of the rows of the others, or one of all rows (of fold -1): after each batch a step against
    the mean gradient, each parameter's by the root of its past squares. rows: hashed_rows() with as many batches.

    An empty batch changes nothing; without rows the parameters stay as drawn."""
    rows = saved(rows)
    p = np.stack([model.initial(seed)] * models)
    past = np.full(p.shape, 1e-8)
    for _ in range(epochs):
        for b in range(batches):
            g, n = batch_gradient(rows.filter(F.col("batch") == b), model, p)
            g = g / np.maximum(n, 1)[:, None] + l2 * p * (g != 0)
            past += g * g
            p = p - rate * g / np.sqrt(past)
    return Fitted(model, p)
