"""Scaled columns of categories and numbers, for learners."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ScaledCodes(Estimator):
    """`features`: for each category one column of 0 and 1 a value, the most frequent first, and one for null and unseen
    values, then the numbers; all over their deviations. They are those that StringIndexer, OneHotEncoder, VectorAssembler
    and StandardScaler make, but fitted by two plain aggregates and made by one function in place of one for each stage."""

    def __init__(self, categorical: Sequence[str], numeric: Sequence[str]):
        super().__init__()
        self.categorical, self.numeric = list(categorical), list(numeric)

    def _fit(self, df: DataFrame) -> ScaledCodesModel:
        n, *deviations = df.agg(F.count("*"), *[F.stddev_samp(F.col(c).cast("double")) for c in self.numeric]).first()
        # values in all combinations first, so that rows aren't repeated for each column
        cells = df.select(*[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(self.categorical)])
        cells = cells.groupBy(*cells.columns).agg(F.count("*").alias("_n"))
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_{i}").alias("value"), "_n") for i in range(len(self.categorical))]).cast("array<struct<i:int,value:string,_n:bigint>>")).alias("x")
        counts = cells.select(each).groupBy("x.i", "x.value").agg(F.sum("x._n").alias("n")).filter("value IS NOT NULL").collect()  # values are few
        values, scales = {}, []
        for i, c in enumerate(self.categorical):
            own = sorted((-r.n, r.value) for r in counts if r.i == i)
            values[c] = [v for _, v in own]
            sizes = [-m for m, _ in own]
            scales += [((n * (n - 1)) / (m * (n - m))) ** 0.5 if 0 < m < n else 0.0 for m in [*sizes, n - sum(sizes)]]
        scales += [1 / s if s else 0.0 for s in deviations]
        return ScaledCodesModel(values, self.numeric, scales)


class ScaledCodesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """values: of each category, in the order of their columns; scales: of all columns. All are kept as one text, which is
    saved and loaded with pipelines."""

    state = Param(Params._dummy(), "state", "values, numeric and scales as JSON", TypeConverters.toString)

    def __init__(self, values: Mapping[str, Sequence[str]] | None = None, numeric: Sequence[str] = (), scales: Sequence[float] = ()):
        super().__init__()
        self._set(state=json.dumps([list((values or {}).items()), list(numeric), [float(x) for x in scales]]))

    @property
    def values(self) -> dict[str, list[str]]:
        return dict(json.loads(self.getOrDefault(self.state))[0])

    @property
    def numeric(self) -> list[str]:
        return json.loads(self.getOrDefault(self.state))[1]

    @property
    def scales(self) -> list[float]:
        return json.loads(self.getOrDefault(self.state))[2]

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = []
        for c, values in self.values.items():
            x = F.col(c).cast("string")
            known = F.coalesce(x.isin(*values), F.lit(False)) if values else F.lit(False)
            columns += [*[F.coalesce(x == v, F.lit(False)) for v in values], ~known]
        columns = [F.when(x, s).otherwise(0.0) for x, s in zip(columns, self.scales)]
        columns += [x * s for x, s in zip(self.numbers(), self.scales[len(columns) :])]
        made = {f"_f{i}": x for i, x in enumerate(columns)}
        return VectorAssembler(inputCols=list(made), outputCol="features").transform(df.withColumns(made)).drop(*made)

    def places(self) -> list[Column]:
        """For each category the place, among all columns, of the one that is not 0."""
        out, first = [], 0
        for c, values in self.values.items():
            x = F.col(c).cast("string")
            out.append(F.coalesce(*[F.when(x == v, F.lit(first + i)) for i, v in enumerate(values)], F.lit(first + len(values))).cast("int"))
            first += len(values) + 1
        return out

    def numbers(self) -> list[Column]:
        """As they are, not scaled."""
        return [F.col(c).cast("double") for c in self.numeric]
