"""Matrices for learners: blocks of both kinds, states that are fitted on one view and applied to all, codes and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.metrics import quantiles
from ..schema import categorical_columns, numeric_columns
from . import blocks
from .states import CoverageBackoff, SurfaceProfiles

#: Blocks with a state that is fitted.
STATEFUL = {"G": CoverageBackoff, "T": SurfaceProfiles}
#: Codes of all columns with which their tables are broadcast, at most.
BROADCAST_CODES = 100_000


def apply_views(fit_on: DataFrame, views: Mapping[str, DataFrame], wanted: str | Sequence[str]) -> dict[str, DataFrame]:
    """Each view with the wanted blocks, in order: those without a state from the view's own rows, those with one fitted on
    the rows of fit_on alone."""
    out = dict(views)
    base = fit_on
    for b in blocks.normalise(wanted):
        if b in STATEFUL:
            state = STATEFUL[b]().fit(base)
            out = {n: state.apply(v) for n, v in out.items()}
        else:
            out = {n: blocks.apply_blocks(v, b) for n, v in out.items()}
            base = blocks.apply_blocks(base, b)
    return out


def train_matrix(df: DataFrame, wanted: str | Sequence[str], target: str = "target") -> tuple[DataFrame, list[str], list[str]]:
    """The rows with blocks, and the names of categorical and numeric features."""
    made = apply_views(df, {"rows": df}, wanted)["rows"]
    skipped = {"id", target, "Churn", "split"}
    return made, [c for c in categorical_columns(made) if c not in skipped], numeric_columns(made, skipped)


def test_matrix(train: DataFrame, test: DataFrame, wanted: str | Sequence[str]) -> DataFrame:
    """The test rows with blocks; states are those of the training rows."""
    return apply_views(train, {"test": test}, wanted)["test"]


test_matrix.__test__ = False  # no test, though its name begins like one


@dataclass
class Codes:
    """Numbers of categories from 1 on in alphabetical order; 0 for values that the fit hasn't seen."""

    columns: Sequence[str]
    tables: Mapping[str, DataFrame] | None = None

    def fit(self, df: DataFrame) -> Codes:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in self.columns])).alias("x")).select("x.*").distinct()
        lists = cells.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("values"))  # categories are few
        coded = saved(lists.select("column", F.posexplode("values").alias("code", "value")).withColumn("code", F.col("code") + 1))  # read once for all columns
        sent = F.broadcast if coded.count() <= BROADCAST_CODES else lambda table: table
        self.tables = {c: sent(coded.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"code_{c}"))) for c in self.columns}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            df = df.join(self.tables[c], F.coalesce(F.col(c).cast("string"), F.lit("nan")) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}").withColumn(f"code_{c}", F.coalesce(f"code_{c}", F.lit(0)))
        return df


@dataclass
class Scaling:
    """Numbers with their medians for what is missing, less the mean and by the population deviation (or by 1 if that is 0)
    of the filled numbers."""

    columns: Sequence[str]
    fitted: DataFrame | None = None

    def fit(self, df: DataFrame) -> Scaling:
        out = None
        for c in self.columns:
            one = quantiles(df, [], c, {f"_med_{c}": 0.5})
            out = one if out is None else out.crossJoin(one)  # one row each
        out = saved(out)
        filled = df.crossJoin(F.broadcast(out))
        x = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"_med_{c}")) for c in self.columns}
        moments = filled.agg(*[f(e).alias(f"_{n}_{c}") for c, e in x.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
        self.fitted = saved(out.crossJoin(moments))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        x = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"_med_{c}")) for c in self.columns}
        std = {c: F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(1.0) for c in self.columns}
        out = df.crossJoin(F.broadcast(self.fitted)).withColumns({f"z_{c}": (e - F.col(f"_mean_{c}")) / std[c] for c, e in x.items()})  # one row
        return out.drop(*[f"_{n}_{c}" for c in self.columns for n in ("med", "mean", "std")])
