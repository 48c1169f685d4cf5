"""Exact metrics, ranks and quantiles as DataFrame plans without a task that holds all rows. All three first count distinct
values; quantiles save the counts, which they read several times."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from .keys import clip

#: Ranges that the numbers between a power of two and the next one fall into.
RANGES = 512


def logloss(y: str, p: str) -> Column:
    """Of one row; predictions are clipped to [1e-6, 1 - 1e-6]."""
    return F.expr(f"-({y} * ln({clip(p)}) + (1 - {y}) * ln(1 - {clip(p)}))")


def _logs(x: pd.Series) -> pd.Series:
    return pd.Series([math.log(v) if v > 0 else math.nan for v in x], x.index, "float64")


def comparable_logloss(y: str, p: str) -> Column:
    """The same with the C library's logarithm, as other engines have it; Spark's own is off by a last digit in places, so
    that losses of predictions that are next to each other compare in another way."""
    ln, clipped = F.pandas_udf(_logs, "double"), F.expr(clip(p))
    return -(F.col(y) * ln(clipped) + (1 - F.col(y)) * ln(1 - clipped))


def value_range(x: Column) -> Column:
    """The number of a double's range, which never falls as the double rises. There are RANGES of them between a power of
    two and the next, so that scores, ranks, logits and amounts of any size are spread over many."""
    size = F.least(F.abs(x), F.lit(1e300))
    octave = F.floor(F.log2(size))
    place = (octave + 1100) * RANGES + F.floor((size / F.pow(F.lit(2.0), octave.cast("double")) - 1) * RANGES)
    return F.when(size < 1e-300, F.lit(0)).otherwise(F.signum(x).cast("int") * place).cast("bigint")


def counted(df: DataFrame, by: Sequence[str], value: Column, name: str, sums: Mapping[str, Column], *also: str) -> DataFrame:
    """Each group's distinct numbers, with sums over the rows in which the value and the columns in `also` hold a number,
    neither null nor NaN; values of no such row are missing.

    The rows aren't filtered: a filter would be moved to where the columns are made, and there repeat all expressions
    behind them once for each use."""
    rows = df.select(*by, value.alias("_k"), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(also)], *[x.alias(f"_s{i}") for i, x in enumerate(sums.values())])
    number = lambda c: ~F.isnan(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
    ok = reduce(lambda a, b: a & b, map(number, ["_k", *[f"_a{i}" for i in range(len(also))]]))
    out = rows.groupBy(*by, F.col("_k").alias(name)).agg(F.count(F.when(ok, 1)).alias("_rows"), *[F.sum(F.when(ok, F.col(f"_s{i}"))).alias(n) for i, n in enumerate(sums)])
    return out.filter("_rows > 0").drop("_rows")


def cumulated(counts: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, str]) -> DataFrame:
    """counts (one row for each value of each group) with, for each name in sums, the sum of that column over the group's
    smaller values.

    First the ranges of values are summed and added up, then the values within a range: no window holds all of a group's
    values, nor one without a group all there are."""
    by = list(by)
    counts = counts.withColumn("_range", value_range(F.col(value).cast("double")))
    totals = counts.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t{i}").over(below), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "_range"]]
    joined = counts.alias("s").join(totals.alias("t"), on).select("s.*", *[f"t._b{i}" for i in range(len(sums))])
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({n: F.col(f"_b{i}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for i, (n, c) in enumerate(sums.items())})
    return out.drop("_range", *[f"_b{i}" for i in range(len(sums))])


def auc(df: DataFrame, by: Sequence[str], y: str, p: str, name: str = "auc") -> DataFrame:
    """Area under the ROC curve of each group, ties counting half; null with one class only.

    Rows without a label or a score, or with NaN as either, don't count; groups with no other rows are missing. Rows are
    reduced to counts of distinct scores first."""
    by = list(by)
    scores = counted(df, by, F.col(p).cast("double"), "_p", {"_pos": F.col(y).cast("long"), "_n": F.lit(1)}, y).withColumns({"_neg": F.col("_n") - F.col("_pos"), "_range": value_range(F.col("_p"))})
    # pairs within ranges of scores first, then those of different ranges: scores are dealt once, and not joined again
    within = Window.partitionBy(*by, "_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("_pos") * (F.coalesce(F.sum("_neg").over(within), F.lit(0)) + F.col("_neg") / 2)
    ranges = scores.withColumn("_u", pairs).groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in ("_u", "_pos", "_neg")])
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_u", F.col("_u") + F.col("_pos") * F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    total = ranges.groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    return total.select(*by, F.expr("_u / nullif(cast(_pos AS double) * _neg, 0)").alias(name))


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str, pct: bool = True, source: DataFrame | None = None) -> DataFrame:
    """df with the average rank of a value in its group, ties sharing their mean; pct: over the values that aren't null.

    Ranks are those of distinct values; rows get theirs by a join. source: where the same rows are read from, if df already
    has joins behind it that needn't be repeated."""
    by = list(by)
    counts = counted(source or df, by, F.col(value), "_v", {"_n": F.lit(1)})
    ranked = cumulated(counts, by, "_v", {"_below": "_n"}).withColumn(name, F.col("_below") + (F.col("_n") + 1) / 2)
    if pct:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
        on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
        ranked = ranked.alias("r").join(totals.alias("t"), on) if by else ranked.alias("r").crossJoin(F.broadcast(totals).alias("t"))  # one row
        ranked = ranked.select("r.*", "t._all").withColumn(name, F.col(name) / F.col("_all"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col(f"a.{value}") == F.col("b._v")]
    return df.alias("a").join(ranked.alias("b"), on, "left").select("a.*", f"b.{name}")


def quantiles(df: DataFrame, by: Sequence[str], value: str, named: Mapping[str, float], n: str | None = None) -> DataFrame:
    """Exact quantiles of each group by name, between two values by their linear interpolation; nulls and NaN don't count.
    n: a column that tells how often a row counts.

    Neither a group's values nor its distinct ones come together in one task."""
    by = list(by)
    counts = saved(counted(df, by, F.col(value).cast("double"), "_v", {"_n": F.col(n) if n else F.lit(1)}))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = cumulated(counts, by, "_v", {"_below": "_n"})
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    ranked = ranked.alias("r").join(totals.alias("t"), on) if by else ranked.alias("r").crossJoin(F.broadcast(totals).alias("t"))  # one row
    ranked = ranked.select("r.*", "t._all")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_v")))

    aggregates = []
    for n, q in named.items():
        place = F.lit(float(q)) * (F.col("_all") - 1)
        aggregates += [at(F.floor(place)).alias(f"_lo_{n}"), at(F.ceil(place)).alias(f"_hi_{n}"), F.max(place - F.floor(place)).alias(f"_f_{n}")]
    out = ranked.groupBy(*by).agg(*aggregates)
    return out.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in named])


def duck_auc(table: str, y: str, p: str, by: str = "") -> str:
    """The same by ranks, for oracles: a query of the groups and auc."""
    part = f"PARTITION BY {by} " if by else ""
    inner = f"SELECT {by + ', ' if by else ''}{y} AS y, rank() OVER ({part}ORDER BY {p}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{p}) - 1) / 2 AS r FROM {table}"
    return f"SELECT {by + ', ' if by else ''}(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(cast(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0) AS auc FROM ({inner}){' GROUP BY ' + by if by else ''}"
