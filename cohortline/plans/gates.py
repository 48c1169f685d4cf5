"""Decisions: check records, the gate over three reports, and a chain of corrections against the incumbent's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.metrics import auc
from ..operators import blend as B
from ..operators import folds as L
from . import protocol as P

# The gate's thresholds.
MAX_ADVERSARIAL_AUC, MAX_HIGH_PSI, MAX_HIGH_TVD, HIGH_DRIFT = 0.58, 2, 2, 0.2
MIN_OVER_BASELINE, MIN_OVER_EQUAL, MAX_STD, MAX_OPTIMISM = 0.0002, 0.00005, 0.0015, 0.00005


def record(name: str, ok: Column, value: Column, otherwise: str = "FAIL") -> Column:
    """A check as a struct: PASS if it holds, else `otherwise`; a check of a missing value doesn't hold."""
    return F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(otherwise).alias("status"), value.cast("double").alias("value"))


def gate(report: DataFrame, max_warnings: int = 0, require_parity: bool = True, has_rank: bool = True) -> tuple[DataFrame, DataFrame]:
    """Checks and the decision of a one-row report with parity_status, adversarial_auc, high_psi, high_tvd, weighted_mean,
    weighted_std, weighted_optimism, equal_mean, rank_mean and baseline_auc. GO without failures and with no more warnings
    than allowed."""
    c = F.col
    over = c("weighted_mean") - c("baseline_auc")
    records = [
        record("parity_overall_status", c("parity_status") == "PASS", (c("parity_status") == "PASS").cast("int"), "FAIL" if require_parity else "WARN"),
        record("drift_adversarial_auc", c("adversarial_auc") <= MAX_ADVERSARIAL_AUC, c("adversarial_auc")),
        record("drift_high_psi_count", c("high_psi") <= MAX_HIGH_PSI, c("high_psi")), record("drift_high_tvd_count", c("high_tvd") <= MAX_HIGH_TVD, c("high_tvd")),
        record("weighted_delta_vs_baseline", over >= MIN_OVER_BASELINE, over),
        record("weighted_delta_vs_equal", c("weighted_mean") - c("equal_mean") >= MIN_OVER_EQUAL, c("weighted_mean") - c("equal_mean"), "WARN"),
        *([record("weighted_delta_vs_rank", c("weighted_mean") >= c("rank_mean"), c("weighted_mean") - c("rank_mean"), "WARN")] if has_rank else []),
        record("weighted_cv_std", c("weighted_std") <= MAX_STD, c("weighted_std"), "WARN"), record("weighted_optimism", c("weighted_optimism") <= MAX_OPTIMISM, c("weighted_optimism"), "WARN"),
    ]
    checks = report.select(F.explode(F.array(*records)).alias("x")).select("x.*")
    v = P.verdict(checks)
    return checks, v.select(F.when((F.col("fail") == 0) & (F.col("warn") <= max_warnings), "GO").otherwise("NO_GO").alias("decision"), "pass", "warn", "fail")


def drift_counts(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """One row: columns of high drift by the stability index and by the total variation distance."""
    high = lambda d, c, n: d.agg(F.coalesce(F.sum((F.col(c) >= HIGH_DRIFT).cast("long")), F.lit(0)).alias(n))
    return high(numeric, "psi", "high_psi").crossJoin(high(categorical, "tvd", "high_tvd"))


def adversarial_severity(value: Column) -> Column:
    """How well training and test rows can be told apart."""
    return F.when(value < 0.58, "low").when(value < 0.65, "moderate").when(value < 0.75, "high").otherwise("critical")


def repeated_aucs(df: DataFrame, predictions: Sequence[str], repeats: int = 5, folds: int = 5, seed: int = 42, y: str = "target", id_column: str = "id") -> DataFrame:
    """repeat, fold, prediction (its column) and the AUC of fixed predictions in each, for all repeats and predictions in one
    pass: a row counts once for each repeat, in the fold that the hash order of that repeat's seed gives it within its label."""
    each = F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat")
    held = F.array(*[F.col(p).cast("double") for p in predictions]).alias("_all")
    rows = df.select(id_column, F.col(y).alias("_y"), held, each).withColumn("_stratum", F.concat_ws(":", F.col("repeat").cast("string"), F.col("_y").cast("string")))
    rows = rows.withColumn("_key", F.concat_ws(":", (F.col("repeat") + seed).cast("string"), F.col(id_column).cast("string")))
    dealt = L.stratified_folds(rows, folds, "", "_stratum", "_key")
    sides = F.explode(F.array(*[F.struct(F.lit(p).alias("prediction"), F.col("_all")[i].alias("_p")) for i, p in enumerate(predictions)])).alias("x")
    return auc(dealt.select("repeat", "fold", "_y", sides).select("repeat", "fold", "_y", "x.*"), ["repeat", "fold", "prediction"], "_y", "_p")


def repeated_auc(df: DataFrame, p: str, repeats: int = 5, folds: int = 5, seed: int = 42, y: str = "target", id_column: str = "id") -> DataFrame:
    """repeat, fold and the AUC of one prediction in each."""
    return repeated_aucs(df, [p], repeats, folds, seed, y, id_column).drop("prediction")


def repeated_stats(each: DataFrame, prefix: str = "cv") -> DataFrame:
    return each.agg(F.count("*").alias("folds"), F.avg("auc").alias(f"{prefix}_mean_auc"), F.stddev_pop("auc").alias(f"{prefix}_std_auc"), F.min("auc").alias(f"{prefix}_min_auc"), F.max("auc").alias(f"{prefix}_max_auc"))


def chain_against_incumbent(df: DataFrame, steps: Mapping[str, tuple[Column, str]], incumbent: Sequence[str], candidate: Sequence[str], reference: str = "reference_pred") -> DataFrame:
    """df with the incumbent's chain as reference_pred and the candidate's as candidate_pred. steps: mask and prediction's
    column by name; both orders name some of them."""
    unknown = [s for s in [*incumbent, *candidate] if s not in steps]
    if unknown or not incumbent or not candidate:
        raise ValueError(f"Chains need known steps; unknown: {unknown}")
    made = {n: B.chain(reference, [steps[s] for s in order]) for n, order in (("_incumbent", incumbent), ("candidate_pred", candidate))}
    return df.withColumns(made).drop(reference).withColumnRenamed("_incumbent", "reference_pred")


def chain_report(df: DataFrame, test: DataFrame, stage: str = "smoke", repeats: int = 5, folds: int = 5, **options) -> DataFrame:  # noqa: ANN003
    """The protocol's checks of a frame of chain_against_incumbent, with both sides' deviations over repeated folds."""
    sides = ["candidate_pred", "reference_pred"]
    df = saved(df.select("id", "target", "segment3", "segment5", *sides, "candidate_loss", "reference_loss"))  # read by several jobs
    stds = {r["prediction"]: r["s"] for r in repeated_aucs(df, sides, repeats, folds).groupBy("prediction").agg(F.stddev_pop("auc").alias("s")).collect()}  # two rows
    return P.checks(df, test, stage, candidate_cv_std=stds.get(sides[0]), reference_cv_std=stds.get(sides[1]), **options)
