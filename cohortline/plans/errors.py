"""Errors by group: a challenger against a reference over many dimensions, hard cases, and what the groups sum up to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.metrics import auc, logloss, quantiles

# The least rows of a group in each dimension, and of a group of hard cases.
MIN_ROWS = {
    "contract": 1000, "payment_method": 1000, "internet_service": 1000, "paperless": 1000, "senior": 1000, "partner": 1000, "dependents": 1000, "tenure_bin": 1000,
    "annual_boundary": 1000, "contract_boundary": 1000, "contract_x_boundary": 2000, "segment3": 5000, "segment5_support": 1, "segment5": 2000,
}
HARD_ROWS = 2000


def with_hard_cases(df: DataFrame, quantile: float = 0.95, y: str = "target", sides: tuple[str, str] = ("reference", "challenger")) -> DataFrame:
    """df with <side>_loss and <side>_hard of both predictions <side>_pred: hard are losses at or over their exact quantile."""
    if not 0.5 < quantile < 1:
        raise ValueError(f"The quantile must lie between 0.5 and 1: {quantile}")
    out = saved(df.withColumns({f"{s}_loss": logloss(y, f"{s}_pred") for s in sides}))  # read for the limits and by each report
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_loss").alias("x")) for s in sides]))
    found = quantiles(out.select(cells.alias("c")).select("c.*"), ["side"], "x", {"limit": quantile})
    limits = found.agg(*[F.max(F.when(F.col("side") == s, F.col("limit"))).alias(f"_{s}") for s in sides])
    hard = {f"{s}_hard": (F.col(f"{s}_loss") >= F.col(f"_{s}")).cast("int") for s in sides}
    return out.crossJoin(F.broadcast(limits)).withColumns(hard).drop(*[f"_{s}" for s in sides])  # one row


def group_errors(df: DataFrame, dimensions: Mapping[str, str], min_rows: Mapping[str, int], y: str = "target") -> DataFrame:
    """A row for each group of each dimension (SQL expressions) with enough rows: rates, AUC, losses, errors and calibration
    of both sides, their differences, shifts of predictions, and shares of hard cases. df is that of with_hard_cases.

    Rows count for all dimensions in one pass, and are one count for each pair of scores and label before that."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("family"), F.coalesce(F.expr(e).cast("string"), F.lit("nan")).alias("group_value")) for n, e in dimensions.items()]))
    pc, pr, t = F.col("challenger_pred"), F.col("reference_pred"), F.col(y)
    each = df.select(cells.alias("g"), t.alias("y"), "challenger_pred", "reference_pred", "challenger_loss", "reference_loss", "challenger_hard", "reference_hard").select("g.*", "y", "challenger_pred", "reference_pred", "challenger_loss", "reference_loss", "challenger_hard", "reference_hard")
    by, t = ["family", "group_value"], F.col("y")
    means = {f"{s}_{n}": e for s, p in (("challenger", pc), ("reference", pr)) for n, e in (("logloss", F.col(f"{s}_loss")), ("brier", (p - t) ** 2), ("mae", F.abs(p - t)), ("pred_mean", p), ("hard_case_rate", F.col(f"{s}_hard")))}
    table = each.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("y").alias("positives"), F.avg("y").alias("positive_rate"), *[F.avg(e).alias(n) for n, e in means.items()], F.avg(F.abs(pc - pr)).alias("mean_abs_pred_shift"), F.avg(pc - pr).alias("signed_pred_shift"))
    least = F.create_map(*[F.lit(x) for n in dimensions for x in (n, int(min_rows[n]))])
    table = table.filter(F.col("rows") >= F.element_at(least, F.col("family")))
    for s in ("challenger", "reference"):
        table = table.join(auc(each, by, "y", f"{s}_pred", f"{s}_auc"), by)
    table = table.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))  # one row
    table = table.withColumns({f"delta_{n}": F.col(f"challenger_{n}") - F.col(f"reference_{n}") for n in ("auc", "logloss", "brier", "mae", "hard_case_rate")})
    gap = lambda s: F.col(f"{s}_pred_mean") - F.col("positive_rate")
    return table.withColumns({
        "logloss_delta_contribution": F.col("delta_logloss") * F.col("rows") / F.col("_all"), "challenger_calibration_gap": gap("challenger"), "reference_calibration_gap": gap("reference"),
        "delta_abs_calibration_gap": F.abs(gap("challenger")) - F.abs(gap("reference")),
    }).drop("_all")


def hard_cases(groups: DataFrame, df: DataFrame, least: int = HARD_ROWS) -> DataFrame:
    """Large groups with the share of the challenger's hard cases over that of all rows, the highest first."""
    overall = df.agg(F.avg("challenger_hard").alias("_rate"))
    out = groups.filter(F.col("rows") >= least).crossJoin(F.broadcast(overall))  # one row
    return out.withColumn("challenger_hard_case_lift", F.when(F.col("_rate") > 0, F.col("challenger_hard_case_rate") / F.col("_rate"))).drop("_rate").orderBy(F.desc("challenger_hard_case_lift"), F.desc("rows"), "family", "group_value")


def family_summary(groups: DataFrame) -> DataFrame:
    """Means of each dimension's groups weighted by rows; groups without an AUC don't count in its mean."""
    mean = lambda c: (F.sum(F.col(c) * F.col("rows")) / F.sum(F.when(F.col(c).isNotNull(), F.col("rows")))).alias(f"weighted_{c}")
    return groups.groupBy("family").agg(F.count("*").alias("groups"), F.sum("rows").alias("rows_sum"), *[mean(c) for c in ("delta_logloss", "delta_brier", "delta_mae", "delta_auc", "mean_abs_pred_shift", "delta_hard_case_rate")])


def selected(table: DataFrame, by: str, n: int, best: bool = True, key: tuple[str, ...] = ("family", "group_value")) -> DataFrame:
    """The n rows with the lowest (best) or highest values of a column; ties by name."""
    return table.orderBy(F.asc_nulls_last(by) if best else F.desc_nulls_last(by), *key).limit(n)
