"""Row selection and rewriting: bands, hard examples, pseudo labels, counterfactual scenarios, rank queries and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.metrics import quantiles
from .blend import array_statistics
from .folds import order_hash

#: The family of the dominant cohort.
DOMINANT = "Electronic check__Month-to-month__Fiber optic"


def band_summary(df: DataFrame, family: Column, p: str, width: float, teachers: Sequence[str] = (), min_std: float | None = None) -> DataFrame:
    """One row: rows, family_rows, band_rows, baseline_rows (both), final_rows (with the teachers that disagree enough), and
    relative_drift, the share of the baseline that this leaves out (0 without a baseline)."""
    inside, near = F.coalesce(family, F.lit(False)), F.coalesce(F.abs(F.col(p) - 0.5) <= width, F.lit(False))
    final = inside & near & (F.coalesce(array_statistics(teachers)["std"] >= min_std, F.lit(False)) if min_std is not None else F.lit(True))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    row = df.agg(F.count("*").alias("rows"), n(inside).alias("family_rows"), n(near).alias("band_rows"), n(inside & near).alias("baseline_rows"), n(final).alias("final_rows"))
    drift = F.when(F.col("baseline_rows") > 0, F.abs(F.col("final_rows") - F.col("baseline_rows")) / F.col("baseline_rows")).otherwise(0.0)
    return row.withColumn("relative_drift", drift)


def uncertainty_band(df: DataFrame, family: Column, p: str, width: float, teachers: Sequence[str] = (), min_std: float | None = None, max_drift: float | None = None) -> DataFrame:
    """in_band: of the family, within width of one half, and with teachers that disagree by min_std at least. With max_drift
    it fails if that condition leaves out a larger share of the band."""
    if not 0 < width < 0.5:
        raise ValueError(f"A band's half width lies in (0, 0.5): {width}")
    if max_drift is not None:
        drift = band_summary(df, family, p, width, teachers, min_std).first()["relative_drift"]
        if drift > max_drift:
            raise ValueError(f"The teachers' condition leaves out {drift:.6f} of the band, more than {max_drift}")
    inside = family & (F.abs(F.col(p) - 0.5) <= width)
    if min_std is not None:
        inside = inside & (array_statistics(teachers)["std"] >= min_std)
    return df.withColumn("in_band", inside.cast("int"))


def hard_examples(df: DataFrame, family: Column, score: Column, q: float) -> DataFrame:
    """hard: rows of the family with a score at or over its exact q-quantile within the family."""
    limit = quantiles(df.filter(family).select(score.alias("_score")), [], "_score", {"_limit": q})
    return df.crossJoin(F.broadcast(limit)).withColumn("hard", (family & (score >= F.col("_limit"))).cast("int")).drop("_limit")


def pseudo_rows(df: DataFrame, teachers: Sequence[str], low: float, high: float, max_std: float | None = None, unanimous: bool = True) -> DataFrame:
    """Rows whose mean teacher is at or beyond a bound, on which all teachers are on one side of one half, with the label
    of that side."""
    stats = array_statistics(teachers)
    out = df.withColumns({"pseudo_p": stats["mean"], "pseudo_std": stats["std"]}).filter((F.col("pseudo_p") >= high) | (F.col("pseudo_p") <= low))
    if unanimous:
        a = F.array(*teachers)
        out = out.filter(F.forall(a, lambda x: x >= 0.5) | F.forall(a, lambda x: x < 0.5))
    if max_std is not None:
        out = out.filter(F.col("pseudo_std") <= max_std)
    return out.withColumn("pseudo_label", (F.col("pseudo_p") >= 0.5).cast("int"))


def pseudo_summary(chosen: DataFrame, target: str = "target", min_rows: int = 0) -> DataFrame:
    """One row of pseudo_rows: how many, of which label, mean prediction, deviation and confidence, and, if there are min_rows
    at least, the share of right labels in all and of each label; null where there are none."""
    y, label = F.col(target), F.col("pseudo_label")
    right = (y == label).cast("double")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    row = chosen.agg(
        F.count("*").alias("selected_rows"), n(label == 1).alias("selected_positive_rows"), n(label == 0).alias("selected_negative_rows"), F.avg("pseudo_p").alias("selected_mean"),
        F.avg("pseudo_std").alias("teacher_std_mean"), F.avg(F.greatest(F.col("pseudo_p"), 1 - F.col("pseudo_p"))).alias("mean_confidence"),
        F.avg(right).alias("accuracy"), F.avg(F.when(label == 1, right)).alias("positive_precision"), F.avg(F.when(label == 0, right)).alias("negative_precision"),
    )
    enough = F.col("selected_rows") >= min_rows
    return row.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_confidence", "accuracy", "positive_precision", "negative_precision")})


def training_rows(df: DataFrame, p: str, weight: float, soft: bool = True, confidence: bool = True) -> DataFrame:
    """A hard label for each row, or with soft=True two rows, weighted by the probability of each label; with confidence
    the weights also by twice the distance from one half."""
    c = F.least(F.greatest(2 * F.abs(F.col(p) - 0.5), F.lit(0.0)), F.lit(1.0)) if confidence else F.lit(1.0)
    if not soft:
        return df.withColumns({"label": (F.col(p) >= 0.5).cast("int"), "weight": c * weight})
    both = F.array(F.struct(F.lit(1).alias("label"), (F.col(p) * c * weight).alias("weight")), F.struct(F.lit(0).alias("label"), ((1 - F.col(p)) * c * weight).alias("weight")))
    return df.withColumn("_x", F.explode(both)).select(*df.columns, "_x.label", "_x.weight")


SCENARIOS = ("auto_payment", "paperless_off", "contract_upgrade", "stability_bundle")


def counterfactuals(df: DataFrame, scenarios: Sequence[str] = SCENARIOS) -> DataFrame:
    """A row for each scenario, with the columns as they would be; a longer contract is one step, taken at once."""
    out = df.withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios))))
    on = lambda s: F.col("scenario").isin(s, "stability_bundle")
    manual = F.col("PaymentMethod").isin("Electronic check", "Mailed check")
    upgraded = F.when(F.col("Contract") == "Month-to-month", "One year").when(F.col("Contract") == "One year", "Two year").otherwise(F.col("Contract"))
    return out.withColumns({
        "PaymentMethod": F.when(on("auto_payment") & manual, "Bank transfer (automatic)").otherwise(F.col("PaymentMethod")),
        "PaperlessBilling": F.when(on("paperless_off"), "No").otherwise(F.col("PaperlessBilling")),
        "Contract": F.when(on("contract_upgrade"), upgraded).otherwise(F.col("Contract")),
    })


QUERY_LEVELS = {
    "segment5": K.segment5(), "segment3": K.segment3(), "contract_internet_tenure": f"{K.key('Contract', 'InternetService')} || '__' || {K.tenure_bin()}",
    "contract_tenure": f"{K.key('Contract')} || '__' || {K.tenure_bin()}", "contract": K.key("Contract"),
}


def query_groups(df: DataFrame, min_rows: int, min_positive: int, min_negative: int, target: str = "target") -> DataFrame:
    """query_level and query_group: the finest level whose group has enough rows of each kind, else global."""
    out = df.withColumns({f"_{n}": F.expr(e) for n, e in QUERY_LEVELS.items()})
    source = out
    for n in QUERY_LEVELS:
        stats = source.groupBy(f"_{n}").agg(F.count("*").alias("_rows"), F.sum(target).alias("_pos"))
        ok = (F.col("_rows") >= min_rows) & (F.col("_pos") >= min_positive) & (F.col("_rows") - F.col("_pos") >= min_negative)
        out = out.join(stats.select(f"_{n}", ok.alias(f"_ok_{n}")), f"_{n}")
    level = F.coalesce(*[F.when(F.col(f"_ok_{n}"), F.lit(n)) for n in QUERY_LEVELS], F.lit("global"))
    group = F.coalesce(*[F.when(F.col(f"_ok_{n}"), F.col(f"_{n}")) for n in QUERY_LEVELS], F.lit("__GLOBAL__"))
    return out.select(*df.columns, level.alias("query_level"), group.alias("query_group"))


def rank_pairs(df: DataFrame, group: str, max_pairs: int, target: str = "target", id_column: str = "id", seed: int = 0) -> DataFrame:
    """Pairs of a positive and a negative row of each group: all of them if no more than max_pairs, else the i-th positive
    with negatives at the same and later places in hash order, which gives max_pairs without forming all.

    No place from max_pairs on is in a pair, so that only the ranges of hashes that begin before it are ordered."""
    keyed = df.select(group, target, id_column).withColumn("_h", order_hash(seed, id_column)).withColumn("_r", F.substring("_h", 1, 3))
    counts = keyed.groupBy(group, target, "_r").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group, target).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("_before", before).filter(F.col("_before") < max_pairs).select(group, target, "_r")
    place = F.row_number().over(Window.partitionBy(group, target).orderBy("_h", id_column)) - 1
    rows = keyed.join(wanted, [group, target, "_r"], "left_semi").select(group, target, id_column, place.alias("_i"))
    stats = df.groupBy(group).agg(F.sum(target).alias("_p"), F.sum(1 - F.col(target)).alias("_n"))
    pos = rows.filter(F.col(target) == 1).join(stats, group).filter("_n > 0")
    pos = pos.withColumn("_take", F.least(F.col("_n"), F.ceil(F.lit(max_pairs) / F.col("_p"))).cast("bigint"))
    pos = pos.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_take") - 1))).withColumn("_j", F.pmod(F.col("_i") + F.col("_k"), F.col("_n")))
    pos = pos.filter(F.col("_k") * F.col("_p") + F.col("_i") < max_pairs).select(group, F.col(id_column).alias("positive_id"), "_j")
    neg = rows.filter(F.col(target) == 0).select(F.col(group).alias("_g"), F.col(id_column).alias("negative_id"), F.col("_i").alias("_m"))
    return pos.join(neg, (F.col(group) == F.col("_g")) & (F.col("_j") == F.col("_m"))).select(group, "positive_id", "negative_id")
