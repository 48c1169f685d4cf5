"""Scans of candidates over grids, signals of counterfactual scenarios, chains on test rows, and robustness of ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.metrics import auc, average_rank
from . import blend as B
from . import folds as L

# The grid of the simple blend, and the scenario that holds all others.
SIMPLE = (0.05, 0.10, 0.15, 0.20, 0.25)
BUNDLE = "stability_bundle"


def fixed_blend(df: DataFrame, candidate: str, reference: str = "reference_pred", y: str = "target") -> DataFrame:
    """One row: the weight of the candidate, of a fixed grid from 0 on, with the highest AUC, that AUC and what it gains
    over the reference. A later weight counts only if it gains more than 1e-12."""
    scanned = B.scan(df, (0.0, *SIMPLE), B.blended(reference, candidate), y)
    rows = scanned.agg(F.array_sort(F.collect_list(F.struct("pos", "alpha", "auc"))).alias("x"))  # six rows
    first = F.col("x")[0]
    start = F.struct(first["alpha"].alias("alpha"), first["auc"].alias("auc"))
    best = F.aggregate("x", start, lambda a, r: F.when(r["auc"] > a["auc"] + 1e-12, F.struct(r["alpha"].alias("alpha"), r["auc"].alias("auc"))).otherwise(a))
    return rows.select(best.alias("b"), first["auc"].alias("_r")).select(F.col("b.alpha").alias("best_alpha"), F.col("b.auc").alias("best_auc"), (F.col("b.auc") - F.col("_r")).alias("delta_vs_reference"))


def rank_blend(df: DataFrame, alphas: Sequence[float], mask: Column, score: str, reference: str = "reference_pred", y: str = "target", id_column: str = "id") -> DataFrame:
    """AUC for each alpha, over all rows and over the mask's, of (1 - alpha) times the reference and alpha times its values
    reassigned within the mask by the order of a score."""
    inside = B.reassign(df.filter(mask).withColumn("_all", F.lit(1)), score, reference, "_all", id_column, "_moved").select(F.col(id_column).alias("_id"), "_moved")
    rows = df.join(inside, df[id_column] == F.col("_id"), "left").withColumn("_mask", F.col("_moved").isNotNull())
    combined = F.when(F.col("_mask"), (1 - F.col("alpha")) * F.col(reference) + F.col("alpha") * F.col("_moved")).otherwise(F.col(reference))
    return B.scan(rows, alphas, combined, y).join(B.scan(rows.filter("_mask"), alphas, combined, y).withColumnRenamed("auc", "auc_on_mask"), ["pos", "alpha"])


def counterfactual_signals(scored: DataFrame, weights: Mapping[str, float], scenarios: Sequence[str], id_column: str = "id") -> DataFrame:
    """Signals of scenarios for each row: scored has id, scenario ('base' or one of scenarios) and each model's pred_<name>.

    Weights are brought to a sum of one; predictions are clipped. A drop is what the base is above a scenario, or 0."""
    total = sum(weights.values())
    blended = reduce(lambda a, b: a + b, [F.col(f"pred_{m}") * (w / total) for m, w in weights.items()])
    rows = scored.select(id_column, "scenario", F.greatest(F.least(blended, F.lit(1 - 1e-6)), F.lit(1e-6)).alias("p"))
    wide = rows.groupBy(id_column).agg(*[F.max(F.when(F.col("scenario") == s, F.col("p"))).alias(f"cf_{s}_pred") for s in ("base", *scenarios)]).withColumnRenamed("cf_base_pred", "cf_base_teacher_pred")
    base = F.col("cf_base_teacher_pred")
    wide = wide.withColumns({f"cf_{s}_delta": F.col(f"cf_{s}_pred") - base for s in scenarios} | {f"cf_{s}_positive_drop": F.greatest(base - F.col(f"cf_{s}_pred"), F.lit(0.0)) for s in scenarios})
    drops = F.array(*[f"cf_{s}_positive_drop" for s in scenarios])
    made = {"cf_mean_positive_drop": F.aggregate(drops, F.lit(0.0), lambda a, x: a + x) / len(scenarios), "cf_max_positive_drop": F.array_max(drops)}
    return wide.withColumns(made | ({"cf_stable_bundle_drop": F.col(f"cf_{BUNDLE}_positive_drop")} if BUNDLE in scenarios else {}))


def signal_scan(df: DataFrame, signals: Sequence[str], alphas: Sequence[float], mask: Column, reference: str = "reference_pred", y: str = "target") -> DataFrame:
    """signal, alpha, auc, delta and the signal's mean and deviation on the mask, for all pairs and, first, the reference
    alone: the clipped reference plus alpha times the signal, on the mask."""
    grid = [("reference", 0.0, -1)] + [(s, float(a), i) for i, (s, a) in enumerate((s, a) for s in signals for a in alphas)]
    value = lambda s: F.lit(None).cast("double") if s == "reference" else F.col(s).cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(a).alias("alpha"), F.lit(i).alias("pos"), value(s).alias("v")) for s, a, i in grid]))
    rows = df.select(F.col(y).alias("_y"), F.col(reference).alias("_r"), F.coalesce(mask, F.lit(False)).alias("_m"), each.alias("g")).select("_y", "_r", "_m", "g.*")
    moved = F.greatest(F.least(F.col("_r") + F.col("alpha") * F.col("v"), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = rows.withColumn("_s", F.when(F.col("_m") & (F.col("pos") >= 0), moved).otherwise(F.col("_r")))
    by = ["signal", "alpha", "pos"]
    inside = rows.filter("_m").groupBy(*by).agg(F.count("*").alias("mask_rows"), F.avg("v").alias("signal_mean"), F.stddev_pop("v").alias("signal_std"))
    out = auc(rows, by, "_y", "_s").join(inside, by, "left")
    base = out.filter("pos = -1").select(F.col("auc").alias("_base"))
    return out.crossJoin(F.broadcast(base)).withColumn("delta", F.col("auc") - F.col("_base")).drop("_base")  # one row


def best_signal(scanned: DataFrame) -> DataFrame:
    """The first pair with the highest AUC that gains more than 1e-15, or the reference."""
    rows = scanned.agg(F.array_sort(F.collect_list(F.struct("pos", "signal", "alpha", "auc"))).alias("x"))  # a row for each pair of the grid
    keep = lambda r: F.struct(r["signal"].alias("signal"), r["alpha"].alias("alpha"), r["auc"].alias("auc"))
    return rows.select(F.aggregate("x", keep(F.col("x")[0]), lambda a, r: F.when(r["auc"] > a["auc"] + 1e-15, keep(r)).otherwise(a)).alias("b")).select("b.*")


def chain_submission(df: DataFrame, steps: Sequence[tuple[str, Column, Column, float]], reference: str = "reference_pred", mode: str = "previous") -> tuple[DataFrame, DataFrame]:
    """The chained prediction `chained` of each row, and step, name, mask_rows, changed_rows, mean and largest shift against
    what was before it. steps: name, mask, residual and alpha; mode 'previous' corrects what the step before has left,
    'base' always the reference."""
    if mode not in ("previous", "base"):
        raise ValueError(f"Unknown mode {mode!r}")
    if not steps or any(not 0 <= a <= 1 for *_, a in steps):
        raise ValueError("A chain needs steps with alphas from 0 to 1")
    clip = lambda x: F.greatest(F.least(x, F.lit(1 - 1e-6)), F.lit(1e-6))
    out = df.withColumn("_at0", F.col(reference))
    for i, (_, mask, residual, alpha) in enumerate(steps):
        start = F.col(f"_at{i}" if mode == "previous" else reference)
        out = out.withColumn(f"_at{i + 1}", F.when(mask, clip(start + alpha * residual)).otherwise(F.col(f"_at{i}")))
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), F.coalesce(m, F.lit(False)).cast("long").alias("m"), F.abs(F.col(f"_at{i + 1}") - F.col(f"_at{i}")).alias("d")) for i, (n, m, _, _) in enumerate(steps)]))
    each = out.select(rows.alias("x")).select("x.*")
    report = each.groupBy("step", "name").agg(F.sum("m").alias("mask_rows"), F.sum((F.col("d") > 1e-15).cast("long")).alias("changed_rows"), F.avg("d").alias("mean_shift"), F.max("d").alias("max_shift"))
    return out.withColumn("chained", F.col(f"_at{len(steps)}")).drop(*[f"_at{i}" for i in range(len(steps) + 1)]), report


def override_prediction(df: DataFrame, mask: Column, specialist: Column, alpha: float, reference: str = "reference_pred") -> DataFrame:
    """specialist_mask, specialist_pred (null outside) and prediction: the reference, on the mask blended with a specialist."""
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must lie between 0 and 1: {alpha}")
    inside = F.coalesce(mask, F.lit(False))
    return df.withColumns({"specialist_mask": inside.cast("int"), "specialist_pred": F.when(inside, specialist), "prediction": F.when(inside, (1 - alpha) * F.col(reference) + alpha * specialist).otherwise(F.col(reference))})


def robustness(df: DataFrame, models: Sequence[str], repeats: int = 3, folds: int = 5, seed: int = 42, y: str = "target", id_column: str = "id", weighted: bool = False, step: float = 0.02, rounds: int = 25) -> DataFrame:
    """method, cv_mean_auc, cv_std_auc, cv_min_auc, cv_max_auc, full_auc and optimism (full less mean) of ensembles with
    equal weights and of mean ranks, over repeated folds; ranks are those within a fold's rows. With weighted=True also of
    weights by coordinate descent, fitted on the other folds: a job for each of its rounds, for all folds together."""
    equal = reduce(lambda a, b: a + b, [F.col(m) for m in models]) / len(models)
    each = F.explode(F.array(*[F.lit(r) for r in range(repeats)]))
    rows = df.select(F.col(id_column).alias("_id"), F.col(y).alias("_y"), *models, each.alias("repeat"))
    rows = rows.withColumns({"_stratum": F.concat_ws(":", F.col("repeat").cast("string"), F.col("_y").cast("string")), "_key": F.concat_ws(":", (F.col("repeat") + seed).cast("string"), F.col("_id").cast("string"))})
    dealt = saved(L.stratified_folds(rows, folds, "", "_stratum", "_key").select("repeat", "fold", "_id", "_y", *models))  # read for each model's ranks
    by = ["repeat", "fold"]

    def ranks(frame: DataFrame, within: list[str]) -> DataFrame:
        source = frame
        for m in models:
            frame = average_rank(frame, within, m, f"_r_{m}", pct=False, source=source)
        return frame.withColumn("_s", reduce(lambda a, b: a + b, [F.col(f"_r_{m}") for m in models]) / len(models))

    plain = saved(df.select(F.col(y).alias("_y"), *models))
    found = {"equal": (auc(dealt.withColumn("_s", equal), by, "_y", "_s"), auc(plain.withColumn("_s", equal), [], "_y", "_s", "full_auc")), "rank": (auc(ranks(dealt, by), by, "_y", "_s"), auc(ranks(plain, []), [], "_y", "_s", "full_auc"))}
    out = None
    for method, (cv, full) in found.items():
        part = cv.agg(F.avg("auc").alias("cv_mean_auc"), F.stddev_pop("auc").alias("cv_std_auc"), F.min("auc").alias("cv_min_auc"), F.max("auc").alias("cv_max_auc")).crossJoin(full)  # one row each
        part = part.select(F.lit(method).alias("method"), "*", (F.col("full_auc") - F.col("cv_mean_auc")).alias("optimism"))
        out = part if out is None else out.unionByName(part)
    if weighted:
        out = out.unionByName(_weighted(dealt, plain, models, repeats, folds, step, rounds))
    return out


def _weighted(dealt: DataFrame, plain: DataFrame, models: Sequence[str], repeats: int, folds: int, step: float, rounds: int) -> DataFrame:
    """The row of weights by descent: those of all folds and of all rows (as repeat -1) are fitted together."""
    whole = plain.select(F.lit(-1).alias("repeat"), F.lit(0).alias("fold"), "_y", *models)
    rows = saved(dealt.select(F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold"), "_y", *models).unionByName(whole))
    fits = [(-1, -1), *[(r, f) for r in range(repeats) for f in range(folds)]]
    fitted = B.batched_descent(rows, fits, models, "_y", step, rounds)
    table = [(r, f, *w) for (r, f), (w, _) in fitted.items() if r >= 0]
    names = [f"_w{j}" for j in range(len(models))]
    weights = F.broadcast(plain.sparkSession.createDataFrame(table, "repeat int, fold int, " + ", ".join(f"{n} double" for n in names)))
    blended = reduce(lambda a, b: a + b, [F.col(w) * F.col(m) for w, m in zip(names, models)])
    held = auc(rows.join(weights, ["repeat", "fold"]).withColumn("_s", blended), ["repeat", "fold"], "_y", "_s")
    full = fitted[-1, -1][1]
    cv = held.agg(F.avg("auc").alias("cv_mean_auc"), F.stddev_pop("auc").alias("cv_std_auc"), F.min("auc").alias("cv_min_auc"), F.max("auc").alias("cv_max_auc"))
    return cv.select(F.lit("weighted").alias("method"), "*", F.lit(full).alias("full_auc"), (F.lit(full) - F.col("cv_mean_auc")).alias("optimism"))


def renormalised(weights: Mapping[str, float], available: Sequence[str]) -> dict[str, float]:
    """The weights of the components that are there, brought to a sum of one."""
    kept = {m: w for m, w in weights.items() if m in available}
    total = sum(kept.values())
    if total <= 0:
        raise ValueError(f"None of the components {sorted(weights)} is available with a weight")
    return {m: w / total for m, w in kept.items()}


def clipped(p: str) -> Column:
    return F.expr(K.clip(p))
