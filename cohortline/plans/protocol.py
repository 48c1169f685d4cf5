"""Family metrics of a candidate against a reference, and the checks that decide about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.metrics import auc, logloss
from ..operators.select import DOMINANT

#: The protocol's thresholds.
MIN_DELTA, MAX_DOMINANT, MAX_TARGET, MAX_DAMAGE, MAX_STD_RATIO = 1e-5, -2e-4, -1e-4, 0.03, 1.15
LARGE, MICRO, PROMOTABLE = (5000, 2000), (1000, 400), (2000, 800)
STAGES = ("smoke", "midcap", "submission")


def analysis(accounts: DataFrame) -> DataFrame:
    """Training rows with both levels of family and the losses of both predictions."""
    out = accounts.withColumns({"segment3": F.expr(K.segment3()), "segment5": F.expr(K.segment5())})
    return out.withColumns({"reference_loss": logloss("target", "reference_pred"), "candidate_loss": logloss("target", "candidate_pred")})


def family_metrics(df: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """Both levels in one pass: each row counts for its segment3 and its segment5. df and test have segment3, segment5."""
    levels = F.explode(F.array(*[F.struct(F.lit(x).alias("family_level"), F.col(x).alias("family_value")) for x in ("segment3", "segment5")])).alias("f")
    each = df.select(levels, "target", "reference_pred", "candidate_pred", "reference_loss", "candidate_loss").select("f.*", "target", "reference_pred", "candidate_pred", "reference_loss", "candidate_loss")
    by = ["family_level", "family_value"]
    table = each.groupBy(*by).agg(F.count("*").alias("train_rows"), F.sum("target").alias("positive_rows"), F.avg(F.col("target").cast("double")).alias("positive_rate"), F.avg("reference_loss").alias("reference_logloss"), F.avg("candidate_loss").alias("candidate_logloss"))
    total = df.agg(F.count("*").alias("_all"))
    for side in ("reference", "candidate"):
        table = table.join(auc(each, by, "target", f"{side}_pred", f"{side}_auc"), by)
    table = table.crossJoin(F.broadcast(total))
    table = table.withColumns({f"{s}_contribution": F.col(f"{s}_logloss") * F.col("train_rows") / F.col("_all") for s in ("reference", "candidate")}).drop("_all")
    table = table.withColumns({"delta_auc": F.col("candidate_auc") - F.col("reference_auc"), "relative_delta": (F.col("candidate_contribution") - F.col("reference_contribution")) / F.greatest(F.abs("reference_contribution"), F.lit(1e-12))})
    if test is not None:
        counts = test.select(levels).select("f.*").groupBy(*by).agg(F.count("*").alias("test_rows"))
        table = table.join(counts, by, "left").withColumn("test_rows", F.coalesce("test_rows", F.lit(0)))
    return table


def checks(df: DataFrame, test: DataFrame, stage: str = "submission", target_family: str | None = None, sister_family: str | None = None, dominant: str = DOMINANT, top: int = 3, candidate_cv_std: float | None = None, reference_cv_std: float | None = None, trace: str | None = None) -> DataFrame:
    """check, status, value: a row for each check of the stage. All come from the family table and the total AUCs, but for
    those of the deviations over folds, from the midcap stage on, and of the submission's file (`trace`)."""
    if stage not in STAGES:
        raise ValueError(f"Unknown stage {stage!r}")
    table = saved(family_metrics(df, test))  # one row for each family, read by every check
    total = auc(df, [], "target", "candidate_pred", "c").crossJoin(auc(df, [], "target", "reference_pred", "r")).select((F.col("c") - F.col("r")).alias("value"))
    row = lambda d, name, ok: d.select(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"), F.col("value").cast("double").alias("value"))
    seg3, seg5 = (table.filter(F.col("family_level") == x) for x in ("segment3", "segment5"))
    of = lambda d, v: d.filter(F.col("family_value") == v).agg(F.max("delta_auc").alias("value"))
    large = (F.col("train_rows") >= LARGE[0]) | (F.col("test_rows") >= LARGE[1])
    ranked = seg5.withColumn("_any", F.max(large).over(Window.partitionBy("family_level"))).filter(large | ~F.col("_any"))
    damage = ranked.orderBy(F.desc("reference_contribution"), F.desc("train_rows"), "family_value").limit(top).agg(F.max("relative_delta").alias("value"))
    micro = seg5.filter("relative_delta < 0").agg(F.coalesce(F.avg(((F.col("train_rows") < MICRO[0]) | (F.col("test_rows") < MICRO[1])).cast("double")), F.lit(0.0)).alias("value"))
    out = [
        row(total, "split_a_delta_auc", F.col("value") >= MIN_DELTA), row(of(seg3, dominant), "split_b_dominant_family", F.col("value") >= MAX_DOMINANT),
        row(damage, "split_b_top_damage_families", F.col("value") <= MAX_DAMAGE), row(micro, "micro_family_dependence", F.col("value") < 1),
    ]
    one = df.sparkSession.range(1)
    given = lambda value, name, ok: one.select(F.lit(name).alias("check"), F.lit("PASS" if ok else "FAIL").alias("status"), F.lit(value).cast("double").alias("value"))
    if stage != "smoke":
        stable = candidate_cv_std is not None and reference_cv_std is not None and candidate_cv_std <= reference_cv_std * MAX_STD_RATIO
        out.append(given(candidate_cv_std, "midcap_cv_std", stable))
    if stage == "submission":
        out.append(given(float(trace is not None), "submission_trace_artifacts", trace is not None))
    if target_family:
        level = seg5 if target_family.count("__") == 4 else seg3
        mine = level.filter(F.col("family_value") == target_family)
        out.append(row(mine.agg(F.count("*").alias("value")), "target_family_presence", F.col("value") > 0))
        if stage != "smoke":
            out.append(row(of(level, target_family), "target_family_on_mask_auc", F.col("value") >= MAX_TARGET))
        if stage == "submission":
            enough = mine.agg(F.coalesce(F.max(((F.col("train_rows") >= PROMOTABLE[0]) & (F.col("test_rows") >= PROMOTABLE[1])).cast("int")), F.lit(0)).alias("value"))
            out.append(row(enough, "target_family_promotable_support", F.col("value") == 1))
            sister = sister_family or K.sister_family(target_family)
            if sister:
                out.append(row(of(seg5, sister), "sister_family_guardrail", F.col("value") >= MAX_TARGET))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def verdict(checked: DataFrame) -> DataFrame:
    """One row: FAIL if any check fails, else WARN if any warns, else PASS, and the counts."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0))
    return checked.agg(F.when(n("FAIL") > 0, "FAIL").when(n("WARN") > 0, "WARN").otherwise("PASS").alias("verdict"), *[n(s).cast("long").alias(s.lower()) for s in ("PASS", "WARN", "FAIL")])


def overall(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: rows, AUC, log loss, Brier score, mean error, rates and the calibration gap."""
    x = df.agg(F.count("*").alias("n"), F.avg(logloss(y, p)).alias("logloss"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), F.avg(F.col(y).cast("double")).alias("positive_rate"), F.avg(p).alias("pred_mean"), F.stddev_pop(p).alias("pred_std"))
    return x.crossJoin(auc(df, [], y, p)).withColumn("calibration_gap", F.col("pred_mean") - F.col("positive_rate"))


def group_metrics(df: DataFrame, dimensions: dict[str, str], y: str, p: str, min_rows: int = 1) -> DataFrame:
    """dimension, value and metrics of all groups with enough rows, for all dimensions in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.expr(e).cast("string").alias("value")) for n, e in dimensions.items()])).alias("g")
    each = df.select(cells, F.col(y).alias("y"), F.col(p).alias("p"), logloss(y, p).alias("loss")).select("g.*", "y", "p", "loss")
    by = ["dimension", "value"]
    table = each.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("positive_rate"), F.avg("p").alias("pred_mean"), F.avg("loss").alias("logloss"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    return table.filter(F.col("n") >= min_rows).join(auc(each, by, "y", "p"), by).withColumn("calibration_gap", F.col("pred_mean") - F.col("positive_rate"))


def rollup(groups: DataFrame) -> DataFrame:
    """Means of each dimension's group metrics, weighted by rows; groups without an AUC don't count in that mean."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(c)
    return groups.groupBy("dimension").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), *[weighted(c) for c in ("auc", "logloss", "mae")])
