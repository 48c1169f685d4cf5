"""Audits of rows and columns: duplicates and conflicting labels, noise, drift, overlap and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.metrics import quantiles
from .blend import array_statistics

#: Deviations of teachers that differ by no more are equal: the same numbers in another order may give such ones.
EQUAL = 1e-15


def signature(columns: Sequence[str]) -> Column:
    """A hash of normalised columns (SQL expressions of texts)."""
    return F.md5(F.concat_ws("|", *[F.expr(c) for c in columns]))


def duplicate_groups(df: DataFrame, sig: Column, label: str, id_column: str, least: int = 2) -> DataFrame:
    """Groups of rows with one signature: size, positive rate, whether labels differ, smallest mode of the label, first id."""
    rows = df.select(sig.alias("sig"), F.col(label).alias("label"), F.col(id_column).alias("id"))
    by_label = rows.groupBy("sig", "label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    groups = by_label.groupBy("sig").agg(F.sum("n").alias("group_size"), F.count("*").alias("labels"), F.sum(F.col("label") * F.col("n")).alias("s"), F.max_by("label", F.struct("n", -F.col("label"))).alias("label_mode"), F.min("first_id").alias("first_id"))
    return groups.filter(F.col("group_size") >= least).select("sig", "group_size", (F.col("s") / F.col("group_size")).alias("positive_rate"), (F.col("labels") > 1).cast("int").alias("is_conflict"), "label_mode", "first_id")


def minority_suspects(df: DataFrame, sig: Column, label: str, sizes: tuple[int, int] = (3, 5), majority: float = 0.75) -> DataFrame:
    """Rows with the rarer label of a small group whose other label has the share `majority` at least."""
    rows = df.withColumn("_sig", sig)
    stats = rows.groupBy("_sig").agg(F.count("*").alias("_n"), F.sum(label).alias("_pos"))
    stats = stats.filter(F.col("_n").between(*sizes) & (F.col("_pos") > 0) & (F.col("_pos") < F.col("_n")))
    share = F.greatest(F.col("_pos"), F.col("_n") - F.col("_pos")) / F.col("_n")
    minority = F.when(F.col("_pos") * 2 > F.col("_n"), 0).otherwise(1)
    return rows.join(stats, "_sig").filter((share >= majority) & (F.col(label) == minority)).withColumns({"group_size": F.col("_n"), "majority_share": share}).drop("_sig", "_n", "_pos")


def numeric_drift(df: DataFrame, columns: Sequence[str], is_test: str = "is_test", bins: int = 10) -> DataFrame:
    """For each column: counts, missing rates, moments and percentiles of both sides, and the population stability index
    over the training side's quantile bins. All columns go through one pass as (column, value) cells."""
    cells = df.select(F.col(is_test).cast("int").alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.expr(K.number(c)).alias("x")) for c in columns])).alias("c")).select("t", "c.column", "c.x")
    cells = saved(cells)  # read for the moments, the quantiles of both sides and the bins
    side = lambda agg, t: agg(F.when(F.col("t") == t, F.col("x")))
    measures = []
    for t, n in ((0, "train"), (1, "test")):
        own = F.when(F.col("t") == t, F.col("x"))
        measures += [F.count(own).alias(f"{n}_count"), (1 - F.count(own) / F.sum((F.col("t") == t).cast("int"))).alias(f"{n}_missing_rate"), side(F.avg, t).alias(f"{n}_mean"), side(F.stddev_pop, t).alias(f"{n}_std")]
    table = cells.groupBy("column").agg(*measures).filter("train_count > 0 AND test_count > 0")
    edges = {f"_e{i}": i / bins for i in range(bins + 1)}
    for t, n in ((0, "train"), (1, "test")):
        named = {f"{n}_p{q * 100:02.0f}": q for q in (0.01, 0.5, 0.99)} | (edges if t == 0 else {})
        table = table.join(quantiles(cells.filter(F.col("t") == t), ["column"], "x", named), "column")
    table = table.withColumn("_edges", F.array_sort(F.array_distinct(F.array(*edges)))).drop(*edges)
    inner = table.select("column", F.expr("slice(_edges, 2, greatest(size(_edges) - 2, 0))").alias("inner"))
    binned = cells.filter("x IS NOT NULL").join(inner, "column").withColumn("bin", F.aggregate("inner", F.lit(0), lambda a, e: a + (e <= F.col("x")).cast("int")))
    hist = binned.groupBy("column", "bin").agg(F.sum(1 - F.col("t")).alias("a"), F.sum("t").alias("b"))
    parts = hist.join(table.select("column", "train_count", "test_count"), "column").select("column", F.greatest(F.col("a") / F.col("train_count"), F.lit(1e-9)).alias("p"), F.greatest(F.col("b") / F.col("test_count"), F.lit(1e-9)).alias("q"))
    psi = parts.groupBy("column").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    out = table.join(psi, "column").withColumn("std_ratio", F.when(F.col("train_std") > 1e-12, F.col("test_std") / F.col("train_std")))
    return out.withColumns({"mean_delta": F.col("test_mean") - F.col("train_mean"), "missing_rate_delta": F.col("test_missing_rate") - F.col("train_missing_rate")}).drop("_edges")


def categorical_drift(df: DataFrame, columns: Sequence[str], is_test: str = "is_test", examples: int = 5) -> DataFrame:
    """For each column: values on both sides, those the training side doesn't have and the first of these, the total variation distance, and the
    most frequent value (the first of equals) with its share."""
    cells = df.select(F.col(is_test).cast("int").alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias("v")) for c in columns])).alias("c")).select("t", "c.column", "c.v")
    counts = cells.groupBy("column", "v").agg(F.sum(1 - F.col("t")).alias("a"), F.sum("t").alias("b"))
    total = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    x = counts.join(total, "column")
    unseen = Window.partitionBy("column", F.col("a") == 0).orderBy("v")
    x = x.withColumn("unseen_place", F.when(F.col("a") == 0, F.row_number().over(unseen)))
    top = lambda n: F.min_by("v", F.struct(-F.col(n), F.col("v")))
    return x.groupBy("column").agg(
        F.sum((F.col("a") > 0).cast("int")).alias("train_unique"), F.sum((F.col("b") > 0).cast("int")).alias("test_unique"), F.sum(((F.col("a") == 0) & (F.col("b") > 0)).cast("int")).alias("unseen_in_test_count"),
        F.slice(F.array_sort(F.collect_list(F.when((F.col("a") == 0) & (F.col("b") > 0) & (F.col("unseen_place") <= examples), F.col("v")))), 1, examples).alias("unseen_examples"),
        (F.sum(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))) / 2).alias("tvd"), top("a").alias("train_top_1"), F.max(F.col("a") / F.col("na")).alias("train_top_1_share"), top("b").alias("test_top_1"), F.max(F.col("b") / F.col("nb")).alias("test_top_1_share"),
    )


def without_overlap(external: DataFrame, own: DataFrame, sig: Column) -> DataFrame:
    """External rows whose signature no own row has."""
    return external.join(own.select(sig.alias("_s")), sig == F.col("_s"), "left_anti")


def coverage(expected: DataFrame, got: DataFrame, id_column: str = "id") -> DataFrame:
    """missing, unexpected and repeated ids, as one row of counts."""
    e, g = expected.select(id_column).distinct(), got.groupBy(id_column).agg(F.count("*").alias("_n"))
    both = e.withColumn("_e", F.lit(1)).join(g, id_column, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return both.agg(n(F.col("_n").isNull()).alias("missing"), n(F.col("_e").isNull()).alias("unexpected"), n(F.coalesce(F.col("_n") > 1, F.lit(False))).alias("repeated"))


def noise_audit(df: DataFrame, teachers: Sequence[str], sig: Column, wrong: float = 0.6, hard: float = 0.95, small: int = 5, target: str = "target", reference: str = "reference_pred") -> DataFrame:
    """id and the first reason that holds: a conflict in a small group of near duplicates; a reference that is far off
    with teachers that all are on its side and agree; an error over the `hard` quantile with teachers that agree."""
    error = F.when(F.col(target) == 1, 1 - F.col(reference)).otherwise(F.col(reference))
    all_wrong = F.forall(F.array(*teachers), lambda x: (x >= 0.5) != (F.col(target) == 1))
    rows = saved(df.select("id", F.col(target).alias("_y"), sig.alias("_sig"), error.alias("_err"), array_statistics(teachers)["std"].alias("_sd"), all_wrong.alias("_wrong")))
    groups = rows.groupBy("_sig").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in ("_err", "_sd")])).alias("s")
    both = quantiles(rows.select(cells).select("s.*"), ["c"], "x", {"hard": hard, "calm": 0.5})
    limits = both.agg(F.max(F.when(F.col("c") == "_err", F.col("hard"))).alias("_hard"), F.max(F.when(F.col("c") == "_sd", F.col("calm"))).alias("_calm"))
    out = rows.join(groups, "_sig").crossJoin(F.broadcast(limits))  # one row
    all_wrong = F.col("_wrong")
    reason = F.when(F.col("_n").between(2, small) & (F.col("_p") > 0) & (F.col("_p") < F.col("_n")), "near_duplicate_conflict")
    reason = reason.when((F.col("_err") >= wrong) & (F.col("_sd") <= F.col("_calm")) & all_wrong, "label_noise").when((F.col("_err") >= F.col("_hard")) & (F.col("_sd") <= F.col("_calm")), "hard_stable")
    return out.select("id", reason.alias("reason")).filter("reason IS NOT NULL")


def label_noise(
    df: DataFrame, teachers: Sequence[str], exact: Column, coarse: Column, *, upper: float = 0.9, lower: float = 0.1, hard: float = 0.995, calm: float = 0.35, loud: float = 0.75,
    most: int = 5, target: str = "target", reference: str = "reference_pred", id_column: str = "id",
) -> DataFrame:
    """Suspicious rows: id, target, abs_error, logloss, exact_group_size, coarse_group_size, near_duplicate_conflict,
    label_noise_candidate, hard_example_stable and primary_reason, the first of these three that holds.

    A conflict is a group of one exact signature with both labels, or of one coarse signature if it has `most` rows at most.
    Noise is a reference beyond upper or lower on the wrong side, with teachers that all are on one side and whose
    deviation is at most its `calm` quantile. Hard and stable is a log loss at or over its `hard` quantile that is neither,
    with teachers' deviation at or over its `loud` quantile or a reference within 0.15 of one half. Quantiles are exact. A
    row without a target or reference is only judged by its groups; without rows there are none."""
    if not (0.5 < upper < 1 and 0 < lower < 0.5):
        raise ValueError(f"Bounds of confidence must lie beyond and below one half: {upper}, {lower}")
    if not all(0 < q < 1 for q in (hard, calm, loud)) or most < 2:
        raise ValueError("Quantiles must lie between 0 and 1, and groups have two rows at least")
    p, y = F.when(F.col(reference).isNotNull(), F.expr(K.clip(reference))), F.col(target).cast("double")
    stats, a = array_statistics(teachers), F.array(*teachers)
    one_side = F.forall(a, lambda x: x >= 0.5) | F.forall(a, lambda x: x < 0.5)
    base = saved(df.select(
        F.col(id_column).alias("id"), F.col(target).alias("target"), F.abs(y - p).alias("abs_error"), (-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss"), F.abs(p - 0.5).alias("margin"),
        ((F.col(target) == 0) & (p >= upper) | (F.col(target) == 1) & (p <= lower)).alias("wrong"), stats["std"].alias("std"), one_side.alias("one_side"), exact.alias("exact"), coarse.alias("coarse"),
    ))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in ("logloss", "std")])).alias("s")
    found = quantiles(base.select(cells).select("s.*"), ["c"], "x", {"hard": hard, "calm": calm, "loud": loud})
    limits = found.agg(F.max(F.when(F.col("c") == "logloss", F.col("hard"))).alias("_hard"), *[F.max(F.when(F.col("c") == "std", F.col(n))).alias(f"_{n}") for n in ("calm", "loud")])
    out = base
    for kind in ("exact", "coarse"):
        groups = base.groupBy(kind).agg(F.count("*").alias(f"{kind}_group_size"), (F.min("target") < F.max("target")).alias(f"_{kind}"))
        out = out.join(groups, kind)
    out = out.crossJoin(F.broadcast(limits))  # one row
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumn("near_duplicate_conflict", yes(F.col("_exact")) | (yes(F.col("_coarse")) & (F.col("coarse_group_size") <= most)))
    out = out.withColumn("label_noise_candidate", yes(F.col("wrong") & F.col("one_side") & (F.col("std") <= F.col("_calm") + EQUAL)))
    unstable = (F.col("std") >= F.col("_loud") - EQUAL) | (F.col("margin") <= 0.15)
    hard_one = yes((F.col("logloss") >= F.col("_hard")) & unstable) & ~F.col("label_noise_candidate") & ~F.col("near_duplicate_conflict")
    reasons = ("near_duplicate_conflict", "label_noise_candidate", "hard_example_stable")
    out = out.withColumn(reasons[2], hard_one).withColumn("primary_reason", F.coalesce(*[F.when(F.col(r), r) for r in reasons]))
    return out.filter("primary_reason IS NOT NULL").select("id", "target", "abs_error", "logloss", "exact_group_size", "coarse_group_size", *reasons, "primary_reason")
