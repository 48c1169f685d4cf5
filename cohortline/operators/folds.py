"""Deterministic splits: the order within a stratum is that of a hash of seed and id, which any engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K


def order_hash(seed: int | str, id_column: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def stratified_positions(df: DataFrame, seed: int | str = 0, by: str = "target", id_column: str = "id") -> DataFrame:
    """_place: from 0, in the hash order of each stratum.

    A stratum may hold any share of the rows: places come from the counts of 4096 hash ranges and a window within each."""
    df = df.withColumn("_h", order_hash(seed, id_column)).withColumn("_r", F.substring("_h", 1, 3))
    # one key of text for the window and the join, so that rows are dealt once
    df = df.withColumn("_key", F.concat("_r", F.coalesce(F.concat(F.lit(":"), F.col(by).cast("string")), F.lit(""))))
    counts = df.groupBy(by, "_r", "_key").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_key", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_key").orderBy("_h", id_column)) - 1
    dealt = df.withColumn("_i", within).join(counts, "_key")
    return dealt.withColumn("_place", F.col("_before") + F.col("_i")).drop("_h", "_r", "_i", "_key", "_before")


def stratified_folds(df: DataFrame, k: int, seed: int | str = 0, by: str = "target", id_column: str = "id", name: str = "fold") -> DataFrame:
    """A fold from 0 to k-1 for each row; each stratum is dealt round in its hash order."""
    return stratified_positions(df, seed, by, id_column).withColumn(name, F.pmod("_place", F.lit(k)).cast("int")).drop("_place")


def stratified_holdout(df: DataFrame, share: float, seed: int | str = 0, by: str = "target", id_column: str = "id", name: str = "holdout") -> DataFrame:
    """1 for the first `share` of each stratum in hash order, else 0."""
    placed = stratified_positions(df, seed, by, id_column)
    size = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_size"))
    out = placed.join(size, F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn(name, (F.col("_place") < F.col("_size") * share).cast("int")).drop("_place", "_by", "_size")


def sampled(df: DataFrame, share: float, seed: int | str = 0, id_column: str = "id") -> DataFrame:
    """Rows whose hash is below the share of its range."""
    return df.filter(F.conv(F.substring(order_hash(seed, id_column), 1, 8), 16, 10).cast("double") < share * 2**32)


def composite_strata(df: DataFrame, min_rows: int, target: str = "target") -> DataFrame:
    """stratum: target and the finest of segment3, payment and contract, contract, or nothing, that has enough rows for
    that target."""
    levels = {"s3": K.segment3(), "pc": K.key("PaymentMethod", "Contract"), "c": K.key("Contract"), "y": "'all'"}
    out = df.withColumns({f"_{n}": F.concat(F.col(target).cast("string"), F.lit("__"), F.expr(e)) for n, e in levels.items()})
    source = out
    for n in ("s3", "pc", "c"):
        counts = source.groupBy(f"_{n}").agg(F.count("*").alias(f"_n_{n}"))
        out = out.join(counts, f"_{n}")
    chosen = F.coalesce(*[F.when(F.col(f"_n_{n}") >= min_rows, F.col(f"_{n}")) for n in ("s3", "pc", "c")], F.col("_y"))
    return out.withColumn("stratum", chosen).drop(*[f"_{n}" for n in levels], "_n_s3", "_n_pc", "_n_c")


def joint_strata(df: DataFrame, family: Column, least: int = 2, target: str = "target") -> DataFrame:
    """stratum: target and membership of a family if each such pair has `least` rows, else the target alone."""
    joint = df.withColumn("_joint", F.concat_ws("__", F.col(target).cast("string"), F.coalesce(family, F.lit(False)).cast("int").cast("string")))
    n = joint.groupBy("_joint").agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    out = joint.crossJoin(F.broadcast(n))  # one row
    return out.withColumn("stratum", F.when(F.col("_least") >= least, F.col("_joint")).otherwise(F.col(target).cast("string"))).drop("_joint", "_least")


def leave_family_out(df: DataFrame, family: Column, min_rows: int = 1, families: Sequence[str] | None = None) -> DataFrame:
    """For each family with enough rows (or each one given): its own rows as side 'valid', and all others as 'train', under
    the family's name as left_out. Families are few; rows are repeated once for each of them."""
    keyed = df.withColumn("_family", family)
    if families is None:
        families = sorted(r["_family"] for r in keyed.groupBy("_family").agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows).select("_family").collect())
    each = keyed.withColumn("left_out", F.explode(F.array(*map(F.lit, families)).cast("array<string>")))
    return each.withColumn("side", F.when(F.col("_family").eqNullSafe(F.col("left_out")), "valid").otherwise("train")).drop("_family")


def sorted_groups(df: DataFrame, group: str, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows with each group's together, in order: dealt by group, sorted within partitions, without a global sort."""
    dealt = df.repartition(partitions, group) if partitions else df.repartition(group)
    return dealt.sortWithinPartitions(group, *by)
