"""Signatures of rows: hashes of normalised columns, by which duplicates and overlaps are found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..schema import SERVICES

# The categories of coarse signatures.
CATEGORIES = ("gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService", *SERVICES, "Contract", "PaperlessBilling", "PaymentMethod")


def _md5(texts: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.expr(t) for t in texts]))


def exact(df: DataFrame, but: Sequence[str] = ("id", "target", "Churn")) -> Column:
    """Of all columns but these: numbers to six decimals, texts without case and odd white space."""
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
    return _md5([K.number_text(c) if numeric(c) else K.normal_text(c) for c in df.columns if c not in but])


def _amounts() -> list[str]:
    whole = lambda c, unit: f"cast(cast(bround({K.normal_number(c, 9)} / {unit}, 0) * {unit} AS BIGINT) AS STRING)"
    return [whole("MonthlyCharges", 1), whole("TotalCharges", 10)]


def _tenure() -> str:
    return f"cast(cast(coalesce({K.number('tenure')}, -1) AS BIGINT) AS STRING)"


def coarse(columns: Sequence[str]) -> Column:
    """Of the categories that are there, the tenure and its bin, charges by one and their total by ten."""
    return _md5([*[K.normal_text(c) for c in CATEGORIES if c in columns], _tenure(), K.tenure_bin(), *_amounts()])


def mitigation(columns: Sequence[str]) -> Column:
    """The coarse one without the bin, and with both segments."""
    return _md5([*[K.normal_text(c) for c in CATEGORIES if c in columns], _tenure(), *_amounts(), K.segment3(), K.segment5()])


def overlap(columns: Sequence[str]) -> Column:
    """Of columns that two tables share: charges to cents, others as they are."""
    return _md5([K.number_text(c, 2) if c in ("MonthlyCharges", "TotalCharges") else f"coalesce(cast({c} AS STRING), '__nan__')" for c in columns])


def duplicate_groups(df: DataFrame, kinds: Mapping[str, Column], label: str = "target", id_column: str = "id", examples: int = 5) -> DataFrame:
    """Groups of two rows and more with one signature of a kind: size, labels, positive rate, whether labels differ, the
    smallest modes of both segments, and the first ids.

    All kinds go through one aggregate by signature, label and segments, so that a large group is reduced before it
    meets; lists are cut to `examples` on the way. Signatures are made once: all aggregates read the saved rows."""
    made = [s.alias(f"_s{i}") for i, s in enumerate(kinds.values())]
    rows = saved(df.select(*made, F.col(label).alias("label"), F.col(id_column).alias("id"), F.expr(K.segment3()).alias("segment3"), F.expr(K.segment5()).alias("segment5")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signature_kind"), F.col(f"_s{i}").alias("signature")) for i, n in enumerate(kinds)]))
    rows = rows.select(each.alias("x"), "label", "id", "segment3", "segment5").select("x.*", "label", "id", "segment3", "segment5")
    by = ["signature_kind", "signature"]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("group_size"), F.sum("label").alias("_pos"), F.array_sort(F.collect_set("label")).alias("labels")).filter("group_size > 1")
    inside = rows.join(sizes.select(*by), by, "left_semi")
    modes = None
    for level in ("segment3", "segment5"):
        counted = inside.groupBy(*by, level).agg(F.count("*").alias("_n"))
        best = counted.groupBy(*by).agg(F.min_by(level, F.struct(-F.col("_n"), F.col(level))).alias(f"{level}_mode"))
        modes = best if modes is None else modes.join(best, by)
    # the first ids: of each part of a group first, then of the parts
    part = inside.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    firsts = part.groupBy(*by, "_part").agg(F.slice(F.array_sort(F.collect_list("id")), 1, examples).alias("ids"))
    firsts = firsts.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, examples).alias("sample_ids"))
    out = sizes.join(modes, by).join(firsts, by)
    return out.select(
        *by, "group_size", F.size("labels").alias("label_unique_count"), "labels", (F.col("_pos") / F.col("group_size")).alias("positive_rate"), (F.size("labels") > 1).alias("inconsistent_labels"), "segment3_mode", "segment5_mode", "sample_ids"
    )


def duplicate_flags(df: DataFrame, kinds: Mapping[str, Column], label: str = "target") -> DataFrame:
    """df with <kind>_group_size and <kind>_inconsistent for each kind of signature; a row by itself has 1 and false."""
    columns, df = df.columns, saved(df.withColumns({f"_s{i}": s for i, s in enumerate(kinds.values())}))  # made once
    for i, n in enumerate(kinds):
        keyed = df.withColumn("_sig", F.col(f"_s{i}"))
        groups = keyed.groupBy("_sig").agg(F.count("*").alias(f"{n}_group_size"), (F.min(label) < F.max(label)).alias(f"{n}_inconsistent")).filter(F.col(f"{n}_group_size") > 1)
        df = keyed.join(groups, "_sig", "left").drop("_sig").withColumns({f"{n}_group_size": F.coalesce(f"{n}_group_size", F.lit(1)), f"{n}_inconsistent": F.coalesce(f"{n}_inconsistent", F.lit(False))})
    return df.select(*columns, *[f"{n}_{c}" for n in kinds for c in ("group_size", "inconsistent")])


def suspicious_families(df: DataFrame, family: Column, suspicious: Column, logloss: Column, error: Column, n: int) -> DataFrame:
    """The n families with the most suspicious rows, then with the highest share of them, then by name."""
    rows = df.select(family.alias("family_value"), suspicious.cast("long").alias("_s"), logloss.alias("_l"), error.alias("_e"))
    table = rows.groupBy("family_value").agg(F.count("*").alias("rows"), F.sum("_s").alias("suspicious_rows"), F.avg("_l").alias("mean_logloss"), F.avg("_e").alias("mean_abs_error"))
    table = table.withColumn("suspicious_rate", F.col("suspicious_rows") / F.greatest("rows", F.lit(1)))
    return table.orderBy(F.desc("suspicious_rows"), F.desc("suspicious_rate"), "family_value").limit(n)
