"""Joins and lookups that fail where their inputs don't fit: repeated keys, missing rows, differing targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns


def strict_binary(column: str) -> Column:
    """1 or 0 of a target that is given as 0 and 1, or as Yes and No in any case; fails on anything else, also on null."""
    raw = F.lower(F.trim(F.col(column).cast("string")))
    value = F.when(raw == "yes", 1).when(raw == "no", 0).when(F.col(column).cast("string").try_cast("double") == 1, 1).when(F.col(column).cast("string").try_cast("double") == 0, 0)
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{column} isn't binary: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int"))


def _checked(df: DataFrame, bad: Column, message: str, told: str) -> DataFrame:
    """df, failing at a row where `bad` holds."""
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit(message), F.coalesce(F.col(told).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True))


def unique(df: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """df, failing if a key occurs more than once. The count is an aggregate by key, with which the join that follows
    shares its partitioning."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_times"))
    counts = _checked(counts, F.col("_times") > 1, f"{what} repeats {', '.join(on)} = ", on[0])
    return df.join(counts.drop("_times"), list(on), "left_semi")


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two tables whose keys don't repeat."""
    return unique(left, on, "The left table").join(unique(right, on, "The right table"), list(on), how)


def complete_left(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """A left one-to-one join that fails if a row of the left table has no value."""
    return _checked(one_to_one(left, right, on, "left"), F.col(value).isNull(), f"No {value} for {on[0]} = ", on[0])


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """df with the table's value for its key. Keys of the table don't repeat; without a default each row has one."""
    require_columns(table, [key, value], "A lookup")
    out = df.join(unique(table.select(key, value), [key], "The lookup"), key, "left")
    return _checked(out, F.col(value).isNull(), f"No {value} for {key} = ", key) if default is None else out.withColumn(value, F.coalesce(value, default))


def compatibility(frames: Mapping[str, DataFrame], id_column: str = "id", target: str = "target", reference: str = "reference_pred", mask: str = "specialist_mask") -> DataFrame:
    """For each frame but the first, compared with that: ids that one of them lacks, targets that differ, the largest
    difference of references, and masks that aren't 0 or 1."""
    (_, base), *others = frames.items()
    base = base.select(id_column, F.col(target).alias("_t"), F.col(reference).alias("_r"), F.lit(1).alias("_a"))
    out = None
    for name, frame in others:
        both = base.join(frame.select(id_column, F.col(target).alias("_u"), F.col(reference).alias("_s"), F.col(mask).cast("double").alias("_m"), F.lit(1).alias("_b")), id_column, "full")
        n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        row = both.agg(n(F.col("_a").isNull() | F.col("_b").isNull()).alias("id_mismatch"), n(F.col("_t") != F.col("_u")).alias("target_mismatch"), F.max(F.abs(F.col("_r") - F.col("_s"))).alias("max_reference_diff"), n(F.col("_b").isNotNull() & ~F.coalesce(F.col("_m").isin(0.0, 1.0), F.lit(False))).alias("bad_mask"))
        row = row.select(F.lit(name).alias("frame"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def require_compatible(frames: Mapping[str, DataFrame], tolerance: float = 1e-8, **names: str) -> None:
    """Fails unless all frames have the same ids and targets, references within the tolerance, and masks of 0 and 1."""
    for r in compatibility(frames, **names).collect():  # one row for each frame
        if r.id_mismatch or r.target_mismatch or r.bad_mask or (r.max_reference_diff or 0) > tolerance:
            raise ValueError(f"Frame {r.frame!r} doesn't fit the first one: {r.asDict()}")


def require_rows(df: DataFrame, mask: Column, least: int, what: str) -> DataFrame:
    """The rows of a mask, failing on evaluation if there are fewer than `least`."""
    n = df.agg(F.coalesce(F.sum(F.coalesce(mask, F.lit(False)).cast("long")), F.lit(0)).alias("_n"))
    n = n.filter(F.when(F.col("_n") < least, F.raise_error(F.concat(F.lit(f"{what} has less than {least} rows: "), F.col("_n").cast("string"))).cast("boolean")).otherwise(True))
    return df.filter(mask).crossJoin(F.broadcast(n)).drop("_n")  # one row


def focus_mask(df: DataFrame, family: Column, p: str, half_width: float | None = None, least: int = 2000) -> DataFrame:
    """The rows of a family, within half_width of one half if given; fails if they are fewer than `least`."""
    if half_width is not None and not 0 < half_width < 0.5:
        raise ValueError(f"The half width must lie between 0 and 0.5: {half_width}")
    return require_rows(df, family if half_width is None else family & (F.abs(F.col(p) - 0.5) <= half_width), least, "The focus mask")


def without_ids(df: DataFrame, other: DataFrame, id_column: str = "id") -> DataFrame:
    """The rows whose ids the other table doesn't have."""
    return df.join(other.select(id_column), id_column, "left_anti")


def column_differences(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns of one table alone, and those whose types differ, in order."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    return {"missing": [c for c in left if c not in right], "extra": [c for c in right if c not in left], "types": [c for c in left if c in right and left[c] != right[c]], "order": [c for c, d in zip(a.columns, b.columns) if c != d]}


def tagged_union(parts: Mapping[str, tuple[DataFrame, float]], tag: str = "source", weight: str = "sample_weight") -> DataFrame:
    """All rows of several tables, with the table's name and weight; columns that a table lacks are null."""
    out = None
    for name, (df, w) in parts.items():
        part = df.withColumns({tag: F.lit(name), weight: F.lit(float(w))})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
