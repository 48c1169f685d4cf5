"""Names, column checks and the handling of missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID, TARGET, POSITIVE = "id", "target", "Yes"
RAW_TARGET = "Churn"
#: The services of an account, those of support first.
SUPPORT = ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport")
ENTERTAINMENT = ("StreamingTV", "StreamingMovies")
SERVICES = SUPPORT + ENTERTAINMENT


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} needs columns that are missing: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns as NULL, so that aggregates and comparisons skip it."""
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes])


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") if c not in set(but)]


Stages = list[dict[str, str]]


def staged(df: DataFrame, stages: Stages, keep_temporary: bool = False) -> DataFrame:
    """df with the columns of each stage, which are SQL expressions over those before; names with _ are temporary."""
    for stage in stages:
        df = df.withColumns({c: F.expr(e) for c, e in stage.items()})
    return df if keep_temporary else df.drop(*[c for s in stages for c in s if c.startswith("_")])


def text(column: str) -> str:
    """A column as text, a missing value being a category of its own."""
    return f"coalesce(cast({column} AS STRING), 'nan')"
