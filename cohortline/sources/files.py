"""Files: CSV with a schema, JSON leaves, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header; with columns, only these are parsed. NaN is read as NULL."""
    reader = spark.read.option("header", True).option("nanValue", "")
    df = nan_to_null(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_leaves(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, path, value of the numbers of flat JSON objects; texts, booleans and nulls don't count."""
    pairs = F.explode(F.from_json(F.col(column), "map<string,string>"))
    return df.select(id_column, pairs.alias("path", "raw")).withColumn("value", F.col("raw").try_cast("double")).filter("value IS NOT NULL").drop("raw")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modification time and SHA-256 of files. Each file is read by one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
