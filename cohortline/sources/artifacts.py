"""Artifacts: specifications of prediction files, reports as JSON, models, manifests, and the history of submissions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import fingerprints, read_csv

# Names of prediction columns in order of preference, and of a report's metrics.
PREDICTIONS = ("oof_pred", "oof_ensemble", "prediction", "pred")
# What a submission's name says about its family, the first that fits.
FAMILIES = (("residual-hier", "residual_hierarchy"), ("rvblend", "teacher_blend_rv"), ("rblend", "teacher_blend_r"), ("blend-grid", "blend_scan"), ("multiseed", "catboost_multiseed"), ("pseudo", "pseudo_labeling"))


@dataclass(frozen=True)
class Spec:
    name: str
    path: str
    column: str | None = None


def parse_spec(raw: str) -> Spec:
    """A specification '<name>=<path>' or '<name>=<path>#<column>'."""
    name, equals, rest = raw.strip().partition("=")
    path, _, column = rest.strip().partition("#")
    if not equals or not name.strip() or not path.strip():
        raise ValueError(f"Expected <name>=<path>[#<column>], not {raw!r}")
    return Spec(name.strip(), path.strip(), column.strip() or None)


def prediction_column(df: DataFrame, preferred: str | None = None) -> str:
    """The named column, the first of the usual ones, or the only one that begins with oof_."""
    if preferred:
        if preferred not in df.columns:
            raise ValueError(f"There is no column {preferred!r}")
        return preferred
    usual = [c for c in PREDICTIONS if c in df.columns] or [c for c in df.columns if c.startswith("oof_")]
    if not usual or (usual[0] not in PREDICTIONS and len(usual) > 1):
        raise ValueError(f"Name the prediction's column; candidates: {usual}")
    return usual[0]


def predictions(spark: SparkSession, specs: Sequence[str], on: Sequence[str] = ("id", "target")) -> dict[str, DataFrame]:
    """For each specification, a frame with the keys and `pred`, for merge_oof; names don't repeat."""
    parsed = [parse_spec(s) for s in specs]
    if len({s.name for s in parsed}) != len(parsed):
        raise ValueError(f"Names repeat: {[s.name for s in parsed]}")
    frames = {s.name: (read_csv(spark, s.path), s.column) for s in parsed}
    return {n: d.select(*on, F.col(prediction_column(d, c)).cast("double").alias("pred")) for n, (d, c) in frames.items()}


def load_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON object (a report, weights), read by Spark wherever it is stored; None if there is no such file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    (row,) = spark.read.text(path, wholetext=True).collect()  # one file
    got = json.loads(row[0])
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no JSON object")
    return got


def nested_leaves(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, path, value of all finite numbers in JSON documents of any shape: a.b for members, a[0] for elements. Texts,
    booleans and nulls don't count, nor does a document that can't be read."""
    read = df.select(F.col(id_column), F.expr(f"try_parse_json({column})").alias("_v")).filter("_v IS NOT NULL")
    level = read.select(id_column, F.lit("").alias("path"), F.col("_v").alias("v"))
    out = None
    kind = F.schema_of_variant("v")
    while True:  # a round for each level of nesting, until a level holds no more objects and arrays
        number = level.filter(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$")).select(id_column, "path", F.try_variant_get("v", "$", "double").alias("value"))
        number = number.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
        out = number if out is None else out.unionByName(number)
        inner = level.filter(kind.rlike("^(OBJECT|ARRAY)"))
        if not inner.limit(1).count():
            return out
        inner.createOrReplaceTempView("_leaves")
        grown = inner.sparkSession.sql(f"SELECT {id_column}, CASE WHEN key IS NULL THEN path || '[' || pos || ']' WHEN path = '' THEN key ELSE path || '.' || key END AS path, value AS v FROM _leaves, LATERAL variant_explode(v)")
        level = grown.filter("v IS NOT NULL")


def manifest(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """label, path, length, modification time and SHA-256 of every file under the paths: a snapshot of artifacts."""
    out = None
    for label, path in paths.items():
        part = fingerprints(spark, path).select(F.lit(label).alias("label"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def submission_path(c: Column) -> Column:
    """With slashes and without leading ./"""
    return F.regexp_replace(F.replace(F.trim(c.cast("string")), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def submission_family(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(part)), F.lit(family)) for part, family in FAMILIES], F.lit("generic"))


def parsed_date(c: Column) -> Column:
    """The instant that a text says, in UTC where it names no zone; null if it can't be read."""
    return F.try_to_timestamp(F.trim(c.cast("string")))


def report_priority(name: Column, has_metric: Column) -> Column:
    """A struct that sorts reports of one submission, the best first."""
    low = F.lower(name)
    bucket = F.when(low.startswith("submission_candidate_"), 0).when(low.startswith("candidate_submission_"), 1).when(low.startswith("validation_protocol_"), 2).when(F.contains(low, F.lit("submission")), 3).otherwise(4)
    return F.struct(bucket.alias("bucket"), F.when(has_metric, 0).otherwise(1).alias("penalty"), low.alias("name"))


def primary_metric(leaves: DataFrame, id_column: str, priority: Sequence[str]) -> DataFrame:
    """id, metric, value: of the leaves whose path is or ends in a metric's name, that of the first metric, at the first path."""
    place = F.coalesce(*[F.when((F.col("path") == m) | F.col("path").endswith(f".{m}"), i) for i, m in enumerate(priority)])
    found = leaves.withColumn("_i", place).filter("_i IS NOT NULL")
    best = found.groupBy(id_column).agg(F.min_by(F.struct("_i", "value"), F.struct("_i", "path")).alias("x"))
    names = F.array(*map(F.lit, priority))
    return best.select(id_column, F.element_at(names, F.col("x._i") + 1).alias("metric"), F.col("x.value").alias("value"))


def best_reports(reports: DataFrame, submission: str, name: str, metric: str) -> DataFrame:
    """Each submission's report that comes first by priority."""
    order = Window.partitionBy(submission).orderBy(report_priority(F.col(name), F.col(metric).isNotNull()))
    return reports.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")  # a submission has a handful


def forensics(history: DataFrame, name: str, score: str, metric: str) -> DataFrame:
    """family, submissions, complete ones, best and mean score, and from three on the correlation of a metric with scores."""
    rows = history.withColumn("family", submission_family(F.col(name)))
    complete = F.col(score).isNotNull()
    pairs = F.sum((complete & F.col(metric).isNotNull()).cast("long"))
    return rows.groupBy("family").agg(F.count("*").alias("submissions"), F.sum(complete.cast("long")).alias("complete"), F.max(score).alias("best"), F.avg(score).alias("mean"), F.when(pairs >= 3, F.corr(metric, score)).alias("correlation"))
