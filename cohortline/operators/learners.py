"""Learners of pyspark.ml, and factorisation machines, behind one cross-validation: boosted trees, linear models, perceptrons,
calibrators, residual and pairwise models. There are no monotone constraints, field-aware factors or pairwise boosting
in pyspark.ml; the models here stand in for those and don't give their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .codes import ScaledCodes
from .factors import Factorised
from .select import rank_pairs


def features(categorical: Sequence[str], numeric: Sequence[str]) -> list:
    """Stages that make `features`; unknown categories have a code of their own, missing numbers are filled before."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep")
    return [index, VectorAssembler(inputCols=[*[f"_i_{c}" for c in categorical], *numeric], outputCol="features")]


def positive(df: DataFrame, name: str) -> DataFrame:
    """The probability of label 1 as a column, without what the pipeline has added."""
    return df.withColumn(name, vector_to_array("probability")[1] if "probability" in df.columns else F.col("prediction"))


def cross_validate(df: DataFrame, folds: int, make: Callable[[int], Estimator], name: str = "oof_pred", fold: str = "fold", mask: str | None = None) -> DataFrame:
    """Each row's prediction by a model of the other folds; the only loop is over folds, two at a time, so that one's passes
    fill what the other's leave of the machines. With a mask (a boolean column) models are fitted and applied on its rows
    alone."""
    rows = df.filter(mask) if mask else df

    def part(k: int) -> DataFrame:
        model = make(k).fit(rows.filter(F.col(fold) != k))
        return positive(model.transform(rows.filter(F.col(fold) == k)), name).select(*df.columns, name)

    with ThreadPool(2) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(part), range(folds))
    return reduce(DataFrame.unionByName, parts)


def boosted(categorical: Sequence[str], numeric: Sequence[str], label: str = "target", rounds: int = 20, weight: str | None = None, regression: bool = False) -> Callable[[int], Estimator]:
    kind = GBTRegressor if regression else GBTClassifier
    options = {"weightCol": weight} if weight else {}
    return lambda k: Pipeline(stages=[*features(categorical, numeric), kind(labelCol=label, maxIter=rounds, maxDepth=4, maxBins=64, seed=17 + k, **options)])


def linear(categorical: Sequence[str], numeric: Sequence[str], label: str = "target") -> Callable[[int], Estimator]:
    return lambda k: Pipeline(stages=[ScaledCodes(categorical, numeric), LogisticRegression(labelCol=label, regParam=0.01, maxIter=25)])


def factorised(categorical: Sequence[str], numeric: Sequence[str], label: str = "target") -> Callable[[int], Estimator]:
    return lambda k: Factorised(categorical, numeric, label, factors=4, steps=15, seed=17 + k)


def perceptron(categorical: Sequence[str], numeric: Sequence[str], width: int, label: str = "target") -> Callable[[int], Estimator]:
    """width: of the one-hot features; the layers are fixed by it."""
    return lambda k: Pipeline(stages=[ScaledCodes(categorical, numeric), MultilayerPerceptronClassifier(labelCol=label, layers=[width, 16, 2], maxIter=30, seed=17 + k)])


def calibrated(df: DataFrame, folds: int, method: str, score: str, name: str = "calibrated") -> DataFrame:
    """Scores by Platt's logistic curve of the logit, or by isotonic regression, of the other folds."""
    rows = df.withColumn("_x", F.expr(K.logit(score)) if method == "platt" else F.col(score))
    if method not in ("platt", "isotonic"):
        raise ValueError(f"Unknown method {method!r}")
    make = lambda k: Pipeline(stages=[VectorAssembler(inputCols=["_x"], outputCol="features"), LogisticRegression(labelCol="target") if method == "platt" else IsotonicRegression(labelCol="target")])
    return cross_validate(rows, folds, make, name).drop("_x")


def pairwise(df: DataFrame, group: str, numeric: Sequence[str], max_pairs: int, id_column: str = "id") -> DataFrame:
    """A linear ranker from the differences of pairs' features, both ways round; rank_score for each row."""
    pairs = rank_pairs(df, group, max_pairs, id_column=id_column)
    x = df.select(F.col(id_column).alias("_id"), F.array(*[F.col(c).cast("double") for c in numeric]).alias("_x"))
    joined = pairs.join(x.toDF("positive_id", "_p"), "positive_id").join(x.toDF("negative_id", "_n"), "negative_id")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.zip_with("_p", "_n", lambda a, b: a - b).alias("d")), F.struct(F.lit(0.0).alias("label"), F.zip_with("_p", "_n", lambda a, b: b - a).alias("d"))))
    rows = joined.select(both.alias("r")).select("r.label", *[F.col("r.d")[i].alias(c) for i, c in enumerate(numeric)])
    model = Pipeline(stages=[VectorAssembler(inputCols=list(numeric), outputCol="features"), LogisticRegression(fitIntercept=False, regParam=0.01)]).fit(rows)
    weights = model.stages[-1].coefficients.toArray().tolist()
    score = sum((F.col(c).cast("double") * w for c, w in zip(numeric, weights)), F.lit(0.0))
    return df.withColumn("rank_score", score)
