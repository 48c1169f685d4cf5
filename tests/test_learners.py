"""Learners: features, folds and fits are those of pyspark.ml, by fewer passes."""

import threading

import pytest
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortline.operators import learners as M
from cohortline.queries import learning as Q

ROWS = [(i, ("a", "b", None, "c", "b", "d")[i % 6] if i % 7 else "b", i % 3, float(i % 17), (i * 7 + i // 3) % 5 // 3, i % 2) for i in range(600)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, c string, k int, x double, target int, fold int").checkpoint()


def test_features_are_those_of_the_stages_and_made_at_once(spark, rows):
    unseen = rows.union(spark.createDataFrame([(-1, "z", 9, 1.5, 0, 0)], rows.schema))
    stages = [
        StringIndexer(inputCols=["c", "k"], outputCols=["i0", "i1"], handleInvalid="keep"), OneHotEncoder(inputCols=["i0", "i1"], outputCols=["h0", "h1"], handleInvalid="keep"),
        VectorAssembler(inputCols=["h0", "h1", "x", "id"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"),
    ]
    want = {r.id: r.features.toArray() for r in Pipeline(stages=stages).fit(rows).transform(unseen).collect()}
    made = M.linear(("c", "k"), ("x", "id"))(0).fit(rows).stages[:-1]
    for stage in made:
        unseen = stage.transform(unseen)
    assert unseen._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 1  # a function for each stage before
    got = {r.id: r.features.toArray() for r in unseen.collect()}
    assert len(got) == 601 and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_a_missing_number_is_still_an_error(rows):
    model = M.linear(("c",), ("x",))(0).fit(rows)
    with pytest.raises(Exception, match="(?i)null"):
        model.transform(rows.withColumn("x", F.when(F.col("id") != 5, F.col("x")))).select("probability").collect()


def test_two_folds_are_fitted_at_a_time(rows):
    both = threading.Barrier(2, timeout=60)  # broken if one fold waits for the other

    class Waiting(Estimator):
        def _fit(self, df):
            both.wait()
            return M.linear(("c",), ("x",))(0).fit(df)

    assert M.cross_validate(rows, 2, lambda k: Waiting()).filter("oof_pred > 0").count() == 600


def test_rows_of_a_learner_hold_its_columns_alone(spark):
    assert Q.rows(spark, "/root/testdata/sf0.001", "Contract", "tenure").columns == ["target", "Contract", "tenure", "fold"]


def test_factorised_is_the_model_of_fmclassifier_from_packed_rows(spark, rows):
    made = M.linear(("c", "k"), ("x", "id"))(0).fit(rows).stages[0]
    want = FMClassifier(labelCol="target", factorSize=4, maxIter=15, seed=17).fit(made.transform(rows))
    model = M.factorised(("c", "k"), ("x", "id"))(0).fit(rows)
    assert not isinstance(model, PipelineModel)  # before: stages that end in FMClassifier, which goes row by row
    unseen = rows.union(spark.createDataFrame([(-1, "z", 9, 1.5, 0, 0)], rows.schema))
    p = {r.id: r.p for r in want.transform(made.transform(unseen)).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.id: r.p for r in M.positive(model.transform(unseen), "p").collect()}
    assert len(got) == 601 and all(got[i] == pytest.approx(p[i], abs=1e-9) for i in p)


def test_factorised_refuses_what_fmclassifier_refuses(rows):
    for bad in (rows.withColumn("x", F.when(F.col("id") != 5, F.col("x"))), rows.withColumn("target", F.lit(2)), rows.withColumn("x", F.lit(float("nan")))):
        with pytest.raises(Exception, match="null|neither 0 nor 1"):
            M.factorised(("c",), ("x",))(0).fit(bad)
