"""Experiments of learners: what they do without rows to learn from, and how often they read their rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortline.operators import audit as A
from cohortline.operators import experiments as X
from cohortline.operators import folds as L

ROWS = [(i, (i * 7 + i // 3) % 2, f"c{i % 3}", float(i % 17), i % 2) for i in range(240)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, target int, c string, x double, fold int").checkpoint()


def test_without_external_rows_there_is_no_teacher_but_the_joint_model(spark, rows):
    make = lambda k: X.plain_logistic(["x"])
    taught = X.external_teacher(rows, rows, make, A.signature(["c"]))
    assert taught.count() == 240 and taught.filter("external_pred IS NOT NULL").count() == 0
    other = rows.withColumn("c", F.lit("d"))
    assert X.external_teacher(rows, other, make, A.signature(["c"])).filter("external_pred > 0").count() == 240
    assert X.joint_training(rows, rows, 2, lambda k: X.plain_logistic(["x"], weight="sample_weight"), A.signature(["c"]), 0.5).count() == 240


def test_fits_read_their_rows_a_fixed_number_of_times(spark, rows):
    def reads(run):
        n = spark.sparkContext.accumulator(0)

        def told(x):
            n.add(1)
            return x

        run(rows.withColumn("x", F.udf(told, "double").asNondeterministic()("x"))).collect()
        return n.value / len(ROWS)

    linear = lambda k: X.plain_logistic(["x"])
    assert reads(lambda d: X.stability(d, 2, (1, 2), lambda seed: linear)) <= 4  # twice a seed, for counts and rows
    assert reads(lambda d: X.multi_seed(d, 2, (1, 2), lambda seed: linear).select("id", "oof_pred")) <= 5
    by = lambda k: X.plain_logistic(["x"], "is_test")
    assert reads(lambda d: X.adversarial(d.filter("fold = 0"), d.filter("fold = 1"), 2, by)) <= 4


def test_strata_are_dealt_once(spark, rows):
    d = rows.withColumn("target", F.when(F.col("id") % 5 > 0, F.col("target")))
    plan = L.stratified_folds(d, 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 1 and len([x for x in plan.splitlines() if "Exchange hashpartitioning(_key" in x]) <= 3
    got = L.stratified_folds(d, 3, 7).collect()
    for stratum in (None, 0, 1):
        mine = sorted((r for r in got if r.target == stratum), key=lambda r: hashlib.md5(f"7:{r.id}".encode()).hexdigest())
        assert [r.fold for r in mine] == [i % 3 for i in range(len(mine))]


def test_neighbours_are_found_once_for_all_that_reads_their_means(spark):
    d = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    made, names = X.neighbour_features(d, d.select("vec_id", F.col("embedding")[0].alias("x")), ["x"], 4, 2)
    assert "InArrow" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 60 and names == ["hop1_x", "hop2_x"]
