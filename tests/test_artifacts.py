import pytest
from pyspark.sql import functions as F

from cohortline.operators import blocks
from cohortline.operators import learners as M
from cohortline.operators import matrix as X
from cohortline.operators import priors as P
from cohortline.sources import artifacts as A
from cohortline.sources import files
from cohortline.sources.accounts import accounts

DATA = "/root/testdata/sf0.001"


def test_specifications():
    assert A.parse_spec(" a = /x/y.csv#p ") == A.Spec("a", "/x/y.csv", "p") and A.parse_spec("a=b#") == A.Spec("a", "b")
    for bad in ("a", "=b", "a=", "a=#c"):
        with pytest.raises(ValueError):
            A.parse_spec(bad)


def test_prediction_files(spark, tmp_path):
    for n, c in (("a", "pred"), ("b", "oof_x")):
        files.write_csv(spark.createDataFrame([(1, 0, 0.25), (2, 1, 0.5)], f"id long, target int, {c} double"), f"{tmp_path}/{n}", one_file=True)
    got = A.predictions(spark, [f"a={tmp_path}/a", f"b={tmp_path}/b#oof_x"])
    assert {n: sorted(map(tuple, d.collect())) for n, d in got.items()} == {n: [(1, 0, 0.25), (2, 1, 0.5)] for n in "ab"}
    two = spark.createDataFrame([(1.0, 2.0)], "oof_a double, oof_b double")
    for frame, preferred in ((two, None), (two, "x"), (two.select(F.col("oof_a").alias("q")), None)):
        with pytest.raises(ValueError):
            A.prediction_column(frame, preferred)
    assert A.prediction_column(two, "oof_b") == "oof_b" and A.prediction_column(two.drop("oof_b")) == "oof_a"


def test_json_and_manifest(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": {"b": [1, true, null, 2.5]}}')
    assert A.load_json(spark, f"{tmp_path}/r.json") == {"a": {"b": [1, True, None, 2.5]}} and A.load_json(spark, f"{tmp_path}/no.json") is None
    d = spark.createDataFrame([(1, '{"a": {"b": [1, true, null, 2.5]}, "c": "x", "d": {}}'), (2, "broken {"), (3, None), (4, "[[3]]"), (5, "{}")], "id long, j string")
    assert sorted(map(tuple, A.nested_leaves(d, "id", "j").collect())) == [(1, "a.b[0]", 1.0), (1, "a.b[3]", 2.5), (4, "[0][0]", 3.0)]
    (row,) = A.manifest(spark, {"run": str(tmp_path)}).collect()
    assert row.label == "run" and row.length == 34 and len(row.sha256) == 64


def test_reports_of_a_submission(spark):
    rows = [("s", "validation_protocol_x.json", 0.5), ("s", "submission_candidate_a.json", None), ("s", "submission_candidate_b.json", 0.7), ("t", "other.json", None)]
    d = spark.createDataFrame(rows, "submission string, name string, metric double")
    assert {r.submission: r["name"] for r in A.best_reports(d, "submission", "name", "metric").collect()} == {"s": "submission_candidate_b.json", "t": "other.json"}
    p = spark.createDataFrame([("././a\\b.csv",)], "p string")
    assert p.select(A.submission_path(F.col("p"))).first()[0] == "a/b.csv"


def test_models_and_encoders_come_back(spark, tmp_path):
    a = accounts(spark, DATA)
    model = M.linear(("Contract",), ("tenure",))(0).fit(a)
    A.save_model(model, f"{tmp_path}/model")
    score = lambda m: [round(r.p, 9) for r in M.positive(m.transform(a), "p").orderBy("id").collect()]
    assert score(model) == score(A.load_model(f"{tmp_path}/model"))
    fitted = P.TargetPriors().fit(a.filter("split = 'train'"))
    P.save_priors(fitted, f"{tmp_path}/priors")
    again = P.load_priors(spark, f"{tmp_path}/priors")
    rows = lambda f: sorted(map(str, P.with_priors(a.filter("split = 'test'"), f, "priors_only").collect()))
    assert rows(fitted) == rows(again) and again.specs == tuple(fitted.specs)


def test_matrices_and_kept_columns(spark):
    a = accounts(spark, DATA)
    made, categorical, numeric = X.train_matrix(a, "A,R,G")
    assert "tenure_bin" in categorical and "segment5_train_rows" in numeric and not {"id", "target", "Churn"} & {*categorical, *numeric}
    kept = blocks.apply_blocks(a.withColumn("payment_friction_index", F.lit(99)), "M")
    assert kept.select("payment_friction_index").distinct().collect()[0][0] == 99 and "contract_commitment_ordinal" in kept.columns
    codes = X.Codes(["Contract"]).fit(a.filter("Contract <> 'Two year'")).apply(a)
    assert {(r.Contract, r.code_Contract) for r in codes.select("Contract", "code_Contract").distinct().collect()} == {("Month-to-month", 1), ("One year", 2), ("Two year", 0)}
