import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortline.operators import blend as B
from cohortline.operators import select as S
from cohortline.plans import parity as P
from cohortline.operators import scans
from cohortline.operators import signatures
from cohortline.plans import gates


def test_parity_of_columns(spark):
    d = spark.createDataFrame([(1, "a", 2.0, "Yes")], "id long, c string, x double, Churn string")
    test, made = d.drop("Churn"), d.drop("Churn")
    good = {c: s for c, s, _ in P.column_checks(d, test, made, made, "Churn", ("A",), {"feature_blocks": ["A"], "feature_count": 3})}
    assert set(good.values()) == {"PASS"} and len(good) == 8
    other = made.select("c", F.col("x").cast("string").alias("x"))
    bad = {c: (s, t) for c, s, t in P.column_checks(d, test.drop("c"), made, other, "Churn", ("A",), {"feature_blocks": ["B"], "feature_count": 9})}
    assert bad["raw_columns_train_vs_test"] == ("FAIL", "c") and bad["engineered_columns_set_match"] == ("FAIL", "id")
    assert bad["engineered_columns_order_match"][0] == "FAIL" and bad["engineered_dtype_match"] == ("WARN", "x") and bad["categorical_columns_match"] == ("WARN", "x")
    assert bad["metrics_feature_blocks_match"][0] == bad["metrics_feature_count_match"][0] == "FAIL"
    none = {c: s for c, s, _ in P.column_checks(d, test, made, made, "Churn")}
    assert none["metrics_file_presence"] == "WARN" and "metrics_feature_count_match" not in none


def test_submissions_without_faults_and_without_rows(spark):
    t = spark.createDataFrame([(i, 0.1 * i) for i in range(1, 8)], "id long, Churn double")
    got = {r["check"]: (r["status"], r["value"]) for r in P.submission_checks(t, t, t).collect()}
    assert {s for s, _ in got.values()} == {"PASS"} and got["reference_correlation"][1] == pytest.approx(1)
    empty = {r["check"]: r["status"] for r in P.submission_checks(t, t.limit(0)).collect()}
    assert empty == {"submission_row_count_match_test": "FAIL", "submission_ids_match_test": "FAIL", "submission_prediction_range": "PASS", "reference_correlation": "WARN"}
    nulls = {r["check"]: r["status"] for r in P.submission_checks(t, t.withColumn("Churn", F.lit(None).cast("double")), t).collect()}
    assert nulls["submission_prediction_range"] == "WARN"


def test_bands_fail_on_drift(spark):
    d = spark.createDataFrame([(0.5, 0.5, 0.5), (0.55, 0.4, 0.7), (0.9, 0.9, 0.9), (None, 0.1, 0.9)], "p double, a double, b double")
    r = S.band_summary(d, F.lit(True), "p", 0.1, ["a", "b"], 0.05).first()
    assert (r.rows, r.band_rows, r.baseline_rows, r.final_rows, r.relative_drift) == (4, 2, 2, 1, 0.5)
    assert S.uncertainty_band(d, F.lit(True), "p", 0.1, ["a", "b"], 0.05, 0.5).filter("in_band = 1").count() == 1
    with pytest.raises(ValueError, match="leaves out"):
        S.uncertainty_band(d, F.lit(True), "p", 0.1, ["a", "b"], 0.05, 0.4)
    with pytest.raises(ValueError, match="half width"):
        S.uncertainty_band(d, F.lit(True), "p", 0.5)
    assert S.band_summary(d.limit(0), F.lit(True), "p", 0.1).first().relative_drift == 0


def test_pseudo_labels_need_enough_rows_for_precision(spark):
    d = spark.createDataFrame([(1, 0.9, 0.95), (0, 0.9, 0.9), (0, 0.05, 0.1), (1, 0.4, 0.6)], "target int, a double, b double")
    chosen = S.pseudo_rows(d, ["a", "b"], 0.1, 0.8)
    r = S.pseudo_summary(chosen).first()
    assert (r.selected_rows, r.selected_positive_rows, r.positive_precision, r.negative_precision) == (3, 2, 0.5, 1.0)
    few = S.pseudo_summary(chosen, min_rows=4).first()
    assert few.selected_rows == 3 and few.accuracy is None and few.positive_precision is None and few.selected_mean is not None


def test_merged_predictions_must_not_repeat(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "id long, target int, pred double")
    assert sorted(map(tuple, B.merge_oof({"x": a, "y": a.filter("id = 2")}).collect())) == [(2, 1, 0.2, 0.2)]
    with pytest.raises(PySparkException, match="y repeats id = 2"):
        B.merge_oof({"x": a, "y": a.unionByName(a.filter("id = 2"))}).collect()


def test_blends_without_a_solution(spark):
    d = spark.createDataFrame([(0.5,)], "x double")
    w = {"cb": 0.4, "xgb": 0.2, "lgb": 0.2, "r": 0.1, "rv": 0.1}
    with pytest.raises(ValueError, match="determine"):
        B.invert_components(d, ("x", w), ("x", w), ("x", w))
    with pytest.raises(ValueError, match="must hold"):
        B.invert_components(d, ("x", {"cb": 1.0}), ("x", w), ("x", w))


def counting(spark, n):  # noqa: ANN001, ANN201
    """Rows whose predictions count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def make(i):
        made.add(1)
        return (i * 37 % 101) / 101

    p = F.udf(make, "double")(F.col("id"))
    rows = spark.range(n).select("id", (F.col("id") % 2).cast("int").alias("target"), F.lit("a").alias("segment3"), F.lit("b").alias("segment5"), p.alias("candidate_pred"), ((F.col("id") * 53 % 97) / 97).alias("reference_pred"))
    return made, rows


def test_chain_report_and_robustness_make_their_rows_once(spark):
    made, rows = counting(spark, 400)
    rows = rows.withColumns({f"{s}_loss": F.col(f"{s}_pred") for s in ("candidate", "reference")})
    assert gates.chain_report(rows, rows, "midcap", 2, 3).count() == 5
    assert made.value <= 2 * 400  # the second is the loss here
    made, rows = counting(spark, 400)
    assert scans.robustness(rows, ["candidate_pred", "reference_pred"], 2, 3).count() == 2
    assert made.value <= 2 * 400


def test_repeated_aucs_equal_those_of_each_prediction(spark):
    _, rows = counting(spark, 200)
    both = {(r.prediction, r.repeat, r.fold): r.auc for r in gates.repeated_aucs(rows, ["candidate_pred", "reference_pred"], 2, 3).collect()}
    alone = {(p, r.repeat, r.fold): r.auc for p in ("candidate_pred", "reference_pred") for r in gates.repeated_auc(rows, p, 2, 3).collect()}
    assert len(both) == 12 and both == alone


def test_signatures_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def sign(x):
        made.add(1)
        return f"s{x % 3}"

    d = spark.createDataFrame([(i, i % 2, "a", "b", "c", "d", 5.0) for i in range(30)], "id long, target int, PaymentMethod string, Contract string, InternetService string, PaperlessBilling string, tenure double")
    kinds = {"k": F.udf(sign)("id")}
    got = signatures.duplicate_groups(d, kinds).collect()
    assert sorted((r.signature, r.group_size, r.sample_ids[:2]) for r in got) == [(f"s{i}", 10, [i, i + 3]) for i in range(3)] and made.value == 30
    flags = signatures.duplicate_flags(d, kinds).collect()
    assert {(r.k_group_size, r.k_inconsistent) for r in flags} == {(10, True)} and made.value == 60
