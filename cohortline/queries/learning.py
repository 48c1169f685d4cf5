"""Queries of learners: their rows can't be checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.masks import preset
from ..functions.metrics import auc
from ..operators import audit as A
from ..operators import experiments as X
from ..operators import folds as L
from ..operators import learners as M
from ..operators import scans as C
from ..operators import select as S
from ..operators.signatures import overlap
from ..plans.gates import adversarial_severity, repeated_stats
from ..sources.accounts import REFERENCE_WEIGHTS, accounts
from ..operators.blend import blend

_CAT, _NUM = ("PaymentMethod", "Contract", "InternetService", "PaperlessBilling", "TechSupport"), ("tenure", "MonthlyCharges", "total")


def rows(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The rows in folds, with the reference and its residual, or with no more than the columns given."""
    a = blend(accounts(s, d), REFERENCE_WEIGHTS).withColumn("total", F.coalesce("TotalCharges", F.lit(0.0)))
    if columns:
        return saved(L.stratified_folds(a.select("id", "target", *columns), 2, 7).drop("id"))  # read by every fit
    return saved(L.stratified_folds(a, 2, 7).select("id", "target", "fold", "reference_pred", *_CAT, *_NUM).withColumn("residual", F.col("target") - F.col("reference_pred")))  # read by every fit


def _report(name: str):  # noqa: ANN202
    return lambda out: auc(out, ["fold"], "target", name).withColumn("auc", F.round("auc", 4))


QUERIES = {
    "learner_boosted": lambda s, d: _report("oof_pred")(M.cross_validate(rows(s, d), 2, M.boosted(_CAT, _NUM, rounds=8))),
    "learner_linear": lambda s, d: _report("oof_pred")(M.cross_validate(rows(s, d, *_CAT, *_NUM), 2, M.linear(_CAT, _NUM))),
    "learner_factorised": lambda s, d: _report("oof_pred")(M.cross_validate(rows(s, d, *_CAT, *_NUM), 2, M.factorised(_CAT, _NUM))),
    "learner_residual": lambda s, d: _report("moved")(M.cross_validate(rows(s, d), 2, M.boosted(_CAT, _NUM, "residual", 5, regression=True), "residual_pred").withColumn("moved", F.col("reference_pred") + 0.2 * F.col("residual_pred"))),
    "learner_platt": lambda s, d: _report("calibrated")(M.calibrated(rows(s, d), 2, "platt", "reference_pred")),
    "learner_isotonic": lambda s, d: _report("calibrated")(M.calibrated(rows(s, d), 2, "isotonic", "reference_pred")),
    "learner_pairwise": lambda s, d: _report("rank_score")(M.pairwise(rows(s, d), "Contract", ["reference_pred", "tenure", "MonthlyCharges"], 3000)),
}


_EC = "ec_mtm_fiber_any"
_TEACHERS = ["pred_cb", "pred_xgb", "pred_lgb"]
# all that both tables share, as in the reference: coarser signatures are those of any row once there are many
_SHARED = (*_CAT, "tenure", "MonthlyCharges", "TotalCharges", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "StreamingTV", "StreamingMovies")
_SIGNATURE = ("Contract", "PaymentMethod", "InternetService", "cast(tenure AS STRING)")


def full(s: SparkSession, d: str) -> DataFrame:
    """The rows with the teachers and all that masks, keys and scenarios read."""
    a = blend(accounts(s, d), REFERENCE_WEIGHTS).withColumn("total", F.coalesce("TotalCharges", F.lit(0.0)))
    columns = ["id", "target", "split", "reference_pred", *_TEACHERS, *_CAT, *_NUM, "TotalCharges", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "StreamingTV", "StreamingMovies"]
    return saved(L.stratified_folds(a.select(*columns), 2, 7))  # read by every fit


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _splines(s: SparkSession, d: str) -> DataFrame:
    rows, made = X.splines(full(s, d), "tenure", (6, 12, 24, 48, 72))
    rows, more = X.meta_features(rows, _TEACHERS)
    return auc(M.cross_validate(rows, 2, lambda k: X.plain_logistic([*made, *more, "MonthlyCharges"])), ["fold"], "target", "oof_pred").withColumn("auc", F.round("auc", 4))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    """Vectors as nodes; the label is whether the first component is above 0, the features those of the neighbours."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    values = v.select("vec_id", F.col("embedding")[0].cast("double").alias("x0"), F.col("embedding")[1].cast("double").alias("x1"))
    rows, made = X.neighbour_features(v, values, ["x0", "x1"], 8, 2)
    rows = rows.withColumn("target", (F.col("x0") > 0).cast("int")).fillna(0.0, made)
    dealt = saved(L.stratified_folds(saved(rows), 2, 7, id_column="vec_id"))  # read by every pass of every fit
    return auc(M.cross_validate(dealt, 2, lambda k: X.plain_logistic(made)), ["fold"], "target", "oof_pred").withColumn("auc", F.round("auc", 4))


def _pseudo(s: SparkSession, d: str) -> DataFrame:
    a = full(s, d)
    own = a.filter("split = 'train'")
    got = X.pseudo_sweep(own.filter("fold = 0"), a.filter("split = 'test'"), own.filter("fold = 1"), _TEACHERS, lambda: X.plain_logistic(["tenure", "MonthlyCharges", "total"], "label", "weight"), [(0.6, 0.1, 0.25), (0.55, 0.12, 0.5)], preset(_EC))
    return _rounded(X.sweep_summary(got).drop("std_delta_global_auc"), "mean_delta_global_auc", "mean_delta_family_auc", "mean_selected_accuracy")


def _scenarios(s: SparkSession, d: str) -> DataFrame:
    a = full(s, d)
    models = {"cb": M.linear(_CAT, _NUM)(0).fit(a.filter("fold = 0")), "xgb": M.linear(_CAT, ("tenure", "MonthlyCharges"))(0).fit(a.filter("fold = 0"))}
    signals = C.counterfactual_signals(X.scenario_scores(a, models), {"cb": 0.6, "xgb": 0.4}, S.SCENARIOS)
    scanned = C.signal_scan(a.join(signals.select("id", "cf_mean_positive_drop", "cf_stable_bundle_drop"), "id"), ["cf_mean_positive_drop", "cf_stable_bundle_drop"], (0.05, 0.2), preset(_EC))
    return _rounded(scanned.select("signal", "alpha", "mask_rows", "auc", "delta"), "auc", "delta")


def _adversarial(s: SparkSession, d: str) -> DataFrame:
    a = full(s, d)
    a = a.select("id", "split", *_CAT, "MonthlyCharges", "total")
    got = X.adversarial(a.filter("split = 'train'").drop("split"), a.filter("split = 'test'").drop("split"), 2, M.linear(_CAT, ("MonthlyCharges", "total"), "is_test"))
    return repeated_stats(got).select("folds", F.round("cv_mean_auc", 2).alias("mean_auc"), adversarial_severity(F.col("cv_mean_auc")).alias("severity"))


def _averaged(s: SparkSession, d: str) -> DataFrame:
    a = full(s, d)
    models = [M.linear(_CAT, _NUM)(k).fit(a.filter(F.col("fold") == k)) for k in range(2)]
    return auc(X.ensemble_prediction(models, a.filter("split = 'test'")), [], "target", "prediction").withColumn("auc", F.round("auc", 4))


def _external(s: SparkSession, d: str) -> DataFrame:
    a = full(s, d)
    own, other, signature = a.filter("split = 'train'"), a.filter("split = 'test'"), overlap(_SHARED)
    taught = X.external_teacher(own, other, M.linear(_CAT, _NUM), signature)
    joint = X.joint_training(own, other, 2, lambda k: X.plain_logistic(["tenure", "MonthlyCharges", "total"], weight="sample_weight"), signature, 0.25)
    transfer = auc(taught, ["fold"], "target", "external_pred", "transfer_auc")
    return auc(joint, ["fold"], "target", "oof_pred", "joint_auc").join(transfer, "fold", "left").select("fold", F.round("transfer_auc", 4).alias("transfer_auc"), F.round("joint_auc", 4).alias("joint_auc"))


QUERIES |= {
    "learner_multi_seed": lambda s, d: _report("oof_pred")(X.multi_seed(rows(s, d).select("id", "target", *_CAT, *_NUM), 2, (1, 2), lambda seed: M.linear(_CAT, _NUM)).withColumn("fold", F.lit(0))),
    "learner_averaged": _averaged,
    "learner_gated": lambda s, d: _rounded(X.gated(full(s, d), 2, M.linear(_CAT, _NUM), preset(_EC), (0.1, 0.3)), "auc"),
    "learner_stacked": lambda s, d: _report("oof_pred")(X.feature_challenger(full(s, d), 2, M.linear(_CAT, _NUM), M.linear(_CAT, (*_NUM, "stack_pred", "stack_available")), preset(_EC))),
    "learner_band_reranker": lambda s, d: _rounded(X.reranked(full(s, d), 2, M.boosted(_CAT, _NUM, "residual", 3, regression=True), preset(_EC) & (F.abs(F.col("reference_pred") - 0.5) <= 0.2), (0.1, 0.3)), "auc"),
    "learner_hard_reranker": lambda s, d: _rounded(X.reranked(S.hard_examples(full(s, d), preset(_EC), F.abs(F.col("pred_cb") - F.col("pred_xgb")), 0.5), 2, M.boosted(_CAT, _NUM, "residual", 3, regression=True), F.col("hard") == 1, (0.1, 0.3)), "auc"),
    "learner_stability": lambda s, d: X.stability(full(s, d).select("id", "target", *_CAT, *_NUM), 2, (1, 2), lambda seed: M.linear(_CAT, _NUM)).agg(F.count("*").alias("rows"), F.round(F.avg("std"), 3).alias("mean_std"), F.round(F.avg("flip"), 3).alias("mean_flip")),
    "learner_encoded": lambda s, d: _report("oof_pred")(X.encoded_boosting(full(s, d), 2, K.ngrams(("Contract", "InternetService", "PaymentMethod")), _NUM, 4)),
    "learner_spline_meta": _splines,
    "learner_perceptron": lambda s, d: _report("oof_pred")(M.cross_validate(rows(s, d, *_CAT[:3], *_NUM[:2]), 2, M.perceptron(_CAT[:3], _NUM[:2], 15))),
    "learner_neighbours": _neighbours,
    "learner_pseudo_sweep": _pseudo,
    "learner_external": _external,
    "learner_mitigated": lambda s, d: _report("oof_pred")(X.mitigated(full(s, d), 2, lambda k: X.plain_logistic(["tenure", "MonthlyCharges", "total"], weight="sample_weight"), A.signature(_SIGNATURE), 0.5)),
    "learner_suite": lambda s, d: _rounded(X.suite(full(s, d), 2, {"few": M.linear(_CAT[:2], _NUM[:1]), "all": M.linear(_CAT, _NUM)}), "oof_auc", "best_auc", "delta_vs_reference"),
    "learner_scenarios": _scenarios,
    "learner_priors": lambda s, d: _report("oof_pred")(X.with_prior_features(full(s, d), 2, lambda k, columns: X.plain_logistic([c for c in columns if c.startswith("prior_") and "logit" in c]))),
    "learner_adversarial": _adversarial,
    "learner_generalisation": lambda s, d: _rounded(X.generalisation(full(s, d), F.expr(K.segment3()), (S.DOMINANT, "Mailed check__One year__DSL"), M.linear(_CAT, _NUM)), "reference_logloss", "left_out_logloss", "reference_auc", "left_out_auc", "gap_auc", "gap_logloss"),
}
