"""Queries of summaries and checks: bands, pseudo labels, inverted blends, and parity of training, test and submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.masks import preset
from ..operators import blend as B
from ..operators import select as S
from ..plans import parity as P
from ..sources.accounts import DUCK, REFERENCE_WEIGHTS, accounts
from .audits import _REF, r6

_TEACHERS = ["pred_cb", "pred_xgb", "pred_lgb"]
_MEAN = "((pred_cb + pred_xgb + pred_lgb) / 3)"
_STD = f"sqrt(((pred_cb - {_MEAN}) ** 2 + (pred_xgb - {_MEAN}) ** 2 + (pred_lgb - {_MEAN}) ** 2) / 3)"
_FAMILY = "PaymentMethod = 'Electronic check' AND Contract = 'Month-to-month' AND InternetService = 'Fiber optic'"
_THREE, _FOUR, _FIVE = {"cb": 0.5, "xgb": 0.3, "lgb": 0.2}, {"cb": 0.4, "xgb": 0.1, "lgb": 0.3, "r": 0.2}, {"cb": 0.3, "xgb": 0.2, "lgb": 0.1, "r": 0.1, "rv": 0.3}


def _band(s: SparkSession, d: str) -> DataFrame:
    a = B.blend(accounts(s, d), REFERENCE_WEIGHTS)
    row = S.band_summary(a, preset("ec_mtm_fiber_any"), "reference_pred", 0.2, _TEACHERS, 0.03)
    return row.select("rows", "family_rows", "band_rows", "baseline_rows", "final_rows", r6("relative_drift", "relative_drift"))


_SHARES = ("selected_mean", "teacher_std_mean", "mean_confidence", "accuracy", "positive_precision", "negative_precision")


def _pseudo(s: SparkSession, d: str) -> DataFrame:
    row = S.pseudo_summary(S.pseudo_rows(accounts(s, d), _TEACHERS, 0.12, 0.6), min_rows=10)
    return row.select("selected_rows", "selected_positive_rows", "selected_negative_rows", *[r6(c, c) for c in _SHARES])


def _inverted(s: SparkSession, d: str) -> DataFrame:
    a = accounts(s, d)
    for name, w in (("three", _THREE), ("four", _FOUR), ("five", _FIVE)):
        a = a.withColumn(name, B.weighted(w))
    rows, errors = B.invert_components(a.select("id", "pred_cb", "pred_r", "three", "four", "five"), ("three", _THREE), ("four", _FOUR), ("five", _FIVE))
    small = errors.select(*[(F.col(f"error_{n}") < 1e-12).alias(f"{n}_reconstructed") for n in ("three", "four", "five")])
    return rows.select("id", *[r6(f"pred_{m}", f"pred_{m}") for m in ("xgb", "lgb", "rv")]).crossJoin(F.broadcast(small))  # one row


def _submission_parity(s: SparkSession, d: str) -> DataFrame:
    """A submission of the test accounts with rows left out, repeated and out of range, against the reference's."""
    a = saved(B.blend(accounts(s, d), REFERENCE_WEIGHTS).filter("split = 'test'").select("id", "reference_pred", "pred_cb"))
    own = a.filter("id % 50 <> 4").select("id", F.expr("CASE WHEN id % 200 = 9 THEN pred_cb + 1 ELSE pred_cb END").alias("Churn"))
    own = own.unionByName(own.filter("id % 100 = 14"))
    checked = P.submission_checks(a, own, a.select("id", F.col("reference_pred").alias("Churn")))
    return checked.select("check", "status", r6("value", "value"))


QUERIES = {"band_summary": _band, "pseudo_summary": _pseudo, "inverted_components": _inverted, "submission_checks": _submission_parity}
_scored = f"WITH {DUCK}, x AS (SELECT *, {_REF} AS ref, {_MEAN} AS mean, {_STD} AS std FROM accounts)"
_six = lambda e, name: f"round({e} + 0.000000001, 6) AS {name}"
ORACLES = {
    "band_summary": f"""{_scored}, n AS (SELECT count(*) AS rows, count(*) FILTER ({_FAMILY}) AS family_rows, count(*) FILTER (abs(ref - 0.5) <= 0.2) AS band_rows,
  count(*) FILTER ({_FAMILY} AND abs(ref - 0.5) <= 0.2) AS baseline_rows, count(*) FILTER ({_FAMILY} AND abs(ref - 0.5) <= 0.2 AND std >= 0.03) AS final_rows FROM x)
SELECT *, {_six('CASE WHEN baseline_rows > 0 THEN (baseline_rows - final_rows) / cast(baseline_rows AS DOUBLE) ELSE 0 END', 'relative_drift')} FROM n""",
    "pseudo_summary": f"""{_scored}, c AS (
  SELECT *, CASE WHEN mean >= 0.5 THEN 1 ELSE 0 END AS label FROM x
  WHERE (mean >= 0.6 OR mean <= 0.12) AND (least(pred_cb, pred_xgb, pred_lgb) >= 0.5 OR greatest(pred_cb, pred_xgb, pred_lgb) < 0.5)
) SELECT count(*) AS selected_rows, count(*) FILTER (label = 1) AS selected_positive_rows, count(*) FILTER (label = 0) AS selected_negative_rows, {_six('avg(mean)', 'selected_mean')},
  {_six('avg(std)', 'teacher_std_mean')}, {_six('avg(greatest(mean, 1 - mean))', 'mean_confidence')}, {_six('avg(cast(target = label AS INTEGER))', 'accuracy')},
  {_six('avg(target) FILTER (label = 1)', 'positive_precision')}, {_six('avg(1 - target) FILTER (label = 0)', 'negative_precision')} FROM c""",
    "inverted_components": f"WITH {DUCK} SELECT id, {_six('pred_xgb', 'pred_xgb')}, {_six('pred_lgb', 'pred_lgb')}, {_six('pred_rv', 'pred_rv')}, true AS three_reconstructed, true AS four_reconstructed, true AS five_reconstructed FROM accounts",
    "submission_checks": f"""{_scored}, t AS (SELECT * FROM x WHERE split = 'test'
), own AS (SELECT id, CASE WHEN id % 200 = 9 THEN pred_cb + 1 ELSE pred_cb END AS p FROM t WHERE id % 50 <> 4
), given AS (SELECT * FROM own UNION ALL SELECT * FROM own WHERE id % 100 = 14
), v AS (
  SELECT (SELECT count(*) FROM given) - (SELECT count(*) FROM t) AS row_gap, (SELECT count(*) FROM t WHERE id % 50 = 4 OR id % 100 = 14) AS ids,
    (SELECT count(*) FROM given WHERE p < 0 OR p > 1) AS outside, (SELECT corr(own.p, t.ref) FROM own JOIN t USING (id)) AS c
)
SELECT 'submission_row_count_match_test' AS "check", CASE WHEN row_gap = 0 THEN 'PASS' ELSE 'FAIL' END AS status, cast(row_gap AS DOUBLE) AS value FROM v
UNION ALL SELECT 'submission_ids_match_test', CASE WHEN ids = 0 THEN 'PASS' ELSE 'FAIL' END, ids FROM v
UNION ALL SELECT 'submission_prediction_range', CASE WHEN outside = 0 THEN 'PASS' ELSE 'WARN' END, outside FROM v
UNION ALL SELECT 'reference_correlation', CASE WHEN c >= 0.95 THEN 'PASS' ELSE 'WARN' END, round(c + 0.000000001, 6) FROM v""",
}
