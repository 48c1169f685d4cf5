"""The audit of label noise in full, and the compass of families left out of a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..operators import audit as A
from ..operators import signatures as S
from ..operators import trees as T
from ..operators.blend import blend
from ..plans import compass as C
from ..sources.accounts import DUCK, REFERENCE_WEIGHTS, accounts
from .audits import _AMOUNTS, _BIN, _REF, _TEXTS, r6

_TEACHERS = ["pred_cb", "pred_xgb", "pred_lgb"]
_OTHER = {"id", "target", "Churn", "split"}


def _noise(s: SparkSession, d: str) -> DataFrame:
    """Accounts, with half of their keys a second time under another label where the id is divisible by 40."""
    a = blend(accounts(s, d), REFERENCE_WEIGHTS)
    copies = a.filter("id % 40 = 0").withColumns({"id": F.col("id") + 100_000_000, "target": F.when(F.col("id") % 80 == 0, 1 - F.col("target")).otherwise(F.col("target"))})
    rows = a.unionByName(copies)
    features = [c for c in accounts(s, d).columns if c not in _OTHER and not c.startswith("pred_")]
    exact = S.exact(rows.select(*features))
    found = A.label_noise(rows, _TEACHERS, exact, S.coarse(features), upper=0.55, lower=0.3, hard=0.9, most=3)
    flags = ("near_duplicate_conflict", "label_noise_candidate", "hard_example_stable")
    return found.select("id", "target", r6("abs_error", "abs_error"), r6("logloss", "logloss"), "exact_group_size", "coarse_group_size", *flags, "primary_reason")


_FEATURES = f"{_TEXTS}, tenure, MonthlyCharges, TotalCharges"
_CLIPPED = "least(greatest(ref, cast(0.000001 AS DOUBLE)), cast(0.999999 AS DOUBLE))"
_NOISE = f"""WITH {DUCK}, doubled AS (
  SELECT * FROM accounts UNION ALL SELECT * REPLACE (id + 100000000 AS id, CASE WHEN id % 80 = 0 THEN 1 - target ELSE target END AS target) FROM accounts WHERE id % 40 = 0
), b AS (SELECT *, {_REF} AS ref, list_avg([pred_cb, pred_xgb, pred_lgb]) AS mean FROM doubled
), c AS (
  SELECT *, {_CLIPPED} AS p, sqrt(((pred_cb - (pred_cb + pred_xgb + pred_lgb) / 3) ** 2 + (pred_xgb - (pred_cb + pred_xgb + pred_lgb) / 3) ** 2 + (pred_lgb - (pred_cb + pred_xgb + pred_lgb) / 3) ** 2) / 3) AS std,
    least(pred_cb, pred_xgb, pred_lgb) >= 0.5 OR greatest(pred_cb, pred_xgb, pred_lgb) < 0.5 AS one_side,
    count(*) OVER e AS exact_group_size, min(target) OVER e < max(target) OVER e AS exact_conflict,
    count(*) OVER g AS coarse_group_size, min(target) OVER g < max(target) OVER g AS coarse_conflict
  FROM b WINDOW e AS (PARTITION BY {_FEATURES}), g AS (PARTITION BY {_TEXTS}, tenure, {_BIN}, {_AMOUNTS})
), x AS (SELECT *, abs(target - p) AS abs_error, -(target * ln(p) + (1 - target) * ln(1 - p)) AS logloss FROM c
), q AS (SELECT quantile_cont(logloss, 0.9) AS hard, quantile_cont(std, 0.35) AS calm, quantile_cont(std, 0.75) AS loud FROM x
), f AS (
  SELECT x.*, hard, loud, exact_conflict OR (coarse_conflict AND coarse_group_size <= 3) AS near_duplicate_conflict,
    ((target = 0 AND p >= 0.55) OR (target = 1 AND p <= 0.3)) AND one_side AND std <= calm + 1e-15 AS label_noise_candidate FROM x, q
), r AS (
  SELECT *, logloss >= hard AND (std >= loud - 1e-15 OR abs(p - 0.5) <= 0.15) AND NOT label_noise_candidate AND NOT near_duplicate_conflict AS hard_example_stable FROM f
)
SELECT id, target, round(abs_error + 0.000000001, 6) AS abs_error, round(logloss + 0.000000001, 6) AS logloss, exact_group_size, coarse_group_size, near_duplicate_conflict, label_noise_candidate,
  hard_example_stable, CASE WHEN near_duplicate_conflict THEN 'near_duplicate_conflict' WHEN label_noise_candidate THEN 'label_noise_candidate' ELSE 'hard_example_stable' END AS primary_reason
FROM r WHERE near_duplicate_conflict OR label_noise_candidate OR hard_example_stable"""


def _compass(s: SparkSession, d: str) -> DataFrame:
    """The families with the largest share of the reference's loss, each scored by trees that have seen none of it."""
    a = blend(accounts(s, d), REFERENCE_WEIGHTS)
    numeric, categorical = ("tenure", "MonthlyCharges"), ("Contract", "InternetService", "PaymentMethod", "PaperlessBilling")
    rows = saved(a.select("id", "target", "split", "reference_pred", F.expr(K.segment3()).alias("family"), *numeric, *categorical))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    binned = T.binning(train, numeric, categorical, bins=8)
    found = C.compass(train, test, "family", binned, T.Options(rounds=4, depth=3), top=4, min_train=50, min_test=10)
    numbers = ("reference_auc", "reference_logloss", "lofo_auc", "lofo_logloss", "gap_auc", "gap_logloss", "gap_contribution")
    return found.select("family", "train_rows", "test_rows", *[F.round(c, 5).alias(c) for c in numbers])


QUERIES = {"label_noise_audit": _noise, "learner_compass": _compass}
ORACLES = {"label_noise_audit": _NOISE}
