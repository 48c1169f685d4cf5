"""Queries of blend weights by descent: the moves of the first round, and the robustness of weights after two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..operators import blend as B
from ..operators import folds as L
from ..operators import scans as C
from ..sources.accounts import DUCK, accounts
from .audits import r6

_MODELS, _REPEATS, _FOLDS, _STEP = ["pred_cb", "pred_xgb", "pred_lgb"], 2, 3, 0.1
_SUMMARY = ("cv_mean_auc", "cv_std_auc", "cv_min_auc", "cv_max_auc", "full_auc", "optimism")


def _moves(s: SparkSession, d: str) -> DataFrame:
    """The AUC of each first move of each fit: of the rows outside a fold, and of all rows (as repeat -1)."""
    a = accounts(s, d).select("id", "target", *_MODELS)
    parts = [a.select(F.lit(-1).alias("repeat"), F.lit(0).alias("fold"), "target", *_MODELS)]
    for r in range(_REPEATS):
        dealt = L.stratified_folds(a, _FOLDS, f":{42 + r}")
        parts.append(dealt.select(F.lit(r).alias("repeat"), "fold", "target", *_MODELS))
    rows = saved(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    fits = [(-1, -1), *[(r, f) for r in range(_REPEATS) for f in range(_FOLDS)]]
    first = B.weight_moves(B.normalise_weights([1.0] * 3), _STEP)
    found = B.move_scores(rows, {f: first for f in fits}, _MODELS)
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("repeat", "left_out", "move")], r6("auc", "auc"))


def _weighted(s: SparkSession, d: str) -> DataFrame:
    found = C.robustness(accounts(s, d), _MODELS, _REPEATS, _FOLDS, weighted=True, step=_STEP, rounds=2)
    return found.filter("method = 'weighted'").select("method", *[r6(c, c) for c in _SUMMARY])


def _rows_sql(prefix: str) -> str:
    """The rows of each fit; the fold of a row comes from the hash of the repeat's seed and its id."""
    return f"""WITH {DUCK}, dealt AS (
  SELECT repeat, id, target, pred_cb, pred_xgb, pred_lgb,
    (row_number() OVER (PARTITION BY repeat, target ORDER BY md5('{prefix}' || cast(repeat + 42 AS VARCHAR) || ':' || cast(id AS VARCHAR)), id) - 1) % 3 AS fold
  FROM accounts, (SELECT unnest([0, 1]) AS repeat)
), fits AS (SELECT -1 AS repeat, -1 AS left_out UNION ALL SELECT r, f FROM (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1, 2]) AS f)
), used AS MATERIALIZED (
  SELECT fits.repeat, left_out, target, pred_cb, pred_xgb, pred_lgb FROM dealt JOIN fits ON fits.repeat = dealt.repeat AND fold <> left_out
  UNION ALL SELECT -1, -1, target, pred_cb, pred_xgb, pred_lgb FROM accounts
), weights_0 AS (SELECT repeat, left_out, cast(1 AS DOUBLE) / 3 AS a, cast(1 AS DOUBLE) / 3 AS b, cast(1 AS DOUBLE) / 3 AS c, NULL::DOUBLE AS auc FROM fits)"""


def _round_sql(t: int) -> str:
    """All moves of a round with their AUC, and the weights after it."""
    moves = ["SELECT repeat, left_out, 0 AS move, a, b, c FROM weights_{t}"]
    names = "abc"
    for i, n in enumerate(names):
        for j, sign in enumerate("-+"):
            x = f"({n} {sign} cast({_STEP} AS DOUBLE))"
            moved = [x if m == n else f"{m} * (1 - {x}) / (1 - {n})" for m in names]
            total = f"({' + '.join(f'greatest(0, {m})' for m in moved)})"
            cells = ", ".join(f"greatest(0, {m}) / {total} AS {k}" for m, k in zip(moved, names))
            moves.append(f"SELECT repeat, left_out, {2 * i + j + 1}, {cells} FROM weights_{{t}}")
    union = " UNION ALL ".join(moves).format(t=t)
    return f""", moves_{t} AS MATERIALIZED ({union}
), blended_{t} AS (
  SELECT m.repeat, m.left_out, move, target, a * pred_cb + b * pred_xgb + c * pred_lgb AS s FROM used u JOIN moves_{t} m ON m.repeat = u.repeat AND m.left_out = u.left_out
), ranked_{t} AS (
  SELECT *, rank() OVER (PARTITION BY repeat, left_out, move ORDER BY s) + (count(*) OVER (PARTITION BY repeat, left_out, move, s) - 1) / 2.0 AS r FROM blended_{t}
), scored_{t} AS MATERIALIZED (
  SELECT repeat, left_out, move, (sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * cast(count(*) - sum(target) AS DOUBLE)) AS auc
  FROM ranked_{t} GROUP BY ALL
), best_{t} AS (
  SELECT repeat, left_out, max(auc) FILTER (move = 0) AS now, max(auc) AS best, arg_min(move, (-auc, move)) AS move FROM scored_{t} GROUP BY ALL
), weights_{t + 1} AS MATERIALIZED (
  SELECT m.repeat, m.left_out, a, b, c, CASE WHEN best > now + 1e-10 THEN best ELSE now END AS auc FROM best_{t} x
  JOIN moves_{t} m ON m.repeat = x.repeat AND m.left_out = x.left_out AND m.move = CASE WHEN best > now + 1e-10 THEN x.move ELSE 0 END
)"""


QUERIES = {"blend_moves": _moves, "ensemble_weighted": _weighted}
ORACLES = {
    "blend_moves": f"{_rows_sql(':')}{_round_sql(0)} SELECT repeat, left_out, cast(move AS BIGINT) AS move, round(auc + 0.000000001, 6) AS auc FROM scored_0",
    "ensemble_weighted": f"""{_rows_sql(':')}{_round_sql(0)}{_round_sql(1)}, held AS (
  SELECT dealt.repeat, fold, target, a * pred_cb + b * pred_xgb + c * pred_lgb AS s FROM dealt JOIN weights_2 w ON w.repeat = dealt.repeat AND w.left_out = fold
), held_ranks AS (SELECT *, rank() OVER (PARTITION BY repeat, fold ORDER BY s) + (count(*) OVER (PARTITION BY repeat, fold, s) - 1) / 2.0 AS r FROM held
), held_auc AS (
  SELECT (sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * cast(count(*) - sum(target) AS DOUBLE)) AS auc FROM held_ranks GROUP BY repeat, fold
) SELECT 'weighted' AS method, round(avg(auc) + 0.000000001, 6) AS cv_mean_auc, round(stddev_pop(auc) + 0.000000001, 6) AS cv_std_auc, round(min(auc) + 0.000000001, 6) AS cv_min_auc,
  round(max(auc) + 0.000000001, 6) AS cv_max_auc, round(max(f.auc_full) + 0.000000001, 6) AS full_auc, round(max(f.auc_full) - avg(auc) + 0.000000001, 6) AS optimism
FROM held_auc, (SELECT auc AS auc_full FROM weights_2 WHERE repeat = -1) f""",
}
