"""Queries of error reports, dominance, gates, chains and scans. Their SQL is written by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.masks import preset
from ..functions.metrics import duck_auc
from ..operators import audit as A
from ..operators import blend as B
from ..operators import blocks
from ..operators import scans as C
from ..operators import select as S
from ..plans import dominance as D
from ..plans import errors as E
from ..plans import gates as G
from ..plans import protocol as P
from ..sources.accounts import DUCK, REFERENCE_WEIGHTS, accounts
from .audits import _BIN, _LOSS, _REF, _S3, _S5, r6

QUERIES, ORACLES = {}, {}
_EC = "(PaymentMethod = 'Electronic check' AND Contract = 'Month-to-month' AND InternetService = 'Fiber optic')"
_SC = f"sc AS (SELECT *, {_S3} AS segment3, {_S5} AS segment5, {_REF} AS ref, 0.2 * pred_cb::DOUBLE + 0.1 * pred_xgb + 0.5 * pred_lgb + 0.1 * pred_r + 0.1 * pred_rv AS cha FROM accounts)"
_SECOND = {"cb": 0.2, "xgb": 0.1, "lgb": 0.5, "r": 0.1, "rv": 0.1}


def register(name: str, query, oracle: str) -> None:  # noqa: ANN001
    QUERIES[name] = query
    ORACLES[name] = f"WITH {DUCK}, {_SC}" + (f", {oracle[1:]}" if oracle.startswith("+") else f" {oracle}")


def d6(expression: str, name: str) -> str:
    return f"round(({expression})::DOUBLE + 0.000000001, 6) + 0 AS {name}"


def both(spark: SparkSession, d: str) -> DataFrame:
    out = B.blend(B.blend(accounts(spark, d), REFERENCE_WEIGHTS), _SECOND, "challenger_pred")
    return out.withColumns({"segment3": F.expr(K.segment3()), "segment5": F.expr(K.segment5())})


# --- errors by group
_DIMS = {
    "contract": "Contract", "payment_method": "PaymentMethod", "internet_service": "InternetService", "paperless": "PaperlessBilling", "senior": "SeniorCitizen", "partner": "Partner", "dependents": "Dependents",
    "tenure_bin": K.tenure_bin(), "annual_boundary": "annual_boundary_bin", "contract_boundary": "contract_boundary_bin", "contract_x_boundary": "contract_x_boundary_bin", "segment3": "segment3", "segment5_support": "segment5_support_bucket", "segment5": "segment5",
}


def _cases(s: SparkSession, d: str) -> DataFrame:
    rows = blocks.apply_blocks(both(s, d), "R")
    support = rows.groupBy("segment5").agg(F.count("*").alias("_support"))
    rows = rows.join(support, "segment5").withColumn("segment5_support_bucket", F.expr(K.segment5_support_bucket("_support")))
    columns = ["target", "reference_pred", "challenger_pred", "Contract", "PaymentMethod", "InternetService", "PaperlessBilling", "SeniorCitizen", "Partner", "Dependents", "tenure", "annual_boundary_bin", "contract_boundary_bin", "contract_x_boundary_bin", "segment3", "segment5", "segment5_support_bucket"]
    return saved(E.with_hard_cases(rows.select(*columns)))  # read by each metric


_MONTHS = "CASE Contract WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 ELSE 1 END"
_TO = lambda m: f"(({m}) - tenure % ({m})) % ({m})"
_BOUND = lambda e: f"CASE WHEN {e} = 0 THEN 'now' WHEN {e} <= 2 THEN 'near_2' WHEN {e} <= 5 THEN 'near_5' ELSE 'far' END"
_CBIN = f"CASE WHEN Contract = 'Month-to-month' THEN 'no_cycle' ELSE {_BOUND(_TO(_MONTHS))} END"
_DUCK_DIMS = {
    "contract": "Contract", "payment_method": "PaymentMethod", "internet_service": "InternetService", "paperless": "PaperlessBilling", "senior": "SeniorCitizen::VARCHAR", "partner": "Partner", "dependents": "Dependents",
    "tenure_bin": _BIN, "annual_boundary": _BOUND(_TO("12")), "contract_boundary": _CBIN, "contract_x_boundary": f"Contract || '__' || {_CBIN}", "segment3": "segment3",
    "segment5_support": "CASE WHEN sup <= 49 THEN 'lt50' WHEN sup <= 99 THEN '50_99' WHEN sup <= 249 THEN '100_249' WHEN sup <= 499 THEN '250_499' ELSE '500_plus' END", "segment5": "segment5",
}
_G1 = f"""+e0 AS (SELECT *, {_LOSS('target', 'ref')} AS rl, {_LOSS('target', 'cha')} AS cl, count(*) OVER (PARTITION BY segment5) AS sup FROM sc), q AS (SELECT quantile_cont(rl, 0.95) AS rq, quantile_cont(cl, 0.95) AS cq FROM e0),
e1 AS (SELECT e0.*, (rl >= rq)::INT AS rh, (cl >= cq)::INT AS ch FROM e0, q), cells AS ({' UNION ALL '.join(f"SELECT '{n}' AS family, {e} AS group_value, {E.MIN_ROWS[n]} AS least, target AS y, ref, cha, rl, cl, rh, ch FROM e1" for n, e in _DUCK_DIMS.items())}),
g0 AS (SELECT family, group_value, count(*) AS rows, sum(y)::BIGINT AS positives, avg(y) AS positive_rate, avg(cl) AS cll, avg(rl) AS rll, avg((cha - y) ** 2) AS cb, avg((ref - y) ** 2) AS rb, avg(abs(cha - y)) AS cm, avg(abs(ref - y)) AS rm, avg(cha) AS cp, avg(ref) AS rp, avg(ch) AS chr, avg(rh) AS rhr,
avg(abs(cha - ref)) AS shift, avg(cha - ref) AS signed FROM cells GROUP BY 1, 2 HAVING count(*) >= min(least)), ca AS ({duck_auc('cells', 'y', 'cha', 'family, group_value')}), ra AS ({duck_auc('cells', 'y', 'ref', 'family, group_value')}),
g AS (SELECT g0.*, ca.auc AS ca, ra.auc AS ra, (SELECT count(*) FROM e1) AS n_all FROM g0 JOIN ca USING (family, group_value) JOIN ra USING (family, group_value))"""
_ERRS = ["positive_rate", "challenger_auc", "reference_auc", "delta_auc", "delta_logloss", "logloss_delta_contribution", "delta_brier", "delta_mae", "delta_abs_calibration_gap", "mean_abs_pred_shift", "signed_pred_shift", "delta_hard_case_rate"]
register(
    "error_groups",
    lambda s, d: E.group_errors(_cases(s, d), _DIMS, E.MIN_ROWS).select("family", "group_value", "rows", "positives", *[r6(c, c) for c in _ERRS]),
    f"{_G1} SELECT family, group_value, rows, positives, {d6('positive_rate', 'positive_rate')}, {d6('ca', 'challenger_auc')}, {d6('ra', 'reference_auc')}, {d6('ca - ra', 'delta_auc')}, {d6('cll - rll', 'delta_logloss')}, {d6('(cll - rll) * rows / n_all', 'logloss_delta_contribution')}, {d6('cb - rb', 'delta_brier')}, {d6('cm - rm', 'delta_mae')}, {d6('abs(cp - positive_rate) - abs(rp - positive_rate)', 'delta_abs_calibration_gap')}, {d6('shift', 'mean_abs_pred_shift')}, {d6('signed', 'signed_pred_shift')}, {d6('chr - rhr', 'delta_hard_case_rate')} FROM g",
)
register(
    "hard_case_lift",
    lambda s, d: (lambda x: E.hard_cases(E.group_errors(x, _DIMS, E.MIN_ROWS), x).select("family", "group_value", "rows", r6("challenger_hard_case_rate", "challenger_hard_case_rate"), r6("challenger_hard_case_lift", "challenger_hard_case_lift")))(_cases(s, d)),
    f"{_G1} SELECT family, group_value, rows, {d6('chr', 'challenger_hard_case_rate')}, {d6('chr / (SELECT avg(ch) FROM e1)', 'challenger_hard_case_lift')} FROM g WHERE rows >= 2000",
)
_W = lambda e, n: d6(f"sum(({e}) * rows) / sum(CASE WHEN ({e}) IS NOT NULL THEN rows END)", n)
register(
    "error_family_summary",
    lambda s, d: E.family_summary(E.group_errors(_cases(s, d), _DIMS, E.MIN_ROWS)).select("family", "groups", "rows_sum", *[r6(f"weighted_{c}", f"weighted_{c}") for c in ("delta_logloss", "delta_brier", "delta_mae", "delta_auc", "mean_abs_pred_shift", "delta_hard_case_rate")]),
    f"{_G1} SELECT family, count(*) AS groups, sum(rows)::BIGINT AS rows_sum, {_W('cll - rll', 'weighted_delta_logloss')}, {_W('cb - rb', 'weighted_delta_brier')}, {_W('cm - rm', 'weighted_delta_mae')}, {_W('ca - ra', 'weighted_delta_auc')}, {_W('shift', 'weighted_mean_abs_pred_shift')}, {_W('chr - rhr', 'weighted_delta_hard_case_rate')} FROM g GROUP BY 1",
)
register(
    "worst_groups",
    lambda s, d: E.selected(E.group_errors(_cases(s, d), _DIMS, E.MIN_ROWS).withColumn("delta_logloss", F.round("delta_logloss", 9)), "delta_logloss", 6, best=False).select("family", "group_value", r6("delta_logloss", "delta_logloss")),
    f"{_G1} SELECT family, group_value, {d6('cll - rll', 'delta_logloss')} FROM g ORDER BY round(cll - rll, 9) DESC, family, group_value LIMIT 6",
)
# --- dominance
_CHALLENGERS = {"cb": "pred_cb", "xgb": "pred_xgb", "second": "challenger_pred"}
_bucket = lambda x, edges, prefix: f"CASE WHEN {x} < {edges}[1] OR {x} > {edges}[len({edges})] THEN '__missing__' ELSE '{prefix}_' || lpad((greatest(len(list_filter({edges}, lambda v: v < {x})), 1) - 1)::VARCHAR, 2, '0') END"
_DOM = f"""+q0 AS (SELECT least(greatest(round(ref, 6), 0.000001), 0.999999) AS r0, * FROM sc), q1 AS (SELECT list_sort(list_distinct([0.0::DOUBLE] || quantile_cont(r0, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) || [1.0::DOUBLE])) AS edges FROM q0),
ch AS ({' UNION ALL '.join(f"SELECT '{n}' AS challenger, target AS y, segment3, segment5, r0 AS r, least(greatest({p}, 0.000001), 0.999999) AS c, edges FROM q0, q1" for n, p in (('cb', 'pred_cb'), ('xgb', 'pred_xgb'), ('second', 'cha')))}),
cx AS (SELECT *, {_LOSS('y', 'r')} AS rl, {_LOSS('y', 'c')} AS cl, {_bucket('r', 'edges', 'score')} AS score_decile, {_bucket('abs(r - 0.5)', '[0.0, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50]', 'confidence')} AS confidence_bucket, {_bucket('abs(c - r)', '[0.0, 0.005, 0.01, 0.02, 0.05, 0.10, 1.0]', 'disagreement')} AS disagreement_bucket FROM ch),
lv AS ({' UNION ALL '.join(f"SELECT challenger, '{x}' AS level, {x} AS value, y, r, c, rl, cl FROM cx" for x in ('segment3', 'segment5', 'score_decile', 'confidence_bucket', 'disagreement_bucket'))}),
ra AS ({duck_auc('lv', 'y', 'r', 'challenger, level, value')}), ca AS ({duck_auc('lv', 'y', 'c', 'challenger, level, value')}),
dl AS (SELECT challenger, level, value, rows, ra.auc AS ra, ca.auc AS ca, rll, cll FROM (SELECT challenger, level, value, count(*) AS rows, avg(rl) AS rll, avg(cl) AS cll FROM lv GROUP BY 1, 2, 3) JOIN ra USING (challenger, level, value) JOIN ca USING (challenger, level, value)),
gr AS ({duck_auc('cx', 'y', 'r', 'challenger')}), gc AS ({duck_auc('cx', 'y', 'c', 'challenger')}),
sm AS (SELECT challenger, max(gc.auc) - max(gr.auc) AS da, avg(cl) - avg(rl) AS dll, corr(r, c) AS pearson, avg(abs(c - r)) AS mad FROM cx JOIN gr USING (challenger) JOIN gc USING (challenger) GROUP BY 1),
dm AS (SELECT challenger, max(CASE WHEN level = 'segment3' AND value = '{S.DOMINANT}' THEN ca - ra END) AS dda, max(CASE WHEN level = 'segment3' AND value = '{S.DOMINANT}' THEN cll - rll END) AS ddl,
avg(CASE WHEN level = 'segment3' THEN coalesce(ra >= ca, false)::INT END) AS w3a, avg(CASE WHEN level = 'segment3' THEN (rll <= cll)::INT END) AS w3l, avg(CASE WHEN level = 'segment5' THEN coalesce(ra >= ca, false)::INT END) AS w5a, avg(CASE WHEN level = 'segment5' THEN (rll <= cll)::INT END) AS w5l FROM dl GROUP BY 1)"""
# the reference to six decimals: sums of weighted predictions that are equal differ in their last bits
_DIAG = lambda name: lambda s, d: D.diagnostic(both(s, d).withColumn("reference_pred", F.round("reference_pred", 6)), _CHALLENGERS)[name]
_delta_columns = lambda t: t.select("challenger", "level", "value", "rows", r6("delta_auc", "delta_auc"), r6("delta_logloss", "delta_logloss"), r6("delta_contribution", "delta_contribution"), "reference_wins_auc", "reference_wins_logloss")
_delta_sql = f"{_DOM} SELECT challenger, level, value, rows, {d6('ca - ra', 'delta_auc')}, {d6('cll - rll', 'delta_logloss')}, {d6('(cll - rll) * rows / (SELECT count(*) FROM sc)', 'delta_contribution')}, coalesce(ra >= ca, false) AS reference_wins_auc, rll <= cll AS reference_wins_logloss FROM dl WHERE level "
register("dominance_families", lambda s, d: _delta_columns(_DIAG("families")(s, d)), _delta_sql + "IN ('segment3', 'segment5')")
register("dominance_slices", lambda s, d: _delta_columns(_DIAG("slices")(s, d)), _delta_sql + "NOT IN ('segment3', 'segment5')")
register(
    "dominance_challengers",
    lambda s, d: _DIAG("challengers")(s, d).select("challenger", *[r6(c, c) for c in ("delta_auc", "delta_logloss", "pearson", "mean_abs_diff", "dominant_delta_auc", "dominant_delta_logloss", "segment3_auc_win_rate", "segment3_logloss_win_rate", "segment5_auc_win_rate", "segment5_logloss_win_rate")]),
    f"{_DOM} SELECT challenger, {d6('da', 'delta_auc')}, {d6('dll', 'delta_logloss')}, {d6('pearson', 'pearson')}, {d6('mad', 'mean_abs_diff')}, {d6('dda', 'dominant_delta_auc')}, {d6('ddl', 'dominant_delta_logloss')}, {d6('w3a', 'segment3_auc_win_rate')}, {d6('w3l', 'segment3_logloss_win_rate')}, {d6('w5a', 'segment5_auc_win_rate')}, {d6('w5l', 'segment5_logloss_win_rate')} FROM sm JOIN dm USING (challenger)",
)
register(
    "dominance_patterns",
    lambda s, d: _DIAG("patterns")(s, d).select("level", "value", r6("mean_delta_logloss", "mean_delta_logloss"), "challengers", "support_rows"),
    f"{_DOM} SELECT level, value, {d6('m', 'mean_delta_logloss')}, challengers, support_rows FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY m DESC, support_rows DESC, value) AS i FROM (SELECT level, value, avg(cll - rll) AS m, count(DISTINCT challenger) AS challengers, sum(rows)::BIGINT AS support_rows FROM dl WHERE level IN ('confidence_bucket', 'disagreement_bucket') GROUP BY 1, 2)) WHERE i <= 5",
)
register(
    "dominance_verdict",
    _DIAG("verdict"),
    f"""{_DOM}, a AS (SELECT avg((ddl > 0)::INT) AS share, min((dll > 0)::INT) = 1 AS global_always FROM sm JOIN dm USING (challenger)), w AS (SELECT coalesce(min((d > 0)::INT), 0) = 1 AS unsure_worse FROM (SELECT avg(cll - rll) AS d FROM dl WHERE value IN ('confidence_00', 'confidence_01', 'confidence_02') GROUP BY challenger)),
x AS (SELECT coalesce(min((d > 0)::INT), 0) = 1 AS disagreement_worse FROM (SELECT avg(cll - rll) AS d FROM dl WHERE value IN ('disagreement_03', 'disagreement_04', 'disagreement_05') GROUP BY challenger))
SELECT share = 1 AS dominant_always, share >= 0.8 AS dominant_mostly, global_always, unsure_worse, disagreement_worse, CASE WHEN share >= 0.8 AND unsure_worse AND disagreement_worse THEN 'unsure_band_of_dominant_family' WHEN share = 1 AND global_always THEN 'explain_reference' ELSE 'review_slices' END AS recommendation FROM a, w, x""",
)
# --- scans
_A = (0.05, 0.1, 0.2, 0.5)
_grid = lambda alphas: " UNION ALL ".join(f"SELECT {i} AS pos, {a}::DOUBLE AS alpha" for i, a in enumerate(alphas))
register(
    "fixed_blend_scan",
    lambda s, d: C.fixed_blend(both(s, d), "challenger_pred").select("best_alpha", r6("best_auc", "best_auc"), r6("delta_vs_reference", "delta_vs_reference")),
    f"+gr AS ({_grid((0.0, 0.05, 0.1, 0.15, 0.2, 0.25))}), ex AS (SELECT pos, alpha, target, (1 - alpha) * ref + alpha * cha AS s FROM sc, gr), au AS ({duck_auc('ex', 'target', 's', 'pos, alpha')}), b AS (SELECT * FROM au ORDER BY round(auc, 12) DESC, pos LIMIT 1) SELECT b.alpha AS best_alpha, {d6('b.auc', 'best_auc')}, {d6('b.auc - (SELECT auc FROM au WHERE pos = 0)', 'delta_vs_reference')} FROM b",
)
register(
    "alpha_scan_rank_blend",
    lambda s, d: C.rank_blend(both(s, d), _A, preset("ec_mtm_fiber_any"), "pred_xgb").select("pos", "alpha", r6("auc", "auc"), r6("auc_on_mask", "auc_on_mask")),
    f"+i AS (SELECT id, row_number() OVER (ORDER BY pred_xgb, id) AS k FROM sc WHERE {_EC}), v AS (SELECT ref AS moved, row_number() OVER (ORDER BY ref, id) AS k FROM sc WHERE {_EC}), m AS (SELECT id, moved FROM i JOIN v USING (k)), gr AS ({_grid(_A)}), ex AS (SELECT pos, alpha, target, CASE WHEN moved IS NOT NULL THEN (1 - alpha) * ref + alpha * moved ELSE ref END AS s, moved IS NOT NULL AS inside FROM sc LEFT JOIN m USING (id), gr) "
    f"SELECT pos, alpha, {d6('a.auc', 'auc')}, {d6('b.auc', 'auc_on_mask')} FROM ({duck_auc('ex', 'target', 's', 'pos, alpha')}) a JOIN ({duck_auc('(SELECT * FROM ex WHERE inside)', 'target', 's', 'pos, alpha')}) b USING (pos, alpha)",
)
_SCEN = ("auto_payment", "paperless_off", "contract_upgrade", "stability_bundle")


def _scenarios(s: SparkSession, d: str) -> DataFrame:
    """A deterministic scorer in place of models: each change of a row takes a tenth off, two more so."""
    a = accounts(s, d)
    rows = S.counterfactuals(a)
    changed = lambda: F.lit(1.0) - 0.1 * ((F.col("PaymentMethod") != F.col("_pm")).cast("int") + (F.col("Contract") != F.col("_c")).cast("int")) - 0.05 * (F.col("PaperlessBilling") != F.col("_pb")).cast("int")
    was = a.select("id", F.col("PaymentMethod").alias("_pm"), F.col("Contract").alias("_c"), F.col("PaperlessBilling").alias("_pb"))
    moved = rows.join(was, "id").select("id", "scenario", *[(F.col(f"pred_{m}") * changed()).alias(f"pred_{m}") for m in ("cb", "xgb")])
    return moved.unionByName(a.select("id", F.lit("base").alias("scenario"), "pred_cb", "pred_xgb"))


_SIG = f"""+sg0 AS (SELECT id, least(greatest((pred_cb * 0.75::DOUBLE + pred_xgb * 0.25), 0.000001), 0.999999) AS base, {', '.join(f"least(greatest((pred_cb * 0.75::DOUBLE + pred_xgb * 0.25) * (1 - ({f})), 0.000001), 0.999999) AS {n}" for n, f in (
    ('auto_payment', "0.1 * (PaymentMethod IN ('Electronic check', 'Mailed check'))::INT"), ('paperless_off', "0.05 * (PaperlessBilling = 'Yes')::INT"), ('contract_upgrade', "0.1 * (Contract <> 'Two year')::INT"),
    ('stability_bundle', "0.1 * ((PaymentMethod IN ('Electronic check', 'Mailed check'))::INT + (Contract <> 'Two year')::INT) + 0.05 * (PaperlessBilling = 'Yes')::INT")))} FROM sc),
sg AS (SELECT *, [{', '.join(f'greatest(base - {n}, 0)' for n in _SCEN)}] AS drops FROM sg0)"""  # fmt: skip
register(
    "counterfactual_signals",
    lambda s, d: C.counterfactual_signals(_scenarios(s, d), {"cb": 3.0, "xgb": 1.0}, _SCEN).select("id", r6("cf_base_teacher_pred", "cf_base_teacher_pred"), *[r6(f"cf_{n}_delta", f"cf_{n}_delta") for n in _SCEN], r6("cf_mean_positive_drop", "cf_mean_positive_drop"), r6("cf_max_positive_drop", "cf_max_positive_drop"), r6("cf_stable_bundle_drop", "cf_stable_bundle_drop")),
    f"{_SIG} SELECT id, {d6('base', 'cf_base_teacher_pred')}, {', '.join(d6(f'{n} - base', f'cf_{n}_delta') for n in _SCEN)}, {d6('list_sum(drops) / 4', 'cf_mean_positive_drop')}, {d6('list_max(drops)', 'cf_max_positive_drop')}, {d6('drops[4]', 'cf_stable_bundle_drop')} FROM sg",
)


def _signals(s: SparkSession, d: str) -> DataFrame:
    signals = C.counterfactual_signals(_scenarios(s, d), {"cb": 3.0, "xgb": 1.0}, _SCEN).select("id", "cf_mean_positive_drop", "cf_stable_bundle_drop")
    return C.signal_scan(both(s, d).join(signals, "id"), ["cf_mean_positive_drop", "cf_stable_bundle_drop"], (0.05, 0.2), preset("ec_mtm_fiber_any"))


_SIGSCAN = f"""{_SIG}, j AS (SELECT sc.*, list_sum(drops) / 4 AS mean_drop, drops[4] AS bundle FROM sc JOIN sg USING (id)), gr AS (SELECT * FROM (VALUES ('reference', 0.0::DOUBLE, -1), ('cf_mean_positive_drop', 0.05, 0), ('cf_mean_positive_drop', 0.2, 1), ('cf_stable_bundle_drop', 0.05, 2), ('cf_stable_bundle_drop', 0.2, 3)) t(signal, alpha, pos)),
ex AS (SELECT signal, alpha, pos, target, {_EC} AS inside, CASE signal WHEN 'cf_mean_positive_drop' THEN mean_drop WHEN 'cf_stable_bundle_drop' THEN bundle END AS v, ref FROM j, gr), ey AS (SELECT *, CASE WHEN inside AND pos >= 0 THEN least(greatest(ref + alpha * v, 0.000001), 0.999999) ELSE ref END AS s FROM ex),
au AS ({duck_auc('ey', 'target', 's', 'signal, alpha, pos')}), st AS (SELECT signal, alpha, pos, count(*) AS mask_rows, avg(v) AS sm, stddev_pop(v) AS ss FROM ey WHERE inside GROUP BY 1, 2, 3)"""
register(
    "signal_alpha_scan",
    lambda s, d: _signals(s, d).select("signal", "alpha", "mask_rows", r6("auc", "auc"), r6("delta", "delta"), r6("signal_mean", "signal_mean"), r6("signal_std", "signal_std")),
    f"{_SIGSCAN} SELECT signal, alpha, mask_rows, {d6('auc', 'auc')}, {d6('auc - (SELECT auc FROM au WHERE pos = -1)', 'delta')}, {d6('sm', 'signal_mean')}, {d6('ss', 'signal_std')} FROM au JOIN st USING (signal, alpha, pos)",
)
register("signal_best", lambda s, d: C.best_signal(_signals(s, d)).select("signal", "alpha", r6("auc", "auc")), f"{_SIGSCAN} SELECT signal, alpha, {d6('auc', 'auc')} FROM au ORDER BY round(auc, 15) DESC, pos LIMIT 1")
_STEPS = (("early_manual_internet", "xgb", 0.2), ("fiber_paperless_early", "lgb", 0.3), ("late_mtm_fiber", "r", 0.1))
_MASKS = {"early_manual_internet": "(Contract = 'Month-to-month' AND InternetService <> 'No' AND PaymentMethod IN ('Electronic check', 'Mailed check') AND tenure <= 24)", "fiber_paperless_early": "(Contract = 'Month-to-month' AND InternetService = 'Fiber optic' AND PaperlessBilling = 'Yes' AND tenure <= 24)", "late_mtm_fiber": "(Contract = 'Month-to-month' AND InternetService = 'Fiber optic' AND tenure > 24)"}


def _chain(mode: str):  # noqa: ANN202
    return lambda s, d: C.chain_submission(both(s, d).filter("split = 'test'"), [(m, preset(m), F.col(f"pred_{p}") - F.col("reference_pred"), a) for m, p, a in _STEPS], mode=mode)


def _chain_sql(mode: str) -> str:
    out, before = "+c0 AS (SELECT *, ref AS at0 FROM sc WHERE split = 'test')", 0
    for i, (m, p, a) in enumerate(_STEPS):
        start = f"at{i}" if mode == "previous" else "ref"
        out += f", c{i + 1} AS (SELECT *, CASE WHEN {_MASKS[m]} THEN least(greatest({start} + {a}::DOUBLE * (pred_{p} - ref), 0.000001), 0.999999) ELSE at{i} END AS at{i + 1} FROM c{before})"
        before = i + 1
    return out


for _mode in ("previous", "base"):
    register(
        f"chain_submission_{_mode}",
        lambda s, d, mode=_mode: _chain(mode)(s, d)[1].select(F.col("step").cast("long").alias("step"), "name", "mask_rows", "changed_rows", r6("mean_shift", "mean_shift"), r6("max_shift", "max_shift")),
        _chain_sql(_mode) + " " + " UNION ALL ".join(f"SELECT {i + 1} AS step, '{m}' AS name, sum(({_MASKS[m]})::INT)::BIGINT AS mask_rows, sum((abs(at{i + 1} - at{i}) > 1e-15)::INT)::BIGINT AS changed_rows, {d6(f'avg(abs(at{i + 1} - at{i}))', 'mean_shift')}, {d6(f'max(abs(at{i + 1} - at{i}))', 'max_shift')} FROM c{len(_STEPS)}" for i, (m, _, _) in enumerate(_STEPS)),
    )
register("chain_submission_rows", lambda s, d: _chain("base")(s, d)[0].select("id", r6("chained", "chained")), f"{_chain_sql('base')} SELECT id, {d6(f'at{len(_STEPS)}', 'chained')} FROM c{len(_STEPS)}")
register(
    "override_prediction",
    lambda s, d: C.override_prediction(both(s, d).filter("split = 'test'"), preset("ec_mtm_fiber_any"), F.col("pred_rv"), 0.3).select("id", "specialist_mask", r6("specialist_pred", "specialist_pred"), r6("prediction", "prediction")),
    f"SELECT id, {_EC}::INT AS specialist_mask, CASE WHEN {_EC} THEN round(pred_rv + 0.000000001, 6) END AS specialist_pred, {d6(f'CASE WHEN {_EC} THEN 0.7 * ref + 0.3 * pred_rv ELSE ref END', 'prediction')} FROM sc WHERE split = 'test'",
)
_TEACH = ["pred_cb", "pred_xgb", "pred_lgb"]
_FOLDS = lambda reps, k: f"SELECT *, (row_number() OVER (PARTITION BY repeat, target ORDER BY md5(':' || (repeat + 42)::VARCHAR || ':' || id::VARCHAR), id) - 1) % {k} AS fold FROM sc, (SELECT unnest(range({reps})) AS repeat)"
_avg_rank = lambda c, by: f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2)"
_ROB = f"""+fo AS ({_FOLDS(2, 3)}), ex AS (SELECT repeat, fold, target, (pred_cb + pred_xgb + pred_lgb) / 3 AS eq, ({' + '.join(_avg_rank(t, 'repeat, fold') for t in _TEACH)}) / 3 AS rk FROM fo), fx AS (SELECT target, (pred_cb + pred_xgb + pred_lgb) / 3 AS eq, ({' + '.join(_avg_rank(t, '1') for t in _TEACH)}) / 3 AS rk FROM sc),
ce AS ({duck_auc('ex', 'target', 'eq', 'repeat, fold')}), cr AS ({duck_auc('ex', 'target', 'rk', 'repeat, fold')}), m AS (SELECT 'equal' AS method, auc, (SELECT auc FROM ({duck_auc('fx', 'target', 'eq')})) AS f FROM ce UNION ALL SELECT 'rank', auc, (SELECT auc FROM ({duck_auc('fx', 'target', 'rk')})) FROM cr)"""
register(
    "ensemble_robustness",
    lambda s, d: C.robustness(accounts(s, d), _TEACH, 2, 3).select("method", *[r6(c, c) for c in ("cv_mean_auc", "cv_std_auc", "cv_min_auc", "cv_max_auc", "full_auc", "optimism")]),
    f"{_ROB} SELECT method, {d6('avg(auc)', 'cv_mean_auc')}, {d6('stddev_pop(auc)', 'cv_std_auc')}, {d6('min(auc)', 'cv_min_auc')}, {d6('max(auc)', 'cv_max_auc')}, {d6('max(f)', 'full_auc')}, {d6('max(f) - avg(auc)', 'optimism')} FROM m GROUP BY 1",
)
# --- chain against incumbent, gate
_ORDERS = (("early_manual_internet", "late_mtm_fiber"), ("early_manual_internet", "fiber_paperless_early"))


def _against(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = P.analysis(G.chain_against_incumbent(both(s, d), {m: (preset(m), f"pred_{p}") for m, p, _ in _STEPS}, *_ORDERS))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


_pred = {m: p for m, p, _ in _STEPS}
_chained = lambda order: "CASE " + " ".join(f"WHEN {_MASKS[m]} THEN pred_{_pred[m]}" for m in reversed(order)) + " ELSE ref END"
_INC = f"+inc AS (SELECT *, {_chained(_ORDERS[0])} AS r, {_chained(_ORDERS[1])} AS c FROM sc), tr AS (SELECT * FROM inc WHERE split = 'train')"
register(
    "chain_vs_incumbent",
    lambda s, d: (lambda tr, te: tr.select("id", r6("reference_pred", "incumbent"), r6("candidate_pred", "candidate")))(*_against(s, d)),
    f"{_INC} SELECT id, {d6('r', 'incumbent')}, {d6('c', 'candidate')} FROM tr",
)
_FAM = lambda level, value: f"(SELECT c.auc - r.auc FROM ({duck_auc(f'(SELECT * FROM tr WHERE {level} = {value!r})', 'target', 'c')}) c, ({duck_auc(f'(SELECT * FROM tr WHERE {level} = {value!r})', 'target', 'r')}) r)"
_STD = lambda p: f"(SELECT stddev_pop(auc) FROM ({duck_auc('fo', 'target', p, 'repeat, fold')}))"
_REL = f"""l5 AS (SELECT segment5 AS v, count(*) AS n, avg({_LOSS('target', 'r')}) * count(*) AS rc, avg({_LOSS('target', 'c')}) * count(*) AS cc FROM tr GROUP BY 1), t5 AS (SELECT segment5 AS v, count(*) AS n_test FROM inc WHERE split = 'test' GROUP BY 1),
r5 AS (SELECT v, n, coalesce(n_test, 0) AS n_test, rc, (cc - rc) / greatest(abs(rc), 1e-12 * (SELECT count(*) FROM tr)) AS rd FROM l5 LEFT JOIN t5 USING (v)), big AS (SELECT * FROM r5 WHERE n >= 5000 OR n_test >= 2000), pick AS (SELECT * FROM big UNION ALL SELECT * FROM r5 WHERE (SELECT count(*) FROM big) = 0),
dmg AS (SELECT max(rd) AS v FROM (SELECT rd FROM pick ORDER BY rc DESC, n DESC, v LIMIT 3))"""
_row = lambda name, v, ok: f"SELECT '{name}' AS \"check\", CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, {d6('v', 'value')} FROM (SELECT {v} AS v)"
register(
    "chain_protocol",
    lambda s, d: G.chain_report(*_against(s, d), stage="midcap", repeats=2, folds=3).select("check", "status", r6("value", "value")),
    f"{_INC}, fo AS (SELECT *, (row_number() OVER (PARTITION BY repeat, target ORDER BY md5(':' || (repeat + 42)::VARCHAR || ':' || id::VARCHAR), id) - 1) % 3 AS fold FROM tr, (SELECT unnest(range(2)) AS repeat)), {_REL} "
    + " UNION ALL ".join([
        _row("split_a_delta_auc", f"(SELECT auc FROM ({duck_auc('tr', 'target', 'c')})) - (SELECT auc FROM ({duck_auc('tr', 'target', 'r')}))", "v >= 1e-5"),
        _row("split_b_dominant_family", _FAM("segment3", S.DOMINANT), "v >= -2e-4"), _row("split_b_top_damage_families", "(SELECT v FROM dmg)", "v <= 0.03"),
        _row("micro_family_dependence", "(SELECT coalesce(avg((n < 1000 OR n_test < 400)::INT), 0) FROM r5 WHERE rd < 0)", "v < 1"),
        f"SELECT 'midcap_cv_std', CASE WHEN a <= b * 1.15 THEN 'PASS' ELSE 'FAIL' END, {d6('a', 'value')} FROM (SELECT {_STD('c')} AS a, {_STD('r')} AS b)",
    ]),
)


def _report(s: SparkSession, d: str) -> DataFrame:
    """The gate's inputs from this library's own reports. Coordinate descent stands behind the weighted figures elsewhere;
    here they are those of fixed weights, and the adversarial figure is the AUC of tenure."""
    equal = (F.col("pred_cb") + F.col("pred_xgb") + F.col("pred_lgb") + F.col("pred_r") + F.col("pred_rv")) / 5
    rows = both(s, d).withColumns({"is_test": (F.col("split") == "test").cast("int"), "_equal": equal})
    a = saved(rows.select("id", "target", "split", "is_test", "tenure", "MonthlyCharges", "Contract", "PaymentMethod", "pred_cb", "pred_rv", "reference_pred", "_equal"))  # read by many jobs
    drift = G.drift_counts(A.numeric_drift(a, ("tenure", "MonthlyCharges", "pred_cb")), A.categorical_drift(a, ["Contract", "PaymentMethod"]))
    adversarial = G.auc(a, [], "is_test", "tenure", "adversarial_auc")
    each = saved(G.repeated_aucs(a, ["reference_pred", "_equal", "pred_rv"], 2, 3))  # 18 rows
    of = lambda p, n: G.repeated_stats(each.filter(F.col("prediction") == p), n).drop("folds")
    out = of("reference_pred", "weighted").crossJoin(of("_equal", "equal")).crossJoin(of("pred_rv", "rank")).crossJoin(drift).crossJoin(adversarial).crossJoin(G.auc(a, [], "target", "pred_cb", "baseline_auc")).crossJoin(G.auc(a, [], "target", "reference_pred", "full"))
    return out.select(F.lit("PASS").alias("parity_status"), "adversarial_auc", "high_psi", "high_tvd", F.col("weighted_mean_auc").alias("weighted_mean"), F.col("weighted_std_auc").alias("weighted_std"), (F.col("full") - F.col("weighted_mean_auc")).alias("weighted_optimism"), F.col("equal_mean_auc").alias("equal_mean"), F.col("rank_mean_auc").alias("rank_mean"), "baseline_auc")


_cv = lambda e, f: f"(SELECT {f}(auc) FROM ({duck_auc(f'(SELECT repeat, fold, target, {e} AS s FROM fo)', 'target', 's', 'repeat, fold')}))"
_EQ = "(pred_cb + pred_xgb + pred_lgb + pred_r + pred_rv) / 5"
_psi = lambda c: f"""(SELECT sum((q - p) * ln(q / p)) FROM (SELECT greatest(count(*) FILTER (split = 'train') / (SELECT count(*) FROM sc WHERE split = 'train'), 1e-9) AS p, greatest(count(*) FILTER (split = 'test') / (SELECT count(*) FROM sc WHERE split = 'test'), 1e-9) AS q
FROM (SELECT split, len(list_filter(e[2:len(e) - 1], lambda v: v <= {c}::DOUBLE)) AS b FROM sc, (SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM sc WHERE split = 'train')) GROUP BY b))"""  # noqa: E731
_tvd = lambda c: f"(SELECT sum(abs(a / na - b / nb)) / 2 FROM (SELECT count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM sc GROUP BY {c}), (SELECT count(*) FILTER (split = 'train') AS na, count(*) FILTER (split = 'test') AS nb FROM sc))"
_GATE = f"""+fo AS ({_FOLDS(2, 3)}), rp AS (SELECT (SELECT auc FROM ({duck_auc("(SELECT (split = 'test')::INT AS t, tenure FROM sc)", 't', 'tenure')})) AS adv, ({' + '.join(f'({_psi(c)} >= 0.2)::INT' for c in ('tenure', 'MonthlyCharges', 'pred_cb'))}) AS psi, ({' + '.join(f'({_tvd(c)} >= 0.2)::INT' for c in ('Contract', 'PaymentMethod'))}) AS tvd,
{_cv('ref', 'avg')} AS wm, {_cv('ref', 'stddev_pop')} AS ws, (SELECT auc FROM ({duck_auc('sc', 'target', 'ref')})) AS full_auc, {_cv(_EQ, 'avg')} AS em, {_cv('pred_rv', 'avg')} AS rm, (SELECT auc FROM ({duck_auc('sc', 'target', 'pred_cb')})) AS base),
ck AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, {v}::DOUBLE AS v, CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS status FROM rp" for n, v, ok, bad in (
    ('parity_overall_status', '1', 'true', 'FAIL'), ('drift_adversarial_auc', 'adv', 'adv <= 0.58', 'FAIL'), ('drift_high_psi_count', 'psi', 'psi <= 2', 'FAIL'), ('drift_high_tvd_count', 'tvd', 'tvd <= 2', 'FAIL'), ('weighted_delta_vs_baseline', '(wm - base)', 'wm - base >= 0.0002', 'FAIL'),
    ('weighted_delta_vs_equal', '(wm - em)', 'wm - em >= 0.00005', 'WARN'), ('weighted_delta_vs_rank', '(wm - rm)', 'wm >= rm', 'WARN'), ('weighted_cv_std', 'ws', 'ws <= 0.0015', 'WARN'), ('weighted_optimism', '(full_auc - wm)', 'full_auc - wm <= 0.00005', 'WARN')))})"""  # fmt: skip
register("gate_checks", lambda s, d: G.gate(_report(s, d))[0].select("check", "status", r6("value", "value")), f'{_GATE} SELECT name AS "check", status, {d6("v", "value")} FROM ck')
register("gate_decision", lambda s, d: G.gate(_report(s, d))[1], f"{_GATE} SELECT CASE WHEN fail = 0 AND warn <= 0 THEN 'GO' ELSE 'NO_GO' END AS decision, * FROM (SELECT count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail FROM ck)")
