"""Queries of predictions: family metrics, checks, blends, scans, chains and error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.masks import PRESETS, preset
from ..functions.metrics import auc, average_rank, comparable_logloss, duck_auc
from ..operators import blend as B
from ..operators import folds as L
from ..operators.select import DOMINANT
from ..plans import gates as GT
from ..plans import protocol as P
from ..sources.accounts import DUCK, REFERENCE_WEIGHTS, accounts, blend_sql
from .selection import TEACHERS, d6, r6

QUERIES, ORACLES = {}, {}
_EARLY = PRESETS["early_all_internet"]


def register(name: str, query, oracle: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = f"WITH {DUCK}, scored AS (SELECT *, CASE WHEN {_EARLY} THEN pred_cb ELSE {blend_sql()} END AS candidate_pred, {blend_sql()} AS reference_pred FROM accounts){', ' + oracle[1:] if oracle.startswith('+') else ' ' + oracle}"


def scored(spark: SparkSession, d: str) -> DataFrame:
    out = B.blend(accounts(spark, d), REFERENCE_WEIGHTS)
    return out.withColumn("candidate_pred", F.when(preset("early_all_internet"), F.col("pred_cb")).otherwise(F.col("reference_pred")))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = P.analysis(scored(spark, d))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


_TRAIN = "(SELECT * FROM tr WHERE split = 'train')"
_LOSS = lambda y, p: f"-({y} * ln({K.clip(p)}) + (1 - {y}) * ln(1 - {K.clip(p)}))"
_FAM = f"tr AS (SELECT *, {K.segment3()} AS segment3, {K.segment5()} AS segment5, {_LOSS('target', 'reference_pred')} AS rl, {_LOSS('target', 'candidate_pred')} AS cl FROM scored), " + ", ".join(
    f"f{n} AS (SELECT 'segment{n}' AS family_level, b.segment{n} AS family_value, b.train_rows, b.positive_rows, b.positive_rate, b.rl, b.cl, r.auc AS reference_auc, c.auc AS candidate_auc, coalesce(t.test_rows, 0) AS test_rows FROM "
    f"(SELECT segment{n}, count(*) AS train_rows, sum(target) AS positive_rows, avg(target) AS positive_rate, avg(rl) AS rl, avg(cl) AS cl FROM tr WHERE split = 'train' GROUP BY 1) b "
    f"JOIN ({duck_auc(_TRAIN, 'target', 'reference_pred', f'segment{n}')}) r USING (segment{n}) "
    f"JOIN ({duck_auc(_TRAIN, 'target', 'candidate_pred', f'segment{n}')}) c USING (segment{n}) "
    f"LEFT JOIN (SELECT segment{n}, count(*) AS test_rows FROM tr WHERE split = 'test' GROUP BY 1) t USING (segment{n}))" for n in (3, 5)
) + ", fam AS (SELECT *, rl * train_rows / (SELECT count(*) FROM tr WHERE split = 'train') AS rc, cl * train_rows / (SELECT count(*) FROM tr WHERE split = 'train') AS cc FROM (SELECT * FROM f3 UNION ALL SELECT * FROM f5)), famd AS (SELECT *, candidate_auc - reference_auc AS delta_auc, (cc - rc) / greatest(abs(rc), 1e-12) AS rd FROM fam)"


def _family(s: SparkSession, d: str) -> DataFrame:
    table = P.family_metrics(*sides(s, d))
    return table.select("family_level", "family_value", "train_rows", "test_rows", "positive_rows", r6("positive_rate"), r6("reference_auc"), r6("reference_logloss"), r6("reference_contribution"), (F.round(F.col("test_rows") / F.greatest("train_rows", F.lit(1)) + 1e-9, 6)).alias("test_train_ratio"))


register("family_metrics", _family, f"+{_FAM} SELECT family_level, family_value, train_rows, test_rows, cast(positive_rows AS BIGINT) AS positive_rows, {d6('positive_rate', 'positive_rate')}, {d6('reference_auc', 'reference_auc')}, {d6('rl', 'reference_logloss')}, {d6('rc', 'reference_contribution')}, {d6('test_rows / greatest(train_rows, 1)', 'test_train_ratio')} FROM fam")
register(
    "family_candidate_metrics",
    lambda s, d: P.family_metrics(*sides(s, d)).select("family_level", "family_value", r6("candidate_auc"), r6("delta_auc"), r6("candidate_logloss"), r6("candidate_contribution"), r6("relative_delta")),
    f"+{_FAM} SELECT family_level, family_value, {d6('candidate_auc', 'candidate_auc')}, {d6('delta_auc', 'delta_auc')}, {d6('cl', 'candidate_logloss')}, {d6('cc', 'candidate_contribution')}, {d6('rd', 'relative_delta')} FROM famd",
)
_TARGET = f"{DOMINANT}__Yes__7_12"
_SISTER = K.sister_family(_TARGET)
_one = lambda name, value, ok: f"SELECT '{name}' AS \"check\", CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, {d6('v', 'value')} FROM (SELECT {value} AS v)"
_tr_auc = lambda p: f"(SELECT auc FROM ({duck_auc(_TRAIN, 'target', p)}))"
_of = lambda level, v: f"(SELECT max(delta_auc) FROM famd WHERE family_level = 'segment{level}' AND family_value = '{v}')"
_checks = " UNION ALL ".join([
    _one("split_a_delta_auc", f"{_tr_auc('candidate_pred')} - {_tr_auc('reference_pred')}", "v >= 1e-5"), _one("split_b_dominant_family", _of(3, DOMINANT), "v >= -2e-4"),
    _one("split_b_top_damage_families", "(SELECT max(rd) FROM (SELECT rd FROM famd WHERE family_level = 'segment5' ORDER BY rc DESC, train_rows DESC, family_value LIMIT 3))", "v <= 0.03"),
    _one("micro_family_dependence", "(SELECT coalesce(avg(CASE WHEN train_rows < 1000 OR test_rows < 400 THEN 1.0 ELSE 0.0 END), 0) FROM famd WHERE family_level = 'segment5' AND rd < 0)", "v < 1"),
    _one("target_family_presence", f"(SELECT count(*) FROM famd WHERE family_level = 'segment5' AND family_value = '{_TARGET}')", "v > 0"), _one("target_family_on_mask_auc", _of(5, _TARGET), "v >= -1e-4"),
    _one("target_family_promotable_support", f"(SELECT coalesce(max(CASE WHEN train_rows >= 2000 AND test_rows >= 800 THEN 1 ELSE 0 END), 0) FROM famd WHERE family_level = 'segment5' AND family_value = '{_TARGET}')", "v = 1"),
    _one("sister_family_guardrail", _of(5, _SISTER), "v >= -1e-4"),
])
_FOLDED = "fo AS (SELECT *, (row_number() OVER (PARTITION BY repeat, target ORDER BY md5(':' || (repeat + 42)::VARCHAR || ':' || id::VARCHAR), id) - 1) % 3 AS fold FROM tr, (SELECT unnest(range(2)) AS repeat) WHERE split = 'train')"
_cv_std = lambda p: f"(SELECT stddev_pop(auc) FROM ({duck_auc('fo', 'target', p, 'repeat, fold')}))"
_checks = f"""{_checks} UNION ALL SELECT 'midcap_cv_std', CASE WHEN v <= w * 1.15 THEN 'PASS' ELSE 'FAIL' END, {d6('v', 'value')} FROM (SELECT {_cv_std('candidate_pred')} AS v, {_cv_std('reference_pred')} AS w)
UNION ALL SELECT 'submission_trace_artifacts', 'FAIL', 0"""
_protocol = lambda s, d: GT.chain_report(*sides(s, d), stage="submission", repeats=2, folds=3, target_family=_TARGET)
register("protocol_checks", lambda s, d: _protocol(s, d).select("check", "status", r6("value")), f"+{_FAM}, {_FOLDED} {_checks}")
register("protocol_verdict", lambda s, d: P.verdict(_protocol(s, d)), f"+{_FAM}, {_FOLDED}, ch AS ({_checks}) SELECT CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail FROM ch")
register(
    "oof_merge",
    lambda s, d: (lambda a: B.merge_oof({m: a.select("id", "target", F.col(f"pred_{m}").alias("pred")) for m in ("cb", "xgb", "lgb")}).select("id", "target", *[r6(f"pred_{m}") for m in ("cb", "xgb", "lgb")]))(accounts(s, d)),
    f"SELECT id, target, {', '.join(d6(f'pred_{m}', f'pred_{m}') for m in ('cb', 'xgb', 'lgb'))} FROM accounts",
)
register("weighted_blend", lambda s, d: scored(s, d).select("id", r6("reference_pred"), r6("candidate_pred")), f"SELECT id, {d6('reference_pred', 'reference_pred')}, {d6('candidate_pred', 'candidate_pred')} FROM scored")
_rank = lambda c: f"((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ())"
register("rank_ensemble", lambda s, d: B.rank_ensemble(accounts(s, d), TEACHERS[:3]).select("id", r6("rank_mean")), f"SELECT id, {d6('(' + ' + '.join(_rank(t) for t in TEACHERS[:3]) + ') / 3', 'rank_mean')} FROM accounts")
_ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5)


def _scan_sql(combined: str) -> str:
    grid = " UNION ALL ".join(f"SELECT {i} AS pos, cast({a} AS DOUBLE) AS alpha" for i, a in enumerate(_ALPHAS))
    return f"+grid AS ({grid}), ex AS (SELECT pos, alpha, target, {combined} AS s FROM scored, grid) SELECT pos, alpha, {d6('auc', 'auc')} FROM ({duck_auc('ex', 'target', 's', 'pos, alpha')})"


def _scan(combined):  # noqa: ANN001, ANN202
    return lambda s, d: B.scan(scored(s, d).select("target", "reference_pred", "pred_cb", "pred_xgb", "Contract", "InternetService", "PaymentMethod", "PaperlessBilling", "tenure"), _ALPHAS, combined).select("pos", "alpha", r6("auc"))


QUERIES["alpha_scan_override"] = lambda s, d: _scan(B.override(preset("ec_mtm_fiber_any"), "reference_pred", "pred_cb"))(s, d)
QUERIES["alpha_scan_global"] = lambda s, d: _scan(B.blended("reference_pred", "pred_xgb"))(s, d)
QUERIES["alpha_scan_residual"] = lambda s, d: _scan(B.residual(preset("ec_mtm_fiber_any"), "reference_pred", "pred_xgb"))(s, d)
for _n, _e in (
    ("alpha_scan_override", f"CASE WHEN {PRESETS['ec_mtm_fiber_any']} THEN (1 - alpha) * reference_pred + alpha * pred_cb ELSE reference_pred END"),
    ("alpha_scan_global", "(1 - alpha) * reference_pred + alpha * pred_xgb"),
    ("alpha_scan_residual", f"CASE WHEN {PRESETS['ec_mtm_fiber_any']} THEN least(greatest(reference_pred + alpha * pred_xgb, 0), 1) ELSE reference_pred END"),
):
    register(_n, QUERIES[_n], _scan_sql(_e))
register(
    "alpha_best",
    lambda s, d: B.best(B.scan(scored(s, d), _ALPHAS, B.blended("reference_pred", "pred_cb"))).select("alpha", r6("auc")),
    f"+grid AS ({' UNION ALL '.join(f'SELECT {i} AS pos, cast({a} AS DOUBLE) AS alpha' for i, a in enumerate(_ALPHAS))}), ex AS (SELECT pos, alpha, target, (1 - alpha) * reference_pred + alpha * pred_cb AS s FROM scored, grid) SELECT alpha, {d6('auc', 'auc')} FROM ({duck_auc('ex', 'target', 's', 'pos, alpha')}) ORDER BY auc DESC, pos LIMIT 1",
)
register(
    "rank_reassign",
    lambda s, d: B.reassign(scored(s, d), "pred_xgb", "reference_pred", "Contract").select("id", r6("reassigned")),
    f"+a AS (SELECT id, Contract, row_number() OVER (PARTITION BY Contract ORDER BY pred_xgb, id) AS i FROM scored), b AS (SELECT Contract, reference_pred, row_number() OVER (PARTITION BY Contract ORDER BY reference_pred, id) AS i FROM scored) SELECT a.id, {d6('b.reference_pred', 'reassigned')} FROM a JOIN b USING (Contract, i)",
)
_STEPS = (("early_manual_internet", "xgb"), ("fiber_paperless_early", "lgb"), ("late_mtm_fiber", "r"), ("one_year_fiber_any", "rv"))
register(
    "chain_prediction",
    lambda s, d: scored(s, d).select("id", F.round(B.chain("reference_pred", [(preset(m), f"pred_{p}") for m, p in _STEPS]) + 1e-9, 6).alias("chained")),
    f"SELECT id, {d6('CASE ' + ' '.join(f'WHEN {PRESETS[m]} THEN pred_{p}' for m, p in reversed(_STEPS)) + ' ELSE reference_pred END', 'chained')} FROM scored",
)
_chain = ["reference_pred"]
for _m, _p in _STEPS:
    _chain.append(f"CASE WHEN {PRESETS[_m]} THEN pred_{_p} ELSE {_chain[-1]} END")
register(
    "chain_shift_stats",
    lambda s, d: B.chain_shifts(scored(s, d), "reference_pred", [(m, preset(m), f"pred_{p}") for m, p in _STEPS]).select(F.col("step").cast("long").alias("step"), "name", F.col("rows").cast("long").alias("n"), F.col("changed").cast("long").alias("changed"), r6("mean_shift"), r6("max_shift")),
    " UNION ALL ".join(f"SELECT {i + 1} AS step, '{m}' AS name, cast(sum(CASE WHEN {PRESETS[m]} THEN 1 ELSE 0 END) AS BIGINT) AS n, cast(sum(CASE WHEN abs(({_chain[i + 1]}) - ({_chain[i]})) > 1e-15 THEN 1 ELSE 0 END) AS BIGINT) AS changed, {d6(f'avg(abs(({_chain[i + 1]}) - ({_chain[i]})))', 'mean_shift')}, {d6(f'max(abs(({_chain[i + 1]}) - ({_chain[i]})))', 'max_shift')} FROM scored" for i, (m, _) in enumerate(_STEPS)),
)
_W2 = {"cb": 0.2, "xgb": 0.1, "lgb": 0.5, "r": 0.1, "rv": 0.1}
register(
    "blend_inversion",
    lambda s, d: B.invert(B.blend(scored(s, d), _W2, "second_pred"), ("reference_pred", REFERENCE_WEIGHTS), ("second_pred", _W2), ("cb", "r", "rv"), ("xgb", "lgb")).select("id", r6("inverted_xgb"), r6("inverted_lgb")),
    f"SELECT id, {d6('pred_xgb', 'inverted_xgb')}, {d6('pred_lgb', 'inverted_lgb')} FROM accounts",
)
_mean = "((" + " + ".join(TEACHERS) + ") / 5)"
_std = f"sqrt(({' + '.join(f'({t} - {_mean}) * ({t} - {_mean})' for t in TEACHERS)}) / 5)"
_arr = f"list_sort([{', '.join(TEACHERS)}], 'DESC')"
register(
    "disagreement_stats",
    lambda s, d: (lambda st: accounts(s, d).select("id", *[F.round(c + 1e-9, 6).alias(f"teacher_{n}") for n, c in st.items()], *[F.round(F.col("pred_cb") - F.col(t) + 1e-9, 6).alias(f"delta_{t[5:]}") for t in TEACHERS[1:]]))(B.array_statistics(TEACHERS)),
    f"SELECT id, {d6(_mean, 'teacher_mean')}, {d6(_std, 'teacher_std')}, {d6(f'{_arr}[1] - {_arr}[5]', 'teacher_range')}, {d6(f'{_arr}[1] - {_arr}[2]', 'teacher_top_gap')}, {', '.join(d6(f'pred_cb - {t}', f'delta_{t[5:]}') for t in TEACHERS[1:])} FROM accounts",
)
register(
    "stability_stats",
    lambda s, d: (lambda a, st, v: a.select("id", F.round(v + 1e-9, 6).alias("vote_share"), F.round(F.least(v, 1 - v) + 1e-9, 6).alias("flip"), F.round(st["std"] + F.least(v, 1 - v) + 1e-9, 6).alias("score")))(accounts(s, d), B.array_statistics(TEACHERS), F.size(F.filter(F.array(*TEACHERS), lambda x: x >= 0.5)) / 5),
    f"SELECT id, {d6('v', 'vote_share')}, {d6('least(v, 1 - v)', 'flip')}, {d6('sd + least(v, 1 - v)', 'score')} FROM (SELECT id, {_std} AS sd, len(list_filter([{', '.join(TEACHERS)}], lambda x: x >= 0.5)) / 5 AS v FROM accounts)",
)
register(
    "stack_features",
    lambda s, d: accounts(s, d).select("id", F.round(F.when(preset("ec_mtm_fiber_any"), F.col("pred_xgb")).otherwise(0.5) + 1e-9, 6).alias("stack_pred"), preset("ec_mtm_fiber_any").cast("long").alias("stack_available"), F.round(F.when(preset("ec_mtm_fiber_any"), F.col("pred_xgb") - F.col("pred_cb")).otherwise(0.0) + 1e-9, 6).alias("stack_delta")),
    f"SELECT id, {d6(f'CASE WHEN {PRESETS['ec_mtm_fiber_any']} THEN pred_xgb ELSE 0.5 END', 'stack_pred')}, cast({PRESETS['ec_mtm_fiber_any']} AS BIGINT) AS stack_available, {d6(f'CASE WHEN {PRESETS['ec_mtm_fiber_any']} THEN pred_xgb - pred_cb ELSE 0 END', 'stack_delta')} FROM accounts",
)
register(
    "gating_features",
    lambda s, d: scored(s, d).select("id", preset("ec_mtm_fiber_any").cast("long").alias("gate_in_family"), F.round(F.when(preset("ec_mtm_fiber_any"), F.col("reference_pred")).otherwise(0.0) + 1e-9, 6).alias("gate_x_reference"), F.when(preset("ec_mtm_fiber_any"), 2.0).otherwise(1.0).alias("sample_weight")),
    f"SELECT id, cast({PRESETS['ec_mtm_fiber_any']} AS BIGINT) AS gate_in_family, {d6(f'CASE WHEN {PRESETS['ec_mtm_fiber_any']} THEN reference_pred ELSE 0 END', 'gate_x_reference')}, cast(CASE WHEN {PRESETS['ec_mtm_fiber_any']} THEN 2 ELSE 1 END AS DOUBLE) AS sample_weight FROM scored",
)


def _repeated(s: SparkSession, d: str) -> DataFrame:
    rows, out = scored(s, d).select("id", "target", "reference_pred"), None
    for r in range(3):
        part = L.stratified_folds(rows, 4, f"r{r}").withColumn("repeat", F.lit(r))
        out = part if out is None else out.unionByName(part)
    each = auc(out, ["repeat", "fold"], "target", "reference_pred")
    return each.agg(F.count("*").alias("n"), F.round(F.avg("auc") + 1e-9, 6).alias("mean"), F.round(F.stddev_pop("auc") + 1e-9, 6).alias("std"), F.round(F.min("auc") + 1e-9, 6).alias("lowest"), F.round(F.max("auc") + 1e-9, 6).alias("highest"))


_rep = " UNION ALL ".join(f"SELECT target, reference_pred, {r} AS rep, (row_number() OVER (PARTITION BY target ORDER BY md5('r{r}:' || cast(id AS VARCHAR)), id) - 1) % 4 AS fold FROM scored" for r in range(3))
register("repeated_cv_auc", _repeated, f"+fo AS ({_rep}), ea AS ({duck_auc('fo', 'target', 'reference_pred', 'rep, fold')}) SELECT count(*) AS n, {d6('avg(auc)', 'mean')}, {d6('stddev_pop(auc)', 'std')}, {d6('min(auc)', 'lowest')}, {d6('max(auc)', 'highest')} FROM ea")
_OVER = ["auc", "logloss", "brier", "mae", "positive_rate", "pred_mean", "pred_std", "calibration_gap"]
register(
    "overall_metrics",
    lambda s, d: P.overall(scored(s, d), "target", "reference_pred").select("n", *[r6(c) for c in _OVER]),
    f"+o AS (SELECT count(*) AS n, avg({_LOSS('target', 'reference_pred')}) AS logloss, avg((reference_pred - target) * (reference_pred - target)) AS brier, avg(abs(reference_pred - target)) AS mae, avg(target) AS positive_rate, avg(reference_pred) AS pred_mean, stddev_pop(reference_pred) AS pred_std FROM scored), p AS (SELECT *, pred_mean - positive_rate AS calibration_gap, (SELECT auc FROM ({duck_auc('scored', 'target', 'reference_pred')})) AS auc FROM o) SELECT n, {', '.join(d6(c, c) for c in _OVER)} FROM p",
)
_DIMS = {
    "PaymentMethod": "PaymentMethod", "Contract": "Contract", "InternetService": "InternetService", "PaperlessBilling": "PaperlessBilling", "tenure_bin": K.tenure_bin(), "segment3": K.segment3(), "segment5": K.segment5(), "gender": "gender",
    "SeniorCitizen": "cast(SeniorCitizen AS STRING)", "Partner": "Partner", "Dependents": "Dependents", "PhoneService": "PhoneService", "MultipleLines": "MultipleLines", "TechSupport": "TechSupport",
}
_cells = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS value, target AS y, reference_pred AS p, {_LOSS('target', 'reference_pred')} AS l FROM scored" for n, e in _DIMS.items())
_grp = f"+ce AS ({_cells}), gm AS (SELECT g.*, a.auc FROM (SELECT dimension, value, count(*) AS n, avg(y) AS positive_rate, avg(p) AS pred_mean, avg(l) AS logloss, avg(abs(p - y)) AS mae FROM ce GROUP BY 1, 2 HAVING count(*) >= 50) g JOIN ({duck_auc('ce', 'y', 'p', 'dimension, value')}) a USING (dimension, value))"
_GM = ["positive_rate", "pred_mean", "logloss", "mae", "auc"]
register("group_metrics_14dim", lambda s, d: P.group_metrics(scored(s, d), _DIMS, "target", "reference_pred", 50).select("dimension", "value", "n", *[r6(c) for c in _GM], r6("calibration_gap")), f"{_grp} SELECT dimension, value, n, {', '.join(d6(c, c) for c in _GM)}, {d6('pred_mean - positive_rate', 'calibration_gap')} FROM gm")
register(
    "metrics_rollup",
    lambda s, d: P.rollup(P.group_metrics(scored(s, d), _DIMS, "target", "reference_pred", 50)).select("dimension", "groups", F.col("n").cast("long").alias("n"), r6("auc"), r6("logloss"), r6("mae")),
    f"{_grp} SELECT dimension, count(*) AS groups, cast(sum(n) AS BIGINT) AS n, {d6('sum(auc * n) / sum(CASE WHEN auc IS NOT NULL THEN n END)', 'auc')}, {d6('sum(logloss * n) / sum(n)', 'logloss')}, {d6('sum(mae * n) / sum(n)', 'mae')} FROM gm GROUP BY 1",
)
_EDGES = (0.05, 0.1, 0.2, 0.4)
_slice = K.bins("reference_pred", _EDGES, ("p0", "p1", "p2", "p3", "p4"))


def _slices(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select(F.expr(_slice).alias("slice"), *[comparable_logloss("target", f"{side}_pred").alias(side) for side in ("candidate", "reference")])
    table = rows.groupBy("slice").agg(F.count("*").alias("n"), F.avg(F.col("candidate") - F.col("reference")).alias("delta"), F.sum((F.col("candidate") < F.col("reference")).cast("long")).alias("wins"))
    delta = F.col("delta") + 1e-9
    return table.select("slice", "n", (F.signum(delta) * F.round(F.abs(delta), 6)).alias("delta"), "wins")  # a small loss is -0.0


register(
    "slice_delta",
    _slices,
    f"SELECT {_slice} AS slice, count(*) AS n, {d6(f'avg(({_LOSS('target', 'candidate_pred')}) - ({_LOSS('target', 'reference_pred')}))', 'delta')}, cast(sum(CASE WHEN {_LOSS('target', 'candidate_pred')} < {_LOSS('target', 'reference_pred')} THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM scored GROUP BY 1",
)
register(
    "correlations",
    lambda s, d: (lambda a: average_rank(average_rank(a, [], "reference_pred", "ra", source=a), [], "candidate_pred", "rb", source=a).agg(F.round(F.corr("reference_pred", "candidate_pred") + 1e-9, 6).alias("pearson"), F.round(F.corr("ra", "rb") + 1e-9, 6).alias("spearman")))(scored(s, d)),
    f"SELECT {d6('corr(reference_pred, candidate_pred)', 'pearson')}, {d6('corr(ra, rb)', 'spearman')} FROM (SELECT *, {_rank('reference_pred')} AS ra, {_rank('candidate_pred')} AS rb FROM scored)",
)
register(
    "submission_parity",
    lambda s, d: (lambda tr, te: tr.agg(F.count("*").alias("train_rows"), F.min("reference_pred").alias("a"), F.max("reference_pred").alias("b")).crossJoin(te.agg(F.count("*").alias("test_rows"), F.sum(((F.col("reference_pred") < 0) | (F.col("reference_pred") > 1)).cast("long")).alias("out_of_range"), F.count_distinct("id").alias("test_ids"))).select("train_rows", "test_rows", "test_ids", "out_of_range", r6("a", "train_low"), r6("b", "train_high")))(*sides(s, d)),
    f"SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows, count(DISTINCT id) FILTER (split = 'test') AS test_ids, cast(sum(CASE WHEN split = 'test' AND (reference_pred < 0 OR reference_pred > 1) THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, {d6("min(CASE WHEN split = 'train' THEN reference_pred END)", 'train_low')}, {d6("max(CASE WHEN split = 'train' THEN reference_pred END)", 'train_high')} FROM scored",
)
