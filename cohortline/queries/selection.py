"""Queries of splits, masks, pseudo labels, rank queries, duplicates, drift and other sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.masks import PRESETS, preset
from ..operators import audit as A
from ..operators import folds as L
from ..operators import graph as G
from ..operators import select as S
from ..sources import files
from ..sources.accounts import DUCK, accounts, blend_sql

QUERIES, ORACLES = {}, {}
TEACHERS = ["pred_cb", "pred_xgb", "pred_lgb", "pred_r", "pred_rv"]
E9 = "0.000000001"


def register(name: str, query, oracle: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = f"WITH {DUCK}, {oracle[1:]}" if oracle.startswith("+") else f"WITH {DUCK} {oracle}"


def plain(name: str, query, oracle: str) -> None:  # noqa: ANN001
    QUERIES[name], ORACLES[name] = query, oracle


def r6(c: str, name: str | None = None):  # noqa: ANN201
    return F.round(F.col(c) + 1e-9, 6).alias(name or c)


def d6(expression: str, name: str) -> str:
    return f"round(cast({expression} AS DOUBLE) + {E9}, 6) AS {name}"


_HASH = "md5('7:' || cast(id AS VARCHAR))"
register("kfold_assign", lambda s, d: L.stratified_folds(accounts(s, d), 5, 7).select("id", F.col("fold").cast("long").alias("fold")), f"SELECT id, (row_number() OVER (PARTITION BY target ORDER BY {_HASH}, id) - 1) % 5 AS fold FROM accounts")
register("holdout_assign", lambda s, d: L.stratified_holdout(accounts(s, d), 0.2, 7).select("id", F.col("holdout").cast("long").alias("holdout")), f"SELECT id, cast(row_number() OVER (PARTITION BY target ORDER BY {_HASH}, id) - 1 < count(*) OVER (PARTITION BY target) * 0.2 AS BIGINT) AS holdout FROM accounts")
register("sampled_rows", lambda s, d: L.sampled(accounts(s, d), 0.1, 7).select("id"), f"SELECT id FROM accounts WHERE cast('0x' || substr({_HASH}, 1, 8) AS BIGINT) < 0.1 * 4294967296")
_strata = {"s3": K.segment3(), "pc": K.key("PaymentMethod", "Contract"), "c": K.key("Contract")}
register(
    "composite_strata",
    lambda s, d: L.composite_strata(accounts(s, d), 40).select("id", "stratum"),
    "SELECT id, CASE " + " ".join(f"WHEN count(*) OVER (PARTITION BY target, {e}) >= 40 THEN cast(target AS VARCHAR) || '__' || {e}" for e in _strata.values()) + " ELSE cast(target AS VARCHAR) || '__all' END AS stratum FROM accounts",
)
_mean = "((" + " + ".join(TEACHERS) + ") / 5)"
_std = f"sqrt(({' + '.join(f'({t} - {_mean}) * ({t} - {_mean})' for t in TEACHERS)}) / 5)"
_EC = PRESETS["ec_mtm_fiber_any"]
register("uncertainty_band", lambda s, d: S.uncertainty_band(accounts(s, d), preset("ec_mtm_fiber_any"), "pred_cb", 0.15, TEACHERS, 0.02).select("id", F.col("in_band").cast("long").alias("in_band")), f"SELECT id, cast({_EC} AND abs(pred_cb - 0.5) <= 0.15 AND {_std} >= 0.02 AS BIGINT) AS in_band FROM accounts")
register("hard_example_mask", lambda s, d: S.hard_examples(accounts(s, d), preset("ec_mtm_fiber_any"), F.abs(F.col("pred_cb") - F.col("pred_xgb")), 0.8).select("id", F.col("hard").cast("long").alias("hard")), f"SELECT id, cast({_EC} AND abs(pred_cb - pred_xgb) >= (SELECT quantile_cont(abs(pred_cb - pred_xgb), 0.8) FROM accounts WHERE {_EC}) AS BIGINT) AS hard FROM accounts")
_pseudo = f"SELECT id, {d6(_mean, 'pseudo_p')}, {d6(_std, 'pseudo_std')}, cast({_mean} >= 0.5 AS BIGINT) AS pseudo_label FROM accounts WHERE ({_mean} >= 0.55 OR {_mean} <= 0.1) AND (({' AND '.join(f'{t} >= 0.5' for t in TEACHERS)}) OR ({' AND '.join(f'{t} < 0.5' for t in TEACHERS)})) AND {_std} <= 0.06"
register("pseudo_select", lambda s, d: S.pseudo_rows(accounts(s, d), TEACHERS, 0.1, 0.55, 0.06).select("id", r6("pseudo_p"), r6("pseudo_std"), F.col("pseudo_label").cast("long").alias("pseudo_label")), _pseudo)
_conf = "least(greatest(2 * abs(pred_cb - 0.5), 0), 1)"
register(
    "soft_label_rows",
    lambda s, d: S.training_rows(accounts(s, d).select("id", "pred_cb"), "pred_cb", 0.25).select("id", F.col("label").cast("long").alias("label"), r6("weight")),
    f"SELECT id, 1 AS label, {d6(f'pred_cb * {_conf} * 0.25', 'weight')} FROM accounts UNION ALL SELECT id, 0, {d6(f'(1 - pred_cb) * {_conf} * 0.25', 'weight')} FROM accounts",
)
_on = lambda s: f"scenario IN ('{s}', 'stability_bundle')"
register(
    "counterfactual_rewrite",
    lambda s, d: S.counterfactuals(accounts(s, d)).select("id", "scenario", "PaymentMethod", "PaperlessBilling", "Contract"),
    f"SELECT id, scenario, CASE WHEN {_on('auto_payment')} AND PaymentMethod IN ('Electronic check', 'Mailed check') THEN 'Bank transfer (automatic)' ELSE PaymentMethod END AS PaymentMethod, CASE WHEN {_on('paperless_off')} THEN 'No' ELSE PaperlessBilling END AS PaperlessBilling, "
    f"CASE WHEN {_on('contract_upgrade')} THEN CASE Contract WHEN 'Month-to-month' THEN 'One year' WHEN 'One year' THEN 'Two year' ELSE Contract END ELSE Contract END AS Contract FROM accounts, (SELECT unnest(['auto_payment', 'paperless_off', 'contract_upgrade', 'stability_bundle']) AS scenario)",
)
_eligible = lambda e: f"(count(*) OVER (PARTITION BY {e}) >= 60 AND sum(target) OVER (PARTITION BY {e}) >= 10 AND count(*) OVER (PARTITION BY {e}) - sum(target) OVER (PARTITION BY {e}) >= 10)"
_levels = "SELECT id, target, CASE " + " ".join(f"WHEN {_eligible(e)} THEN '{n}'" for n, e in S.QUERY_LEVELS.items()) + " ELSE 'global' END AS query_level, CASE " + " ".join(f"WHEN {_eligible(e)} THEN {e}" for e in S.QUERY_LEVELS.values()) + " ELSE '__GLOBAL__' END AS query_group FROM accounts"
register("query_groups", lambda s, d: S.query_groups(accounts(s, d), 60, 10, 10).select("id", "query_level", "query_group"), f"SELECT id, query_level, query_group FROM ({_levels})")
register(
    "rank_pairs",
    lambda s, d: S.rank_pairs(accounts(s, d), "Contract", 2000),
    "+o AS (SELECT Contract, id, target, row_number() OVER (PARTITION BY Contract, target ORDER BY md5('0:' || cast(id AS VARCHAR)), id) - 1 AS i FROM accounts), st AS (SELECT Contract, sum(target) AS p, sum(1 - target) AS n FROM accounts GROUP BY 1), "
    "ps AS (SELECT o.Contract, o.id, o.i, p, n, unnest(range(cast(least(n, ceil(2000 / p)) AS BIGINT))) AS k FROM o JOIN st USING (Contract) WHERE target = 1 AND n > 0) "
    "SELECT ps.Contract, ps.id AS positive_id, o.id AS negative_id FROM ps JOIN o ON o.Contract = ps.Contract AND o.target = 0 AND o.i = (ps.i + ps.k) % ps.n WHERE k * p + ps.i < 2000",
)
_doc_sig = "lower(trim(regexp_replace(coalesce(text, '__missing__'), '[ \\t\\n\\r]+', ' ', 'g')))"


def _dup_docs(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 2).alias("label"), F.md5(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("__missing__")), r"[ \t\n\r]+", " ")))).alias("s"))
    return A.duplicate_groups(docs, F.col("s"), "label", "doc_id").select("sig", "group_size", r6("positive_rate"), F.col("is_conflict").cast("long").alias("is_conflict"), "label_mode", "first_id")


def _duck_dups(rows: str, least: int = 2) -> str:
    return f"SELECT sig, count(*) AS group_size, {d6('avg(label)', 'positive_rate')}, cast(count(DISTINCT label) > 1 AS BIGINT) AS is_conflict, cast(CASE WHEN sum(label) * 2 > count(*) THEN 1 ELSE 0 END AS BIGINT) AS label_mode, min(id) AS first_id FROM ({rows}) GROUP BY sig HAVING count(*) >= {least}"


plain("dup_exact_docs", _dup_docs, _duck_dups(f"SELECT md5({_doc_sig}) AS sig, doc_id % 2 AS label, doc_id AS id FROM documents"))
_coarse = [*[f"lower(trim({c}))" for c in (*K.SEGMENT3, "PaperlessBilling")], K.tenure_bin(), "cast(cast(floor(MonthlyCharges / 10) AS BIGINT) AS STRING)"]
_coarse_duck = "md5(" + " || '|' || ".join(_coarse) + ")"
register("dup_coarse_orders", lambda s, d: A.duplicate_groups(accounts(s, d), A.signature(_coarse), "target", "id").select("sig", "group_size", r6("positive_rate"), F.col("is_conflict").cast("long").alias("is_conflict"), F.col("label_mode").cast("long").alias("label_mode"), "first_id"), _duck_dups(f"SELECT {_coarse_duck} AS sig, target AS label, id FROM accounts"))
register(
    "fold_suspects",
    lambda s, d: A.minority_suspects(accounts(s, d), A.signature(_coarse), "target").select("id", "group_size", r6("majority_share")),
    f"SELECT id, n AS group_size, {d6('greatest(p, n - p) / n', 'majority_share')} FROM (SELECT id, target, count(*) OVER (PARTITION BY g) AS n, sum(target) OVER (PARTITION BY g) AS p FROM (SELECT id, target, {_coarse_duck} AS g FROM accounts)) WHERE n BETWEEN 3 AND 5 AND p > 0 AND p < n AND greatest(p, n - p) / n >= 0.75 AND target = CASE WHEN p * 2 > n THEN 0 ELSE 1 END",
)
register(
    "overlap_anti",
    lambda s, d: (lambda a: A.without_overlap(a.filter("split = 'test'"), a.filter("split = 'train'"), A.signature(_coarse)).select("id"))(accounts(s, d)),
    f"SELECT id FROM accounts WHERE split = 'test' AND {_coarse_duck} NOT IN (SELECT {_coarse_duck} FROM accounts WHERE split = 'train')",
)
register("id_coverage", lambda s, d: (lambda a: A.coverage(a.filter("split = 'train'"), a.filter("id % 3 = 0").unionByName(a.filter("id % 3 = 0 AND tenure < 9"))))(accounts(s, d).select("id", "split", "tenure")),
         "SELECT (SELECT count(*) FROM accounts WHERE split = 'train' AND id % 3 <> 0) AS missing, (SELECT count(*) FROM accounts WHERE split = 'test' AND id % 3 = 0) AS unexpected, (SELECT count(*) FROM accounts WHERE id % 3 = 0 AND tenure < 9) AS repeated")
_DRIFT = ("tenure", "MonthlyCharges", "TotalCharges", "pred_cb")
_DN = ["train_missing_rate", "test_missing_rate", "missing_rate_delta", "train_mean", "test_mean", "mean_delta", "train_std", "test_std", "std_ratio", *[f"{t}_p{q}" for t in ("train", "test") for q in ("01", "50", "99")], "psi"]


def _duck_drift(c: str) -> str:
    x = f"cast({c} AS DOUBLE)"
    side = lambda t: f"(SELECT {x} AS x FROM accounts WHERE split = '{t}')"
    edges = f"(SELECT list_sort(list_distinct(quantile_cont(x, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM {side('train')})"
    stats = lambda t: f"(SELECT count(x) AS {t}_count, 1 - count(x) / count(*) AS {t}_missing_rate, avg(x) AS {t}_mean, stddev_pop(x) AS {t}_std, quantile_cont(x, 0.01) AS {t}_p01, quantile_cont(x, 0.5) AS {t}_p50, quantile_cont(x, 0.99) AS {t}_p99 FROM {side(t)})"
    bins = f"(SELECT split, len(list_filter(e[2:len(e) - 1], lambda v: v <= {x})) AS b FROM accounts, {edges} WHERE {c} IS NOT NULL)"
    psi = f"(SELECT sum((q - p) * ln(q / p)) AS psi FROM (SELECT greatest(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) / (SELECT count({c}) FROM accounts WHERE split = 'train'), 1e-9) AS p, greatest(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) / (SELECT count({c}) FROM accounts WHERE split = 'test'), 1e-9) AS q FROM {bins} GROUP BY b))"
    return f"SELECT '{c}' AS \"column\", *, test_mean - train_mean AS mean_delta, test_missing_rate - train_missing_rate AS missing_rate_delta, test_std / train_std AS std_ratio FROM {stats('train')}, {stats('test')}, {psi}"


register(
    "drift_numeric",
    lambda s, d: A.numeric_drift(accounts(s, d).withColumn("is_test", (F.col("split") == "test").cast("int")), _DRIFT).select("column", "train_count", "test_count", *[r6(c) for c in _DN]),
    f'SELECT "column", train_count, test_count, {", ".join(d6(c, c) for c in _DN)} FROM (' + " UNION ALL ".join(_duck_drift(c) for c in _DRIFT) + ")",
)
_CAT = ("PaymentMethod", "Contract", "TechSupport")


_LATE = {"PaymentMethod": "PaymentMethod", "Contract": "CASE WHEN split = 'test' AND tenure > 60 THEN 'Late' ELSE Contract END", "TechSupport": "TechSupport"}


def _duck_cat(c: str) -> str:
    f = f"(SELECT {_LATE[c]} AS v, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS b FROM accounts GROUP BY 1)"
    return f"SELECT '{c}' AS \"column\", cast(count(*) FILTER (a > 0) AS BIGINT) AS train_unique, cast(count(*) FILTER (b > 0) AS BIGINT) AS test_unique, cast(count(*) FILTER (a = 0 AND b > 0) AS BIGINT) AS unseen_in_test_count, string_agg(v, ',' ORDER BY v) FILTER (a = 0 AND b > 0) AS unseen_examples, {d6('sum(abs(a / na - b / nb)) / 2', 'tvd')}, arg_min(v, (-a, v)) AS train_top_1, {d6('max(a / na)', 'train_top_1_share')}, arg_min(v, (-b, v)) AS test_top_1, {d6('max(b / nb)', 'test_top_1_share')} FROM {f}, (SELECT sum(a) AS na, sum(b) AS nb FROM {f})"


def _cat(s: SparkSession, d: str) -> DataFrame:
    # contracts of late test rows are a value of their own, which the training side doesn't have
    rows = accounts(s, d).withColumn("is_test", (F.col("split") == "test").cast("int")).withColumn("Contract", F.expr(_LATE["Contract"]))
    out = A.categorical_drift(rows, _CAT)
    return out.select("column", "train_unique", "test_unique", "unseen_in_test_count", F.nullif(F.array_join("unseen_examples", ","), F.lit("")).alias("unseen_examples"), r6("tvd"), "train_top_1", r6("train_top_1_share"), "test_top_1", r6("test_top_1_share"))


register("drift_categorical", _cat, " UNION ALL ".join(_duck_cat(c) for c in _CAT))
_noise = f"{blend_sql()}"
register(
    "noise_audit",
    lambda s, d: A.noise_audit(accounts(s, d).withColumn("reference_pred", F.expr(_noise.replace("cast(", "CAST("))), TEACHERS, A.signature(_coarse)).select("id", "reason"),
    f"""+b AS (SELECT *, {_noise} AS ref, {_std} AS sd, {_coarse_duck} AS g, CASE WHEN target = 1 THEN 1 - ({_noise}) ELSE {_noise} END AS err FROM accounts),
c AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, sum(target) OVER (PARTITION BY g) AS p, (SELECT quantile_cont(err, 0.95) FROM b) AS hard, (SELECT median(sd) FROM b) AS calm FROM b),
r AS (SELECT id, CASE WHEN n BETWEEN 2 AND 5 AND p > 0 AND p < n THEN 'near_duplicate_conflict' WHEN err >= 0.6 AND sd <= calm AND (({' AND '.join(f'({t} >= 0.5) <> (target = 1)' for t in TEACHERS)})) THEN 'label_noise' WHEN err >= hard AND sd <= calm THEN 'hard_stable' END AS reason FROM c)
SELECT id, reason FROM r WHERE reason IS NOT NULL""",
)
plain(
    "knn_embeddings",
    lambda s, d: G.exact_knn(s.read.parquet(f"{d}/embeddings.parquet"), 8).select("vec_id", "neighbour", F.col("rank").cast("long").alias("rank")),
    "SELECT vec_id, neighbour, rank FROM (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (cast(z[1] AS DOUBLE) - z[2]) * (cast(z[1] AS DOUBLE) - z[2]))), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 8",
)
plain(
    "json_leaves_events",
    lambda s, d: files.json_leaves(s.read.parquet(f"{d}/events.parquet").select("event_id", "props"), "event_id", "props").groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")),
    "SELECT key AS path, count(*) AS n, round(sum(cast(value AS DOUBLE)), 4) AS total FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value, json_type(json_extract(props, '$.' || key)) AS kind) WHERE kind IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') GROUP BY 1",
)
plain(
    "forensics_events",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"), F.avg("value").alias("mean"), F.count_distinct("user_id").alias("users"), F.corr("value", F.col("user_id").cast("double")).alias("c")).select("event_type", "n", r6("best"), r6("mean"), "users", F.when(F.col("n") >= 3, F.round(F.col("c") + 1e-9, 6)).alias("corr")),
    f"SELECT event_type, count(*) AS n, {d6('max(value)', 'best')}, {d6('avg(value)', 'mean')}, count(DISTINCT user_id) AS users, CASE WHEN count(*) >= 3 THEN round(corr(value, user_id) + {E9}, 6) END AS corr FROM events GROUP BY 1",
)
