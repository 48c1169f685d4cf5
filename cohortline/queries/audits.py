"""Queries of signatures, guarded joins and further splits. Their SQL is written by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.masks import preset
from ..functions.metrics import logloss
from ..operators import folds as L
from ..operators import guards as G
from ..operators import signatures as S
from ..operators.select import DOMINANT
from ..sources.accounts import DUCK, REFERENCE_WEIGHTS, accounts
from ..operators.blend import blend

QUERIES, ORACLES = {}, {}


def register(name: str, query, oracle: str) -> None:  # noqa: ANN001
    QUERIES[name] = query
    ORACLES[name] = f"WITH {DUCK}" + (f", {oracle[1:]}" if oracle.startswith("+") else f" {oracle}")


def r6(c, name: str):  # noqa: ANN001, ANN201
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6).alias(name)


_BIN = "CASE WHEN tenure <= 6 THEN '0_6' WHEN tenure <= 12 THEN '7_12' WHEN tenure <= 24 THEN '13_24' WHEN tenure <= 48 THEN '25_48' ELSE '49_plus' END"
_S3 = "PaymentMethod || '__' || Contract || '__' || InternetService"
_S5 = f"{_S3} || '__' || PaperlessBilling || '__' || {_BIN}"
_TEXTS = """lower(trim(gender)), cast(SeniorCitizen AS VARCHAR), lower(trim(Partner)), lower(trim(Dependents)), lower(trim(PhoneService)), lower(trim(MultipleLines)), lower(trim(InternetService)),
  lower(trim(OnlineSecurity)), lower(trim(OnlineBackup)), lower(trim(DeviceProtection)), lower(trim(TechSupport)), lower(trim(StreamingTV)), lower(trim(StreamingMovies)),
  lower(trim(Contract)), lower(trim(PaperlessBilling)), lower(trim(PaymentMethod))"""
_AMOUNTS = "cast(cast(round_even(MonthlyCharges, 0) AS BIGINT) AS VARCHAR), cast(cast(round_even(coalesce(TotalCharges, -999999) / 10, 0) * 10 AS BIGINT) AS VARCHAR)"
_SIGS = f"""sig AS (SELECT *, {_S3} AS segment3, {_S5} AS segment5,
  md5(concat_ws('|', {_TEXTS}, cast(tenure AS VARCHAR), {_BIN}, {_AMOUNTS})) AS coarse,
  md5(concat_ws('|', {_TEXTS}, cast(tenure AS VARCHAR), {_AMOUNTS}, {_S3}, {_S5})) AS mitigation,
  md5(concat_ws('|', Contract, PaymentMethod, cast(tenure AS VARCHAR), cast(cast(round_even(MonthlyCharges * 100, 0) AS BIGINT) AS VARCHAR), cast(cast(round_even(coalesce(TotalCharges, -999999) * 100, 0) AS BIGINT) AS VARCHAR))) AS overlap,
  md5(concat_ws('|', lower(trim(Contract)), lower(trim(InternetService)), cast(tenure * 1000000 AS VARCHAR), cast(cast(round_even(MonthlyCharges * 1000000, 0) AS BIGINT) AS VARCHAR))) AS exact
  FROM accounts)"""
_SHARED = ("Contract", "PaymentMethod", "tenure", "MonthlyCharges", "TotalCharges")


def signed(spark: SparkSession, d: str) -> DataFrame:
    a = accounts(spark, d)
    exact = S.exact(a.select("id", "target", "Contract", "InternetService", F.col("tenure"), "MonthlyCharges"))
    return a.withColumns({"exact": exact, "coarse": S.coarse(a.columns), "mitigation": S.mitigation(a.columns), "overlap": S.overlap(_SHARED)})


_KINDS = ("exact", "coarse")
register("signatures", lambda s, d: signed(s, d).select("id", "exact", "coarse", "mitigation", "overlap"), f"+{_SIGS} SELECT id, exact, coarse, mitigation, overlap FROM sig")
register(
    "normalised_numbers",
    lambda s, d: accounts(s, d).select("id", F.expr(K.normal_number("TotalCharges", 1)).alias("total"), F.expr(K.number_text("MonthlyCharges")).alias("monthly")),
    "SELECT id, coalesce(round_even(TotalCharges, 1), -999999) AS total, cast(cast(round_even(MonthlyCharges * 1000000, 0) AS BIGINT) AS VARCHAR) AS monthly FROM accounts",
)
_groups = lambda k: f"""SELECT '{k}' AS signature_kind, {k} AS signature, count(*) AS group_size, count(DISTINCT target) AS label_unique_count, avg(target) AS positive_rate, count(DISTINCT target) > 1 AS inconsistent_labels,
  list_sort(list(DISTINCT target))::VARCHAR AS labels, list_sort(list(id))[1:5]::VARCHAR AS sample_ids FROM sig GROUP BY {k} HAVING count(*) > 1"""  # noqa: E731
_mode = lambda k, level: f"SELECT {k} AS signature, arg_min({level}, (-n, {level})) AS {level}_mode FROM (SELECT {k}, {level}, count(*) AS n FROM sig GROUP BY ALL) GROUP BY 1"
_list = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")).alias(c)
register(
    "duplicate_summary",
    lambda s, d: S.duplicate_groups(signed(s, d), {k: F.col(k) for k in _KINDS}).select("signature_kind", "signature", "group_size", F.col("label_unique_count").cast("long").alias("label_unique_count"), r6("positive_rate", "positive_rate"), "inconsistent_labels", _list("labels"), _list("sample_ids"), "segment3_mode", "segment5_mode"),
    f"+{_SIGS}, g AS ({' UNION ALL '.join(_groups(k) for k in _KINDS)}), m AS ({' UNION ALL '.join(f'SELECT * FROM ({_mode(k, "segment3")}) JOIN ({_mode(k, "segment5")}) USING (signature)' for k in _KINDS)}) SELECT signature_kind, signature, group_size, label_unique_count, round(positive_rate + 0.000000001, 6) AS positive_rate, inconsistent_labels, labels, sample_ids, segment3_mode, segment5_mode FROM g JOIN m USING (signature)",
)
register(
    "duplicate_flags",
    lambda s, d: S.duplicate_flags(signed(s, d).select("id", "target", "exact", "coarse"), {k: F.col(k) for k in _KINDS}).select("id", "exact_group_size", "exact_inconsistent", "coarse_group_size", "coarse_inconsistent"),
    f"+{_SIGS} SELECT id, count(*) OVER (PARTITION BY exact) AS exact_group_size, min(target) OVER (PARTITION BY exact) < max(target) OVER (PARTITION BY exact) AS exact_inconsistent, count(*) OVER (PARTITION BY coarse) AS coarse_group_size, min(target) OVER (PARTITION BY coarse) < max(target) OVER (PARTITION BY coarse) AS coarse_inconsistent FROM sig",
)
_REF = "(cast(0.35 AS DOUBLE) * pred_cb + cast(0.25 AS DOUBLE) * pred_xgb + cast(0.15 AS DOUBLE) * pred_lgb + cast(0.1 AS DOUBLE) * pred_r + cast(0.15 AS DOUBLE) * pred_rv)"
_CLIP = lambda p: f"least(greatest({p}, cast(0.000001 AS DOUBLE)), cast(0.999999 AS DOUBLE))"
_LOSS = lambda y, p: f"-({y} * ln({_CLIP(p)}) + (1 - {y}) * ln(1 - {_CLIP(p)}))"
register(
    "suspicious_families",
    lambda s, d: (lambda a: S.suspicious_families(a, F.expr(K.segment3()), F.abs(F.col("target") - F.col("reference_pred")) >= 0.6, logloss("target", "reference_pred"), F.abs(F.col("target") - F.col("reference_pred")), 8).select("family_value", "rows", "suspicious_rows", r6("suspicious_rate", "suspicious_rate"), r6("mean_logloss", "mean_logloss"), r6("mean_abs_error", "mean_abs_error")))(blend(accounts(s, d), REFERENCE_WEIGHTS)),
    f"+b AS (SELECT {_S3} AS family_value, target AS y, {_REF} AS p FROM accounts), g AS (SELECT family_value, count(*) AS rows, cast(sum(CASE WHEN abs(y - p) >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS suspicious_rows, avg({_LOSS('y', 'p')}) AS l, avg(abs(y - p)) AS e FROM b GROUP BY 1) SELECT family_value, rows, suspicious_rows, round(suspicious_rows / rows + 0.000000001, 6) AS suspicious_rate, round(l + 0.000000001, 6) AS mean_logloss, round(e + 0.000000001, 6) AS mean_abs_error FROM g ORDER BY suspicious_rows DESC, suspicious_rows / rows DESC, family_value LIMIT 8",
)
register("strict_target", lambda s, d: accounts(s, d).select("id", G.strict_binary("Churn").alias("label"), G.strict_binary("target").alias("same")), "SELECT id, CASE Churn WHEN 'Yes' THEN 1 ELSE 0 END AS label, target AS same FROM accounts")
register(
    "complete_left_join",
    lambda s, d: (lambda a: G.complete_left(a.filter("split = 'test'").select("id", "tenure"), a.select("id", "pred_cb"), ["id"], "pred_cb").select("id", "tenure", r6("pred_cb", "pred_cb")))(accounts(s, d)),
    "SELECT id, tenure, round(pred_cb + 0.000000001, 6) AS pred_cb FROM accounts WHERE split = 'test'",
)
register(
    "family_lookup",
    lambda s, d: (lambda a: G.lookup(a.select("id", F.expr(K.segment3()).alias("family")), a.groupBy(F.expr(K.segment3()).alias("family")).agg(F.avg("target").alias("rate")), "family", "rate").select("id", r6("rate", "rate")))(accounts(s, d)),
    f"SELECT id, round(avg(target) OVER (PARTITION BY {_S3}) + 0.000000001, 6) AS rate FROM accounts",
)


def _frames(s: SparkSession, d: str) -> dict[str, DataFrame]:
    a = blend(accounts(s, d), REFERENCE_WEIGHTS)
    frame = lambda p, moved=0.0: a.select("id", "target", (F.col("reference_pred") + moved).alias("reference_pred"), preset("ec_mtm_fiber_any").cast("int").alias("specialist_mask"), F.col(p).alias("candidate_pred"))
    return {"first": frame("pred_cb"), "same": frame("pred_xgb"), "moved": frame("pred_lgb", 0.25), "other_targets": frame("pred_r").withColumn("target", F.when(F.col("id") % 2 == 0, 1 - F.col("target")).otherwise(F.col("target")))}


register(
    "frame_compatibility",
    lambda s, d: G.compatibility(_frames(s, d)).select("frame", "id_mismatch", "target_mismatch", r6("max_reference_diff", "max_reference_diff"), "bad_mask"),
    "SELECT frame, 0 AS id_mismatch, CASE WHEN frame = 'other_targets' THEN (SELECT count(*) FROM accounts WHERE id % 2 = 0) ELSE 0 END AS target_mismatch, CASE WHEN frame = 'moved' THEN 0.25 ELSE 0 END AS max_reference_diff, 0 AS bad_mask FROM (SELECT unnest(['same', 'moved', 'other_targets']) AS frame)",
)
register("index_difference", lambda s, d: (lambda a: G.without_ids(a.filter("split = 'train'").select("id"), a.filter("Contract = 'One year'")))(accounts(s, d)), "SELECT id FROM accounts WHERE split = 'train' AND Contract <> 'One year'")
_EC = "PaymentMethod = 'Electronic check' AND Contract = 'Month-to-month' AND InternetService = 'Fiber optic'"
register(
    "focus_mask",
    lambda s, d: G.focus_mask(accounts(s, d), F.expr(K.segment3()) == DOMINANT, "pred_cb", 0.2, 1).select("id"),
    f"SELECT id FROM accounts WHERE {_EC} AND abs(pred_cb - 0.5) <= 0.2",
)
register(
    "tagged_union",
    lambda s, d: (lambda a: G.tagged_union({"own": (a.filter("split = 'train'").select("id", "target", "tenure"), 1.0), "external": (a.filter("split = 'test'").select("id", "target"), 0.25)}).groupBy("source").agg(F.count("*").alias("rows"), F.count("tenure").alias("with_tenure"), F.round(F.sum("sample_weight"), 4).alias("weight")))(accounts(s, d)),
    "SELECT CASE split WHEN 'train' THEN 'own' ELSE 'external' END AS source, count(*) AS rows, CASE split WHEN 'train' THEN count(*) ELSE 0 END AS with_tenure, round(count(*) * CASE split WHEN 'train' THEN 1 ELSE 0.25 END, 4)::DOUBLE AS weight FROM accounts GROUP BY split",
)
register(
    "joint_strata",
    lambda s, d: L.joint_strata(accounts(s, d), preset("ec_mtm_fiber_any")).select("id", "stratum"),
    f"+j AS (SELECT id, target::VARCHAR AS y, target::VARCHAR || '__' || CASE WHEN {_EC} THEN '1' ELSE '0' END AS joint FROM accounts), n AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM j GROUP BY joint)) SELECT id, CASE WHEN least >= 2 THEN joint ELSE y END AS stratum FROM j, n",
)
register(
    "leave_family_out",
    lambda s, d: L.leave_family_out(accounts(s, d), F.expr(K.segment3()), 200).groupBy("left_out", "side").agg(F.count("*").alias("rows"), F.sum("target").alias("positives")),
    f"+f AS (SELECT {_S3} AS family, count(*) AS n, sum(target) AS p FROM accounts GROUP BY 1), t AS (SELECT sum(n) AS n, sum(p) AS p FROM f) SELECT family AS left_out, 'valid' AS side, n AS rows, p::BIGINT AS positives FROM f WHERE n >= 200 UNION ALL SELECT family, 'train', (t.n - f.n)::BIGINT, (t.p - f.p)::BIGINT FROM f, t WHERE f.n >= 200",
)
register(
    "sister_families",
    lambda s, d: accounts(s, d).select(F.expr(K.segment5()).alias("family")).distinct().select("family", F.expr(K.sister_column("family")).alias("sister")),
    f"SELECT DISTINCT {_S5} AS family, {_S3} || '__' || PaperlessBilling || '__' || CASE {_BIN} WHEN '0_6' THEN '7_12' WHEN '7_12' THEN '0_6' WHEN '13_24' THEN '7_12' WHEN '25_48' THEN '13_24' ELSE '25_48' END AS sister FROM accounts",
)
register(
    "segment5_support",
    lambda s, d: (lambda a: a.join(a.groupBy("g").agg(F.count("*").alias("n")), "g").select("id", "n", F.expr(K.segment5_support_bucket("n")).alias("bucket")))(accounts(s, d).select("id", F.expr(K.segment5()).alias("g"))),
    f"SELECT id, n, CASE WHEN n <= 49 THEN 'lt50' WHEN n <= 99 THEN '50_99' WHEN n <= 249 THEN '100_249' WHEN n <= 499 THEN '250_499' ELSE '500_plus' END AS bucket FROM (SELECT id, count(*) OVER (PARTITION BY {_S5}) AS n FROM accounts)",
)
