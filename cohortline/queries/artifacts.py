"""Queries of reports, submissions' names, fitted codes, scaling and states. Their SQL is written by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import SEGMENT3
from ..operators import matrix as M
from ..sources import artifacts as R
from ..sources.accounts import DUCK, accounts

QUERIES, ORACLES = {}, {}


def _reports(s: SparkSession, d: str) -> DataFrame:
    """A nested report of each order, of the order's own numbers."""
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    inner = F.struct(F.struct((k % 1000).alias("auc"), F.lit(True).alias("ok"), F.lit("text").alias("note")).alias("cv"), F.array((k % 7).cast("double") / 4, (k % 11).cast("double") / 4).alias("folds"), F.when(k % 2 == 0, k % 5).alias("maybe"))
    return o.select(k.alias("id"), F.to_json(inner).alias("report"))


QUERIES["report_leaves"] = lambda s, d: R.nested_leaves(_reports(s, d), "id", "report").groupBy("path").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
ORACLES["report_leaves"] = """SELECT 'cv.auc' AS path, count(*) AS n, sum(o_orderkey % 1000)::DOUBLE AS total FROM orders UNION ALL SELECT 'folds[0]', count(*), sum((o_orderkey % 7) / 4) FROM orders UNION ALL SELECT 'folds[1]', count(*), sum((o_orderkey % 11) / 4) FROM orders
UNION ALL SELECT 'maybe', count(*), sum(o_orderkey % 5) FROM orders WHERE o_orderkey % 2 = 0"""
QUERIES["primary_metrics"] = lambda s, d: R.primary_metric(R.nested_leaves(_reports(s, d), "id", "report"), "id", ("maybe", "auc"))
ORACLES["primary_metrics"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'maybe' ELSE 'auc' END AS metric, (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 ELSE o_orderkey % 1000 END)::DOUBLE AS value FROM orders"
# a submission for each order: names of several families, dates of which some can't be read, scores of which some are missing
_NAMES = ("sub-residual-hier-v3.csv", "RBLEND_2.csv", "rvblend.csv", "blend-grid.csv", "multiseed-5.csv", "pseudo.csv", "plain.csv")


def _history(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    date = F.when(k % 9 == 0, F.lit("not a date")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 10:20:30")))
    return o.select(k.alias("id"), F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int")).alias("name"), date.alias("date"), F.when(k % 3 > 0, (k % 100).cast("double")).alias("score"), ((k * 7) % 50).cast("double").alias("metric"))


_FAMILY = "CASE id % 7 WHEN 0 THEN 'residual_hierarchy' WHEN 1 THEN 'teacher_blend_r' WHEN 2 THEN 'teacher_blend_rv' WHEN 3 THEN 'blend_scan' WHEN 4 THEN 'catboost_multiseed' WHEN 5 THEN 'pseudo_labeling' ELSE 'generic' END"
_HIST = "WITH h AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 100)::DOUBLE END AS score, ((o_orderkey * 7) % 50)::DOUBLE AS metric, o_orderdate FROM orders)"
QUERIES["submission_forensics"] = lambda s, d: R.forensics(_history(s, d), "name", "score", "metric").withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean", "correlation")})
ORACLES["submission_forensics"] = f"{_HIST} SELECT {_FAMILY} AS family, count(*) AS submissions, count(score) AS complete, max(score) AS best, round(avg(score) + 0.000000001, 6) AS mean, CASE WHEN count(score) >= 3 THEN round(corr(metric, score) + 0.000000001, 6) END AS correlation FROM h GROUP BY 1"
QUERIES["submission_dates"] = lambda s, d: _history(s, d).select("id", R.submission_family(F.col("name")).alias("family"), F.date_format(R.parsed_date(F.col("date")), "yyyy-MM-dd HH:mm").alias("at"))
ORACLES["submission_dates"] = f"{_HIST} SELECT id, {_FAMILY} AS family, CASE WHEN id % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20' END AS at FROM h"
QUERIES["fitted_codes"] = lambda s, d: (lambda a: M.Codes(SEGMENT3[:2]).fit(a.filter("split = 'train'")).apply(a.filter("split = 'test'")).select("id", F.col("code_PaymentMethod").cast("long").alias("payment"), F.col("code_Contract").cast("long").alias("contract")))(accounts(s, d))
ORACLES["fitted_codes"] = f"WITH {DUCK}, p AS (SELECT PaymentMethod, row_number() OVER (ORDER BY PaymentMethod) AS pc FROM (SELECT DISTINCT PaymentMethod FROM accounts WHERE split = 'train')), c AS (SELECT Contract, row_number() OVER (ORDER BY Contract) AS cc FROM (SELECT DISTINCT Contract FROM accounts WHERE split = 'train')) SELECT id, coalesce(pc, 0) AS payment, coalesce(cc, 0) AS contract FROM accounts LEFT JOIN p USING (PaymentMethod) LEFT JOIN c USING (Contract) WHERE split = 'test'"
QUERIES["fitted_scaling"] = lambda s, d: (lambda a: M.Scaling(("TotalCharges", "tenure")).fit(a.filter("split = 'train'")).apply(a.filter("split = 'test'")).select("id", F.round("z_TotalCharges", 6).alias("total"), F.round("z_tenure", 6).alias("tenure")))(accounts(s, d))
ORACLES["fitted_scaling"] = f"WITH {DUCK}, m AS (SELECT median(TotalCharges) AS med FROM accounts WHERE split = 'train'), f AS (SELECT avg(coalesce(TotalCharges, med)) AS mu, stddev_pop(coalesce(TotalCharges, med)) AS sd, avg(tenure) AS tm, stddev_pop(tenure) AS ts FROM accounts, m WHERE split = 'train') SELECT id, round((coalesce(TotalCharges, med) - mu) / sd, 6) AS total, round((tenure - tm) / ts, 6) AS tenure FROM accounts, m, f WHERE split = 'test'"
QUERIES["test_matrix"] = lambda s, d: (lambda a: M.test_matrix(a.filter("split = 'train'"), a.filter("split = 'test'"), "A,G").select("id", "tenure_bin", F.col("is_new_customer").cast("long").alias("is_new_customer"), F.col("segment3_train_rows").cast("long").alias("segment3_train_rows")))(accounts(s, d))
ORACLES["test_matrix"] = f"WITH {DUCK}, n AS (SELECT PaymentMethod, Contract, InternetService, count(*) AS n FROM accounts WHERE split = 'train' GROUP BY ALL) SELECT id, CASE WHEN tenure <= 6 THEN '0_6' WHEN tenure <= 12 THEN '7_12' WHEN tenure <= 24 THEN '13_24' WHEN tenure <= 48 THEN '25_48' ELSE '49_plus' END AS tenure_bin, (tenure <= 6)::BIGINT AS is_new_customer, coalesce(n, 0) AS segment3_train_rows FROM accounts LEFT JOIN n USING (PaymentMethod, Contract, InternetService) WHERE split = 'test'"
