"""Queries of the histogram trees. Their SQL grows the same trees level by level, written out for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.metrics import auc
from ..operators import folds as L
from ..operators import trees as T
from ..operators.blend import blend
from ..sources.accounts import DUCK, REFERENCE_WEIGHTS, accounts
from .audits import _REF, r6

QUERIES, ORACLES = {}, {}
_NUMERIC, _CATEGORICAL = ("tenure", "MonthlyCharges"), ("Contract", "InternetService", "PaymentMethod")
_MONOTONE = {"tenure": -1, "MonthlyCharges": 1}
_FOLDS = 2


def _rows(s: SparkSession, d: str) -> DataFrame:
    a = blend(accounts(s, d), REFERENCE_WEIGHTS)
    columns = ["id", "target", "fold", "reference_pred", *_NUMERIC, *_CATEGORICAL]
    return saved(L.stratified_folds(a, _FOLDS, 7).select(*columns))  # read by every round


def _binned(rows: DataFrame) -> T.Binning:
    return T.binning(rows, _NUMERIC, _CATEGORICAL, bins=8)


def _graded(s: SparkSession, d: str) -> tuple[DataFrame, T.Binning]:
    rows = _rows(s, d)
    binned = _binned(rows)
    return T.logistic_gradients(T.prepare(rows, binned, models=_FOLDS), range(_FOLDS)), binned


def _histogram(s: SparkSession, d: str) -> DataFrame:
    graded, _ = _graded(s, d)
    hist = T.histograms(graded, {m: F.lit(1) for m in range(_FOLDS)})
    return hist.select(*[F.col(c).cast("long").alias(c) for c in ("model", "node", "feature", "bin", "g", "h", "n")])


def _first_tree(s: SparkSession, d: str) -> DataFrame:
    graded, binned = _graded(s, d)
    options = T.Options(depth=3, rate=1.0, l2=3.0, least_rows=5, monotone=_MONOTONE)
    trees = T.grow(graded, range(_FOLDS), binned, options)
    rows = [(m, n, f, b, t.values[2 * n], t.values[2 * n + 1]) for m, t in trees.items() for n, (f, b) in t.splits.items()]
    out = s.createDataFrame(rows, "model long, node long, feature long, bin long, left double, right double")
    return out.select("model", "node", "feature", "bin", r6("left", "left_value"), r6("right", "right_value"))


_CURVE = T.Options(rounds=3, depth=2, rate=0.3, l2=3.0, least_rows=5, patience=0)


def _curve(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    model = T.fit(rows, _binned(rows), _CURVE, models=_FOLDS, fold="fold", stages=True)
    return T.curve(model).select(F.col("fold").cast("long").alias("fold"), F.col("iteration").cast("long").alias("iteration"), r6("auc", "auc"))


def _lambdas(s: SparkSession, d: str) -> DataFrame:
    """Sums over pairs at margins that are the reference's log odds, in thousandths."""
    rows = _rows(s, d)
    margin = (F.round(F.log(F.col("reference_pred") / (1 - F.col("reference_pred"))) * 1000) / 1000).alias("m0")
    pairs = T.fold_pairs(rows.withColumn("fold", F.lit(-1)), "Contract", 3000, 1)
    return T.pair_sums(rows.select("id", margin), pairs, [0]).select("id", F.col("g0").alias("g"), F.col("h0").alias("h"))


_BASE = f"""{DUCK}, folded AS (
  SELECT *, (row_number() OVER (PARTITION BY target ORDER BY md5('7:' || cast(id AS VARCHAR)), id) - 1) % 2 AS fold FROM accounts
), edges AS (
  SELECT list_sort(list_distinct(quantile_cont(cast(tenure AS DOUBLE), [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS tenure_edges,
    list_sort(list_distinct(quantile_cont(MonthlyCharges, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS charge_edges FROM folded
), contracts AS (SELECT Contract, row_number() OVER (ORDER BY count(*) DESC, Contract) AS code FROM folded GROUP BY Contract
), services AS (SELECT InternetService, row_number() OVER (ORDER BY count(*) DESC, InternetService) AS code FROM folded GROUP BY InternetService
), payments AS (SELECT PaymentMethod, row_number() OVER (ORDER BY count(*) DESC, PaymentMethod) AS code FROM folded GROUP BY PaymentMethod
), base AS MATERIALIZED (
  SELECT id, target, fold, [1 + len(list_filter(tenure_edges, lambda e: e < tenure)), 1 + len(list_filter(charge_edges, lambda e: e < MonthlyCharges)),
    contracts.code, services.code, payments.code] AS b
  FROM folded JOIN edges ON true JOIN contracts USING (Contract) JOIN services USING (InternetService) JOIN payments USING (PaymentMethod)
), rows_0 AS MATERIALIZED (SELECT base.*, model, cast(0 AS DOUBLE) AS m FROM base, (SELECT unnest([0, 1]) AS model))"""


def _level(t: str, level: int, rate: float, monotone: str) -> str:
    """The splits of one level of the trees of round t and, from them, the next level's nodes, limits and values."""
    now, then = f"{t}_{level}", f"{t}_{level + 1}"
    weight = "greatest(least(-({g}) / ({h} + 3.0), high), low)"
    loss = "({g} * {w} + 0.5 * ({h} + 3.0) * {w} * {w})"
    return f""", hist_{now} AS (
  SELECT model, node, feature, b[feature + 1] AS bin, cast(sum(g) AS BIGINT) AS g, cast(sum(h) AS BIGINT) AS h, count(*) AS n
  FROM nodes_{now}, (SELECT unnest(range(5)) AS feature) WHERE g IS NOT NULL GROUP BY ALL
), sums_{now} AS (
  SELECT model, node, feature, bin, low, high, nl, na,
    cast(gl AS DOUBLE) / 1048576 AS gl, cast(hl AS DOUBLE) / 1048576 AS hl, cast(ga - gl AS DOUBLE) / 1048576 AS gr, cast(ha - hl AS DOUBLE) / 1048576 AS hr,
    cast(ga AS DOUBLE) / 1048576 AS ga, cast(ha AS DOUBLE) / 1048576 AS ha
  FROM (SELECT *, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(n) OVER upto AS nl, sum(g) OVER f AS ga, sum(h) OVER f AS ha, sum(n) OVER f AS na FROM hist_{now}
    WINDOW f AS (PARTITION BY model, node, feature), upto AS (PARTITION BY model, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)) JOIN limits_{now} USING (model, node)
), weights_{now} AS (
  SELECT *, {weight.format(g='gl', h='hl')} AS lw, {weight.format(g='gr', h='hr')} AS rw, {weight.format(g='ga', h='ha')} AS w FROM sums_{now}
), gains_{now} AS (
  SELECT *, {loss.format(g='ga', h='ha', w='w')} - {loss.format(g='gl', h='hl', w='lw')} - {loss.format(g='gr', h='hr', w='rw')} AS gain, {monotone} AS direction FROM weights_{now}
), splits_{now} AS MATERIALIZED (
  SELECT * FROM gains_{now} WHERE gain > 0.000000001 AND nl >= 5 AND na - nl >= 5 AND (direction = 0 OR direction * (rw - lw) >= 0)
  QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, feature, bin) = 1
), limits_{then} AS (
  SELECT model, 2 * node AS node, CASE WHEN direction < 0 THEN (lw + rw) / 2 ELSE low END AS low, CASE WHEN direction > 0 THEN (lw + rw) / 2 ELSE high END AS high FROM splits_{now}
  UNION ALL SELECT model, 2 * node + 1, CASE WHEN direction > 0 THEN (lw + rw) / 2 ELSE low END, CASE WHEN direction < 0 THEN (lw + rw) / 2 ELSE high END FROM splits_{now}
), nodes_{then} AS MATERIALIZED (
  SELECT id, target, fold, n.b, n.model, m, n.g, n.h, CASE WHEN s.node IS NULL THEN n.node WHEN n.b[s.feature + 1] > s.bin THEN 2 * n.node + 1 ELSE 2 * n.node END AS node,
    CASE WHEN s.node IS NULL THEN value WHEN n.b[s.feature + 1] > s.bin THEN s.rw * {rate} ELSE s.lw * {rate} END AS value
  FROM nodes_{now} n LEFT JOIN splits_{now} s ON s.model = n.model AND s.node = n.node
)"""


def _round(t: int, depth: int, rate: float, monotone: str = "0") -> str:
    start = f""", nodes_{t}_0 AS MATERIALIZED (
  SELECT id, target, fold, b, model, m, CASE WHEN fold <> model THEN cast(round((p - target) * 1048576) AS BIGINT) END AS g,
    CASE WHEN fold <> model THEN cast(round(p * (1 - p) * 1048576) AS BIGINT) END AS h, 1 AS node, cast(0 AS DOUBLE) AS value
  FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM rows_{t - 1})
), limits_{t}_0 AS (SELECT model, 1 AS node, cast(-1e300 AS DOUBLE) AS low, cast(1e300 AS DOUBLE) AS high FROM (SELECT unnest([0, 1]) AS model))"""
    levels = "".join(_level(str(t), i, rate, monotone) for i in range(depth))
    return start + levels + f", rows_{t} AS MATERIALIZED (SELECT id, target, fold, b, model, m + value AS m FROM nodes_{t}_{depth})"


_DIRECTION = "CASE feature WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END"
_TREE = " UNION ALL ".join(
    f"SELECT model, node, feature, bin, round(lw + 0.000000001, 6) AS left_value, round(rw + 0.000000001, 6) AS right_value FROM splits_1_{i}" for i in range(3)
)
_STAGES = " UNION ALL ".join(f"SELECT fold, {t} AS iteration, target, m FROM rows_{t} WHERE fold = model" for t in (1, 2, 3))

QUERIES |= {"boosted_histogram": _histogram, "boosted_first_tree": _first_tree, "boosted_curve": _curve, "pair_lambdas": _lambdas}
ORACLES |= {
    "boosted_histogram": f"WITH {_BASE}{_round(1, 1, 1.0)} SELECT model, node, feature, bin, g, h, n FROM hist_1_0",
    "boosted_first_tree": f"WITH {_BASE}{_round(1, 3, 1.0, _DIRECTION)} {_TREE}",
    "boosted_curve": f"""WITH {_BASE}{''.join(_round(t, 2, 0.3) for t in (1, 2, 3))}, stages AS ({_STAGES}
), ranked AS (SELECT *, rank() OVER (PARTITION BY fold, iteration ORDER BY m) + (count(*) OVER (PARTITION BY fold, iteration, m) - 1) / 2.0 AS r FROM stages)
SELECT fold, cast(iteration AS BIGINT) AS iteration,
  round((sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * cast(count(*) - sum(target) AS DOUBLE)) + 0.000000001, 6) AS auc
FROM ranked GROUP BY fold, iteration""",
    "pair_lambdas": f"""WITH {DUCK}, o AS (
  SELECT Contract, id, target, row_number() OVER (PARTITION BY Contract, target ORDER BY md5('0:' || cast(id AS VARCHAR)), id) - 1 AS i,
    round(ln({_REF} / (1 - {_REF})) * 1000) / 1000 AS m FROM accounts
), st AS (SELECT Contract, sum(target) AS p, sum(1 - target) AS n FROM accounts GROUP BY 1
), ps AS (
  SELECT o.Contract, o.id, o.m, o.i, p, n, unnest(range(cast(least(n, ceil(3000 / p)) AS BIGINT))) AS k FROM o JOIN st USING (Contract) WHERE target = 1 AND n > 0
), pairs AS (
  SELECT ps.id AS ahead, o.id AS behind, 1 / (1 + exp(ps.m - o.m)) AS wrong
  FROM ps JOIN o ON o.Contract = ps.Contract AND o.target = 0 AND o.i = (ps.i + ps.k) % ps.n WHERE k * p + ps.i < 3000
), ends AS (
  SELECT ahead AS id, -cast(round(wrong * 1048576) AS BIGINT) AS g, cast(round(wrong * (1 - wrong) * 1048576) AS BIGINT) AS h FROM pairs
  UNION ALL SELECT behind, cast(round(wrong * 1048576) AS BIGINT), cast(round(wrong * (1 - wrong) * 1048576) AS BIGINT) FROM pairs
) SELECT id, cast(sum(g) AS BIGINT) AS g, cast(sum(h) AS BIGINT) AS h FROM ends GROUP BY id""",
}


def _learned(s: SparkSession, d: str) -> DataFrame:
    """Monotone trees stopped by the AUC of validation rows: each fold's best round, its AUC, and that of the final fit."""
    rows = _rows(s, d)
    options = T.Options(rounds=10, depth=3, rate=0.3, patience=3, monotone=_MONOTONE)
    model = T.fit(rows, _binned(rows), options, models=_FOLDS, fold="fold")
    scores = auc(model.out_of_fold(), ["fold"], "target", "oof_pred").select("fold", F.round("auc", 4).alias("auc"))
    rounds = s.createDataFrame(list(enumerate(model.best)), "fold int, best_iteration int")
    final = T.refit(rows, model)
    return scores.join(F.broadcast(rounds), "fold").withColumn("final_iterations", F.lit(len(final.trees[0])))


def _ranker(s: SparkSession, d: str) -> DataFrame:
    """Pairwise boosted scores of rows by the model of the other fold: AUC within each contract."""
    rows = _rows(s, d)
    options = T.Options(rounds=6, depth=3, rate=0.3, patience=3)
    model = T.fit_ranker(rows, _binned(rows), "Contract", 3000, _FOLDS, options)
    scores = model.out_of_fold("rank_score", probability=False).join(rows.select("id", "Contract"), "id")
    return auc(scores, ["Contract", "fold"], "target", "rank_score").withColumn("auc", F.round("auc", 4))


QUERIES |= {"learner_monotone": _learned, "learner_ranker": _ranker}
