"""One account for each order: a deterministic projection of orders and customers into the account schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SERVICES

#: Divisors of the services' parities, and multipliers of each model's noise.
SERVICE_DIVISORS = dict(zip(SERVICES, (3, 5, 7, 11, 13, 17)))
FLAG_DIVISORS = {"PhoneService": 19, "MultipleLines": 23, "gender": 29, "Partner": 31, "Dependents": 37, "SeniorCitizen": 41}
FLAG_VALUES = {f: ("'Yes'", "'No'") for f in FLAG_DIVISORS} | {"gender": ("'Male'", "'Female'"), "SeniorCitizen": ("1", "0")}
MODELS = {"cb": (3, 5), "xgb": (7, 11), "lgb": (13, 17), "r": (19, 23), "rv": (29, 31)}
#: Weights of the reference blend.
REFERENCE_WEIGHTS = {"cb": 0.35, "xgb": 0.25, "lgb": 0.15, "r": 0.10, "rv": 0.15}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts with their models' predictions; a column that isn't used isn't computed."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    k, cents = F.col("id"), F.col("_c")
    case = lambda column, pairs: F.coalesce(*[F.when(F.col(column).isin(*keys), F.lit(v)) for keys, v in pairs])
    a = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("_c"),
        case("o_orderpriority", [(("1-URGENT", "2-HIGH"), "Electronic check"), (("3-MEDIUM",), "Mailed check"), (("4-NOT SPECIFIED",), "Bank transfer (automatic)"), (("5-LOW",), "Credit card (automatic)")]).alias("PaymentMethod"),
        case("o_orderstatus", [(("P",), "Month-to-month"), (("F",), "One year"), (("O",), "Two year")]).alias("Contract"),
        case("c_mktsegment", [(("MACHINERY", "BUILDING"), "Fiber optic"), (("AUTOMOBILE", "FURNITURE"), "DSL"), (("HOUSEHOLD",), "No")]).alias("InternetService"),
    )
    base = F.expr("CASE WHEN PaymentMethod = 'Electronic check' AND Contract = 'Month-to-month' AND InternetService = 'Fiber optic' THEN 61 WHEN Contract = 'Month-to-month' THEN 30 WHEN Contract = 'One year' THEN 10 ELSE 4 END")
    a = a.withColumns({
        "PaperlessBilling": F.when(cents % 10 < 6, "Yes").otherwise("No"), "tenure": (1 + k % 72).cast("int"),
        "MonthlyCharges": (1825 + cents % 10051).cast("double") / 100, "_base": base,
    }).withColumns({
        "target": F.when((cents * 31 + k * 17) % 100 < F.col("_base"), 1).otherwise(0),
        "TotalCharges": F.when(k % 997 != 0, ((1825 + cents % 10051) * F.col("tenure") + cents % 2001).cast("double") / 100),
        **{s: F.when(F.col("InternetService") == "No", "No internet service").when(F.expr(f"(_c div {d}) % 2 = 0"), "Yes").otherwise("No") for s, d in SERVICE_DIVISORS.items()},
        **{f: F.expr(f"CASE WHEN (_c div {d}) % 2 = 0 THEN {FLAG_VALUES[f][0]} ELSE {FLAG_VALUES[f][1]} END") for f, d in FLAG_DIVISORS.items()},
    })
    a = a.withColumns({
        "Churn": F.when(F.col("target") == 1, "Yes").otherwise("No"), "split": F.when(k % 5 == 4, "test").otherwise("train"),
        **{f"pred_{m}": (100 + F.col("_base") * 60 + F.expr("(3000 * target * (id % 3)) div 3") + (cents * x + k * y) % 1500).cast("double") / 10000 for m, (x, y) in MODELS.items()},
    })
    return a.drop("_c", "_base")


def _duck() -> str:
    flags = ",\n    ".join(
        [f"CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN (c // {d}) % 2 = 0 THEN 'Yes' ELSE 'No' END AS {s}" for s, d in SERVICE_DIVISORS.items()]
        + [f"CASE WHEN (c // {d}) % 2 = 0 THEN {FLAG_VALUES[f][0]} ELSE {FLAG_VALUES[f][1]} END AS {f}" for f, d in FLAG_DIVISORS.items()]
    )
    preds = ",\n    ".join(f"cast(100 + base * 60 + (3000 * target * (id % 3)) // 3 + (c * {x} + id * {y}) % 1500 AS DOUBLE) / 10000 AS pred_{m}" for m, (x, y) in MODELS.items())
    return f"""accounts0 AS (
  SELECT o_orderkey AS id, cast(round(o_totalprice * 100) AS BIGINT) AS c,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Electronic check' WHEN o_orderpriority = '3-MEDIUM' THEN 'Mailed check' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Bank transfer (automatic)' WHEN o_orderpriority = '5-LOW' THEN 'Credit card (automatic)' END AS PaymentMethod,
    CASE o_orderstatus WHEN 'P' THEN 'Month-to-month' WHEN 'F' THEN 'One year' WHEN 'O' THEN 'Two year' END AS Contract,
    CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'Fiber optic' WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'DSL' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'No' END AS InternetService
  FROM orders JOIN customer ON o_custkey = c_custkey
), accounts1 AS (
  SELECT *, CASE WHEN c % 10 < 6 THEN 'Yes' ELSE 'No' END AS PaperlessBilling, cast(1 + id % 72 AS INTEGER) AS tenure, cast(1825 + c % 10051 AS DOUBLE) / 100 AS MonthlyCharges,
    CASE WHEN PaymentMethod = 'Electronic check' AND Contract = 'Month-to-month' AND InternetService = 'Fiber optic' THEN 61 WHEN Contract = 'Month-to-month' THEN 30 WHEN Contract = 'One year' THEN 10 ELSE 4 END AS base
  FROM accounts0
), accounts2 AS (
  SELECT *, CASE WHEN (c * 31 + id * 17) % 100 < base THEN 1 ELSE 0 END AS target,
    CASE WHEN id % 997 = 0 THEN NULL ELSE cast((1825 + c % 10051) * tenure + c % 2001 AS DOUBLE) / 100 END AS TotalCharges,
    {flags}
  FROM accounts1
), accounts AS (
  SELECT * EXCLUDE (c, base), CASE WHEN target = 1 THEN 'Yes' ELSE 'No' END AS Churn, CASE WHEN id % 5 = 4 THEN 'test' ELSE 'train' END AS split,
    {preds}
  FROM accounts2
)"""


#: The same projection as DuckDB common table expressions, for the oracles; the last is called accounts.
DUCK = _duck()


def blend_sql(weights: dict[str, float] = REFERENCE_WEIGHTS) -> str:
    """A weighted sum of predictions, added in order."""
    return " + ".join(f"cast({w} AS DOUBLE) * pred_{m}" for m, w in weights.items())
