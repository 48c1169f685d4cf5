"""Target encodings: a hierarchy of smoothed priors, and fold-safe encodings without a loop over folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..schema import SERVICES, staged


@dataclass(frozen=True)
class PriorSpec:
    name: str
    columns: tuple[str, ...]
    min_support: int
    alpha: float


#: The default hierarchy, from coarse to fine.
DEFAULT_SPECS = (
    PriorSpec("contract", ("Contract",), 1, 300.0),
    PriorSpec("contract_internet", ("Contract", "InternetService"), 20, 120.0),
    PriorSpec("segment3", K.SEGMENT3, 30, 60.0),
    PriorSpec("segment4_tenure", (*K.SEGMENT3, "_prior_bin"), 50, 35.0),
    PriorSpec("segment5_paperless", (*K.SEGMENT3, "PaperlessBilling", "_prior_bin"), 80, 25.0),
)
NUMERIC = ("tenure", "MonthlyCharges", "TotalCharges", "_monthly_per_tenure", "_addons")
FRAME = [
    {
        "_prior_bin": f"CASE WHEN {K.number('tenure')} IS NULL THEN '__MISSING__' ELSE {K.tenure_bin()} END",
        "_monthly_per_tenure": f"{K.filled('MonthlyCharges')} / coalesce(greatest({K.number('tenure')}, 1e0), 1e0)", "_addons": f"cast({K.count_yes(SERVICES)} AS DOUBLE)",
    }
]


@dataclass
class TargetPriors:
    """fit() aggregates sums and counts by group in one pass over the rows for each level; apply() joins them."""

    specs: Sequence[PriorSpec] = DEFAULT_SPECS
    numeric: Sequence[str] = NUMERIC
    tables: dict[str, DataFrame] = field(default_factory=dict)
    totals: DataFrame | None = None

    def fit(self, df: DataFrame, target: str = "target") -> TargetPriors:
        base = staged(df, FRAME, True)
        means = [F.avg(F.expr(K.number(c))).alias(f"_g_{c}") for c in self.numeric]
        self.totals = base.agg(F.avg(target).alias("_g"), *means)
        base = base.crossJoin(F.broadcast(self.totals))  # one row
        for s in self.specs:
            sums = [F.sum(F.coalesce(F.expr(K.number(c)), f"_g_{c}")).alias(f"_{s.name}_{c}") for c in self.numeric]
            keyed = base.withColumn(f"_key_{s.name}", F.expr(K.key(*s.columns)))
            self.tables[s.name] = keyed.groupBy(f"_key_{s.name}").agg(F.sum(target).alias(f"_sum_{s.name}"), F.count(target).alias(f"_n_{s.name}"), *sums)
        return self

    def apply(self, df: DataFrame, deviations: bool = True) -> DataFrame:
        """Posterior, logit, support and low-support flag of each level; the finest level with enough support; and
        how numbers differ from that level's smoothed means."""
        out = staged(df, FRAME, True).withColumns({f"_key_{s.name}": F.expr(K.key(*s.columns)) for s in self.specs})
        for s in self.specs:
            out = out.join(self.tables[s.name], f"_key_{s.name}", "left")
        out = out.crossJoin(F.broadcast(self.totals))
        columns = {"prior_global": F.col("_g"), "prior_global_logit": F.expr(K.logit("_g"))}
        for s in self.specs:
            posterior = f"(coalesce(_sum_{s.name}, 0) + {s.alpha}D * _g) / (coalesce(_n_{s.name}, 0) + {s.alpha}D)"
            columns |= {
                f"prior_{s.name}": F.expr(posterior), f"prior_logit_{s.name}": F.expr(K.logit(f"({posterior})")), f"support_{s.name}": F.coalesce(f"_n_{s.name}", F.lit(0)),
                f"is_low_support_{s.name}": (F.coalesce(f"_n_{s.name}", F.lit(0)) < s.min_support).cast("int"),
            }
        out = out.withColumns(columns)
        finest = lambda value, default: F.coalesce(*[F.when(F.col(f"support_{s.name}") >= s.min_support, value(s)) for s in reversed(self.specs)], default)
        level = {s.name: i + 1 for i, s in enumerate(self.specs)}
        out = out.withColumns({
            "prior_hier": finest(lambda s: F.col(f"prior_{s.name}"), F.col("_g")), "prior_hier_support": finest(lambda s: F.col(f"support_{s.name}"), F.lit(0)),
            "prior_hier_source": finest(lambda s: F.lit(s.name), F.lit("global")), "prior_hier_level": finest(lambda s: F.lit(level[s.name]), F.lit(0)),
        }).withColumns({"prior_hier_logit": F.expr(K.logit("prior_hier")), "prior_hier_is_global": (F.col("prior_hier_source") == "global").cast("int")})
        made = [c for c in out.columns if c.startswith(("prior_", "support_", "is_low_support_"))]
        if deviations:
            for c in self.numeric:
                name = c.lstrip("_")
                mean = finest(lambda s, c=c: (F.coalesce(F.col(f"_{s.name}_{c}"), F.lit(0.0)) + F.lit(s.alpha) * F.col(f"_g_{c}")) / (F.coalesce(f"_n_{s.name}", F.lit(0)) + F.lit(s.alpha)), F.col(f"_g_{c}"))
                out = out.withColumn(f"cohort_mean_{name}", mean)
                out = out.withColumn(f"cohort_delta_{name}", F.coalesce(F.expr(K.number(c)), f"_g_{c}") - F.col(f"cohort_mean_{name}"))
                out = out.withColumn(f"cohort_rel_{name}", F.col(f"cohort_delta_{name}") / (F.abs(f"cohort_mean_{name}") + 1))
                made += [f"cohort_{k}_{name}" for k in ("mean", "delta", "rel")]
        return out.select(*df.columns, *made)


def save_priors(fitted: TargetPriors, path: str) -> None:
    """A fitted encoder as tables: one of each level's groups and one of the totals, with the levels' definitions."""
    session = fitted.totals.sparkSession
    specs = [(i, s.name, list(s.columns), s.min_support, float(s.alpha), list(fitted.numeric)) for i, s in enumerate(fitted.specs)]
    session.createDataFrame(specs, "place int, name string, columns array<string>, min_support int, alpha double, numeric array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/specs")
    fitted.totals.write.mode("overwrite").parquet(f"{path}/totals")
    for s in fitted.specs:
        fitted.tables[s.name].write.mode("overwrite").parquet(f"{path}/level={s.name}")


def load_priors(spark, path: str) -> TargetPriors:  # noqa: ANN001
    """The encoder that save_priors has written."""
    rows = spark.read.parquet(f"{path}/specs").orderBy("place").collect()  # one for each level
    specs = tuple(PriorSpec(r["name"], tuple(r["columns"]), r["min_support"], r["alpha"]) for r in rows)
    return TargetPriors(specs, tuple(rows[0]["numeric"]), {s.name: spark.read.parquet(f"{path}/level={s.name}") for s in specs}, spark.read.parquet(f"{path}/totals"))


def with_priors(df: DataFrame, fitted: TargetPriors, mode: str = "raw_plus_priors", keep: Sequence[str] = ("id", "target")) -> DataFrame:
    """df with the encoder's columns, or with mode='priors_only' these and the kept columns alone."""
    if mode not in ("raw_plus_priors", "priors_only"):
        raise ValueError(f"Unknown mode {mode!r}")
    out = fitted.apply(df)
    return out if mode == "raw_plus_priors" else out.select(*[c for c in keep if c in df.columns], *[c for c in out.columns if c not in df.columns])


def fold_safe_encoding(df: DataFrame, columns: Sequence[str], target: str = "target", fold: str = "fold", alpha: float = 10.0, external: DataFrame | None = None) -> DataFrame:
    """TE_<column> and TE_COUNT_<column>: each row's value's smoothed mean target, and log of one plus its rows, without
    the rows of its own fold; external rows (same columns and target) count in every fold.

    All columns and folds come from one aggregate by column, value and fold, by subtraction."""
    cells = lambda d, f: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v")) for c in columns])).alias("x"), f.alias("f"), F.col(target).cast("double").alias("y")).select("x.c", "x.v", "f", "y")
    all_rows = cells(df, F.col(fold).cast("int"))
    if external is not None:
        all_rows = all_rows.unionByName(cells(external, F.lit(-1)))
    by_fold = all_rows.groupBy("c", "v", "f").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    total = by_fold.groupBy("c", "v").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    prior_fold = by_fold.groupBy("c", "f").agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"))
    prior = prior_fold.groupBy("c").agg(F.sum("ps").alias("as"), F.sum("pn").alias("an"))
    left = by_fold.filter("f >= 0").join(total, ["c", "v"]).join(prior_fold, ["c", "f"]).join(prior, "c")
    left = left.withColumns({"s": F.col("ts") - F.col("s"), "n": F.col("tn") - F.col("n"), "p": (F.col("as") - F.col("ps")) / F.nullif(F.col("an") - F.col("pn"), F.lit(0))})
    made = left.select("c", "v", "f", F.when(F.col("n") > 0, (F.col("s") + F.col("p") * alpha) / (F.col("n") + alpha)).otherwise(F.col("p")).alias("te"), F.log1p(F.col("n").cast("double")).alias("cnt"))
    out = df
    for c in columns:
        own = made.filter(F.col("c") == c).select(F.col("v").alias(f"_v_{c}"), F.col("f").alias("_f"), F.col("te").alias(f"TE_{c}"), F.col("cnt").alias(f"TE_COUNT_{c}"))
        out = out.join(own, (F.coalesce(out[c].cast("string"), F.lit("nan")) == F.col(f"_v_{c}")) & (out[fold] == F.col("_f")), "left").drop(f"_v_{c}", "_f")
    return out


def full_encoding(df: DataFrame, fitted_on: DataFrame, column: str, target: str = "target", alpha: float = 10.0) -> DataFrame:
    """The same for rows outside the fit: over all fit rows; a value that isn't there gets the prior and 0."""
    table = fitted_on.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("_v")).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    prior = fitted_on.agg(F.avg(target).alias("_p"))
    out = df.join(table, F.coalesce(F.col(column).cast("string"), F.lit("nan")) == F.col("_v"), "left").crossJoin(F.broadcast(prior))
    te = F.when(F.col("_n").isNotNull(), (F.col("_s") + F.col("_p") * alpha) / (F.col("_n") + alpha)).otherwise(F.col("_p"))
    return out.withColumns({f"TE_{column}": te, f"TE_COUNT_{column}": F.log1p(F.coalesce("_n", F.lit(0)).cast("double"))}).drop("_v", "_s", "_n", "_p")


def smoothed_means(df: DataFrame, columns: Sequence[str], target: str = "target", alpha: float = 10.0) -> DataFrame:
    """name, value, rows, smooth of every value of the columns (given as name: SQL expression pairs or names)."""
    items = columns.items() if isinstance(columns, dict) else [(c, c) for c in columns]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("value")) for n, e in items])).alias("x"), F.col(target).cast("double").alias("y")).select("x.*", "y")
    table = cells.groupBy("name", "value").agg(F.count("y").alias("rows"), F.sum("y").alias("s"))
    prior = table.groupBy("name").agg((F.sum("s") / F.sum("rows")).alias("p"))
    return table.join(prior, "name").select("name", "value", "rows", ((F.col("s") + F.col("p") * alpha) / (F.col("rows") + alpha)).alias("smooth"), F.log1p(F.col("rows").cast("double")).alias("log_count"))


