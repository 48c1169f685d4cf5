"""Operators with a fitted state: fit() aggregates training rows into small tables, apply() joins them to any rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.metrics import quantiles
from ..schema import staged, text
from .blocks import _T0, MACRO, SURFACE, VALUE_PRIMITIVES, _flag


@dataclass
class CoverageBackoff:
    """Rows of each detailed and parent family in training rows."""

    min_rows: int = 75
    counts3: DataFrame | None = None
    counts5: DataFrame | None = None

    def fit(self, df: DataFrame) -> CoverageBackoff:
        keyed = df.select(F.expr(K.segment3()).alias("segment3_family"), F.expr(K.segment5()).alias("segment5_family"))
        by5 = keyed.groupBy("segment3_family", "segment5_family").agg(F.count("*").alias("segment5_train_rows"))
        self.counts5 = by5.drop("segment3_family")
        self.counts3 = by5.groupBy("segment3_family").agg(F.sum("segment5_train_rows").alias("segment3_train_rows"))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        out = staged(df, [{"segment3_family": K.segment3(), "segment5_family": K.segment5()}])
        out = out.join(self.counts3, "segment3_family", "left").join(self.counts5, "segment5_family", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("segment3_train_rows", "segment5_train_rows")})
        return staged(out, [{
            "segment5_seen_in_fit": _flag("segment5_train_rows > 0"), "segment5_low_support_in_fit": _flag(f"segment5_train_rows < {self.min_rows}"),
            "segment5_backoff_to_segment3": _flag(f"segment5_train_rows < {self.min_rows}"), "segment5_share_within_segment3": "cast(segment5_train_rows AS DOUBLE) / greatest(segment3_train_rows, 1)",
            "segment3_support_bucket": K.support_bucket("segment3_train_rows"), "segment5_support_bucket": K.support_bucket("segment5_train_rows"),
            "segment5_backoff_family": f"CASE WHEN segment5_train_rows >= {self.min_rows} THEN segment5_family ELSE 'BACKOFF__' || segment3_family END",
        }])


LEVELS = ("detail", "coarse", "paperless")
SURFACE_STAGES = [
    *VALUE_PRIMITIVES,
    {"_macro": _flag(MACRO), "_paper": text("PaperlessBilling"), "_fine": K.fine_tenure_bin(_T0), "_wide": K.tenure_bin(_T0)},
    {"_detail_key": "_paper || '__' || _fine", "_coarse_key": "_paper || '__' || _wide", "_paperless_key": "_paper"},
]


def _edges_passed(edges: Column, value: Column) -> Column:
    """How many of the edges are at or below a value."""
    return F.aggregate(edges, F.lit(0), lambda n, e: n + (e <= value).cast("int"))


@dataclass
class SurfaceProfiles:
    """Rows, medians and deciles of the dominant family's measures at three levels, of training rows."""

    min_detailed: int = 75
    min_coarse: int = 75
    profiles: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> SurfaceProfiles:
        """All three levels in one pass over the family: each row counts for three keys."""
        base = staged(df, SURFACE_STAGES, True).filter("_macro = 1")
        levels = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"_{x}_key").alias("key")) for x in LEVELS])).alias("k")
        cells = F.array(F.struct(F.lit("").alias("c"), F.lit(0.0).alias("x")), *[F.struct(F.lit(p).alias("c"), F.col(c).cast("double").alias("x")) for c, p in SURFACE])
        each = base.select(levels, cells.alias("cells")).select("k.*", F.explode("cells").alias("s")).select("level", "key", "s.*")
        counts = saved(each.groupBy("level", "key", "c", "x").agg(F.count("*").alias("n")))
        sizes = counts.filter("c = ''").groupBy("level", "key").agg(F.sum("n").alias("rows"))
        deciles = {f"e{i}": i / 10 for i in range(1, 10)}
        found = quantiles(counts.filter("c <> ''"), ["level", "key", "c"], "x", {"med": 0.5, **deciles}, n="n")
        edges = F.array_distinct(F.array(*deciles))
        of = lambda column, p: F.max(F.when(F.col("c") == p, column))
        measures = [e for _, p in SURFACE for e in (of(F.col("med"), p).alias(f"med_{p}"), of(edges, p).alias(f"edges_{p}"))]
        table = sizes.join(found.groupBy("level", "key").agg(*measures), ["level", "key"], "left")
        self.profiles = {x: table.filter(F.col("level") == x).drop("level") for x in LEVELS}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """Every row's columns; of the first level with enough rows for the family, defaults for others."""
        out = staged(df, SURFACE_STAGES, True)
        for x in LEVELS:
            p = self.profiles[x].select(F.col("key").alias(f"_{x}_key"), F.struct(*[c for c in self.profiles[x].columns if c != "key"]).alias(f"_{x}"))
            out = out.join(p, f"_{x}_key", "left")
        detailed = F.coalesce(F.col("_detail.rows"), F.lit(0)) >= self.min_detailed
        coarse = F.coalesce(F.col("_coarse.rows"), F.lit(0)) >= self.min_coarse
        level = F.when(detailed, "detail").when(coarse, "coarse").otherwise("paperless")
        chosen = F.when(detailed, F.col("_detail")).when(coarse, F.col("_coarse")).otherwise(F.col("_paperless"))
        out = out.withColumns({"_level": level, "_p": chosen})
        family = F.col("_macro") == 1
        fitted = family & F.col("_p").isNotNull()
        when = lambda value, default: F.when(fitted, value).otherwise(F.lit(default))
        segment = F.concat(F.col("_level"), F.lit("__"), F.when(F.col("_level") == "detail", F.col("_detail_key")).when(F.col("_level") == "coarse", F.col("_coarse_key")).otherwise(F.col("_paperless_key")))
        rows = when(F.col("_p.rows"), 0)
        name = lambda c: f"ec_surface_fit_{c}"
        columns = {
            name("is_family"): F.col("_macro"), name("is_paperless_family"): F.expr(_flag("_macro = 1 AND _paper = 'Yes'")), name("level"): when(F.col("_level"), "other"), name("segment"): when(segment, "other"), name("rows"): rows,
            name("used_coarse"): when((F.col("_level") == "coarse").cast("int"), 0), name("used_paperless"): when((F.col("_level") == "paperless").cast("int"), 0),
        }
        for c, p in SURFACE:
            columns[name(f"{p}_minus_train_median")] = when(F.col(c) - F.col(f"_p.med_{p}"), 0.0)
            if p not in ("paid", "support"):
                edges = F.col(f"_p.edges_{p}")
                columns[name(f"{p}_rank_fit")] = when((_edges_passed(edges, F.col(c)) + 0.5).cast("double") / (F.size(edges) + 1), 0.5)
        columns[name("monthly_over_train_median")] = when(F.col("_mc") / F.greatest(F.col("_p.med_monthly"), F.lit(1.0)), 1.0)
        out = out.withColumns(columns)
        out = out.withColumn(name("pressure_x_support_deficit"), when(F.col(name("monthly_over_train_median")) * F.col("support_deficit_count"), 0.0))
        out = out.withColumn(name("support_bucket"), F.expr(K.support_bucket(name("rows"))))
        return out.select(*df.columns, *[c for c in out.columns if c.startswith("ec_surface_fit_")])
