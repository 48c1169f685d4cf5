"""How a reference holds against several challengers: by family, by slices of the scores, and in patterns over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions import keys as K
from ..functions.metrics import auc, logloss, quantiles
from ..operators.select import DOMINANT

# Edges of the slices of confidence and of disagreement.
CONFIDENCE = (0.0, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50)
DISAGREEMENT = (0.0, 0.005, 0.01, 0.02, 0.05, 0.10, 1.0)
SLICES = {"score": "score_decile", "confidence": "confidence_bucket", "disagreement": "disagreement_bucket"}


def edge_bucket(x: Column, edges: Column, prefix: str) -> Column:
    """prefix_00 for the first bin, and so on. Bins end with their upper edge, the first holds its lower edge too; what
    lies outside, or is missing, is __missing__. edges: an array, whose repeats don't count."""
    e = F.array_sort(F.array_distinct(edges))
    below = F.size(F.filter(e, lambda v: v < x))
    n = F.when(x == e[0], 1).otherwise(below)
    return F.when((x >= e[0]) & (x <= F.element_at(e, -1)), F.concat(F.lit(f"{prefix}_"), F.lpad((n - 1).cast("string"), 2, "0"))).otherwise("__missing__")


def challenges(df: DataFrame, challengers: Mapping[str, str], y: str = "target", reference: str = "reference_pred") -> DataFrame:
    """A row for each account and challenger (name: prediction's column), with families, both losses and the slices."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("challenger"), F.col(c).alias("_p")) for n, c in challengers.items()]))
    keyed = df.withColumns({"segment3": F.expr(K.segment3()), "segment5": F.expr(K.segment5()), "reference_pred": F.expr(K.clip(reference))})
    named = {f"_q{i:02d}": i / 10 for i in range(1, 10)}
    deciles = quantiles(keyed, [], "reference_pred", named).select(F.array(F.lit(0.0), *named, F.lit(1.0)).alias("_edges"))
    rows = keyed.select(F.col(y).alias("target"), "segment3", "segment5", "reference_pred", each.alias("c")).select("target", "segment3", "segment5", "reference_pred", "c.challenger", F.expr(K.clip("c._p")).alias("candidate_pred"))
    rows = rows.withColumns({"reference_loss": logloss("target", "reference_pred"), "candidate_loss": logloss("target", "candidate_pred")})
    p = F.col("reference_pred")
    return rows.crossJoin(F.broadcast(deciles)).withColumns({
        "score_decile": edge_bucket(p, F.col("_edges"), "score"), "confidence_bucket": edge_bucket(F.abs(p - 0.5), F.array(*map(F.lit, CONFIDENCE)), "confidence"),
        "disagreement_bucket": edge_bucket(F.abs(F.col("candidate_pred") - p), F.array(*map(F.lit, DISAGREEMENT)), "disagreement"),
    }).drop("_edges")


def deltas(rows: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """challenger, level, value and both sides' metrics of each group; a tie is the reference's win."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("value")) for x in levels]))
    each = rows.select("challenger", cells.alias("g"), "target", "reference_pred", "candidate_pred", "reference_loss", "candidate_loss").select("challenger", "g.*", "target", "reference_pred", "candidate_pred", "reference_loss", "candidate_loss")
    by = ["challenger", "level", "value"]
    table = each.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("reference_loss").alias("reference_logloss"), F.avg("candidate_loss").alias("candidate_logloss"))
    for side in ("reference", "candidate"):
        table = table.join(auc(each, by, "target", f"{side}_pred", f"{side}_auc"), by)
    totals = rows.groupBy("challenger").agg(F.count("*").alias("_all"))
    table = table.join(F.broadcast(totals), "challenger")  # a row for each challenger
    table = table.withColumns({"delta_auc": F.col("candidate_auc") - F.col("reference_auc"), "delta_logloss": F.col("candidate_logloss") - F.col("reference_logloss")})
    return table.withColumns({
        "delta_contribution": F.col("delta_logloss") * F.col("rows") / F.col("_all"),
        "reference_wins_auc": F.coalesce(F.col("reference_auc") >= F.col("candidate_auc"), F.lit(False)), "reference_wins_logloss": F.col("reference_logloss") <= F.col("candidate_logloss"),
    }).drop("_all")


def summaries(rows: DataFrame, families: DataFrame, dominant: str = DOMINANT) -> DataFrame:
    """One row for each challenger: global differences, correlation, the dominant family's differences and the shares of
    families in which the reference wins."""
    by = ["challenger"]
    out = rows.groupBy(*by).agg((F.avg("candidate_loss") - F.avg("reference_loss")).alias("delta_logloss"), F.corr("reference_pred", "candidate_pred").alias("pearson"), F.avg(F.abs(F.col("candidate_pred") - F.col("reference_pred"))).alias("mean_abs_diff"))
    both = auc(rows, by, "target", "candidate_pred", "_c").join(auc(rows, by, "target", "reference_pred", "_r"), by)
    out = out.join(both.select("challenger", (F.col("_c") - F.col("_r")).alias("delta_auc")), by)
    of = lambda level, c: F.avg(F.when(F.col("level") == level, F.col(c).cast("double")))
    at = (F.col("level") == "segment3") & (F.col("value") == dominant)
    wins = [of(x, f"reference_wins_{m}").alias(f"{x}_{m}_win_rate") for x in ("segment3", "segment5") for m in ("auc", "logloss")]
    return out.join(families.groupBy(*by).agg(F.max(F.when(at, F.col("delta_auc"))).alias("dominant_delta_auc"), F.max(F.when(at, F.col("delta_logloss"))).alias("dominant_delta_logloss"), *wins), by)


def patterns(slices: DataFrame, top: int = 5) -> DataFrame:
    """Of the slices of confidence and of disagreement, the `top` ones with the highest mean difference of losses over the
    challengers, with these's number and rows."""
    found = slices.filter(F.col("level").isin(SLICES["confidence"], SLICES["disagreement"]))
    table = found.groupBy("level", "value").agg(F.avg("delta_logloss").alias("mean_delta_logloss"), F.count_distinct("challenger").alias("challengers"), F.sum("rows").alias("support_rows"))
    order = Window.partitionBy("level").orderBy(F.desc("mean_delta_logloss"), F.desc("support_rows"), "value")
    return table.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)  # a dozen slices


def verdict(summary: DataFrame, slices: DataFrame) -> DataFrame:
    """One row: whether the dominant family is the reference's everywhere, and in 80% of the challenges; whether all
    challengers lose where the reference is unsure, where they disagree with it, and overall; and what follows."""
    low = [f"confidence_{i:02d}" for i in range(3)]
    high = [f"disagreement_{i:02d}" for i in range(3, 6)]
    worse = lambda values: slices.filter(F.col("value").isin(*values)).groupBy("challenger").agg(F.avg("delta_logloss").alias("d")).agg(F.coalesce(F.min((F.col("d") > 0).cast("int")), F.lit(0)).alias("w"))
    share = F.avg((F.col("dominant_delta_logloss") > 0).cast("double"))
    base = summary.agg((share == 1).alias("dominant_always"), (share >= 0.8).alias("dominant_mostly"), (F.min((F.col("delta_logloss") > 0).cast("int")) == 1).alias("global_always"))
    out = base.crossJoin(worse(low).select((F.col("w") == 1).alias("unsure_worse"))).crossJoin(worse(high).select((F.col("w") == 1).alias("disagreement_worse")))  # one row each
    next_step = F.when(F.col("dominant_mostly") & F.col("unsure_worse") & F.col("disagreement_worse"), "unsure_band_of_dominant_family").when(F.col("dominant_always") & F.col("global_always"), "explain_reference").otherwise("review_slices")
    return out.withColumn("recommendation", next_step)


def diagnostic(df: DataFrame, challengers: Mapping[str, str]) -> dict[str, DataFrame]:
    """All tables: challengers, families, slices, patterns, verdict."""
    rows = saved(challenges(df, challengers))  # six narrow columns, read by all that follow
    families, slices = saved(deltas(rows, ("segment3", "segment5"))), saved(deltas(rows, tuple(SLICES.values())))  # read by what follows; a row for each group
    summary = saved(summaries(rows, families))
    return {"challengers": summary, "families": families, "slices": slices, "patterns": patterns(slices), "verdict": verdict(summary, slices)}
