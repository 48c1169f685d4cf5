"""The compass of generalisation: how much worse a family is predicted by a model that has seen none of its rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import auc, logloss
from ..operators import trees as T


def reference_families(train: DataFrame, test: DataFrame, family: str, reference: str = "reference_pred", target: str = "target") -> DataFrame:
    """family, train_rows, test_rows, positive_rate and the reference's AUC, log loss and share of the whole loss. A null
    family is a family by its name 'nan'."""
    name = F.coalesce(F.col(family).cast("string"), F.lit("nan")).alias("family")
    rows = train.select(name, F.col(target).alias("y"), F.col(reference).alias("p"), logloss(target, reference).alias("loss"))
    table = rows.groupBy("family").agg(F.count("*").alias("train_rows"), F.avg("y").alias("positive_rate"), F.avg("loss").alias("reference_logloss"))
    counts = test.select(name).groupBy("family").agg(F.count("*").alias("test_rows"))
    table = table.join(auc(rows, ["family"], "y", "p", "reference_auc"), "family", "left").join(counts, "family", "left")
    total = train.agg(F.count("*").alias("all_rows"))
    table = table.crossJoin(F.broadcast(total))  # one row
    share = F.col("reference_logloss") * F.col("train_rows") / F.col("all_rows")
    return table.withColumns({"test_rows": F.coalesce("test_rows", F.lit(0)), "reference_contribution": share})


def left_out(train: DataFrame, family: str, families: list[str], binned: T.Binning, options: T.Options, id_column: str = "id", target: str = "target") -> T.Boosted:
    """Models that have each seen all rows but one family's, fitted together: a level of all their trees is one aggregate over
    the rows. Each is equal to a fit by itself, as sums of gradients are exact. Rows of other families are in all of them."""
    spark = train.sparkSession
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(families)), "fold int, _family string"))
    name = F.coalesce(F.col(family).cast("string"), F.lit("nan"))
    rows = train.drop("fold").join(numbers, name == F.col("_family"), "left").withColumn("fold", F.coalesce("fold", F.lit(-1))).drop("_family")
    return T.fit(rows, binned, replace(options, patience=0), models=len(families), id_column=id_column, target=target, fold="fold")


def compass(
    train: DataFrame, test: DataFrame, family: str, binned: T.Binning, options: T.Options, *, top: int, min_train: int = 1, min_test: int = 0, reference: str = "reference_pred",
    id_column: str = "id", target: str = "target",
) -> DataFrame:
    """reference_families of the `top` families with enough rows that have the largest share of the reference's loss, with
    lofo_auc and lofo_logloss of models that haven't seen them, and the gaps: gap_auc, gap_logloss and its share
    gap_contribution. A family of one class has no AUC; without any family that is large enough there are no rows."""
    table = reference_families(train, test, family, reference, target)
    chosen = table.filter((F.col("train_rows") >= min_train) & (F.col("test_rows") >= min_test))
    names = [r.family for r in chosen.orderBy(F.desc("reference_contribution"), F.desc("train_rows"), "family").limit(top).select("family").collect()]
    if not names:
        empty = table.limit(0)
        return empty.withColumns({c: F.lit(None).cast("double") for c in ("lofo_auc", "lofo_logloss", "gap_auc", "gap_logloss", "gap_contribution")})
    model = left_out(train, family, names, binned, options, id_column, target)
    scored = model.out_of_fold("p").filter("fold >= 0").select("fold", F.col("target").alias("y"), "p", logloss("target", "p").alias("loss"))
    losses = scored.groupBy("fold").agg(F.avg("loss").alias("lofo_logloss"))
    of = F.broadcast(train.sparkSession.createDataFrame(list(enumerate(names)), "fold int, family string"))
    lofo = losses.join(auc(scored, ["fold"], "y", "p", "lofo_auc"), "fold", "left").join(of, "fold").drop("fold")
    out = table.join(F.broadcast(lofo), "family")
    out = out.withColumns({"gap_auc": F.col("reference_auc") - F.col("lofo_auc"), "gap_logloss": F.col("lofo_logloss") - F.col("reference_logloss")})
    return out.withColumn("gap_contribution", F.col("gap_logloss") * F.col("train_rows") / F.col("all_rows"))
