"""Checks that training rows, test rows and a submission fit together: columns, order, types, categories, ids, range and
correlation with a reference submission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import categorical_columns

#: Fixed value: a submission correlates with the reference at least so much.
MIN_CORRELATION = 0.95


def _capped(names: Sequence[str], most: int = 20) -> str:
    return ",".join(sorted(names)[:most])


def column_checks(train: DataFrame, test: DataFrame, prepared_train: DataFrame, prepared_test: DataFrame, target: str, blocks: Sequence[str] = (), metrics: dict | None = None) -> list[tuple[str, str, str]]:
    """(check, status, detail) of the columns of raw and prepared tables, and of what a metrics file says of them. Nothing of
    the rows is read. A check of the metrics warns if there is no file, or no such entry in it."""
    raw, other = {c for c in train.columns if c != target}, set(test.columns)
    mine, theirs = prepared_train.columns, prepared_test.columns
    kinds, kinds_too = dict(prepared_train.dtypes), dict(prepared_test.dtypes)
    changed = [c for c in mine if c in kinds_too and kinds[c] != kinds_too[c]]
    words, words_too = set(categorical_columns(prepared_train)), set(categorical_columns(prepared_test))
    fails = lambda bad, how="FAIL": how if bad else "PASS"
    out = [
        ("raw_columns_train_vs_test", fails(raw ^ other), _capped(raw ^ other)),
        ("engineered_columns_set_match", fails(set(mine) ^ set(theirs)), _capped(set(mine) ^ set(theirs))),
        ("engineered_columns_order_match", fails(mine != theirs), ""),
        ("engineered_dtype_match", fails(changed, "WARN"), _capped(changed)),
        ("categorical_columns_match", fails(words ^ words_too, "WARN"), _capped(words ^ words_too)),
        ("metrics_file_presence", fails(metrics is None, "WARN"), ""),
    ]
    if metrics is not None:
        said, count = metrics.get("feature_blocks"), metrics.get("feature_count")
        known = isinstance(said, list)
        out.append(("metrics_feature_blocks_match", "WARN" if not known and (said is not None or blocks) else fails(known and said != list(blocks)), ""))
        out.append(("metrics_feature_count_match", "WARN" if not isinstance(count, int) else fails(count != len(mine)), str(count)))
    return out


def submission_checks(test: DataFrame, submission: DataFrame, reference: DataFrame | None = None, id_column: str = "id", prediction: str = "Churn") -> DataFrame:
    """check, status, value of a submission: rows as many as test rows, ids that only one of both has or that repeat, the
    share of predictions within 0 and 1, and the correlation with a reference submission; all from one join by id.

    A null prediction is out of range; without a reference that check warns, as it does if there is no correlation."""
    ids = test.select(F.col(id_column).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    own = submission.select(F.col(id_column).alias("id"), F.col(prediction).cast("double").alias("p")).groupBy("id").agg(F.count("*").alias("s"), F.sum(F.coalesce(F.col("p").between(0, 1), F.lit(False)).cast("int")).alias("within"), F.max("p").alias("p"))
    both = ids.join(own, "id", "full")
    if reference is not None:
        both = both.join(reference.select(F.col(id_column).alias("id"), F.col(prediction).cast("double").alias("r")).groupBy("id").agg(F.max("r").alias("r")), "id", "left")
    else:
        both = both.withColumn("r", F.lit(None).cast("double"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    row = both.agg(
        (n("s") - n("t")).alias("rows"), n((~F.coalesce((F.col("s") == 1) & (F.col("t") == 1), F.lit(False))).cast("int")).alias("ids"),
        (n("s") - n("within")).alias("range"), F.corr("p", "r").alias("correlation"),
    )
    check = lambda name, ok, bad, value: F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(bad).alias("status"), F.col(value).cast("double").alias("value"))
    checks: list[Column] = [
        check("submission_row_count_match_test", F.col("rows") == 0, "FAIL", "rows"), check("submission_ids_match_test", F.col("ids") == 0, "FAIL", "ids"),
        check("submission_prediction_range", F.col("range") == 0, "WARN", "range"), check("reference_correlation", F.col("correlation") >= MIN_CORRELATION, "WARN", "correlation"),
    ]
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
