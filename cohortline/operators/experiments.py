"""Experiments composed of learners: repeated and averaged models, specialists, rerankers, pseudo labels, external rows,
suspects, priors, neighbours, scenarios, adversarial validation and families left out. Their loops are over models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.metrics import auc, logloss
from . import audit, folds, graph, priors, scans, select
from . import blend as B
from . import learners as M


def multi_seed(df: DataFrame, n_folds: int, seeds: Sequence[int], make: Callable[[int], Callable[[int], Estimator]], name: str = "oof_pred", id_column: str = "id") -> DataFrame:
    """Each row's mean out-of-fold prediction over seeds; folds are dealt anew for each. make(seed) gives a fold's learner."""
    out = None
    for s in seeds:
        dealt = saved(folds.stratified_folds(df.drop("fold"), n_folds, s, id_column=id_column))  # read by every pass of every fit
        part = M.cross_validate(dealt, n_folds, make(s), "_p").select(id_column, "_p")
        out = part if out is None else out.unionByName(part)
    return df.join(out.groupBy(id_column).agg(F.avg("_p").alias(name)), id_column)


def ensemble_prediction(models: Sequence[PipelineModel], df: DataFrame, name: str = "prediction") -> DataFrame:
    """df with the mean of the models' probabilities; all models' columns are of one pass over the rows."""
    out, made = df, []
    for i, m in enumerate(models):
        out = M.positive(m.transform(out), f"_p{i}").select(*df.columns, *made, f"_p{i}")
        made.append(f"_p{i}")
    return out.withColumn(name, reduce(lambda a, b: a + b, map(F.col, made)) / len(made)).drop(*made)


def gated(df: DataFrame, n_folds: int, make: Callable[[int], Estimator], mask: Column, alphas: Sequence[float], reference: str = "reference_pred") -> DataFrame:
    """The scan of blends, on the mask, with a specialist that is fitted on the mask's rows of the other folds."""
    rows = df.withColumn("_mask", F.coalesce(mask, F.lit(False)))
    special = M.cross_validate(rows, n_folds, make, "_special", mask="_mask").select("id", "_special")
    return B.scan(rows.join(special, "id", "left"), alphas, B.override(F.col("_mask"), reference, "_special"))


def feature_challenger(df: DataFrame, n_folds: int, specialist: Callable[[int], Estimator], challenger: Callable[[int], Estimator], mask: Column) -> DataFrame:
    """Out-of-fold predictions of a challenger that sees a specialist's out-of-fold scores: stack_pred (one half outside its
    mask) and stack_available."""
    rows = df.withColumn("_mask", F.coalesce(mask, F.lit(False)))
    special = M.cross_validate(rows, n_folds, specialist, "_special", mask="_mask").select("id", "_special")
    stacked = rows.join(special, "id", "left").withColumns({"stack_pred": F.coalesce("_special", F.lit(0.5)), "stack_available": F.col("_mask").cast("int")}).drop("_special", "_mask")
    return M.cross_validate(saved(stacked), n_folds, challenger)  # read by every pass of every fit


def reranked(df: DataFrame, n_folds: int, make: Callable[[int], Estimator], mask: Column, alphas: Sequence[float], reference: str = "reference_pred") -> DataFrame:
    """The scan of corrections by a regression of the residual, fitted and applied on a mask: an uncertainty band, or hard
    examples. make's label is `residual`."""
    rows = df.withColumns({"_mask": F.coalesce(mask, F.lit(False)), "residual": F.col("target") - F.col(reference)})
    moved = M.cross_validate(rows, n_folds, make, "_move", mask="_mask").select("id", "_move")
    return B.scan(rows.join(moved, "id", "left").withColumn("_move", F.coalesce("_move", F.lit(0.0))), alphas, B.residual(F.col("_mask"), reference, "_move"))


def stability(df: DataFrame, n_folds: int, seeds: Sequence[int], make: Callable[[int], Callable[[int], Estimator]]) -> DataFrame:
    """For each row, over models of several seeds: mean, deviation, lowest, highest, range, share of votes for one half or
    more, flip and the score by which examples are hard."""
    out = None
    for s in seeds:
        dealt = saved(folds.stratified_folds(df.drop("fold"), n_folds, s))  # read by every pass of every fit
        part = M.cross_validate(dealt, n_folds, make(s), "_p").select("id", "_p")
        out = part if out is None else out.unionByName(part)
    table = out.groupBy("id").agg(F.avg("_p").alias("mean"), F.stddev_pop("_p").alias("std"), F.min("_p").alias("low"), F.max("_p").alias("high"), F.avg((F.col("_p") >= 0.5).cast("double")).alias("vote_share"))
    flip = F.least(F.col("vote_share"), 1 - F.col("vote_share"))
    return table.withColumns({"range": F.col("high") - F.col("low"), "flip": flip, "score": F.col("std") + flip})


def encoded_boosting(df: DataFrame, n_folds: int, columns: Mapping[str, str], numeric: Sequence[str], rounds: int = 8, external: DataFrame | None = None) -> DataFrame:
    """Out-of-fold predictions of boosted trees on fold-safe target encodings of n-grams (name: SQL expression); external
    rows without the signatures of own ones count in every encoding."""
    keyed = df.withColumns({n: F.expr(e) for n, e in columns.items()})
    more = None if external is None else external.withColumns({n: F.expr(e) for n, e in columns.items()})
    encoded = priors.fold_safe_encoding(keyed, list(columns), external=more)
    made = [f"{k}{n}" for n in columns for k in ("TE_", "TE_COUNT_")]
    ready = saved(encoded.fillna(0.0, made))  # read by every pass of every fit
    return M.cross_validate(ready, n_folds, M.boosted((), [*made, *numeric], rounds=rounds))


def splines(df: DataFrame, column: str, knots: Sequence[float]) -> tuple[DataFrame, list[str]]:
    """df with a cubic basis of truncated powers at the knots, scaled to the last one, and the columns' names."""
    x, top = F.col(column).cast("double"), float(knots[-1])
    basis = {f"{column}_s{i}": F.pow(F.greatest(x - float(k), F.lit(0.0)) / top, F.lit(3.0)) for i, k in enumerate(knots[:-1])} | {f"{column}_p{i}": F.pow(x / top, F.lit(float(i))) for i in (1, 2, 3)}
    return df.withColumns(basis), list(basis)


def meta_features(df: DataFrame, teachers: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Teachers' logits, their mean, deviation and range: what a meta-model sees."""
    stats = B.array_statistics(teachers)
    made = {f"logit_{t}": F.expr(f"ln(least(greatest({t}, 0.000001D), 0.999999D) / (1 - least(greatest({t}, 0.000001D), 0.999999D)))") for t in teachers} | {f"teacher_{n}": stats[n] for n in ("mean", "std", "range")}
    return df.withColumns(made), list(made)


def pseudo_sweep(labelled: DataFrame, unlabelled: DataFrame, valid: DataFrame, teachers: Sequence[str], make: Callable[[], Estimator], grid: Sequence[tuple[float, float, float]], family: Column, max_std: float | None = None) -> DataFrame:
    """upper, lower, weight, selected_rows, selected_accuracy, delta_global_auc, delta_family_auc for each configuration: a
    model of labelled and weighted pseudo-labelled rows against that of the labelled alone, on the valid rows. make's weight
    column is `weight`."""
    base_rows = labelled.withColumns({"label": F.col("target"), "weight": F.lit(1.0)})

    def scores(rows: DataFrame) -> tuple[float, float | None]:
        got = M.positive(make().fit(rows).transform(valid), "_s")
        of = lambda d: (auc(d, [], "target", "_s").first() or [None])[0]
        return of(got), of(got.filter(family))

    base, out = scores(base_rows), []
    for upper, lower, weight in grid:
        chosen = select.pseudo_rows(unlabelled, teachers, lower, upper, max_std)
        n, right = chosen.agg(F.count("*"), F.avg((F.col("pseudo_label") == F.col("target")).cast("double"))).first()
        added = select.training_rows(chosen, "pseudo_p", weight, soft=False, confidence=False)
        got = scores(base_rows.unionByName(added, allowMissingColumns=True)) if n else base
        out.append((upper, lower, weight, n, right, got[0] - base[0], None if got[1] is None or base[1] is None else got[1] - base[1]))
    return labelled.sparkSession.createDataFrame(out, "upper double, lower double, weight double, selected_rows long, selected_accuracy double, delta_global_auc double, delta_family_auc double")


def sweep_summary(results: DataFrame) -> DataFrame:
    """Over repeats of each configuration: their number, means and deviation, the best first."""
    by = ["upper", "lower", "weight"]
    table = results.groupBy(*by).agg(F.count("*").alias("repeats"), F.avg("delta_global_auc").alias("mean_delta_global_auc"), F.stddev_pop("delta_global_auc").alias("std_delta_global_auc"), F.avg("delta_family_auc").alias("mean_delta_family_auc"), F.avg("selected_rows").alias("mean_selected_rows"), F.avg("selected_accuracy").alias("mean_selected_accuracy"))
    return table.orderBy(F.desc_nulls_last("mean_delta_global_auc"), F.desc_nulls_last("mean_delta_family_auc"), F.desc_nulls_last("mean_selected_accuracy"), *by)


def joint_training(own: DataFrame, external: DataFrame, n_folds: int, make: Callable[[int], Estimator], signature: Column, weight: float, name: str = "oof_pred") -> DataFrame:
    """Out-of-fold predictions of own rows by models that also see, with a weight, the external rows whose signature no own
    row has. make's weight column is `sample_weight`."""
    more = audit.without_overlap(external, own, signature).withColumns({"sample_weight": F.lit(float(weight)), "fold": F.lit(-1)})
    rows = own.withColumn("sample_weight", F.lit(1.0))
    both = rows.unionByName(more.select(*[c for c in rows.columns if c in more.columns]), allowMissingColumns=True)
    return M.cross_validate(saved(both), n_folds, make, name)  # read by every pass of every fit


def external_teacher(own: DataFrame, external: DataFrame, make: Callable[[int], Estimator], signature: Column, name: str = "external_pred") -> DataFrame:
    """own with the prediction of a model of the external rows that overlap none; null if all overlap."""
    rows = saved(audit.without_overlap(external, own, signature))  # read by every pass of the fit
    if rows.isEmpty():
        return own.withColumn(name, F.lit(None).cast("double"))
    model = make(0).fit(rows)
    return M.positive(model.transform(own), name).select(*own.columns, name)


def mitigated(df: DataFrame, n_folds: int, make: Callable[[int], Estimator], signature: Column, weight: float = 0.0) -> DataFrame:
    """Out-of-fold predictions with the suspects of each fold's training rows dropped (weight 0) or weighted down. make's
    weight column is `sample_weight`."""
    out = None
    for k in range(n_folds):
        train = df.filter(F.col("fold") != k)
        suspects = audit.minority_suspects(train, signature, "target").select("id").withColumn("_w", F.lit(float(weight)))
        rows = train.join(suspects, "id", "left").withColumn("sample_weight", F.coalesce("_w", F.lit(1.0))).drop("_w").filter("sample_weight > 0")
        part = M.positive(make(k).fit(rows).transform(df.filter(F.col("fold") == k).withColumn("sample_weight", F.lit(1.0))), "oof_pred").select(*df.columns, "oof_pred")
        out = part if out is None else out.unionByName(part)
    return out


def suite(df: DataFrame, n_folds: int, configurations: Mapping[str, Callable[[int], Estimator]], reference: str = "reference_pred") -> DataFrame:
    """For each configuration: its AUC out of fold, and the best blend with the reference."""
    out = None
    for name, make in configurations.items():
        got = saved(M.cross_validate(df, n_folds, make, "_p").select("target", reference, "_p"))  # read for both figures
        row = auc(got, [], "target", "_p", "oof_auc").crossJoin(scans.fixed_blend(got, "_p", reference)).select(F.lit(name).alias("configuration"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def with_prior_features(df: DataFrame, n_folds: int, make: Callable[[int, list[str]], Estimator], name: str = "oof_pred") -> DataFrame:
    """Out-of-fold predictions on hierarchical priors that are fitted on the other folds alone."""
    out = None
    for k in range(n_folds):
        fitted = priors.TargetPriors().fit(df.filter(F.col("fold") != k))
        train, valid = (fitted.apply(d) for d in (df.filter(F.col("fold") != k), df.filter(F.col("fold") == k)))
        columns = [c for c, t in train.dtypes if c not in df.columns and t != "string"]
        train = saved(train)  # read by every pass of the fit
        part = M.positive(make(k, columns).fit(train).transform(valid), name).select(*df.columns, name)
        out = part if out is None else out.unionByName(part)
    return out


def neighbour_features(vectors: DataFrame, values: DataFrame, columns: Sequence[str], k: int = 8, hops: int = 2) -> tuple[DataFrame, list[str]]:
    """values with the means of their columns over each row's nearest neighbours, and over those's, and the names."""
    return hop_means(saved(graph.exact_knn(vectors, k)), values, columns, hops)  # read by each hop


def hop_means(edges: DataFrame, values: DataFrame, columns: Sequence[str], hops: int = 2) -> tuple[DataFrame, list[str]]:
    """values with the means of their columns over the neighbours of given edges, and over those's, and the names."""
    out, last, made = values, list(columns), []
    for h in range(hops):
        means = graph.neighbour_means(edges, out, last)
        names = [f"hop{h + 1}_{c}" for c in columns]
        out = out.join(means.toDF("vec_id", *names), "vec_id", "left")
        last, made = names, [*made, *names]
    return out, made


def scenario_scores(df: DataFrame, models: Mapping[str, PipelineModel], scenarios: Sequence[str] = select.SCENARIOS) -> DataFrame:
    """id, scenario ('base' too) and each model's pred_<name> of the rows as they would be."""
    rows = select.counterfactuals(df, scenarios).unionByName(df.withColumn("scenario", F.lit("base")))
    made = []
    for n, m in models.items():
        rows = M.positive(m.transform(rows), f"pred_{n}").select(*df.columns, "scenario", *made, f"pred_{n}")
        made.append(f"pred_{n}")
    return rows.select("id", "scenario", *made)


def adversarial(train: DataFrame, test: DataFrame, n_folds: int, make: Callable[[int], Estimator]) -> DataFrame:
    """fold and AUC of telling test rows from training rows, out of fold; make's label is is_test."""
    rows = train.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))
    dealt = saved(folds.stratified_folds(rows.drop("fold"), n_folds, 7, by="is_test"))  # read by every pass of every fit
    return auc(M.cross_validate(dealt, n_folds, make, "_p"), ["fold"], "is_test", "_p")


def generalisation(df: DataFrame, family: Column, families: Sequence[str], make: Callable[[int], Estimator], reference: str = "reference_pred") -> DataFrame:
    """For each family: rows, AUC and loss of the reference, and of a model that has seen no row of it, with the gaps."""
    out = None
    for i, value in enumerate(families):
        inside = family == value
        model = make(i).fit(df.filter(~F.coalesce(inside, F.lit(False))))
        rows = M.positive(model.transform(df.filter(inside)), "_left")
        loss = rows.agg(F.count("*").alias("rows"), F.avg(logloss("target", reference)).alias("reference_logloss"), F.avg(logloss("target", "_left")).alias("left_out_logloss"))
        row = loss.crossJoin(auc(rows, [], "target", reference, "reference_auc")).crossJoin(auc(rows, [], "target", "_left", "left_out_auc"))  # one row each
        row = row.select(F.lit(value).alias("family"), "*", (F.col("reference_auc") - F.col("left_out_auc")).alias("gap_auc"), (F.col("left_out_logloss") - F.col("reference_logloss")).alias("gap_logloss"))
        out = row if out is None else out.unionByName(row)
    return out


def plain_logistic(columns: Sequence[str], label: str = "target", weight: str | None = None) -> Estimator:
    """A logistic regression of number columns."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip"), LogisticRegression(labelCol=label, regParam=0.01, maxIter=25, **({"weightCol": weight} if weight else {}))])
