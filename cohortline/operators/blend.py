"""The algebra of predictions: blends, overrides, residual chains, scans over a grid, rank reassignment and inversion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import auc, average_rank
from ..schema import require_columns


def weighted(weights: Mapping[str, float], prefix: str = "pred_") -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"{prefix}{m}") for m, w in weights.items()])


def blend(df: DataFrame, weights: Mapping[str, float], name: str = "reference_pred") -> DataFrame:
    require_columns(df, [f"pred_{m}" for m in weights], "A blend")
    return df.withColumn(name, weighted(weights))


def merge_oof(frames: Mapping[str, DataFrame], on: Sequence[str] = ("id", "target")) -> DataFrame:
    """One row for each key that all frames have, with each frame's `pred` as pred_<name>; fails on evaluation where a frame
    repeats a key. The check is the aggregate by key that the join needs anyway."""

    def once(name: str, df: DataFrame) -> DataFrame:
        keyed = df.groupBy(*on).agg(F.count("*").alias("_n"), F.first("pred").alias(f"pred_{name}"))
        told = F.raise_error(F.concat(F.lit(f"{name} repeats {on[0]} = "), F.coalesce(F.col(on[0]).cast("string"), F.lit("null"))))
        return keyed.filter(F.when(F.col("_n") > 1, told.cast("boolean")).otherwise(True)).drop("_n")

    return reduce(lambda a, b: a.join(b, list(on)), [once(n, d) for n, d in frames.items()])


def duplicates(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, for one-to-one checks."""
    return df.groupBy(*on).agg(F.count("*").alias("rows")).filter("rows > 1")


def array_statistics(columns: Sequence[str]) -> dict[str, Column]:
    """Mean, population deviation, range, gap of the two highest, of columns in a row."""
    a = F.array(*columns)
    n = len(columns)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(F.transform(a, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n
    ordered = F.sort_array(a, asc=False)
    return {"mean": mean, "std": F.sqrt(var), "range": F.array_max(a) - F.array_min(a), "top_gap": ordered[0] - ordered[1]}


def scan(df: DataFrame, alphas: Sequence[float], combined: Column, y: str = "target") -> DataFrame:
    """AUC of `combined` (an expression with alpha) for each alpha: one grouped metric for all, not one job for each."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(a)).alias("alpha")) for i, a in enumerate(alphas)])).alias("g")
    rows = df.withColumn("g", grid).select("*", "g.pos", "g.alpha").drop("g").withColumn("_s", combined)
    return auc(rows, ["pos", "alpha"], y, "_s")


def best(scanned: DataFrame) -> DataFrame:
    """The first alpha with the highest AUC."""
    return scanned.agg(F.max_by(F.struct("alpha", "auc"), F.struct("auc", -F.col("pos"))).alias("x")).select("x.*")


def override(mask: Column, reference: str, specialist: str) -> Column:
    return F.when(mask, (1 - F.col("alpha")) * F.col(reference) + F.col("alpha") * F.col(specialist)).otherwise(F.col(reference))


def blended(reference: str, challenger: str) -> Column:
    return (1 - F.col("alpha")) * F.col(reference) + F.col("alpha") * F.col(challenger)


def residual(mask: Column, reference: str, correction: str) -> Column:
    moved = F.least(F.greatest(F.col(reference) + F.col("alpha") * F.col(correction), F.lit(0.0)), F.lit(1.0))
    return F.when(mask, moved).otherwise(F.col(reference))


def chain(reference: str, steps: Sequence[tuple[Column, str]]) -> Column:
    """Steps in order, each over its mask; where masks overlap the later one counts."""
    return reduce(lambda cur, s: F.when(s[0], F.col(s[1])).otherwise(cur), steps, F.col(reference))


def chain_shifts(df: DataFrame, reference: str, steps: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """step, rows, changed, mean and largest shift of each step against what was before it."""
    cur, rows = F.col(reference), []
    for i, (name, mask, pred) in enumerate(steps):
        new = F.when(mask, F.col(pred)).otherwise(cur)
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), mask.cast("int").alias("in_mask"), F.abs(new - cur).alias("shift")))
        cur = new
    each = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return each.groupBy("step", "name").agg(F.sum("in_mask").alias("rows"), F.sum((F.col("shift") > 1e-15).cast("int")).alias("changed"), F.avg("shift").alias("mean_shift"), F.max("shift").alias("max_shift"))


def rank_ensemble(df: DataFrame, columns: Sequence[str], name: str = "rank_mean") -> DataFrame:
    """Mean of the columns' average ranks, each divided by the number of rows."""
    source = df
    for c in columns:
        df = average_rank(df, [], c, f"_r_{c}", source=source)
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"_r_{c}") for c in columns]) / len(columns)).drop(*[f"_r_{c}" for c in columns])


def reassign(df: DataFrame, score: str, reference: str, group: str, id_column: str = "id", name: str = "reassigned") -> DataFrame:
    """Within each group the i-th lowest score gets the i-th lowest reference value; ties by id."""
    place = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(c, id_column))
    by_score = df.withColumn("_i", place(score))
    by_value = df.select(F.col(group).alias("_g"), F.col(reference).alias(name), place(reference).alias("_j"))
    return by_score.join(by_value, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_i") == F.col("_j"))).drop("_i", "_j", "_g")


def invert(df: DataFrame, first: tuple[str, Mapping[str, float]], second: tuple[str, Mapping[str, float]], known: Sequence[str], unknown: tuple[str, str]) -> DataFrame:
    """Two components of two blends whose weights and other components are known, by Cramer's rule."""
    (p, w), (q, v) = first, second
    a, b = unknown
    det = w[a] * v[b] - w[b] * v[a]
    if abs(det) < 1e-12:
        raise ValueError("The blends' weights don't determine the components")
    x, y = (F.col(c) - reduce(lambda s, t: s + t, [F.lit(float(u[m])) * F.col(f"pred_{m}") for m in known], F.lit(0.0)) for c, u in ((p, w), (q, v)))
    return df.withColumns({f"inverted_{a}": (x * v[b] - y * w[b]) / det, f"inverted_{b}": (y * w[a] - x * v[a]) / det})


def invert_components(df: DataFrame, three: tuple[str, Mapping[str, float]], four: tuple[str, Mapping[str, float]], five: tuple[str, Mapping[str, float]]) -> tuple[DataFrame, DataFrame]:
    """pred_xgb, pred_lgb and pred_rv of blends whose other components are known, and one row of the largest errors with which
    the components give the blends again.

    Each blend is a column and its weights: of cb, xgb, lgb; of these and r; and of these and rv. xgb and lgb come from
    the first two, rv is what is left of the third."""
    for (_, w), names in zip((three, four, five), (("cb", "xgb", "lgb"), ("cb", "xgb", "lgb", "r"), ("cb", "xgb", "lgb", "r", "rv"))):
        if not set(names) <= set(w):
            raise ValueError(f"A blend's weights must hold {sorted(names)}")
    if abs(five[1]["rv"]) < 1e-12:
        raise ValueError("The third blend doesn't hold rv")
    pair = invert(df, (three[0], {**three[1], "r": 0.0}), four, ("cb", "r"), ("xgb", "lgb"))
    out = pair.withColumnsRenamed({"inverted_xgb": "_xgb", "inverted_lgb": "_lgb"}).drop("pred_xgb", "pred_lgb", "pred_rv")
    out = out.withColumnsRenamed({"_xgb": "pred_xgb", "_lgb": "pred_lgb"})
    rest = F.col(five[0]) - weighted({m: five[1][m] for m in ("cb", "xgb", "lgb", "r")})
    out = out.withColumn("pred_rv", rest / five[1]["rv"])
    errors = [F.max(F.abs(weighted(w) - F.col(c))).alias(f"error_{n}") for n, (c, w) in zip(("three", "four", "five"), (three, four, five))]
    return out, out.agg(*errors)


def normalise_weights(weights: Sequence[float]) -> list[float]:
    """Negative weights as 0, and all to a sum of 1; equal ones if nothing is left."""
    w = [max(0.0, x) for x in weights]
    total = reduce(lambda a, b: a + b, w)  # in order, as other engines add
    return [x / total for x in w] if total > 0 else [1 / len(w)] * len(w)


def weight_moves(now: Sequence[float], step: float) -> list[list[float]]:
    """The weights themselves, and those after each step of one weight, down and then up, with the others rescaled; a step
    beyond 0 or 1 isn't one."""
    out = [list(now)]
    for i, w in enumerate(now):
        for x in (w - step, w + step):
            if 0.0 <= x <= 1.0:
                rest, others = 1.0 - w, len(now) - 1
                moved = [x if j == i else (v * (1.0 - x) / rest if rest > 1e-12 else (1.0 - x) / others) for j, v in enumerate(now)]
                out.append(normalise_weights(moved))
    return out


def move_scores(rows: DataFrame, tried: Mapping[tuple[int, int], list[list[float]]], models: Sequence[str], y: str = "target") -> DataFrame:
    """repeat, left_out, move, auc: the AUC of each tried blend of each fit over the rows of its repeat outside its fold, in one
    job. rows: repeat, fold, y and the models' columns; tried: weights by (repeat, left_out), few at any number of rows."""
    grid = [(r, f, i, *w) for (r, f), many in sorted(tried.items()) for i, w in enumerate(many)]
    names = [f"_w{j}" for j in range(len(models))]
    schema = "_repeat int, left_out int, move int, " + ", ".join(f"{n} double" for n in names)
    small = F.broadcast(rows.sparkSession.createDataFrame(grid, schema))
    each = rows.join(small, (F.col("repeat") == F.col("_repeat")) & (F.col("fold") != F.col("left_out")))
    s = reduce(lambda a, b: a + b, [F.col(w) * F.col(m) for w, m in zip(names, models)])
    return auc(each.select("repeat", "left_out", "move", y, s.alias("_s")), ["repeat", "left_out", "move"], y, "_s")


def batched_descent(
    rows: DataFrame, fits: Sequence[tuple[int, int]], models: Sequence[str], y: str = "target", step: float = 0.02, rounds: int = 25
) -> dict[tuple[int, int], tuple[list[float], float]]:
    """Blend weights and their AUC for each fit (repeat, left_out): in each round every fit takes its best move, while that
    gains more than 1e-10. A round is one job for all moves of all fits that still go on. A fit without rows of both
    classes keeps equal weights and has no AUC."""
    best = {f: (normalise_weights([1.0] * len(models)), float("nan")) for f in fits}
    open_ = set(fits)
    for _ in range(rounds):
        if not open_:
            break
        tried = {f: weight_moves(best[f][0], step) for f in open_}
        found: dict[tuple[int, int], dict[int, float]] = {}
        for r in move_scores(rows, tried, models, y).collect():  # a row for each move
            if r["auc"] is not None:
                found.setdefault((r["repeat"], r["left_out"]), {})[r["move"]] = r["auc"]
        for f in list(open_):
            scores = found.get(f)
            if scores is None:
                open_.discard(f)
                continue
            at = max(scores, key=lambda i: (scores[i], -i))
            if scores[at] <= scores[0] + 1e-10:
                best[f] = (best[f][0], scores[0])
                open_.discard(f)
            else:
                best[f] = (tried[f][at], scores[at])
    return best


def coordinate_descent(df: DataFrame, models: Sequence[str], y: str = "target", step: float = 0.02, rounds: int = 25) -> tuple[list[float], float]:
    """Blend weights (of columns pred_<model>) that no step of one of them improves, and their AUC over all rows."""
    rows = df.select(F.lit(0).alias("repeat"), F.lit(0).alias("fold"), y, *[f"pred_{m}" for m in models])
    return batched_descent(rows, [(0, -1)], [f"pred_{m}" for m in models], y, step, rounds)[0, -1]
