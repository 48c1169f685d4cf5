from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cohortline.operators import audit as A
from cohortline.operators import blend as B
from cohortline.operators import trees as T
from cohortline.plans import compass as C


def test_reasons_take_precedence(spark):
    rows = [  # id, target, reference, teachers, exact, coarse
        (1, 0, 0.95, (0.9, 0.9), "a", "A"), (2, 1, 0.95, (0.9, 0.9), "a", "A"),  # one exact signature, both labels
        (3, 0, 0.5, (0.5, 0.5), "c", "C"), (4, 1, 0.5, (0.5, 0.5), "d", "C"),  # a small coarse group
        *[(10 + i, i % 2, 0.2 + i / 100, (0.2, 0.2 + i / 50), f"g{i}", "G") for i in range(6)],  # a large one
        (20, 0, 0.93, (0.8, 0.8), "n", "N"), (21, 0, 0.92, (0.4, 0.8), "m", "M"), (22, None, 0.9, (0.5, 0.5), "o", "O"), (23, 1, None, (0.5, 0.5), "p", "P"),
    ]
    d = spark.createDataFrame([(i, y, r, *t, e, c) for i, y, r, t, e, c in rows], "id long, target int, reference_pred double, t1 double, t2 double, e string, c string")
    got = {r.id: r for r in A.label_noise(d, ["t1", "t2"], F.col("e"), F.col("c"), hard=0.8, calm=0.5, loud=0.9).collect()}
    assert {i: r.primary_reason for i, r in got.items() if i < 5} == {i: "near_duplicate_conflict" for i in (1, 2, 3, 4)}
    assert got[20].primary_reason == "label_noise_candidate" and got[20].exact_group_size == 1
    assert got[21].primary_reason == "hard_example_stable" and not got[21].label_noise_candidate  # its teachers differ
    assert not {22, 23} & set(got) and not any(r.near_duplicate_conflict for i, r in got.items() if i >= 10)
    assert A.label_noise(d.limit(0), ["t1", "t2"], F.col("e"), F.col("c")).count() == 0
    with pytest.raises(ValueError, match="one half"):
        A.label_noise(d, ["t1"], F.col("e"), F.col("c"), upper=0.4)


def test_families_left_out_together_equal_separate_fits(spark):
    rows = [(i, (i * 7919 % 13 + i % 3 * 4) % 2, "abc"[i % 3] if i % 7 else None, float(i * 31 % 97), 0.1 + (i * 37 % 80) / 100) for i in range(600)]
    d = spark.createDataFrame(rows, "id long, target int, family string, x double, reference_pred double").checkpoint()
    binned, options = T.binning(d, ["x"], ["family"], bins=8), T.Options(rounds=3, depth=2, patience=0)
    together = C.left_out(d, "family", ["a", "nan"], binned, options)
    for m, inside in enumerate((F.col("family").eqNullSafe("a"), F.col("family").isNull())):
        assert together.trees[m] == T.fit(d.filter(~inside), binned, options).trees[0]
    got = {r.family: r for r in C.compass(d, d.filter("id % 5 = 0"), "family", binned, options, top=3, min_train=50).collect()}
    assert len(got) == 3 and all(r.gap_auc == pytest.approx(r.reference_auc - r.lofo_auc) for r in got.values())
    best = [r.family for r in C.reference_families(d, d, "family").orderBy(F.desc("reference_contribution")).collect()]
    assert set(best[:3]) == set(got) and C.compass(d, d, "family", binned, options, top=3, min_train=10**6).count() == 0


def test_moves_stay_on_the_simplex_and_descent_ends_where_none_gains(spark):
    for w in ([1 / 3] * 3, [1.0, 0.0, 0.0], [0.95, 0.05, 0.0]):
        for x in B.weight_moves(w, 0.1):
            assert sum(x) == pytest.approx(1) and min(x) >= 0
    assert len(B.weight_moves([1.0, 0.0, 0.0], 0.1)) == 4
    rows = [(i, i % 2, (i * 37 % 101) / 101 + (i % 2) * 0.3, (i * 53 % 97) / 97, (i * 17 % 89) / 89 + (i % 2) * 0.1, i % 3) for i in range(240)]
    d = spark.createDataFrame(rows, "id long, target int, pred_a double, pred_b double, pred_c double, fold int").withColumn("repeat", F.lit(0))
    models = ["pred_a", "pred_b", "pred_c"]
    fitted = B.batched_descent(d, [(0, 0), (0, 1), (0, -1), (5, 0)], models, step=0.1, rounds=12)
    assert fitted[5, 0][0] == [1 / 3] * 3 and fitted[5, 0][1] != fitted[5, 0][1]  # no rows
    for f in ((0, 0), (0, -1)):
        w, best = fitted[f]
        scores = {r["move"]: r["auc"] for r in B.move_scores(d, {f: B.weight_moves(w, 0.1)}, models).collect()}
        assert scores[0] == pytest.approx(best) and max(scores.values()) <= best + 1e-10
    assert B.coordinate_descent(d, ["a", "b", "c"], step=0.1, rounds=12) == fitted[0, -1]


def test_deviations_that_differ_by_rounding_are_equal(spark):
    rows = [(i, 1, 0.1, *t, str(i)) for i, t in enumerate(permutations((0.0613, 0.3843, 0.2231)))]
    d = spark.createDataFrame(rows, "id long, target int, reference_pred double, t1 double, t2 double, t3 double, s string")
    deviations = {r[0] for r in d.select(B.array_statistics(["t1", "t2", "t3"])["std"]).collect()}
    assert len(deviations) > 1 and max(deviations) - min(deviations) < 1e-15
    got = A.label_noise(d, ["t1", "t2", "t3"], F.col("s"), F.col("s"), upper=0.9, lower=0.2, calm=1e-9).collect()
    assert {r.id for r in got if r.label_noise_candidate} == set(range(6))
