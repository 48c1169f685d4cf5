import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortline.functions import keys as K
from cohortline.functions.metrics import auc, average_rank, comparable_logloss
from cohortline.operators import audit as A
from cohortline.operators import blend as B
from cohortline.operators import blocks
from cohortline.operators.learners import calibrated
from cohortline.operators.priors import fold_safe_encoding
from cohortline.operators.states import CoverageBackoff
from cohortline.schema import nan_to_null, require_columns


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties_groups_and_one_class(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)] + [("c", 1, 0.5), ("c", 1, 0.7), (None, 0, 0.1), (None, 1, 0.1)]
    d = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r.auc for r in auc(d, ["g"], "y", "p").collect()}
    assert got["c"] is None and got[None] == 0.5
    for g in "ab":
        assert got[g] == pytest.approx(brute_auc([(y, p) for h, y, p in rows if h == g]))
    up = auc(d.withColumn("p", 1 - F.col("p")), ["g"], "y", "p").filter("g = 'a'").first().auc
    assert up == pytest.approx(1 - got["a"])
    assert auc(d.withColumn("p", F.col("p") ** 3 * 7), ["g"], "y", "p").filter("g = 'b'").first().auc == pytest.approx(got["b"])


def test_average_rank_shares_ties_and_skips_nulls(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, 9.0), (5, None)], "id int, v double")
    assert {r.id: r.r for r in average_rank(d, [], "v", "r").collect()} == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}


def test_bins_are_right_closed_and_missing_is_a_text(spark):
    d = spark.createDataFrame([(6.0,), (6.5,), (48.0,), (49.0,), (None,)], "tenure double")
    assert [r[0] for r in d.select(F.expr(K.tenure_bin())).collect()] == ["0_6", "7_12", "25_48", "49_plus", "nan"]
    assert spark.range(1).select(F.expr(K.support_bucket("0")), F.expr(K.support_bucket("75"))).first() == ("zero", "75_199")
    assert K.sister_family("a__b__c__Yes__7_12") == "a__b__c__Yes__0_6" and K.sister_family("a__b__c__Yes__0_6").endswith("7_12") and K.sister_family("a__b__c__Yes__x") == "a__b__c__No__x"


def test_reassignment_keeps_the_values_and_empty_chains_the_reference(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, "ab"[i % 2], rng.random(), rng.choice([0.1, 0.2, 0.3])) for i in range(50)], "id int, g string, s double, r double")
    out = B.reassign(d, "s", "r", "g").collect()
    assert sorted((x.g, x.reassigned) for x in out) == sorted((x.g, x.r) for x in out)
    same = d.withColumn("c", B.chain("r", [(F.lit(False), "s")]))
    assert same.filter("c <> r").count() == 0


def test_a_fold_s_labels_do_not_change_its_own_encodings(spark):
    rows = [(i, "xyz"[i % 3], i % 4, int(i % 5 == 0)) for i in range(80)]
    d = spark.createDataFrame(rows, "id int, v string, fold int, target int")
    e = spark.createDataFrame([(i, v, f, 1 - y if f == 2 else y) for i, v, f, y in rows], d.schema)
    own = lambda x: {r.id: (r.TE_v, r.TE_COUNT_v) for r in fold_safe_encoding(x, ["v"]).filter("fold = 2").collect()}
    assert own(d) == own(e)


def test_drift_of_equal_sides_is_nothing(spark):
    d = spark.createDataFrame([(float(i % 17), "ab"[i % 2], t) for i in range(100) for t in (0, 1)], "x double, c string, is_test int")
    n, c = A.numeric_drift(d, ["x"]).first(), A.categorical_drift(d, ["c"]).first()
    assert n.psi == pytest.approx(0) and n.mean_delta == 0 and c.tvd == 0 and c.unseen_in_test_count == 0


def test_fitted_on_itself_counts_are_its_own(spark):
    d = spark.createDataFrame([("E", "M", "F", "Yes", i % 30) for i in range(100)], "PaymentMethod string, Contract string, InternetService string, PaperlessBilling string, tenure int")
    out = CoverageBackoff(10).fit(d).apply(d)
    assert {r.segment3_train_rows for r in out.collect()} == {100} and sum(1 / r.segment5_train_rows for r in out.collect()) == pytest.approx(4)


def test_guards(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert nan_to_null(d).filter("x IS NULL").count() == 1
    with pytest.raises(ValueError):
        require_columns(d, ["y"], "It")
    with pytest.raises(ValueError):
        blocks.normalise("A,nothing")
    with pytest.raises(ValueError):
        blocks.apply_blocks(d, "G")
    with pytest.raises(ValueError):
        calibrated(d, 2, "spline", "x")
    assert blocks.normalise("h, r,VALUE,R") == ("H", "R", "V") and B.normalise_weights([-1, 0]) == [0.5, 0.5]


def test_auc_leaves_out_rows_without_label_or_score(spark):
    rows = [(1, 0.9), (0, 0.2), (None, 0.9), (None, 0.9), (1, float("nan")), (0, None)]
    d = spark.createDataFrame(rows, "y int, p double")
    assert auc(d, [], "y", "p").first().auc == 1.0
    nan = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, float("nan")), (0, 0.5)], "y int, p double")
    assert auc(nan, [], "y", "p").first().auc == 1.0


def test_ranges_rise_with_values_and_spread_small_ones(spark):
    import random

    from cohortline.functions.metrics import value_range

    rng = random.Random(1)
    values = sorted({0.0, -0.0, 1.0, 2.0, 4.0, 0.5, 1e-300, -1e300, 1e308, *(rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-12, 12) for _ in range(3000))})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(value_range(F.col("v"))).collect()]
    assert got == sorted(got)
    small = spark.createDataFrame([(rng.random() * 1e-3,) for _ in range(5000)], "v double")
    assert small.groupBy(value_range(F.col("v"))).count().agg(F.max("count")).first()[0] < 100


def test_quantiles_equal_numpy(spark):
    import random

    import numpy as np

    from cohortline.functions.metrics import quantiles

    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 0.5, -3.0]) * (10 if g else 1)) for g in (0, 1) for _ in range(501)] + [(2, 7.0), (0, None), (1, float("nan")), (3, None)]
    d = spark.createDataFrame(rows, "g int, v double")
    named = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: [r[n] for n in named] for r in quantiles(d, ["g"], "v", named).collect()}
    for g in (0, 1, 2):
        own = [v for h, v in rows if h == g and v is not None and v == v]
        assert got[g] == pytest.approx(np.quantile(own, list(named.values())).tolist())
    assert 3 not in got
    none = quantiles(d.limit(0), ["g"], "v", named)
    assert none.columns == ["g", *named] and none.collect() == []


def test_text_and_sister_keys(spark):
    d = spark.createDataFrame([("  A \t b\n c ",), (None,)], "t string")
    assert [r[0] for r in d.select(F.expr(K.normal_text("t"))).collect()] == ["a b c", "__missing__"]
    values = ["a__b__c__Yes__0_6", "a__b__c__Yes__25_48", "a__b__c__No__x", "a__b"]
    s = spark.createDataFrame([(v,) for v in values], "f string")
    assert [r[0] for r in s.select(F.expr(K.sister_column("f"))).collect()] == [K.sister_family(v) for v in values]


def test_losses_compare_as_in_other_engines(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, rng.randint(1, 9999) / 10000) for i in range(2000)] + [(2000, 1, None), (2001, 0, 0.0), (2002, 1, 1.0)]
    got = spark.createDataFrame(rows, "id long, y int, p double").select("id", comparable_logloss("y", "p").alias("loss")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE t (id BIGINT, y INT, p DOUBLE)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = dict(c.execute(f"SELECT id, -(y * ln({K.clip('p')}) + (1 - y) * ln(1 - {K.clip('p')})) FROM t").fetchall())
    assert {r.id: r.loss for r in got} == want


def test_auc_and_ranks_dont_repeat_what_makes_a_score(spark):
    """A filter on the score was moved below the columns that make it, and held their expressions once for each use."""
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 100).alias("s"))
    for _ in range(8):
        df = df.withColumn("s", F.when(F.col("s") > 0.5, F.col("s") * 0.9).otherwise(F.col("s") + 0.01))
    for out in (auc(df, [], "y", "s"), average_rank(df, [], "s", "r")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("0.01") < 100
