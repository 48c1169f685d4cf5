import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortline.functions.metrics import auc
from cohortline.operators import graph as G
from cohortline.operators import learners as M
from cohortline.operators import messages as S


def test_gradients_equal_differences(spark):
    rng = np.random.default_rng(1)
    nodes = [(i, rng.normal(size=3).tolist(), float(i % 2) if i != 7 else None, float(i % 5 > 0 and i != 7)) for i in range(30)]
    edges = [(i, int(j)) for i in range(28) for j in rng.choice(30, 3, replace=False) if j != i]
    n = spark.createDataFrame(nodes, "id long, x array<double>, y double, learn double").repartition(3)
    e = S.weighted_edges(spark.createDataFrame(edges, "vec_id long, neighbour long"))
    p = {n: v + 0.1 * rng.normal(size=v.shape) for n, v in S.initial(3, 4).items()}  # no state right on the bend
    loss, g = S.gradients(n, e, p)

    def forward(q):
        x = np.array([r[1] for r in nodes])
        w = np.zeros((30, 30))
        for i, j in edges:
            w[i, j] += 1 / sum(a == i for a, _ in edges)
        h = np.maximum(x @ q["in"] + q["in_b"], 0)
        for hop in (1, 2):
            h = np.maximum(h @ q[f"own{hop}"] + w @ h @ q[f"near{hop}"] + q[f"b{hop}"], 0)
        z = h @ q["out"] + q["out_b"][0]
        use = [i for i in range(30) if nodes[i][3]]
        return np.mean([np.logaddexp(0, z[i]) - nodes[i][2] * z[i] for i in use])

    assert loss == pytest.approx(forward(p), abs=1e-12)
    flat, found = S.flat(p), S.flat(g)
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert found[k] == pytest.approx((forward(S.shaped(up, p)) - forward(S.shaped(down, p))) / 2e-6, abs=1e-6)


def test_blocks_give_the_same_gradients(spark, monkeypatch):
    """Few nodes a block; neighbours in other blocks, repeated and missing ones, nodes without edges or label, many edges."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 3)), np.ones((50, 3))])
    nodes = [(3 * i, x[i].tolist(), float(i % 2) if i % 4 else 0.0, float(i % 5 > 0)) for i in range(200)]
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    edges = [(3 * i, 3 * int(j)) for i in range(190) for j in np.argsort(gap[i])[1:5]] + [(0, 1), (3, 1), (3, 9), (3, 9), (1, 3)]
    n = spark.createDataFrame(nodes, "id long, x array<double>, y double, learn double").repartition(3)
    e = spark.createDataFrame(edges, "vec_id long, neighbour long")
    p = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in S.initial(3, 4).items()}
    packed = S.blocks(n, e)
    assert packed.count() > 6 and packed.agg(F.sum("a")).first()[0] == 160
    loss, g = S.block_gradients(packed, p)
    want, wanted = S.gradients(n, S.weighted_edges(e), p)
    assert loss == pytest.approx(want, abs=1e-12) and np.allclose(S.flat(g), S.flat(wanted), atol=1e-12)
    others = n.withColumn("learn", 1 - F.col("learn"))
    made = S.block_predicted(S.packed(S.dealt(n, e), F.col("learn") == 0), p)
    brute = S.predicted(others, S.weighted_edges(e), p).join(others.filter("learn = 1").select("id"), "id")
    rows = lambda df: [(r.id, r.y, pytest.approx(r.prediction, abs=1e-12)) for r in df.orderBy("id").collect()]
    assert rows(made) == rows(brute) and made.count() == 40
    assert S.blocks(n, e.unionByName(spark.createDataFrame([(0, j) for j in range(40)], e.schema))) is None
    assert S.blocks(n.unionByName(n.limit(1)), e) is None


def test_learned_messages_beat_fixed_means(spark):
    """The label is whether a node's neighbours have two features of one sign: no weighting of plain means tells."""
    rng = np.random.default_rng(4)
    group = rng.normal(size=(60, 2)) * 1.5
    of = rng.integers(0, 60, 400)
    x = group[of] + 0.6 * rng.normal(size=(400, 2))
    y = (group[of].prod(1) > 0).astype(int)
    edges = [(i, int(j)) for i in range(400) for j in rng.permutation(np.flatnonzero((of == of[i]) & (np.arange(400) != i)))[:5]]
    nodes = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(of[i] % 2)) for i in range(400)], "id long, x array<double>, y int, learn int").checkpoint()
    e = spark.createDataFrame(edges, "vec_id long, neighbour long").checkpoint()
    model = S.fit(nodes, e, width=8, rounds=14, rate=0.12)
    assert model.losses[-1] < 0.7 * model.losses[0]
    got = S.predicted(nodes, S.weighted_edges(e), model.parameters).join(nodes.filter("learn = 0").select("id"), "id")
    trained = auc(got, [], "y", "prediction").first()[0]
    values = nodes.select(F.col("id").alias("vec_id"), "y", "learn", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    means = values.join(G.neighbour_means(e, values, ["a", "b"]), "vec_id", "left").fillna(0.0)
    fixed = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "nb_a", "nb_b"], outputCol="features"), LogisticRegression(labelCol="y")]).fit(means.filter("learn = 1"))
    plain = auc(M.positive(fixed.transform(means.filter("learn = 0")), "p"), [], "y", "p").first()[0]
    assert trained > 0.8 and trained > plain + 0.1


def test_others_are_predicted_in_blocks_and_along_edges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2))
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    nodes = spark.createDataFrame([(i, x[i].tolist(), float(x[i, 0] > 0) if i != 5 else None, int(i % 3 > 0)) for i in range(120)], "id long, x array<double>, y double, learn int").checkpoint()
    e = spark.createDataFrame([(i, int(j)) for i in range(118) for j in np.argsort(gap[i])[1:4]], "vec_id long, neighbour long").checkpoint()
    got = []
    for most in (16, 1):  # with blocks and without
        monkeypatch.setattr(S, "MOST_EDGES", most)
        model = S.fit(nodes, e, width=3, rounds=2)
        assert (model.rows is None) == (most == 1)
        got.append({r.id: r.prediction for r in model.others().collect()})
    assert set(got[0]) == set(got[1]) == {i for i in range(120) if i % 3 == 0 or i == 5}  # 5 has no label
    assert all(got[0][i] == pytest.approx(got[1][i], abs=1e-9) for i in got[0])


def test_no_nodes(spark):
    none = S.fit(spark.createDataFrame([], "id long, x array<double>, y int, learn int"), spark.createDataFrame([], "vec_id long, neighbour long"), rounds=1)
    assert none.losses == [0.0]
