import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions.metrics import auc, logloss
from cohortline.operators import latent as N


def make(spark, n=900):
    """The label comes from pairs of categories, not from single ones."""
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 6, n), rng.integers(0, 6, n), rng.integers(0, 3, n)
    table = rng.normal(size=(6, 6)) * 2.5
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(table[a, b] + 0.7 * x)))).astype(int)
    rows = [(i, int(y[i]) if i % 97 else None, int(i % 2), f"a{a[i]}", f"b{b[i]}" if i % 50 else None, f"c{c[i]}", float(x[i]) if i % 40 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, target int, fold int, a string, b string, c string, x double").checkpoint()


@pytest.fixture(scope="module")
def data(spark):
    return make(spark)


MODELS = [N.FieldAware(3, 64, 3, 1), N.EmbeddingPerceptron(3, 64, 3, 5, 1)]


@pytest.mark.parametrize("model", MODELS)
def test_gradients_equal_differences(model):
    rng = np.random.default_rng(1)
    p = model.initial(2) + 0.05 * rng.normal(size=model.size)
    codes, x, y = rng.integers(0, 64, (40, 3)), rng.normal(size=(40, 1)), rng.integers(0, 2, 40)
    loss = lambda q: (np.logaddexp(0, model.scores(q, codes, x)) - y * model.scores(q, codes, x)).sum()
    got = np.zeros(model.size)
    rest = 1 / (1 + np.exp(-model.scores(p, codes, x))) - y
    model.gradients(p, codes, x, rest, lambda k, v: np.add.at(got, np.ravel(k), np.ravel(v)))
    for k in rng.permutation(model.size)[:150]:
        e = np.zeros(model.size)
        e[k] = 1e-6
        assert got[k] == pytest.approx((loss(p + e) - loss(p - e)) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("model", MODELS)
def test_equal_for_any_number_of_partitions(data, model):
    rows = N.hashed_rows(data, ["a", "b", "c"], ["x"], bits=6, batches=2)
    a, b = (N.fit(r, model, models=2, epochs=1, batches=2).parameters for r in (rows.coalesce(1), rows.repartition(5)))
    assert (a == b).all() and (a[0] != a[1]).any()


@pytest.mark.parametrize("model", MODELS)
def test_batches_without_rows_of_a_model(data, model):
    """A partition or the last part of it may hold rows of one fold alone, or none with a target."""
    rows = N.hashed_rows(data, ["a", "b", "c"], ["x"], bits=6, batches=2)
    parts = rows.repartition(64, "fold", F.isnull("y"))
    a, b = (N.fit(r, model, models=2, epochs=1, batches=2) for r in (rows.coalesce(1), parts))
    assert (a.parameters == b.parameters).all()
    p = lambda f, r: sorted((x.id, round(x.p, 12)) for x in f.predict(r, "p").collect())
    assert p(a, rows.coalesce(1)) == p(b, parts)


def test_pairs_of_categories_are_learned(spark, data):
    loss = {}
    for name, model, rate in (("factors", N.FieldAware(3, 1024, 4, 1), 0.3), ("single", N.FieldAware(3, 1024, 0, 1), 0.3), ("perceptron", N.EmbeddingPerceptron(3, 1024, 8, 16, 1), 0.1)):
        rows = N.hashed_rows(data, ["a", "b", "c"], ["x"], bits=10, batches=2)
        got = N.fit(rows, model, models=2, epochs=10, batches=2, rate=rate).predict(rows, "p").filter("y IS NOT NULL")
        loss[name] = got.agg(F.avg(logloss("y", "p"))).first()[0]
        assert got.count() == data.filter("target IS NOT NULL").count()
    assert loss["factors"] < loss["single"] - 0.05 and loss["perceptron"] < loss["single"] - 0.03


def test_no_rows(spark, data):
    rows = N.hashed_rows(data.limit(0), ["a"], ["x"], bits=4, batches=1)
    fitted = N.fit(rows, N.FieldAware(1, 16, 2, 1), epochs=1, batches=1)
    assert (fitted.parameters[0] == N.FieldAware(1, 16, 2, 1).initial(7)).all() and fitted.predict(rows).count() == 0
    assert auc(fitted.predict(N.hashed_rows(data, ["a"], ["x"], bits=4, batches=1)).filter("y IS NOT NULL"), [], "y", "prediction").count() == 1
