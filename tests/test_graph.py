import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortline.operators import graph as G


def brute(rows, k, queries=None):
    have = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    n = max((len(v) for _, v in have), default=0)
    full = [(i, [*v, *[0.0] * (n - len(v))]) for i, v in have]
    out = []
    for i, v in full:
        if queries is None or i in queries:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in full if j != i)[:k]
            out += [(i, j, r + 1) for r, (_, j) in enumerate(near)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, [float(rng.randrange(4)) for _ in range(5)]) for i in range(220)]
    out += [(300 + i, [1.0, 2.0, 3.0, 0.0, 1.0]) for i in range(60)]  # copies
    return out + [(500, None), (501, [None] * 5), (502, [math.nan] * 5), (None, [1.0] * 5), (503, [1.0, 2.0]), (504, []), (505, [-0.0] * 5), (506, [0.0] * 5)]


@pytest.mark.parametrize("tile", [4096, 50])
def test_exact_neighbours_equal_brute_force(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(G, "TILE", tile)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).repartition(3)
    assert sorted(map(tuple, G.exact_knn(d, 4).collect())) == brute(rows, 4)
    some = G.exact_knn(d, 4, queries=d.filter("vec_id % 20 = 0"))
    assert sorted(map(tuple, some.collect())) == brute(rows, 4, {i for i, _ in rows if i is not None and i % 20 == 0})


@pytest.mark.parametrize("tile", [4096, 20])
def test_index_with_all_lists_is_exact(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(G, "TILE", tile)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, work = G.indexed_knn(d, 4, probes=99)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4)
    assert work.agg(F.sum("entries")).first()[0] == len({tuple(v) for _, v in rows if v is not None and all(x is not None and x == x for x in v)}) - 1  # that without an id


def test_few_probes_find_most_with_little_work(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8)).repeat(60, 0) + 0.2 * rng.normal(size=(2400, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = d.filter("vec_id % 20 = 0")
    found, work = G.indexed_knn(d, 8, probes=3, queries=q)
    n, share = G.recall(found, G.exact_knn(d, 8, queries=q)).first()
    assert n == 120 and share >= 0.9
    assert work.agg(F.sum(F.col("entries") * F.col("queries"))).first()[0] < 0.25 * 120 * 2400


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert G.exact_knn(none, 3).count() == 0 and G.indexed_knn(none, 3, probes=2)[0].count() == 0
    assert G.exact_knn(one, 3).count() == 0 and G.indexed_knn(one, 3, probes=2)[0].count() == 0


def test_vectors_of_accounts(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0), (3, None, None)], "id long, c string, x double")
    got = {r.vec_id: r.embedding for r in G.graph_vectors(d, ["c"], ["x"], 2.0).collect()}
    assert [v[:3] for _, v in sorted(got.items())] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]] and got[3][3] == pytest.approx(0) and got[2][3] > 0


def test_lists_within_reach_hold_all_true_neighbours(spark, rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 4)).repeat(40, 0) + 0.3 * rng.normal(size=(1200, 4))
    made = [(i, v.tolist()) for i, v in enumerate(x)]
    for some in (rows, made):
        d = spark.createDataFrame(some, "vec_id long, embedding array<double>").repartition(3)
        q = d.filter("vec_id % 20 = 0")
        found, true, work = G.indexed_and_exact(d, 4, probes=1, queries=q)
        assert sorted(map(tuple, true.collect())) == brute(some, 4, {i for i, _ in some if i is not None and i % 20 == 0})
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, G.indexed_knn(d, 4, probes=1, queries=q)[0].collect()))


def test_products_leave_out_no_neighbour():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(5000, 6)), 1) + 1e4  # ties, and numbers whose squares lose digits
    q = x[:300]
    row, col = G._pairs(q, x, 5, np.full(300, np.inf))
    kept = set(zip(row.tolist(), col.tolist()))
    d = G._distances(q, x)
    kth = np.partition(d, 4, axis=1)[:, 4]
    assert all((i, j) in kept for i, j in zip(*np.nonzero(d <= kth[:, None]))) and len(kept) < 300 * 5000
    huge = np.full((3, 2), 1e200)
    assert len(G._pairs(huge, huge, 1, np.full(3, np.inf))[0]) == 9  # overflow rules nothing out


def test_vectors_are_read_from_any_part_of_a_column():
    rows = [b"", np.array([1.0, 2.0]).tobytes(), b"", np.arange(3.0).tobytes(), np.arange(5.0).tobytes()]
    column = pa.array(rows, pa.binary())
    for c in (column.slice(1), column.slice(1, 3), pa.chunked_array([column.slice(0, 1), column.slice(3)]), column.slice(0, 1), column.cast(pa.large_binary())):
        got, sizes = G._matrix(c, 3)
        raw = c.to_pylist()
        assert sizes.tolist() == [len(r) // 8 for r in raw]
        assert [x.tolist() for x in got] == [[*np.frombuffer(r)[:3], *[0.0] * (3 - len(r) // 8)] for r in raw]


def test_fitted_points_are_computed_once(spark):
    """The plan of the points reads the rows once: codes and scales are saved, not fitted again for each column."""
    d = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3], float(i), float(-i)) for i in range(30)], "id long, c string, e string, x double, y double")
    plan = G.graph_vectors(d, ["c", "e"], ["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
