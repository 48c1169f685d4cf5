import math
import random

import numpy as np
import pytest

from cohortline.llm.topk import Queries, top_k


def brute(rows, queries, k, scale):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    q = lambda v: [math.floor(scale * x) for x in v]
    have = [(i, q(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, v in queries:
        if i is not None and ok(v):
            others = list(have)
            others.remove((i, q(v)))  # one row is its own
            s = sorted((-sum(a * b for a, b in zip(q(v), w)), j) for j, w in others)[:k]
            out += [(i, n + 1, j, -t) for n, (t, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block,big", [(1 << 20, False), (30, False), (1 << 20, True)])
def test_equals_brute_force(spark, block, big):
    rng = random.Random(block)
    x = lambda: rng.choice([-1.0, -0.5, 0.25, 0.999, 0.0]) * (2.0**22 if big else 1)
    rows = [(i, [x() for _ in range(rng.choice([6, 6, 6, 4, 0, 8]))]) for i in range(120)]
    rows += [(200, None), (201, [None] * 6), (202, [math.nan] * 6), (203, [math.inf] * 6), (None, [1.0] * 6), (7, [0.5] * 6), (50, rows[50][1]), (60, [0.999] * 6)]
    rows += [(300 + i, [0.25] * 6) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as VEC_ID").repartition(3)
    queries = [(i, v) for i, v in rows if i is not None and i % 10 == 0]
    got = top_k(d, spark.createDataFrame(queries, "vec_id long, embedding array<double>"), k=4, block_numbers=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 4, 256)


def test_fewer_candidates_than_k_and_none(spark):
    d = spark.createDataFrame([(0, [1.0, 0.5]), (1, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(d, d.filter("vec_id = 0")).collect()] == [(0, 1, 1, -65536)]
    assert top_k(d, d.limit(0)).count() == 0 and top_k(d.limit(0), d.limit(0)).count() == 0


def test_the_cutoff_leaves_few_scores_to_put_together():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(2000, 64)))
    ids = np.arange(2000)
    first = Queries(ids[:20], x[:20], 4, 5)
    got = [r for r in first.search(x, ids)][0]
    cutoff = np.array([sorted(got[2][got[0] == i])[-6] for i in range(20)], float)
    second = Queries(ids[:20], x[:20], 4, 5, cutoff)
    q, at, total, itself = [r for r in second.search(x, ids)][0]
    q, at = q[~itself], at[~itself]
    full = x[:20] @ x.T
    full[np.arange(20), np.arange(20)] = -np.inf
    assert itself.sum() == 20 and all(sorted(at[q == i]) == sorted(np.argsort(-full[i], kind="stable")[:5]) for i in range(20))
    assert first.resolved <= 20 * 4 * 6 and second.resolved < 20 * 2000 / 2
