import math

import numpy as np
import pytest

from cohortline.llm import rotated
from cohortline.llm.rotated import Codes, nearest


def brute(rows, queries, k):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    have = [(i, v) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, v in queries:
        if i is None or not ok(v):
            continue
        others = list(have)
        others.remove((i, v))  # one row is its own
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in others)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_dirty_rows_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 70)]) for i in range(150)]
    rows += [(200, None), (201, [None] * 70), (202, [math.nan] * 70), (203, [math.inf] * 70), (204, [0.0] * 70), (205, []), (None, [1.0] * 70)]
    rows += [(10, rows[10][1]), (20, [1.0] * 70), (7, [0.5] * 3)] + [(300 + i, rows[10][1]) for i in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as VEC_ID", "3 as x").repartition(3)
    queries = [(i, v) for i, v in rows if i is not None and i % 10 == 0]
    got = nearest(d, spark.createDataFrame(queries, "vec_id long, embedding array<double>"), k=6, deviations=6.0, block_numbers=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 6)


def test_few_or_no_candidates(spark):
    d = spark.createDataFrame([(0, [1.0, 0.5]), (1, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(d, d.filter("vec_id = 0")).collect()] == [(0, 1, 1, -1.0)]
    assert nearest(d, d.limit(0)).count() == 0 and nearest(d.limit(0), d.limit(0)).count() == 0
    one = d.filter("vec_id = 0")
    assert nearest(one, one).count() == 0


@pytest.mark.parametrize("dims", [1, 64, 100])
def test_estimates_stay_within_their_bounds(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(3000, dims)) + rng.normal(size=dims)
    x[0] = x.mean(0)
    codes = Codes(x.mean(0), 7)
    estimate, error = codes.bounds(*codes.encode(x), codes.questions(x[:40]))
    true = x[:40] @ x.T
    outside = np.abs(estimate - true) > error
    assert outside.mean() < 0.06
    if dims > 1:
        assert abs(np.mean(estimate - true)) < 0.02 * np.abs(true).mean() + 0.05


def test_query_recall_and_work(spark, monkeypatch):
    data = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in rotated.query(spark, data).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        found = sorted(got[ids[i]])
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - score[np.searchsorted(ids, v)]) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len(best & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.98
    codes = Codes(x[:1024].mean(0), 7)
    estimate, error = codes.bounds(*codes.encode(x), codes.questions(x[:50]))
    limit = np.sort(x[:50] @ x.T, 1)[:, -21]
    assert (estimate + error >= limit[:, None]).mean() < 0.3  # most are never scored


def test_layout_changes_no_score(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.filter("vec_id % 20 = 0")
    a, b = ({(r.query_id, r.vec_id): r.score for r in nearest(d, q).collect()} for d in (v.coalesce(1), v.repartition(7)))
    assert len(a) == len(b) == 500 and len(a.keys() & b.keys()) >= 495 and all(a[p] == b[p] for p in a.keys() & b.keys())
