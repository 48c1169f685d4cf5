import re
from collections import defaultdict

import pytest

from cohortline.llm.mixing import mix


def water(sizes, budget=1.5, cap=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left, target = set(), budget * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        level = (left - sum(cap * sizes[s] for s in full)) / max(1, sum(w[s] for s in free))
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in order}
        full |= set(over)


@pytest.mark.parametrize("sorted_rows", [2, 10_000])
def test_targets_and_taken_words(spark, sorted_rows):
    docs = [(i, "w " * (i * 7 % 23), None if i % 11 == 0 else f"s{i % 5 * (i % 3)}") for i in range(300)]
    docs += [(900 + i, "big " * 50, "hot") for i in range(200)] + [(None, None, "hot"), (5, "", "z"), (7, "a b", "z"), (7, "a b", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("text", "Text").selectExpr("*", "1 as size", "Text as text")
    q = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    got = mix(d, quality=q, sorted_rows=sorted_rows).collect()
    assert len(got) == len(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in docs:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and (int(r.target) // max(1, r.source_size)) * r["size"] <= r.taken
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mix(d.repartition(3), quality=q, sorted_rows=sorted_rows).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_no_rows_and_no_words(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(d).count() == 0
    d = spark.createDataFrame([(1, None, "a"), (2, " \t", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mix(d).collect()] == [(0, 0.0, 0)] * 2


def test_a_budget_that_ends_among_equal_rows(spark):
    docs = [(7, "a b c", "a")] * 40 + [(i, "x", "b") for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix(d, sorted_rows=2, budget=0.5).collect()
    want = water({"a": 120, "b": 30}, budget=0.5)
    assert len(got) == len(docs)
    for s, w in want.items():
        assert sum(r.taken for r in got if r.source == s) == int(w)
