import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cohortline.llm import near_dedup as N

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(t):
    w = PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t)}


def brute(docs):
    """Least id of each document's class, by all pairs."""
    sets = [None if t is None else shingle_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or ():
            holders[x].append(i)
    near = {(i, j) for h in holders.values() for k, i in enumerate(h) for j in h[k + 1 :]}
    for i, j in near:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, least.get(root(i))) for i, (d, _) in enumerate(docs)), key=repr)


@pytest.mark.parametrize("kind", ["one", "whole", "real"])
def test_agreement_is_weighted_similarity(kind):
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 150).astype(np.uint64)
        w = {"one": np.ones(150), "whole": rng.integers(1, 5, 150).astype(float), "real": rng.uniform(0.2, 3, 150)}[kind]
        v = np.where(rng.random(150) < 0.3, w * 0.5 if kind == "real" else np.maximum(1, w - 1), w)
        s = N.dart_signatures(np.repeat([0, 1], 100), np.concatenate([x[:100], x[50:]]), np.concatenate([w[:100], v[50:]]), 2)
        a, b = np.zeros(150), np.zeros(150)
        a[:100], b[50:] = w[:100], v[50:]
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_classes_of_the_smallest_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = N.query(spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute(docs)


def edited(rng, words, share):
    return " ".join(rng.choice(["x", "yy", "zed"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = [(1000 + i, edited(rng, base, rng.choice([0.01, 0.02, 0.04]))) for i in range(400)]
    docs += [(2000 + i, " ".join(f"v{rng.randrange(500)}" for _ in range(60))) for i in range(50)]
    docs += [(i, docs[0][1]) for i in range(30)] + [(3000, None), (3001, None), (3002, ""), (3003, ""), (3004, "?!"), (3005, "one two"), (3006, "One, two!"), (3007, "one two three"), (None, "?!"), (7, docs[0][1])]
    docs += [(4000, "long " * 100_000 + "tail"), (4001, "long " * 100_000 + "tails")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as class_id", "'T' as TEXT").repartition(5)
    want = brute(docs)
    got = N.near_duplicates(d).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == want
    kept = N.one_of_each(d)
    assert kept.columns == d.columns
    nulls = sum(t is None for _, t in docs)
    assert sorted(r[0] for r in kept.collect()) == sorted({c for _, c in want}) and nulls == 2


def test_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(d).count() == 0 and N.one_of_each(d).count() == 0
    d = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert N.near_duplicates(d).count() == 1 and N.one_of_each(d).count() == 1


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(8)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(120)]
    edges = [(ids[i], ids[i + 1]) for i in range(40)] + [(ids[50], ids[i]) for i in range(51, 80)] + [(ids[80 + i], ids[80 + (i + 1) % 10]) for i in range(10)] + [(ids[100], ids[101])] * 3
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = [(r.node, r.comp) for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in up)
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0
