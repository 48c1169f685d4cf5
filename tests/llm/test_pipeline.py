import re

import corpus_pipeline
from test_decontamination import split
from test_mixing import water
from test_near_dedup import brute as classes
from test_secrets import brute as base_spans


def test_each_stage_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    start = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [split(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(x[i : i + min(10, len(x))]) for x in items for i in range(max(1, len(x) - 9)) if x}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if k < 4:
            assert docs.columns == start.columns and all(r.n_chars == len(r.text) for r in after.values())
        if k == 0:
            assert after == before  # all have a language
        elif k == 1:
            assert sorted(after) == sorted({c for _, c in classes([(r.doc_id, r.text) for r in before.values()])})
        elif k == 2:
            for i, r in before.items():
                w = split(r.text)
                hit = {j for n in {len(x) for x in windows} for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for j in range(a, a + n)}
                assert (i in after) == (len(hit) <= 0.5 * len(w))
                if i in after:
                    assert split(after[i].text) == [x for j, x in enumerate(w) if j not in hit] and (hit or r == after[i])
        elif k == 3:
            assert sorted(after) == sorted(before)
            for i, r in before.items():
                assert not base_spans(after[i].text) and (base_spans(r.text) or after[i] == r)
        else:
            size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in before.items()}
            sources = {}
            for i, r in before.items():
                sources[r.source] = sources.get(r.source, 0) + size[i]
            taken = dict.fromkeys(sources, 0)
            for i, r in after.items():
                assert r["size"] == size[i] and 0 <= r.taken <= 2 * size[i]
                taken[before[i].source] += r.taken
            want = water(sources)
            assert all(abs(taken[s] - want[s]) <= 1 for s in sources)
