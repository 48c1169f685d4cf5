import itertools
import zlib

import numpy as np
import pyarrow as pa

from cohortline.llm import _arrow as A
from cohortline.llm import language as L


def brute(model, emit, first):
    out = np.zeros_like(emit)
    begins = np.flatnonzero(first)
    for a, z in zip(begins, np.append(begins[1:], len(emit))):
        for y in itertools.product(range(emit.shape[1]), repeat=int(z - a)):
            v = model.start[y[0]] + sum(emit[a + i, k] for i, k in enumerate(y)) + sum(model.trans[p, q] for p, q in zip(y, y[1:]))
            for i, k in enumerate(y):
                out[a + i, k] += np.exp(v)
    return out / out.sum(1, keepdims=True)


def test_marginals_and_pairs_equal_brute_force(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 3)
    rng = np.random.default_rng(0)
    m = L.Chain(["a", "b", "c"])
    for _ in range(10):
        m.trans, m.start = rng.normal(size=(3, 3)), rng.normal(size=3)
        emit, first = rng.normal(size=(17, 3)), np.isin(np.arange(17), [0, 1, 5, 11])
        post = m.marginals(emit, first)
        assert np.allclose(post, brute(m, emit, first))
        joint, seen = L._pairs(m, emit, first, post, np.zeros(17, int))
        assert np.allclose(joint.sum(0), post[~first].sum(0)) and seen[0, 0] == 13


def test_long_sequences_stay_finite():
    m = L.Chain(["a", "b"])
    emit = np.tile([[30.0, -30.0], [-30.0, 30.0]], (5000, 1))
    assert np.isfinite(m.marginals(emit, np.arange(10_000) == 0)).all()


def test_held_out_accuracy_and_code_switching(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and len(r.text) <= L.SAMPLE_CHARS]
    m = L.fit([r.text for r in learned], [r.lang for r in learned], epochs=2)
    d = spark.createDataFrame([(r.doc_id, r.text) for r in held], "doc_id long, text string")
    got = {r._0: r for r in L.identify(d, m).collect()}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    en, fr = (" ".join(next(r.text for r in held if r.lang == x and len(r.text) > 400).split()[:40]) for x in ("en", "fr"))
    data, off, _ = A.buffers(pa.array([f"{en} {fr}"]))
    (_, _, doc, s, e, h), = A.words(data, off)
    post = m.marginals(m.emissions(data, s, e, h)[0], np.diff(doc, prepend=-1) != 0).argmax(1)
    half = len(list(A.words(*A.buffers(pa.array([en]))[:2]))[0][3])
    assert np.mean(post[:half] == m.languages.index("en")) > 0.85 and np.mean(post[half:] == m.languages.index("fr")) > 0.85


def test_nulls_no_letters_long_and_clashing(spark):
    rows = [(i, "the cat and the dog sat " * 3 if i % 2 else "le chat et le chien dans la maison " * 3, "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 345 !! ☃ ²", "fr"), (103, "the dog " * 100_000, None), (104, "東京", None), (104, "東京", None), (None, "the dog", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as Lang")
    m = L.train(d.filter("doc_id < 100"))
    got = {r._0: r for r in L.identify(d, m).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == got[None].lang_pred == "en" and got[104].lang_pred in ("en", "fr")
    kept = L.keep_identified(d)
    assert kept.columns == d.columns and {r[0] for r in kept.collect()} == set(range(60)) | {103, 104, None}
    empty = d.limit(0)
    assert L.identify(empty, L.train(empty)).count() == 0 and L.identify(d, L.Chain([])).filter("lang_pred <> 'und'").count() == 0


def test_mixed_texts_of_certain_words_are_kept(spark):
    words = {"en": "the dog sat with that white thing", "fr": "chien maison dans cette jolie rue bleue", "de": "hund und schwarze katze gehen nicht", "ru": "собака идет домой через большой лес"}
    rows = [(i, f"{words[x]} " * 3, x) for i in range(80) for x in [sorted(words)[i % 4]]]
    rows += [(100, " ".join(f"{w} " * 6 for w in words.values()), "en"), (101, "1 2 3", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.train(d.filter("doc_id < 80"))
    r = L.identify(d.filter("doc_id = 100"), m).first()
    assert r.score < 0.4 < 0.9 < r.certainty
    kept = {x.doc_id for x in L.keep_identified(d).collect()}
    assert 100 in kept and 101 not in kept
    flat = L.Chain(["a", "b", "c"])
    assert abs(L.identify(d.filter("doc_id = 100"), flat).first().certainty - 1 / 3) < 1e-6
