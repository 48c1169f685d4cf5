import os
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cohortline.llm import phrases
from cohortline.llm.phrases import collocations


def brute(rows, max_words, least, within, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(Fraction(1000000 * a * a, f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            held = any(q != p and len(q) > len(p) and x == lang and b >= least and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in f.items())
            if not held:
                found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def texts(rng, n):
    words = ["New", "york", "ÉTÉ", "été", "a", "b", "the", " x", "日本", "_", "c#"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?"]
    for _ in range(n):
        yield rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("max_words,least,within,top,size", [(3, 3, 50, 2000, 0), (4, 2, 80, 5, 40), (2, 1, 50, 7, 1)])
def test_equals_brute_force(spark, monkeypatch, max_words, least, within, top, size):
    rng = random.Random(max_words)
    rows = list(texts(rng, 150)) + [("en", None), (None, ""), ("en", " . "), ("en", "york " * 500), ("de", "Big Apple. " * 300)]
    rows += rows[:10]
    d = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as a", "3 as LANG").repartition(3)
    if size:
        rows_of = phrases.slices
        monkeypatch.setattr(phrases, "slices", lambda data, off: rows_of(data, off, size))
    got = collocations(d, max_words=max_words, least=least, within=within, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, max_words, least, within, top)


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", None), (None, "one")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_slices_hold_all_pieces(size):
    rng = random.Random(size)
    rows = [t.encode() for _, t in texts(rng, 30)] + [b"", b"x" * 200, b"a b" * 90 + b". c"]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = [b"" for _ in rows]
    for raw, places, numbers in phrases.slices(np.frombuffer(b"".join(rows), np.uint8), off, size):
        ends = [*places[1:], len(raw) + (len(numbers) == 1)]
        for i, a, z in zip(numbers, places, ends):
            got[i] += raw[a : z - 1].tobytes() if len(numbers) > 1 else raw.tobytes()
    assert got == rows


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    want = c.execute(phrases.ORACLE).fetchall()
    assert len(want) > 100 and sorted(map(tuple, phrases.query(spark, data).collect())) == sorted(want)


def test_memory_of_a_batch_stays_small():
    """A worker counts a batch in slices, whatever the batch's size: with slices of 2 MB the arrays took 72 MB here, now 18."""
    rng = np.random.default_rng(3)
    words = rng.choice(np.frombuffer(b"abcdefghijklmnopqrst", np.uint8), (1 << 20, 6))
    words[:, 5] = 32
    data = words.ravel()
    off = np.arange(0, len(data) + 1, 6 * 256)
    sieve = np.full(1 << (phrases.SIEVE_BITS - 6), 2**64 - 1, np.uint64)
    phrases._tables(1)
    tracemalloc.start()
    for raw, places, texts in phrases.slices(data, off):
        for _ in phrases.ngrams(raw, places, np.zeros(len(texts), np.int64), pa.array(["en"]), [sieve]):
            pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 40
