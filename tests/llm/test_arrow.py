import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortline.llm import _arrow as A


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("table,pattern", [(A.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (A.GRAPHIC, r"[^\x20\x09-\x0D]+")])
def test_words_equal_a_regular_expression(monkeypatch, table, pattern):
    monkeypatch.setattr(A, "SLICE_BYTES", 50)
    rng = random.Random(0)
    for _ in range(120):
        texts = ["".join(rng.choice("abABé \n.,9\x00日") for _ in range(rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(rng.randint(0, 8))]
        texts = [None if rng.random() < 0.1 else t for t in texts]
        data, off, valid = A.buffers(pa.array(texts, pa.string()))
        assert valid.tolist() == [t is not None for t in texts]
        got, hashes = [[] for _ in texts], {}
        for _, _, doc, s, e, h in A.words(data, off, table):
            for d, a, b, x in zip(doc, s, e, h):
                w = lower(bytes(data[a:b]).decode())
                got[d].append(w)
                assert hashes.setdefault(w, x) == x
        assert got == [re.findall(pattern, lower(t or "")) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_buffers_of_a_slice_and_of_nothing():
    column = pa.array(["ab", None, "c"])[1:]
    data, off, valid = A.buffers(column)
    assert [bytes(data[a:b]) for a, b in zip(off, off[1:])] == [b"", b"c"] and valid.tolist() == [False, True]
    assert len(A.buffers(pa.array([], pa.string()))[1]) == 1
    assert np.array_equal(A.buffers(pa.array([None, None], pa.string()))[1], [0, 0, 0])
