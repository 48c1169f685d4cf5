import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cohortline.llm import tokens as T


@pytest.fixture(scope="module")
def enc():
    return T.encoder(T.vocabulary_path(), P.PATTERN)


def random_text(rng):
    return "".join(rng.choice(["the", " of", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "1234", "'s", "!?", "<|endoftext|>", " \n", " ", "a" * 30]) for _ in range(rng.randint(0, 40)))


def test_offsets_equal_another_encoder(enc):
    rng = random.Random(4)
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for _ in range(400):
        t = random_text(rng)
        sizes = enc.sizes(t) if t else np.zeros(0, int)
        assert np.array_equal(sizes, enc._encode(t)) and sizes.sum() == len(t.encode())
        got = whole.encode(t, add_special_tokens=False)
        byte = np.cumsum([0, *[len(c.encode()) for c in t]])
        char = lambda x, t=byte: int(np.searchsorted(t, x, "right")) - 1
        ends = np.cumsum(sizes)
        assert [(char(a), char(z - 1) + 1) for a, z in zip(ends - sizes, ends)] == [tuple(x) for x in got.offsets]


@pytest.mark.parametrize("rule", T.RULES)
def test_attribution_equals_brute_force(rule):
    rng = random.Random(5)
    for _ in range(300):
        sizes = np.array([rng.randint(1, 5) for _ in range(rng.randint(0, 12))], int)
        total = int(sizes.sum())
        borders = np.array([0, *sorted(rng.randint(0, total) for _ in range(rng.randint(0, 5))), total])
        want, over, at = np.zeros(len(borders) - 1), 0, 0
        for n in sizes:
            own = [max(0, min(at + n, z) - max(at, a)) for a, z in zip(borders, borders[1:])]
            over += sum(x > 0 for x in own) > 1
            k = next(i for i, x in enumerate(own) if x) if rule == "first" else int(np.argmax(own))
            want += np.array(own) / n if rule == "share" else np.eye(len(own))[k]
            at += n
        counts, crossing = T.attribute(sizes, borders, rule)
        assert np.allclose(counts, want) and crossing == over


def test_lines_fields_and_odd_rows(spark, enc):
    rows = [(1, "one line\nand two\n\n\nfour", "x"), (2, None, "x"), (3, "", None), (4, "\n", "x"), (5, "word " * 200_000, "x"), (5, "a", "x"), (5, "a", "x"), (None, " " * 30_000 + "b", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, tokens string").selectExpr("*", "1 as TEXT")
    got = T.by_line(d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert sum(r["tokens"]) == r.n_tokens and len(r["tokens"]) == r.n_sections and r.n_tokens == len(enc._encode(r._1 or ""))
        assert r.n_sections == len((r._1 or "").splitlines())
    assert next(r for r in got if r._0 == 1).n_crossing == 1
    two = T.by_fields(d.filter("doc_id = 1"), ["tokens", "text"], rule="share").first()
    assert two.n_sections == 2 and sum(two["tokens"]) == pytest.approx(two.n_tokens) and two.n_tokens == len(enc._encode("x" + rows[0][1]))
    assert T.by_line(d.limit(0)).count() == 0
