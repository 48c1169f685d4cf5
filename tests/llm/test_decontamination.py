import random
import re

from pyspark.sql import functions as F

from cohortline.llm.decontamination import SuffixAutomaton, contamination, decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window):
    w, hit, ids = split(text), set(), set()
    for name, t in items:
        x = split(t)
        k = min(len(x), window)
        for i in range(len(x) - k + 1 if x else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    if name is not None:
                        ids.add(str(name))
    return len(w), len(hit), sorted(ids)


def longest(w, items):
    out = []
    for j in range(len(w)):
        n = 0
        while n <= j and any(w[j - n : j + 1] == x[i : i + n + 1] for x in items for i in range(len(x))):
            n += 1
        out.append(n)
    return out


def test_automaton_gives_longest_matches():
    rng = random.Random(3)
    for _ in range(60):
        items = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 5))]
        a = SuffixAutomaton([(str(i), x) for i, x in enumerate(items)], 4)
        w = [rng.randrange(4) for _ in range(30)]
        assert a.stream(w)[0] == longest(w, items)


def test_equals_brute_force_in_one_block_or_many(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("aabBcd") + rng.choice(["", "", ",", " é"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 6, 9]))) for i in range(7)] + [(3, "a b c d a b"), (None, "c c c d"), (9, None)]
    docs = [(i, text(rng.choice([0, 3, 12, 40]))) for i in range(40)] + [(7, None), (None, "a b c d a b"), (None, "a b c d a b"), (1, "!?")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *brute(t, items, 4)) for i, t in docs], key=repr)
    for size in (1000, 10):
        got = contamination(d, it, window=4, block_words=size).collect()
        assert sorted([(r._0, r.n_words, r.n_hit, r["items"]) for r in got], key=repr) == want
        for r in got:
            assert sum(s.words for s in r.spans) == r.n_hit
            assert [split(r._1[s.start : s.end]) for s in r.spans] == [split(r._1)[s.first : s.first + s.words] for s in r.spans]


def test_cutting_dropping_and_clashing_names(spark):
    d = spark.createDataFrame(
        [(1, "keep this é a b c d here", "x", 1), (2, "a b c d", "x", 2), (3, None, "x", 3), (4, "", None, 4)],
        "doc_id long, text string, TEXT string, n_words long",
    )
    it = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    got = decontaminate(d, it, window=4)
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect())) == [(1, "keep this é   here", "x", 1), (3, None, "x", 3), (4, "", None, 4)]
    assert decontaminate(d, it.limit(0), window=4).count() == 4
    assert decontaminate(d.filter(F.lit(False)), it, window=4).count() == 0


def test_very_long_text_and_item(spark):
    body = " ".join(f"w{i}" for i in range(60_000))
    d = spark.createDataFrame([(1, "x " * 300_000 + body)], "doc_id long, text string")
    r = contamination(d, spark.createDataFrame([("i", body)], "item_id string, text string"), block_words=30_000).first()
    assert (r.n_words, r.n_hit, r["items"], len(r.spans)) == (360_000, 60_000, ["i"], 1)
