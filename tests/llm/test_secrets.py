import hashlib
import random
import re

from cohortline.llm import secrets as S


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def random_text(rng):
    parts = ["token", "Token", "API_KEY", "apikey", "toKen", "paſsword", "secret", ":", "=", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ABC123", "abcdef0123", "é", "東", "\n", "x.y/z", "abc"]
    return "".join(rng.choice(parts) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randint(0, 40)))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(3000):
        t = random_text(rng)
        assert S.base_spans(t) == brute(t), t


def test_merging_keeps_counts_and_learns_a_format():
    rng = random.Random(1)
    values = ["sk_" + "".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(200)]
    a = S.Automaton([S.symbols(v) for v in values])
    assert len(a.next) < 12 and sum(a.counts[0].values()) == 200 and sum(sum(c.values()) for c, k in zip(a.counts, a.level) if k == 1) == 200
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(16, 22))) for _ in range(500)]
    g = S.Grammar({0: values, 1: [], 2: []}, words)
    more = "sk_" + "".join(rng.choice("0123456789abcdef") for _ in range(20))
    assert g.kind(more) == 0 and all(g.kind(w) < 0 for w in words)
    t = f"é {more} and {words[0]}"
    assert g.added(t, []) == [(2, 0, 25)] and g.added(t, [(5, 2, 9)]) == []


def test_query_rows_and_cut_texts(spark):
    rng = random.Random(3)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = [(i, f"é say token = \"{hexa(40)}\" then ththeonanerthing{'e' * (i % 5)} on") for i in range(60)]
    docs += [(100, None), (101, ""), (None, "AKIA" + "Z9" * 10), (102, "x " * 300_000 + "password: hunter22"), (103, hexa(30)), (103, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as spans", "7L as n_chars", "'T' as TEXT")
    grammar = S.learn(d)
    got = S.scan(d, grammar).collect()
    assert len(got) == len(docs)
    for r in got:
        base = [(x.start, S.KINDS.index(x.kind), x.end) for x in r["base"]]
        assert base == brute(r._1) and all(x in r.spans for x in r["base"])
    assert len({(r._1, str(r.spans)) for r in got}) == len({t for _, t in docs})
    cut = S.without_secrets(d)
    assert cut.columns == d.columns and cut.count() == len(docs)
    for r in cut.collect():
        assert not brute(r[1]) and (r[1] is None or "[SECRET]" not in r[1] or r[3] == len(r[1]))
    assert S.scan(d.limit(0), S.learn(d.limit(0))).count() == 0


def test_digest_of_the_query(spark):
    got = S.query(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got:
        base = brute(texts[r.doc_id])
        said = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))


def test_sampled_credentials_without_a_keyword_are_found(spark):
    rng = random.Random(5)
    key = lambda: "sk_" + "".join(rng.choice("0123456789abcdef") for _ in range(20))
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(16, 22)))
    planted = [key() for _ in range(40)]
    plain = [word() for _ in range(60)] + [str(rng.randrange(10**15, 10**16)) for _ in range(3)]
    docs = [(f"token={key()} then",) for _ in range(40)] + [(f"it is {k} here",) for k in planted] + [(f"so {w} on",) for w in plain]
    d = spark.createDataFrame(docs, "text string")
    got = {r._0: [(x.kind, r._0[x.start : x.end]) for x in r.spans] for r in S.scan(d, S.learn(d)).collect()}
    assert all(got[f"it is {k} here"] == [("assign", k)] for k in planted) and all(got[f"so {w} on"] == [] for w in plain)


def test_short_candidates_and_tokens_around_a_base_span(spark):
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    short = ["sk_" + hexa(9) for _ in range(30)]
    around = ["ghp_" + hexa(24) + "XYZ", "x/" + hexa(24) + "-" + hexa(30), "AKIA" + "Z9" * 10 + "abc"]
    alone = ["(" + hexa(24) + ".)", "mytoken=" + hexa(24), "token = " + "x-" + hexa(24)]
    plain = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(6, 15))) for _ in range(200)] + ["2024-11-26", "555-8590", "10.20.30.40"]
    docs = [(f"token=sk_{hexa(9)} then",) for _ in range(300)] + [(f"it is {k} here",) for k in [*short, *around, *alone, *plain]]
    d = spark.createDataFrame(docs, "text string")
    got = {r._0: r for r in S.scan(d, S.learn(d)).collect()}
    spans = lambda x: {r._0[s.start : s.end] for r in [got[f"it is {x} here"]] for s in r.spans}
    assert all(x in spans(x) for x in [*short, *around])
    assert all(len(got[f"it is {x} here"].spans) == len(got[f"it is {x} here"]["base"]) for x in [*alone, *plain])
    cut = {r[0] for r in S.without_secrets(d, n_chars=None).collect()}
    assert "it is [SECRET] here" in cut and not any(x[4:20] in t for x in [*short, *around] for t in cut)


def test_states_tell_formats_apart_and_unlabelled_credentials_of_each_are_added(spark):
    rng = random.Random(8)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kinds = [lambda: "ghp_" + of(mixed, 36), lambda: of(up, 32), lambda: "-".join(of(low, n) for n in (8, 4, 4, 4, 12))]
    a = S.Automaton([S.symbols(k()) for k in kinds for _ in range(100)])
    assert len(a.next) > 8 and a.level.count(2) > 3
    score = [a.score(S.symbols(k())) for k in kinds]
    assert all(x > a.score(S.symbols(of(mixed, n))) + 20 for x, n in zip(score, (40, 32, 36)))
    planted = [k() for k in kinds for _ in range(20)]
    plain = [of("etaoinshr", rng.randint(6, 20)) for _ in range(300)] + ["2024-11-26", "http://www.example.org/index.html", "INTERNATIONAL"]
    docs = [(f"api_key={k()} then",) for k in kinds for _ in range(120)] + [(f"it is {x} here",) for x in [*planted, *plain]]
    d = spark.createDataFrame(docs, "text string")
    got = {r._0: r for r in S.scan(d, S.learn(d)).collect()}
    assert [(v, got[f"it is {v} here"].spans) for v in planted if [(x.start, x.end) for x in got[f"it is {v} here"].spans] != [(6, 6 + len(v))]] == []
    assert all(not got[f"it is {v} here"].spans for v in plain)
