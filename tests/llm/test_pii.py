import re

import pytest

from cohortline.llm import pii as P

ROWS = [
    (1, "Mail ann.b@mail6.example.com or ANN.B@mail6.example.com, call +1 (456) 555-2186 now."),
    (2, "Same: ann.b@mail6.example.com; +1 456 555 2186; card 4111 1111 1111 1111, 4111111111111111 and 9777946427004852"),
    (3, "IP 53.183.220.240 and 8.8.8.8, v2.0, 3.14, 1.2.3, token = \"0699380317fbdbd72283411a858f5\""),
    (4, "Frau Müller met Mrs. Anna Müller and Mr Smith; Иван Петров, Dr. Petrov"),
    (5, "DE89 3704 0044 0532 0130 00 and 123-45-6789"),
    (6, "Nothing personal here. The version 2.0 of 1234 or 12345678901."),
    (7, None),
    (8, ""),
    (9, "élan.24@mail6.example.com"),
    (10, "word " * 100_000 + "ann.b@mail6.example.com"),
    (10, "word " * 100_000 + "ann.b@mail6.example.com"),
    (None, "x" * 300_000 + " 1 2 3"),
]


@pytest.fixture(scope="module")
def got(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'c' as n_entities", "'T' as TEXT", "1 as kind")
    rows = P.pseudonymise(d, key="k").collect()
    assert len(rows) == len(ROWS) and {r[2] for r in rows} == {"c"}
    return {r._0: r for r in rows}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10


def test_coreference_and_format(got):
    a = re.fullmatch(r"Mail (\S+) or (\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}) now\.", got[1]._1)
    b = re.fullmatch(r"Same: (\S+); (\+1 \d{3} \d{3} \d{4}); card (\d{4} \d{4} \d{4} \d{4}), (\d{16}) and (\d{16})", got[2]._1)
    assert a and b and a[1] == b[1] and a[2][:5] == a[1][:5].upper() and a[1] != "ann.b@mail6.example.com" and a[1].endswith(".com")
    assert re.sub(r"\D", "", a[3]) == re.sub(r"\D", "", b[2]) != "14565552186"
    assert b[3].replace(" ", "") == b[4] != "4111111111111111" and luhn(b[4]) == 0 and b[4][0] == "4" and luhn(b[5]) != 0
    assert got[10]._1 == "word " * 100_000 + a[1] and got[10][-1] == 1


def test_other_kinds(got):
    m = re.fullmatch(r'IP (\d+\.\d+\.\d+\.\d+) and (\d\.\d\.\d\.\d), v2.0, 3.14, 1.2.3, token = "0699380317fbdbd72283411a858f5"', got[3]._1)
    assert m and m[1] != "53.183.220.240" and [len(x) for x in m[1].split(".")] == [2, 3, 3, 3] and all(int(x) < 256 for x in m[1].split("."))
    m = re.fullmatch(r"Frau (\w+) met Mrs\. (\w+) (\w+) and Mr (\w+); (\w+) (\w+), Dr\. (\w+)", got[4]._1)
    assert m and m[1] == m[3] and "ller" not in got[4]._1 and m[2] in P.NAMES["f", "latin"] and m[5] in P.NAMES["m", "cyrillic"]
    assert re.fullmatch("[а-яА-Я]+", m[6]) and re.fullmatch("[A-Za-z]+", m[7])
    iban, ssn = got[5]._1.split(" and ")
    s = iban.replace(" ", "")
    assert iban != ROWS[4][1][:27] and [len(x) for x in iban.split(" ")] == [4, 4, 4, 4, 4, 2] and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != "123-45-6789"
    assert re.fullmatch(r"[^\W\d]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", got[9]._1) and ord(got[9]._1[0]) > 127


def test_texts_without_entities_stay(got):
    for i, t in ROWS:
        if i in (6, 7, 8, None):
            assert got[i]._1 == t and got[i][-1] == 0


def test_distinct_and_never_an_entity(spark):
    ips = [f"{a}.{b}.1.{c}" for a in range(1, 9) for b in range(1, 9) for c in range(1, 9)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "doc_id long, text string")
    new = [r._1 for r in P.pseudonymise(d, key="k").collect()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)
    assert P.pseudonymise(d.limit(0), key="k").count() == 0


def test_one_surrogate_of_a_surname_in_all_names(spark):
    sur = sorted({a + b + c for a in ("Bar", "Kel", "Mor", "Tan") for b in "aeiou" for c in ("ck", "dt", "ff", "gg", "ll", "mm", "nn", "pp", "rr", "ss", "tt", "zz")})
    greek = ["Π" + a + b + c for a in "αειου" for b in "βγδζθκλμνξ" for c in "αεηιο"]
    rows = [(f"Mr {x}", f"Mrs Anna {x}", f"Peter {x}") for x in [*sur, *(f"{x}{y}" for x in sur for y in ("er", "in", "ow")), *greek]]
    d = spark.createDataFrame([(" ; ".join(r),) for r in rows], "text string")
    got = [re.fullmatch(r"Mr (\w+) ; Mrs (\w+) (\w+) ; (\w+) (\w+)", r[0]) for r in P.pseudonymise(d, key="k").collect()]
    assert len(got) == len(rows) and all(m and m[1] == m[3] == m[5] for m in got)
    assert len({m[1] for m in got}) == len(rows) and not {m[1] for m in got} & {r[0][3:] for r in rows}
    assert {m[2] for m in got} <= set(P.NAMES["f", "latin"]) - {"Anna"} and len({m[2] for m in got}) == 1


def test_the_space_of_surnames_grows(spark, monkeypatch):
    monkeypatch.setitem(P.SYLLABLES, "latin", ["ba", "do"])
    d = spark.createDataFrame([(f"Mr K{a}{b}x",) for a in "aeiou" for b in "bcdfglmnrst"], "text string")
    got = {r[0] for r in P.pseudonymise(d, key="k").collect()}
    assert len(got) == 55 and all(re.fullmatch(r"Mr (Ba|Do)(ba|do)+", t) for t in got)


def test_a_full_format_keeps_its_form_and_stays_distinct(spark):
    ips = [f"{i // 1000 % 10}.{i // 100 % 10}.{i // 10 % 10}.{i % 10}" for i in range(0, 10_000) if i % 5 < 3]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "doc_id long, text string")
    new = [r._1 for r in P.pseudonymise(d, key="k").sort("_0").collect()]
    assert len(ips) == 6000 and len(set(new)) == 6000 and all(re.fullmatch(r"\d\.\d\.\d\.\d", x) for x in new)
    assert all(a != b for a, b in zip(ips, new))


def test_the_permutation_is_one_without_fixed_points(spark):
    radices = [3, 1, 4, 2]
    rows = [([a, 0, b, c],) for a in range(3) for b in range(4) for c in range(2)]
    d = spark.createDataFrame(rows, "v array<int>")
    for key in ("a", "b"):
        new = [tuple(r[0]) for r in d.select(P._permuted(P.F.col("v"), P.F.array(*map(P.F.lit, radices)), key, P.F.lit("t"))).collect()]
        assert sorted(new) == sorted(tuple(r[0]) for r in rows) and all(x != tuple(r[0]) for x, r in zip(new, rows))


def test_wrong_checks_stay_wrong_and_unknown_letters_are_replaced(spark):
    rows = ["4111111111111111", "4111111111111112", "DE89370400440532013000", "DE88370400440532013000", "ab\u05d0\u05d1@ex.com", "\u05d2\u05d3@ex.com"]
    new = [r._0 for r in P.pseudonymise(spark.createDataFrame([(x,) for x in rows], "text string"), key="k").collect()]
    got = dict(zip(rows, new)) if len(new) == len(rows) else {}
    assert len(set(new)) == len(rows) and not set(new) & set(rows) and len(got) == 6
    cards = [x for x in new if x.isdigit()]
    assert sorted(luhn(x) == 0 for x in cards) == [False, True] and all("\u05d0" > c for x in new for c in x)


def test_several_given_names_and_particles(spark):
    texts = ["Dr Anna Maria Schmidt came.", "Peter van der Berg and Mr de la Cruz left; Anna was there.", "Mr van Berg knows Schmidt."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b, c = (r[1] for r in sorted(map(tuple, P.pseudonymise(d, key="k").select("_0", "_1").collect())))
    m = re.fullmatch(r"Dr (\w+) (\w+) (\w+) came\.", a)
    assert m and not {"Anna", "Maria", "Schmidt"} & set(m.groups()) and {m[1], m[2]} <= set(P.NAMES["f", "latin"]) and m[1] != m[2]
    n = re.fullmatch(r"(\w+) van der (\w+) and Mr de la (\w+) left; Anna was there\.", b)
    assert n and n[1] in P.NAMES["m", "latin"] and not {"Peter", "Berg", "Cruz"} & set(n.groups())
    o = re.fullmatch(r"Mr van (\w+) knows Schmidt\.", c)
    assert o and o[1] == n[2]  # one surname, one surrogate
