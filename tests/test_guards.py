import pytest
from pyspark.sql import functions as F

from cohortline.operators import guards as G
from cohortline.operators import scans as C
from cohortline.plans import dominance as D


def fails(df):
    with pytest.raises(Exception, match="repeats|No |isn't binary|less than"):
        df.collect()


def test_strict_binary(spark):
    ok = spark.createDataFrame([("Yes",), ("no",), ("1",), ("0.0",), (" YES ",)], "t string")
    assert [r[0] for r in ok.select(G.strict_binary("t")).collect()] == [1, 0, 1, 0, 1]
    for bad in ("maybe", "2", None):
        fails(spark.createDataFrame([(bad,)], "t string").select(G.strict_binary("t")))


def test_joins_fail_where_they_do_not_fit(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 0.5), (2, 0.6)], "id long, p double")
    assert sorted(map(tuple, G.complete_left(a, b, ["id"], "p").collect())) == [(1, 0.5), (2, 0.6)]
    fails(G.complete_left(a, b.filter("id = 1"), ["id"], "p"))
    fails(G.one_to_one(a, b.union(b), ["id"]))
    fails(G.lookup(a, b.filter("id = 1"), "id", "p"))
    assert sorted(r.p for r in G.lookup(a, b.filter("id = 1"), "id", "p", F.lit(9.0)).collect()) == [0.5, 9.0]
    fails(G.focus_mask(b, F.col("id") > 0, "p", least=3))
    assert G.focus_mask(b, F.col("id") > 0, "p", 0.05, 1).count() == 1


def test_compatible_frames(spark):
    rows = [(1, 0, 0.5, 1), (2, 1, 0.25, 0)]
    f = lambda r: spark.createDataFrame(r, "id long, target int, reference_pred double, specialist_mask int")
    G.require_compatible({"a": f(rows), "b": f(rows[::-1])})
    for other in ([(1, 0, 0.5, 1)], [(1, 1, 0.5, 1), rows[1]], [(1, 0, 0.6, 1), rows[1]], [(1, 0, 0.5, 2), rows[1]], [(1, 0, 0.5, None), rows[1]]):
        with pytest.raises(ValueError):
            G.require_compatible({"a": f(rows), "b": f(other)})


def test_columns_union_and_weights(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, t string"), spark.createDataFrame([(2, 3, 4.0)], "id int, u int, v double")
    assert G.column_differences(a, b) == {"missing": ["t"], "extra": ["u", "v"], "types": ["id"], "order": ["t"]}
    assert G.tagged_union({"a": (a, 1.0), "b": (b, 0.5)}).count() == 2
    assert C.renormalised({"a": 1.0, "b": 3.0, "c": 9.0}, ["a", "b"]) == {"a": 0.25, "b": 0.75}
    with pytest.raises(ValueError):
        C.renormalised({"a": 1.0}, ["b"])


def test_edge_buckets(spark):
    d = spark.createDataFrame([(0.0,), (0.05,), (0.051,), (0.5,), (0.6,), (-0.1,), (None,)], "x double")
    got = [r[0] for r in d.select(D.edge_bucket(F.col("x"), F.array(*map(F.lit, (0.0, 0.05, 0.5, 0.5))), "c")).collect()]
    assert got == ["c_00", "c_00", "c_01", "c_01", "__missing__", "__missing__", "__missing__"]
