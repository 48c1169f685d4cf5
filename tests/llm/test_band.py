import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from cohortline.llm import band
from cohortline.llm.band import Band, Region, band_pairs, cover, near_prices, tiled


def brute(items, lines, k, b):
    sold = []
    for sale, no, item, q, amount in lines:
        if None not in (sale, item, q, amount) and q and math.isfinite(amount):
            a = math.floor(100 * amount + 0.5)
            sold.append(((2 * a + q) // (2 * q), sale, -(2**63) if no is None else no, item, zlib.crc32(f"{sale},{'' if no is None else no},{item}".encode())))
    out = []
    for item, price in items:
        near = []
        if item is not None and price is not None and math.isfinite(price):
            p = math.floor(100 * price + 0.5)
            near = sorted((abs(u - p), u, s, n, i, c) for u, s, n, i, c in sold if i != item and (abs(u - p) <= b.apart or 1000 * abs(u - p) <= b.permille * min(u, p)))
        sums = (len(near), sum(x[0] for x in near), sum(x[5] for x in near))
        out += [(item, n + 1, *x[:3], None if x[3] == -(2**63) else x[3], x[4], *sums) for n, x in enumerate(near[:k])] or [(item, 0, *[None] * 5, *sums)]
    return sorted(out, key=repr)


def rows(rng, wide):
    price = lambda: rng.choice([1.0, 1.0, 2.5, rng.randrange(100, wide) / 100, rng.randrange(100, wide) / 100])
    items = [(i, price()) for i in range(60)] + [(None, 1.0), (3, None), (5, math.nan), (6, math.inf), (7, 1e300), (8, -4.0), (9, 0.0), (2, 1.0), (2, 1.0), (61, 1e7)]
    lines = []
    for i in range(900):
        q = rng.choice([1, 2, 3, 7, 50])
        lines.append((rng.randrange(200), rng.choice([1, 2, 3, None]), rng.choice([2, 2, rng.randrange(60)]), q, round(price() * q, 2)))
    lines += [(None, 1, 1, 1, 1.0), (1, 1, None, 1, 1.0), (1, 1, 1, None, 1.0), (1, 1, 1, 1, None), (1, 1, 1, 0, 1.0), (1, 1, 1, -2, 5.0), (1, 1, 1, 2, -9.0), (1, 1, 1, 1, math.nan), (4, 1, 1, 1, -4.02)]
    return items, lines + lines[:40]


@pytest.mark.parametrize("k,b,wide,least", [(10, Band(50, 5), 30000, 2048), (3, Band(0, 5), 300, 16), (4, Band(200, 100), 900, 8)])
def test_equals_brute_force(spark, monkeypatch, k, b, wide, least):
    monkeypatch.setattr(band, "LEAST_ROWS", least)
    monkeypatch.setattr(band, "MOST_ROWS", max(least, 64))
    items, lines = rows(random.Random(wide), wide)
    i = spark.createDataFrame(items, "item_id long, price double").selectExpr("*", "1 as p", "2 as ITEM_ID", "3 as near").repartition(2)
    s = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, quantity int, amount double").selectExpr("*", "1 as u", "2 as n", "3 as kind").repartition(3)
    got = near_prices(i, s, k=k, band=b)
    assert got.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(items, lines, k, b)


def test_empty_sides(spark):
    i = spark.createDataFrame([(1, 2.0)], "item_id long, price double")
    s = spark.createDataFrame([(1, 1, 2, 1, 2.0)], "sale_id long, line_no int, item_id long, quantity int, amount double")
    assert [tuple(r) for r in near_prices(i, s.limit(0)).collect()] == [(1, 0, None, None, None, None, None, 0, 0, 0)]
    assert near_prices(i.limit(0), s).count() == 0
    assert near_prices(i, s).first()["n_pairs"] == 1


@pytest.mark.parametrize("least", [8, 4096])
def test_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(band, "LEAST_ROWS", least)
    monkeypatch.setattr(band, "MOST_ROWS", max(least, 64))
    rng = random.Random(5)
    value = lambda: rng.choice([None, 100, 100, -7, 0, rng.randrange(5000), 2**60])
    left, right = [(i, value()) for i in range(200)], [(i, value()) for i in range(300)] + [(None, 5)]
    got = band_pairs(*[spark.createDataFrame(x, "id long, value long").selectExpr("*", "1 as v") for x in (left, right)], band=Band(3, 20))
    want = [(i, x, j, y) for i, x in left for j, y in right if None not in (x, y) and max(x, y) < 2**60 and (abs(x - y) <= 3 or 1000 * abs(x - y) <= 20 * min(x, y))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert band_pairs(spark.createDataFrame([], "id long, value long"), spark.createDataFrame(right, "id long, value long")).count() == 0


def test_ends_of_the_band():
    x = np.arange(-300, 4000)
    for b in (Band(50, 5), Band(0, 5), Band(1, 300)):
        low, high = b.ends(x)
        for i in range(0, len(x), 7):
            near = x[(np.abs(x - x[i]) <= b.apart) | (1000 * np.abs(x - x[i]) <= b.permille * np.minimum(x, x[i]))]
            assert near.min() == max(low[i], -300) and near.max() == min(high[i], 3999)
        assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()


def test_regions_cover_each_cell_of_the_band_once_and_are_balanced():
    rng = np.random.default_rng(1)
    side = lambda n: np.array([(i, c, 10 * i, 10 * i + 9) for i, c in enumerate(rng.integers(1, 50, n))])
    rows, columns, b = side(300), side(400), Band(25, 0)
    rows[40, 1] = 900
    regions = cover(rows, columns, b, 200)
    cells = [(i, j) for r in regions for i in range(r.row, r.row_end) for j in range(r.column, r.column_end)]
    assert len(cells) == len(set(cells))
    low, high = b.ends(rows[:, 2])[0], b.ends(rows[:, 3])[1]
    assert {(i, j) for i in range(300) for j in range(400) if columns[j, 3] >= low[i] and columns[j, 2] <= high[i]} <= set(cells)
    load = [rows[r.row : r.row_end, 1].sum() / r.down + columns[r.column : r.column_end, 1].sum() / r.across for r in regions]
    assert max(load) <= 200
    assert [r.first for r in regions] == np.cumsum([0, *[r.down * r.across for r in regions]])[:-1].tolist()
    assert isinstance(tiled(rows, columns, b, 4)[0], Region) and tiled(rows[:0], columns, b, 4) == []


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    want = c.execute(band.ORACLE).fetchall()
    assert len(want) > 100 and sorted(map(tuple, band.query(spark, data).collect()), key=repr) == sorted(want, key=repr)
