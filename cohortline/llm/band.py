"""Numeric band joins by tiling the matrix of both sides' values.

The rows of the matrix are the left side's values, its columns the right side's. A histogram of each side, with a bounded
number of bins, tells which of its cells the band crosses; rectangles of about equal numbers of rows cover these cells and no
others. Each rectangle is one region of the join: a value goes to the regions of its row or column, and within a region
the band's ends are found by binary search in the sorted columns. A bin that holds too many rows for a region is dealt over
several by a hash. What the driver holds, and what is broadcast, are bins and regions, never rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import pick, saved, table

#: Bins between a number and its double; at most 2 * 53 * BINS + 1 in all.
BINS = 256
#: Values up to this size take part.
LARGEST = 2**52
#: Rows that a region holds at least and at most; between them, as many as leave a few regions for each reducer.
LEAST_ROWS, MOST_ROWS, PER_REDUCER = 2048, 200_000, 2
#: Stands for a null line number, which comes before all others.
NO_LINE = -(2**63)


@dataclass(frozen=True)
class Band:
    """Numbers x and y are near if |x - y| <= apart or 1000 |x - y| <= permille * min(x, y)."""

    apart: int = 50
    permille: int = 5

    def ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest number near x: both never fall as x rises."""
        some = np.maximum(x, 0)
        low = -(-1000 * some // (1000 + self.permille))
        return np.minimum(x - self.apart, np.where(x > 0, low, x)), np.maximum(x + self.apart, x + self.permille * some // 1000)

    def columns(self, x: str) -> tuple[Column, Column]:
        low = F.expr(f"least({x} - {self.apart}, if({x} > 0, (1000 * {x} + {999 + self.permille}) div {1000 + self.permille}, {x}))")
        return low, F.expr(f"greatest({x} + {self.apart}, {x} + ({self.permille} * greatest({x}, 0)) div 1000)")


def binned(x: str) -> Column:
    """The number of a value's bin, which never falls as the value rises."""
    size = F.abs(F.col(x))
    return F.when(size > 0, F.signum(F.col(x)).cast("int") * (1 + F.floor(F.log2(size) * BINS).cast("int"))).otherwise(0)


def histogram(df: DataFrame, value: str) -> np.ndarray:
    """(bin, rows, least value, greatest value) of each bin that has rows, in order."""
    rows = df.groupBy(binned(value).alias("bin")).agg(F.count("*"), F.min(value), F.max(value)).collect()
    return np.array(sorted(map(tuple, rows)), dtype=np.int64).reshape(-1, 4)


@dataclass(frozen=True)
class Region:
    """Bins [row, row_end) by [column, column_end) of the histograms, dealt over across * down regions from number first on."""

    row: int
    row_end: int
    column: int
    column_end: int
    down: int
    across: int
    first: int


def _blocks(counts: np.ndarray, at: int, end: int, most: int) -> list[tuple[int, int, int]]:
    """Runs of bins with no more than `most` rows, or with one bin: (from, to, the rows in units of most)."""
    total = np.concatenate([[0], np.cumsum(counts[at:end])])
    out, i = [], 0
    while at + i < end:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        out.append((at + i, at + j, max(1, -int(-(total[j] - total[i]) // most))))
        i = j
    return out


def cover(rows: np.ndarray, columns: np.ndarray, band: Band, size: int) -> list[Region]:
    """Rectangles over all cells that the band crosses, each with about `size` rows of both sides at most."""
    out, first, half = [], 0, max(1, size // 2)
    for i, j, down in _blocks(rows[:, 1], 0, len(rows), half):
        low, high = band.ends(rows[i:j, 2])[0][0], band.ends(rows[i:j, 3])[1][-1]
        c, d = int(np.searchsorted(columns[:, 3], low)), int(np.searchsorted(columns[:, 2], high, "right"))
        for a, b, across in _blocks(columns[:, 1], c, d, half):
            out.append(Region(i, j, a, b, down, across, first))
            first += down * across
    return out


def tiled(rows: np.ndarray, columns: np.ndarray, band: Band, reducers: int) -> list[Region]:
    """The cover whose regions are smallest without being more than PER_REDUCER for each reducer, between the limits."""
    low, high = LEAST_ROWS, MOST_ROWS
    while low < high:
        size = (low + high) // 2
        regions = cover(rows, columns, band, size)
        many = regions[-1].first + regions[-1].down * regions[-1].across if regions else 0
        low, high = (size + 1, high) if many > PER_REDUCER * reducers else (low, size)
    return cover(rows, columns, band, low)


def dealt(left: DataFrame, right: DataFrame, left_value: str, right_value: str, band: Band) -> tuple[DataFrame, DataFrame]:
    """Both sides with the regions that each row goes to; every pair of near values meets in exactly one."""
    spark = left.sparkSession
    rows, columns = histogram(left, left_value), histogram(right, right_value)
    regions = tiled(rows, columns, band, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def side(df, value, bins, ranges, own, other, many, step, step_own):
        at = [(int(bins[i, 0]), r.first, own(r), other(r), many(r)) for r in regions for i in range(*ranges(r))]
        of = spark.createDataFrame(at, "bin int, first int, own int, other int, across int")
        hashed = F.pmod(F.xxhash64(value), F.col("own")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col("other") - 1))
        joined = df.withColumn("bin", binned(value)).join(F.broadcast(of), "bin").select(*df.columns, "first", "across", hashed.alias("own"), copies.alias("copy"))
        return joined.select(*df.columns, (F.col("first") + F.col(step_own) * F.col("across") + F.col(step)).alias("region"))

    a = side(left, left_value, rows, lambda r: (r.row, r.row_end), lambda r: r.down, lambda r: r.across, lambda r: r.across, "copy", "own")
    b = side(right, right_value, columns, lambda r: (r.column, r.column_end), lambda r: r.across, lambda r: r.down, lambda r: r.across, "own", "copy")
    return a, b


def band_pairs(left: DataFrame, right: DataFrame, *, band: Band = Band(), left_id: str = "id", left_value: str = "value", right_id: str = "id", right_value: str = "value") -> DataFrame:
    """left_id, left_value, right_id, right_value: all pairs of rows with near values, ids being 64-bit numbers.

    Rows with a null value, or one beyond 2^52 in size, pair with none; null ids stay null. Repeated rows pair each. An empty
    side gives no rows. Other columns, of no matter what name, don't matter."""
    sides = [pick(df, id=i, v=v).select(F.col("id").cast("long").alias("id"), F.col("v").cast("long").alias("v")).filter(F.abs("v") <= LARGEST) for df, i, v in ((left, left_id, left_value), (right, right_id, right_value))]
    a, b = dealt(*sides, "v", "v", band)

    def join(t: pa.Table) -> pa.Table:
        kind, v = t["kind"].to_numpy(), t["v"].to_numpy()
        one, two = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        two = two[np.argsort(v[two], kind="stable")]
        low, high = band.ends(v[one])
        first, end = np.searchsorted(v[two], low), np.searchsorted(v[two], high, "right")
        n = end - first
        x = np.repeat(one, n)
        y = two[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        return pa.table([t["id"].take(pa.array(x)), pa.array(v[x]), t["id"].take(pa.array(y)), pa.array(v[y])], ["left_id", "left_value", "right_id", "right_value"])

    both = a.withColumn("kind", F.lit(0)).unionByName(b.withColumn("kind", F.lit(1)))
    return both.groupBy("region").applyInArrow(join, "left_id long, left_value long, right_id long, right_value long")


def _summaries(band: Band, k: int):
    """The join of one region of values (kind 0), sums of lines by value (1) and lines (2): for each value the number of near
    lines, the sums of their gaps and checks, and the nearest lines, 2k at most and k at most of one item: whichever item is
    left out later, the k nearest of the others are among them."""

    def join(t: pa.Table) -> pa.Table:
        kind, v = t["kind"].to_numpy(), t["v"].to_numpy()
        p = np.sort(v[kind == 0])
        low, high = band.ends(p)
        at = np.flatnonzero(kind == 1)
        at = at[np.argsort(v[at], kind="stable")]
        u = v[at]
        n, check = t["n"].to_numpy()[at], t["crc"].to_numpy()[at]
        total, weighed, checks = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * u, check))
        a, m, z = np.searchsorted(u, low), np.searchsorted(u, p), np.searchsorted(u, high, "right")
        below, above = total[m] - total[a], total[z] - total[m]
        gaps = p * below - (weighed[m] - weighed[a]) + (weighed[z] - weighed[m]) - p * above
        at = np.flatnonzero(kind == 2)
        sale, line, item = (t[c].to_numpy(zero_copy_only=False)[at] for c in ("sale_id", "line_no", "item_id"))
        at = np.lexsort((item, line, sale, v[at]))
        u_of, sale, line, item = v[np.flatnonzero(kind == 2)][at], sale[at], line[at], item[at]
        starts = np.searchsorted(u_of, u).tolist() + [len(u_of)]
        values, items, chosen, sizes = u.tolist(), item.tolist(), [], []
        for x, left, right, first, end in zip(p.tolist(), (m - 1).tolist(), m.tolist(), a.tolist(), z.tolist()):
            had: dict[int, int] = {}
            before = len(chosen)
            while len(chosen) - before < 2 * k and (left >= first or right < end):
                if right >= end or (left >= first and x - values[left] <= values[right] - x):
                    g, left = left, left - 1
                else:
                    g, right = right, right + 1
                for i in range(starts[g], starts[g + 1]):
                    c = had.get(items[i], 0)
                    if c < k:
                        had[items[i]] = c + 1
                        chosen.append(i)
            sizes.append(len(chosen) - before)
        chosen = np.array(chosen, np.int64)
        x = np.repeat(p, sizes)
        fields = [np.abs(u_of[chosen] - x), u_of[chosen], sale[chosen], line[chosen], item[chosen]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], ["gap", "u", "sale_id", "line_no", "item_id"]))
        return pa.table([pa.array(p), pa.array(below + above), pa.array(gaps), pa.array(checks[z] - checks[a]), lists], ["p", "n", "gaps", "crc", "near"])

    return join


def cents(x: Column) -> Column:
    """floor(100 x + 0.5) as a number, null where it isn't one or is beyond 2^52."""
    y = x.cast("double") * 100 + F.lit(0.5)
    return F.when(F.abs(y) <= float(LARGEST) / 4, F.floor(y).cast("long"))


def near_prices(items: DataFrame, lines: DataFrame, *, k: int = 10, band: Band = Band()) -> DataFrame:
    """For each row of items its k nearest lines of other items by price per unit, and sums over all near lines: item_id,
    rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc.

    Prices and amounts are in cents. Lines that are null in sale_id, item_id, quantity or amount, or have a quantity of 0, and
    amounts and prices that are no numbers or beyond 10^13 never pair. Order is by gap, u, sale_id, line_no (null first) and
    line_item_id; repeated lines count and rank each, repeated items are answered each. An item without pairs has one row of
    rank 0 with nulls and zeros, and so has one without an id. Other columns, of no matter what name, don't matter.

    Both sides are summed by value before they are dealt, so that a hot price or item is one row there: lines by (item, u)
    and by u, items by (item, price). Of the lines of one u, 2k at most go on, k at most of one item, which holds the k
    nearest of all others whichever item is left out; what an item's own lines add to the sums is taken off by a join on it."""
    a, q = F.col("a"), F.col("q")
    goods = pick(items, item_id="item_id", price="price").select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p"))
    goods = goods.groupBy("item_id", "p").agg(F.count("*").alias("copies"))
    sold = pick(lines, sale_id="sale_id", line_no="line_no", item_id="item_id", quantity="quantity", amount="amount")
    sold = sold.select(*[F.col(c).cast("long").alias(c) for c in ("sale_id", "line_no", "item_id")], F.col("quantity").cast("long").alias("q"), cents(F.col("amount")).alias("a"))
    up, by = (2 * a + q) * F.signum(q).cast("long"), F.nullif(F.abs(2 * q), F.lit(0))
    sold = sold.withColumns({"x": up, "y": by}).select("sale_id", "line_no", "item_id", F.expr("(x - pmod(x, y)) div y").alias("u"))
    sold = sold.filter("sale_id IS NOT NULL AND item_id IS NOT NULL AND u IS NOT NULL")
    check = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(","), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.lit(","), F.col("item_id").cast("string")).cast("binary"))
    by_item = saved(sold.groupBy("item_id", "u").agg(F.count("*").alias("n"), F.sum(check).alias("crc")))
    sums = by_item.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    order = ["sale_id", "line_no", "item_id"]
    numbered = sold.withColumn("line_no", F.coalesce("line_no", F.lit(NO_LINE)))
    first = numbered.withColumn("i", F.row_number().over(Window.partitionBy("u", "item_id").orderBy("sale_id", "line_no"))).filter(F.col("i") <= k)
    first = first.withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy(*order))).filter(F.col("i") <= 2 * k)
    none = F.lit(0).cast("long")
    right = sums.select(F.lit(1).alias("kind"), F.col("u").alias("v"), "n", "crc", *[none.alias(c) for c in order])
    right = saved(right.unionByName(first.select(F.lit(2).alias("kind"), F.col("u").alias("v"), none.alias("n"), none.alias("crc"), *order)))
    prices = goods.filter("p IS NOT NULL AND item_id IS NOT NULL").select(F.lit(0).alias("kind"), F.col("p").alias("v")).distinct()
    left = prices.select("kind", "v", *[none.alias(c) for c in ("n", "crc", *order)])
    one, two = dealt(left, right, "v", "v", band)
    near = "array<struct<gap:long,u:long,sale_id:long,line_no:long,item_id:long>>"
    found = one.unionByName(two).groupBy("region").applyInArrow(_summaries(band, k), f"p long, n long, gaps long, crc long, near {near}")
    found = found.groupBy("p").agg(*[F.sum(c).alias(c) for c in ("n", "gaps", "crc")], F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    low, high = band.columns("p")
    own = goods.join(by_item, "item_id").filter((F.col("u") >= low) & (F.col("u") <= high)).groupBy("item_id", "p")
    own = own.agg(F.sum("n").alias("own_n"), F.sum(F.abs(F.col("u") - F.col("p")) * F.col("n")).alias("own_gaps"), F.sum("crc").alias("own_crc"))
    out = goods.join(found, "p", "left").join(own, ["item_id", "p"], "left")
    part = lambda c: F.when(F.col("item_id").isNotNull(), F.coalesce(F.col(c), none) - F.coalesce(F.col(f"own_{c}"), none)).otherwise(none)
    others = F.slice(F.filter("near", lambda x: x["item_id"] != F.col("item_id")), 1, k)
    each = out.withColumn("copy", F.explode(F.expr("array_repeat(0, cast(copies AS int))"))).select("item_id", part("n").alias("n_pairs"), part("gaps").alias("gap_sum"), part("crc").alias("lines_crc"), F.posexplode_outer(others).alias("at", "x"))
    number = F.when(F.col("x.line_no") != NO_LINE, F.col("x.line_no"))
    return each.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("rank"), "x.gap", "x.u", "x.sale_id", number.alias("line_no"), F.col("x.item_id").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_prices(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"), k=10, band=Band(50, 5))


ORACLE = """
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), s AS (
  SELECT sale_id, cast(line_no AS BIGINT) AS line_no, item_id, cast(floor(100 * amount + 0.5) AS BIGINT) AS a, cast(quantity AS BIGINT) AS q,
    sale_id || ',' || coalesce(cast(line_no AS VARCHAR), '') || ',' || item_id AS key
  FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND isfinite(amount)
), l AS (
  SELECT sale_id, line_no, item_id, ((2 * a + q) * sign(q) - (((2 * a + q) * sign(q)) % (2 * abs(q)) + 2 * abs(q)) % (2 * abs(q))) // (2 * abs(q)) AS u,
    xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) AS crc
  FROM s, step
), i AS (SELECT row_number() OVER () AS r, item_id, CASE WHEN isfinite(price) THEN cast(floor(100 * price + 0.5) AS BIGINT) END AS p FROM items
), j AS (
  SELECT r, i.item_id, abs(u - p) AS gap, u, sale_id, line_no, l.item_id AS line_item_id, crc
  FROM i JOIN l ON (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p)) AND l.item_id <> i.item_id
), n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM j
), t AS (SELECT r, count(*) AS n_pairs, sum(gap) AS gap_sum, sum(crc) AS lines_crc FROM j GROUP BY r)
SELECT i.item_id, cast(coalesce(n.rank, 0) AS INTEGER) AS rank, n.gap, n.u, n.sale_id, n.line_no, n.line_item_id,
  coalesce(n_pairs, 0) AS n_pairs, cast(coalesce(gap_sum, 0) AS BIGINT) AS gap_sum, cast(coalesce(lines_crc, 0) AS BIGINT) AS lines_crc
FROM i LEFT JOIN n ON n.r = i.r AND n.rank <= 10 LEFT JOIN t ON t.r = i.r
"""
