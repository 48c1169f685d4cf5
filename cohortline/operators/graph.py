"""Nearest neighbours by an index of centroid lists, their exact yardstick, and the features of their graph.

Equal vectors are one entry of the index, with the k + 1 least ids that have it: more of them can be no row's neighbours. Each
entry is in the list of its nearest centroid; a query goes to the lists of its nearest few. Lists that are too long for a
task are dealt over several, and so are their queries; candidates are scored exactly.

A tile of vectors and queries first meets as a product of matrices, whose rounding is bounded; only pairs that may be among the
nearest within the bound are scored dimension by dimension."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from .matrix import Codes, Scaling

#: Vectors that centroids are fitted on, those with the least hashes; rounds of the fit; most lists.
SAMPLE_ROWS, ROUNDS, MOST_LISTS = 8192, 12, 4096
#: Entries and queries that meet in one task, at most; those that meet in one product of matrices.
TILE, BLOCK = 32768, (256, 2048)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, list) to (id, doubles as bytes), without vectors that are null or hold null or non-finite parts."""
    for b in batches:
        lists = b.column(1)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
        kept = values[np.repeat(ok, n)] + 0.0  # -0.0 is 0.0
        cuts = np.concatenate([[0], np.cumsum(n[ok])]) * 8
        if cuts[-1] < 2**31:
            rows = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(kept)])
        else:
            rows = pa.array([kept.data[a // 8 : z // 8].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)).cast(pa.int64()), rows], ["vec_id", "x"])


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors given as bytes, with zeros for missing parts, and their lengths."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out, sizes = np.zeros((len(column), dims)), np.zeros(len(column), np.int64)
    first = 0
    for c in chunks:
        if len(c):
            wide = pa.types.is_large_binary(c.type)
            at = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            n = np.diff(at) // 8
            values = np.frombuffer(c.buffers()[2], np.float64, n.sum(), at[0]) if n.any() else np.zeros(0)
            where, row = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(first, first + len(c)), n)
            known = where < dims  # what a query has beyond all entries is as far from each of them
            out[row[known], where[known]] = values[known]
            sizes[first : first + len(c)] = n
            first += len(c)
    return out, sizes


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, added up dimension by dimension."""
    d = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        d += (q[:, j, None] - x[None, :, j]) ** 2
    return d


def read(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, a vector as bytes. Rows without an id and vectors that are null or hold null or non-finite parts take no
    part; of vectors of unlike length the missing parts count as 0 in distances."""
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector)).filter("vec_id IS NOT NULL").mapInArrow(_read, "vec_id long, x binary")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """x and ids, the k + 1 least of the rows that have it: each vector once."""
    order = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    few = rows.withColumn("i", order).filter(F.col("i") <= k + 1)
    return few.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _pairs(q: np.ndarray, x: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in q and x, by q, among which are the k nearest of each q, with all ties, that are within its limit.

    Squared distances less that of q come from products, each off by `slack` at most; a number that overflows leaves the pair in."""
    with np.errstate(over="ignore", invalid="ignore"):
        size, own = (x * x).sum(1), (q * q).sum(1)
        slack = 4e-16 * (x.shape[1] + 8) * (np.sqrt(own) + np.sqrt(size.max())) ** 2
        most = limits - own + slack
        rows, cols, values = [], [], []
        for a in range(0, len(x), BLOCK[1]):
            near = q @ (-2 * x[a : a + BLOCK[1]].T)
            near += size[a : a + BLOCK[1]]
            if a == 0 and near.shape[1] >= k:
                most = np.fmin(most, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)
            r, c = np.nonzero(~(near > most[:, None]))
            rows.append(r)
            cols.append(c + a)
            values.append(near[r, c])
        row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
        order = np.lexsort((value, row))
        row, col, value = row[order], col[order], value[order]
        n = np.bincount(row, minlength=len(q))
        last = np.minimum(np.cumsum(n) - n + k - 1, max(0, len(row) - 1))  # of the k lowest of each, if there are as many
        kth = np.where(n >= k, value[last] if len(row) else 0.0, np.inf)
        keep = ~(value > (kth + 2 * slack)[row])
    return row[keep], col[keep]


def _nearest(k: int, dims: int):
    """The join of a tile: for each query (kind 1) the k nearest entries (kind 0) with other vectors that are no further than
    its limit, if it has one."""

    def join(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        at = [np.flatnonzero(kind == i) for i in (0, 1)]
        vectors, sizes = _matrix(t["x"], dims)
        (x, q), (size, own) = ([v[a] for a in at] for v in (vectors, sizes))
        del vectors
        ids = t["ids"].take(pa.array(at[0])).combine_chunks()
        limits = t["limit"].take(pa.array(at[1])).fill_null(np.inf).to_numpy()
        least = pc.list_element(ids, 0).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)
        where, found, gaps = [], [], []
        for a in range(0, len(q) if len(x) else 0, BLOCK[0]):
            row, col = _pairs(q[a : a + BLOCK[0]], x, k + 1, limits[a : a + BLOCK[0]])
            row = row + a
            d = np.zeros(len(row))
            for j in range(dims):  # added up dimension by dimension
                d += (q[row, j] - x[col, j]) ** 2
            ok = d <= limits[row]
            near = np.flatnonzero(d == 0)
            ok[near] &= (q[row[near]] != x[col[near]]).any(1) | (own[row[near]] != size[col[near]])  # not the same vector
            row, col, d = row[ok], col[ok], d[ok]
            order = np.lexsort((least[col], d, row))
            row, col, d = row[order], col[order], d[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            where.append(row[first])
            found.append(col[first])
            gaps.append(d[first])
        of, to = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (where, found))
        return pa.table([t["x"].take(pa.array(at[1][of])), pa.array(np.concatenate([np.zeros(0), *gaps])), ids.take(pa.array(to))], ["x", "d", "ids"])

    return join


def _answers(asked: DataFrame, found: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """vec_id, neighbour, rank from the neighbouring vectors of each asked one: ids of its own vector are at distance 0."""
    own = known.select("x", F.lit(0.0).alias("d"), "ids")
    each = F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id")))
    lists = found.select("x", "d", "ids").unionByName(own).select("x", each.alias("n")).groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("n"))), 1, k + 1).alias("n"))
    rows = asked.join(lists, "x").select("vec_id", F.slice(F.filter("n", lambda e: e["id"] != F.col("vec_id")), 1, k).alias("n"))
    return rows.select("vec_id", F.posexplode("n").alias("at", "e")).select("vec_id", F.col("e.id").alias("neighbour"), (F.col("at") + 1).alias("rank"))


def _met(tiles: DataFrame, k: int, dims: int) -> DataFrame:
    """Neighbours over all tiles that a query meets: the k nearest vectors (x, d, ids)."""
    met = tiles.groupBy("tile").applyInArrow(_nearest(k, dims), "x binary, d double, ids array<long>")
    return _best(met, k)


def _best(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("x").orderBy("d", F.col("ids")[0])
    return met.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k).drop("i")


def _dims(rows: DataFrame) -> tuple[int, int]:
    n, size = rows.agg(F.count("*"), F.coalesce(F.max(F.length("x")), F.lit(0))).first()
    return n, max(1, size // 8)


def exact_knn(vectors: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """vec_id, neighbour, rank: the k nearest other rows by Euclidean distance, ties to the smaller id, for each row of
    queries (all, if none are given). Every query meets every vector, in tiles of a matrix: the yardstick of the index."""
    rows = saved(read(vectors, id_column, vector))
    known = saved(entries(rows, k))
    asked = rows if queries is None else saved(read(queries, id_column, vector))
    n, dims = _dims(known)
    wanted = asked.select("x").distinct()
    side = lambda size: min(TILE, max(1, TILE // 8, -(-size // 8)))  # noqa: E731  (smaller tiles for small tables)
    across, down = (max(1, -(-size // side(size))) for size in (n, wanted.count()))
    part = lambda of: F.pmod(F.xxhash64("x"), F.lit(of))
    copies = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = F.lit(None).cast("double").alias("limit")
    a = known.select(F.lit(0).alias("kind"), "x", "ids", none, part(across).alias("c"), copies(down).alias("r"))
    b = wanted.select(F.lit(1).alias("kind"), "x", F.lit(None).cast("array<long>").alias("ids"), none, copies(across).alias("c"), part(down).alias("r"))
    tiles = a.unionByName(b).withColumn("tile", F.col("r") * across + F.col("c"))
    return _answers(asked, _met(tiles, k, dims), known, k)


@dataclass
class VectorIndex:
    """Entries (x, ids, list) by the centroid that is nearest, how many are in each list, and how far its furthest is."""

    lists: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]
    k: int
    radii: dict[int, float]

    def _probed(self, wanted: DataFrame, probes: int) -> DataFrame:
        """x, list and place: the lists of each x by the distance of their centroids, from 0."""
        centroids, most = self.centroids, min(probes, len(self.centroids))

        def probe(batches):
            for b in batches:
                x, _ = _matrix(b.column(0), centroids.shape[1])
                for a in range(0, len(x), 1024):
                    d = _distances(x[a : a + 1024], centroids)
                    at = np.argpartition(d, most - 1, axis=1)[:, :most]
                    at = np.take_along_axis(at, np.lexsort((at, np.take_along_axis(d, at, 1)), axis=1), 1)
                    place = np.tile(np.arange(most, dtype=np.int32), len(at))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 1024).take(pa.array(np.repeat(np.arange(len(at)), most))), pa.array(at.ravel().astype(np.int32)), pa.array(place)], ["x", "list", "place"])

        return wanted.select("x").mapInArrow(probe, "x binary, list int, place int")

    def _within(self, wanted: DataFrame, probes: int) -> DataFrame:
        """x, limit, list: the lists but the nearest `probes` that may hold an entry within the limit of x. By the triangle
        inequality none is nearer than the distance of the centroid less the radius."""
        centroids, most = self.centroids, min(probes, len(self.centroids))
        radii = np.array([self.radii.get(i, -np.inf) for i in range(len(centroids))])

        def probe(batches):
            for b in batches:
                (x, _), limit = _matrix(b.column(0), centroids.shape[1]), b.column(1).fill_null(np.inf).to_numpy(zero_copy_only=False)
                for a in range(0, len(x), 1024):
                    d = _distances(x[a : a + 1024], centroids)
                    reach = (np.sqrt(limit[a : a + 1024])[:, None] + radii) * (1 + 1e-9) + 1e-9
                    may = np.sqrt(d) <= reach
                    near = np.argpartition(d, most - 1, axis=1)[:, :most]
                    np.put_along_axis(may, near, False, 1)
                    row, at = np.nonzero(may)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 1024).take(pa.array(row)), b.column(1).slice(a, 1024).take(pa.array(row)), pa.array(at.astype(np.int32))], ["x", "limit", "list"])

        return wanted.select("x", "limit").mapInArrow(probe, "x binary, limit double, list int")

    def _visited(self, visits: DataFrame) -> DataFrame:
        """x, d, ids: the k nearest entries of each x in the lists that it visits (x, list, limit)."""
        counts = visits.groupBy("list").agg(F.count("*").alias("n")).collect()  # no more rows than lists
        rows, first = [], 0
        for r in sorted(counts):
            across, down = -(-self.sizes.get(r.list, 1) // TILE), -(-r.n // TILE)
            rows.append((r.list, first, across, down))
            first += across * down
        plan = F.broadcast(self.lists.sparkSession.createDataFrame(rows, "list int, first int, across int, down int"))
        part = lambda of: F.pmod(F.xxhash64("x"), F.col(of)).cast("int")
        copies = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        a = self.lists.join(plan, "list").select(F.lit(0).alias("kind"), "x", "ids", F.lit(None).cast("double").alias("limit"), "first", "across", part("across").alias("c"), copies("down").alias("r"))
        b = visits.join(plan, "list").select(F.lit(1).alias("kind"), "x", F.lit(None).cast("array<long>").alias("ids"), "limit", "first", "across", copies("across").alias("c"), part("down").alias("r"))
        tiles = a.unionByName(b).select("kind", "x", "ids", "limit", (F.col("first") + F.col("r") * F.col("across") + F.col("c")).alias("tile"))
        return _met(tiles, self.k, self.centroids.shape[1])

    def _limits(self, found: DataFrame) -> DataFrame:
        """x and limit: the distance of its k-th entry, if it has as many."""
        return found.groupBy("x").agg(F.when(F.count("*") >= self.k, F.max("d")).alias("limit"))

    def search(self, asked: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """Neighbours (vec_id, neighbour, rank) of rows (vec_id, x), and list, entries and queries of all lists visited."""
        found, work, _ = self._searched(asked, probes)
        return _answers(asked, found, self.lists, self.k), work

    def search_and_exact(self, asked: DataFrame, probes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What search finds, the true neighbours, and the search's work. For the latter each query also visits all lists
        that may hold a nearer entry than the furthest it has found; all others are proved to be further away."""
        found, work, wanted = self._searched(asked, probes)
        rest = saved(self._within(wanted.join(self._limits(found), "x", "left"), probes))
        true = _best(found.unionByName(self._visited(rest)), self.k)
        return _answers(asked, found, self.lists, self.k), _answers(asked, true, self.lists, self.k), work

    def _searched(self, asked: DataFrame, probes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        wanted = asked.select("x").distinct()
        visits = saved(self._probed(wanted, probes))
        counts = visits.groupBy("list").agg(F.count("*").alias("n")).collect()  # no more rows than lists
        work = self.lists.sparkSession.createDataFrame([(r.list, self.sizes.get(r.list, 0), r.n) for r in sorted(counts)], "list int, entries long, queries long")
        # the nearest list first: of the others only what is within the distances found there is of use
        first = saved(self._visited(visits.filter("place = 0").withColumn("limit", F.lit(None).cast("double"))))
        others = visits.filter("place > 0").join(self._limits(first), "x", "left").select("x", "list", "limit")
        return saved(_best(first.unionByName(self._visited(others)), self.k)), work, wanted


def fitted_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a bounded sample: from rows spread over it by their distance, moved to the means of their rows."""
    rng = np.random.default_rng(7)
    chosen = [0]
    gap = _distances(sample[:1], sample)[0]
    for _ in range(min(lists, len(sample)) - 1):
        if gap.sum() == 0:
            break
        chosen.append(int(rng.choice(len(sample), p=gap / gap.sum())))
        gap = np.minimum(gap, _distances(sample[chosen[-1:]], sample)[0])
    centroids = sample[chosen]
    for _ in range(rounds):
        near = np.concatenate([_distances(sample[a : a + 1024], centroids).argmin(1) for a in range(0, len(sample), 1024)])
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def build_index(rows: DataFrame, k: int, lists: int | None = None) -> VectorIndex:
    """An index of rows (vec_id, x). By default there are as many lists as the root of the number of vectors; the centroids
    are fitted on SAMPLE_ROWS of them, all are in a list."""
    known = saved(entries(rows, k))
    n, dims = _dims(known)
    lists = min(MOST_LISTS, lists or max(1, int(n**0.5)))
    sample, _ = _matrix(pa.array([bytes(r.x) for r in known.orderBy(F.xxhash64("x"), "x").limit(SAMPLE_ROWS).select("x").collect()], pa.binary()), dims)
    centroids = fitted_centroids(sample, lists) if len(sample) else np.zeros((1, dims))

    def assign(batches):
        for b in batches:
            x, _ = _matrix(b.column(0), dims)
            near = np.concatenate([np.zeros(0, np.int64), *[_closest(x[a : a + 1024], centroids) for a in range(0, len(x), 1024)]])
            gap = np.sqrt(((x - centroids[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(gap)], ["x", "ids", "list", "gap"])

    dealt = saved(known.mapInArrow(assign, "x binary, ids array<long>, list int, gap double"))
    lists_of = dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()  # no more than lists
    return VectorIndex(dealt.drop("gap"), centroids, {r.list: r.n for r in lists_of}, k, {r.list: r.gap for r in lists_of})


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each x, but for rounding: any list will do that is told the distance."""
    return ((centroids * centroids).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def indexed_knn(vectors: DataFrame, k: int, *, probes: int, lists: int | None = None, id_column: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """vec_id, neighbour, rank as exact_knn finds them in the lists that are probed, and the lists' entries and queries, whose
    products are the work. Empty tables give no rows; repeated rows of one id are one candidate."""
    rows = saved(read(vectors, id_column, vector))
    asked = rows if queries is None else saved(read(queries, id_column, vector))
    return build_index(rows, k, lists).search(asked, probes)


def indexed_and_exact(vectors: DataFrame, k: int, *, probes: int, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What indexed_knn finds, the true neighbours as exact_knn finds them, and the index's work. The true ones come from the
    same lists and those that the triangle inequality doesn't rule out."""
    rows = saved(read(vectors))
    return build_index(rows, k).search_and_exact(saved(read(queries)), probes)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """queries, and the share of true neighbours that were found."""
    hit = true.join(found.select("vec_id", "neighbour", F.lit(1).alias("hit")), ["vec_id", "neighbour"], "left")
    return hit.agg(F.count_distinct("vec_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))


def graph_vectors(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], multiplier: float = 3.0, id_column: str = "id") -> DataFrame:
    """vec_id and embedding: a 0 or 1 for each value of each category, and standardised numbers times the multiplier."""
    codes, scaling = Codes(categorical).fit(df), Scaling(numeric).fit(df)
    sizes = {c: codes.tables[c].count() for c in categorical}
    flags = [(F.col(f"code_{c}") == i).cast("double") for c in categorical for i in range(1, sizes[c] + 1)]
    numbers = [F.col(f"z_{c}") * multiplier for c in numeric]
    return scaling.apply(codes.apply(df)).select(F.col(id_column).alias("vec_id"), F.array(*flags, *numbers).alias("embedding"))


def neighbour_means(edges: DataFrame, values: DataFrame, columns: list[str], id_column: str = "vec_id") -> DataFrame:
    """Mean of the neighbours' columns: one hop of aggregation on the graph; again on the result for two."""
    v = values.select(F.col(id_column).alias("neighbour"), *columns)
    return edges.join(v, "neighbour").groupBy(id_column).agg(*[F.avg(c).alias(f"nb_{c}") for c in columns])
