"""Approximate nearest neighbours by inner product: one-bit codes of randomly rotated vectors, with bounds of their error.

A vector, less a centre and scaled to length one, is turned by a random rotation; the signs of its components are its code.
The code's own direction has a known inner product with the vector, so that the code's inner product with a turned query,
divided by it, estimates that of the vector without bias, with an error that falls with the root of the number of dimensions.
Codes are packed bits; queries are cut to a few bits too, and the products are counts of common bits.

The first pass scores, in each tile of rows, the vectors with the highest estimates; the k-th best of these exact scores is a
safe cutoff. The second scores all vectors whose estimate and bound together reach it. Both go over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import pick, saved, table

#: Numbers that one block of queries holds, 8 bytes each: the bound of what is broadcast.
BLOCK_NUMBERS = 1 << 20
#: Candidates and queries that are compared at once, and pairs that are scored at once.
TILE, ASKED, PAIRS = 2048, 256, 1 << 16
#: Rows whose mean is the centre: those with the least hashes.
SAMPLE_ROWS = 1024
#: Bits of a query's components, and the width of the bounds in deviations of the estimate.
QUERY_BITS, DEVIATIONS = 6, 2.0


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, list) to (id, doubles as bytes); null, empty and zero vectors go, and those with null or non-finite parts."""
    for b in batches:
        lists = b.column(1)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        some = np.concatenate([[0], np.cumsum(values != 0)])
        ok = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
        rows = [values[a:z].tobytes() for a, z, o in zip(ends, ends[1:], ok) if o]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)).cast(pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "x"])


def matrix(raw: list[bytes], dims: int) -> np.ndarray:
    """Rows of numbers; missing parts are 0."""
    out = np.zeros((len(raw), dims))
    for i, r in enumerate(raw):
        out[i, : len(r) // 8] = np.frombuffer(r)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as 64-bit numbers."""
    by = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(by, ((0, 0), (0, -by.shape[1] % 8)))).view(np.uint64)


class Codes:
    """The rotation and the centre that a table's codes are made with."""

    def __init__(self, centre: np.ndarray, seed: int):
        self.centre, self.dims = centre, len(centre)
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.dims, self.dims)))
        self.turn = q * np.sign(np.diag(r))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, lengths of the vectors without the centre, the codes' inner products with them, products with the centre."""
        rest = x - self.centre
        length = np.sqrt((rest * rest).sum(1))
        turned = rest @ self.turn.T
        own = np.abs(turned).sum(1) / np.sqrt(self.dims) / np.where(length > 0, length, 1.0)
        return packed(turned >= 0), length, np.where(length > 0, own, 1.0), x @ self.centre

    def questions(self, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bit planes of the turned queries, their offsets and steps, sums, lengths and products with the centre."""
        rest = q - self.centre
        turned = rest @ self.turn.T
        low = turned.min(1, initial=0.0)
        step = np.maximum(turned.max(1, initial=0.0) - low, 1e-300) / (2**QUERY_BITS - 1)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        planes = np.stack([packed((level >> b) & 1 == 1) for b in range(QUERY_BITS)], 1)
        sums = low * self.dims + step * level.sum(1)
        return planes, low, step, sums, np.sqrt((rest * rest).sum(1)), q @ self.centre - self.centre @ self.centre

    def bounds(self, codes, length, own, with_centre, asked, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of inner products (queries by candidates) and their errors' bounds."""
        planes, low, step, sums, q_length, q_centre = asked
        common = np.zeros((len(low), len(codes)))
        for b in range(planes.shape[1]):
            count = np.zeros(common.shape, np.int32)
            for w in range(codes.shape[1]):
                count += np.bitwise_count(planes[:, b, w, None] & codes[None, :, w])
            common += count * float(1 << b)
        ones = np.bitwise_count(codes).sum(1)
        product = (2 * (low[:, None] * ones + step[:, None] * common) - sums[:, None]) / np.sqrt(self.dims)
        scale = length / own
        spread = np.sqrt(np.maximum(1 - own * own, 0) / max(self.dims - 1, 1))
        error = deviations * scale * (q_length[:, None] * spread + step[:, None] / np.sqrt(12.0))
        return scale * product + with_centre + q_centre[:, None], error


def index(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> tuple[DataFrame, Codes | None]:
    """All vectors with their codes and correction numbers, and what they are made with; None if there is no vector."""
    rows = saved(pick(vectors, vec_id=vec_id, x=vector).filter("vec_id IS NOT NULL").mapInArrow(read, "vec_id long, x binary"))
    dims = (rows.agg(F.max(F.length("x"))).first()[0] or 0) // 8
    if not dims:
        return rows, None
    sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id", "x").limit(SAMPLE_ROWS).select("x").collect()
    codes = Codes(matrix([bytes(r.x) for r in sample], dims).mean(0), seed)

    def encode(batches):
        for b in batches:
            code, *numbers = codes.encode(matrix(b.column(1).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), *map(pa.array, numbers)], ["vec_id", "x", "code", "length", "own", "centre"])

    return saved(rows.mapInArrow(encode, "vec_id long, x binary, code binary, length double, own double, centre double")), codes


def exact(x: np.ndarray, q: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed by itself, so that equal vectors score the same in any tile."""
    return np.concatenate([np.zeros(0), *[(x[q[a : a + PAIRS]] * vectors[at[a : a + PAIRS]]).sum(1) for a in range(0, len(q), PAIRS)]])


def _tiles(batches, codes: Codes, x: np.ndarray, deviations: float):
    """For tiles of candidates and groups of queries: the first query, ids, vectors, estimates and bounds."""
    asked = [codes.questions(x[a : a + ASKED]) for a in range(0, len(x), ASKED)]
    for b in batches:
        for a in range(0, b.num_rows, TILE):
            part = b.slice(a, TILE)
            code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, -1)
            numbers = [part.column(i).to_numpy() for i in (2, 3, 4)]
            vectors = matrix(part.column(5).to_pylist(), codes.dims)
            for g, questions in enumerate(asked):
                yield g * ASKED, part.column(0).to_numpy(), vectors, *codes.bounds(code, *numbers, questions, deviations)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7, deviations: float = DEVIATIONS, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries the k rows of vectors found with the largest inner
    product, in double precision; all but the query's own row are candidates, ties go to the smaller id.

    Vectors that are null, empty or zero, or hold null or non-finite parts, take no part, nor do rows without an id. Of
    vectors of different lengths the missing parts count as 0. Repeated rows are candidates each, of which one is a query's
    own; repeated queries are answered each. With fewer candidates than k all are returned; no rows give none. Other columns,
    of no matter what name, don't matter. A neighbour is missed only if its estimate
    is low by more than its bound, `deviations` times the error's deviation; with 6 none is."""
    spark = vectors.sparkSession
    table_, codes = index(vectors, vec_id=vec_id, vector=vector, seed=seed)
    asked = saved(pick(queries, vec_id=vec_id, x=vector).filter("vec_id IS NOT NULL").mapInArrow(read, "vec_id long, x binary"))
    n = asked.count()
    if codes is None or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = codes.dims
    blocks = max(1, -(-n * dims // block_numbers))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)))
    coded = table_.select("vec_id", "code", "length", "own", "centre", "x")
    out = None
    for block in range(blocks):
        rows = sorted((r.vec_id, bytes(r.x)) for r in dealt.filter(F.col("block") == block).select("vec_id", "x").collect())
        if not rows:
            continue
        ids, x = np.array([r[0] for r in rows], np.int64), matrix([r[1][: dims * 8] for r in rows], dims)

        def first_scores(batches, x=x):
            best = np.full((len(x), k + 1), -np.inf)  # one more, for the query's own row
            for first, _, vectors_, estimate, _ in _tiles(batches, codes, x, deviations):
                m, part = min(k + 1, estimate.shape[1]), slice(first, first + len(estimate))
                at = np.argpartition(-estimate, m - 1, axis=1)[:, :m].ravel()
                score = exact(x, np.repeat(np.arange(first, first + len(estimate)), m), vectors_, at)
                best[part] = -np.partition(-np.hstack([best[part], score.reshape(-1, m)]), k, axis=1)[:, : k + 1]
            q, at = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, at])], ["q", "score"])

        by_score = Window.partitionBy("q").orderBy(F.desc("score"))
        limits = coded.mapInArrow(first_scores, "q int, score double").withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 1)
        cutoff = np.full(len(rows), -np.inf)
        for r in limits.filter(F.col("n") == k + 1).select("q", "score").collect():
            cutoff[r.q] = r.score

        def resolve(batches, x=x, ids=ids, cutoff=cutoff):
            for first, own, vectors_, estimate, error in _tiles(batches, codes, x, deviations):
                q, at = np.nonzero(estimate + error >= cutoff[first : first + len(estimate), None])
                q += first
                score = exact(x, q, vectors_, at)
                reach = score >= cutoff[q]
                q, at, score = q[reach], at[reach], score[reach]
                order = np.lexsort((own[at], -score, q))
                q, at, score = q[order], at[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q, "left") <= k
                q, at, score = q[best], at[best], score[best]
                itself = ids[q] == own[at]
                itself[itself] = (x[q[itself]] == vectors_[at[itself]]).all(1)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(own[at]), pa.array(itself), pa.array(score)], ["q", "vec_id", "itself", "score"])

        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        found = coded.mapInArrow(resolve, "q int, vec_id long, itself boolean, score double").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
        found = found.withColumn("copy", F.row_number().over(Window.partitionBy("q", "itself").orderBy("n"))).filter("NOT (itself AND copy = 1)")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        of = spark.createDataFrame([(i, v) for i, v in enumerate(ids.tolist())], "q int, query_id long")
        best = found.join(F.broadcast(of), "q").select("query_id", "rank", "vec_id", "score")
        best = saved(best) if blocks > 1 else best
        out = best if out is None else out.unionByName(best)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)
