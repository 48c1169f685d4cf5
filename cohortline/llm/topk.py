"""Exact top-k search by inner product, with a three-phase uniform threshold.

A vector's dimensions are cut into slices, and each slice is a list of partial scores. Phase one takes the best partial
scores of each list and resolves those candidates; the k-th best of their exact scores is a safe cutoff. Phase two sends
the cutoffs of all queries of a block back over the candidates: a total that reaches the cutoff has a partial score that
reaches the cutoff divided by the number of slices, so only such entries are collected. Phase three resolves them
exactly. Queries go over all rows in blocks, so that what is broadcast has a fixed bound."""

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
#: Candidates that are scored at once.
TILE = 2048
#: Products and sums below this are exact in doubles; with larger numbers Python's integers count.
EXACT = 2.0**53


def quantise(batches, scale: int):
    """(id, vector) to (id, row hash, int64 components, floor(scale * x)); vectors with null or non-finite parts go."""
    for b in batches:
        lists = b.column(1)
        ok = lists.is_valid().to_numpy(zero_copy_only=False)
        values = lists.flatten() if not isinstance(lists, pa.ChunkedArray) else lists.combine_chunks().flatten()
        x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        ok &= bad[ends[1:]] == bad[ends[:-1]]
        x = np.floor(scale * np.where(np.isfinite(x), x, 0.0))
        rows = [x[a:z].tobytes() for a, z, o in zip(ends, ends[1:], ok) if o]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)).cast(pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "x"])


def _matrix(raw: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(raw), dims))
    n = np.array([len(r) // 8 for r in raw])
    if len(raw) and (n == dims).all():
        return np.frombuffer(b"".join(raw)).reshape(len(raw), dims)
    for i, r in enumerate(raw):
        v = np.frombuffer(r)[:dims]  # what a query doesn't have counts as 0
        out[i, : len(v)] = v
    return out


class Queries:
    """A block of queries of bounded size, with a cutoff for each in the second pass."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, slices: int, k: int, cutoff: np.ndarray | None = None):
        self.ids, self.x, self.k, self.cutoff = ids, x, k, cutoff
        self.cuts = np.array_split(np.arange(x.shape[1]), max(1, min(slices, x.shape[1])))
        self.most, self.resolved = float(np.abs(x).sum(1).max(initial=0)), 0

    def partials(self, c: np.ndarray) -> list[np.ndarray]:
        """Partial scores of candidates (columns) for queries (rows) in each slice."""
        if self.most * float(np.abs(c).max(initial=0)) < EXACT:
            return [self.x[:, s] @ c[:, s].T for s in self.cuts]
        q, o = (np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape) for m in (self.x, c))
        return [q[:, s].dot(o[:, s].T) for s in self.cuts]

    def search(self, c: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Query rows, candidates' places, exact scores and whether it may be the query's own row (of its id and vector): of each
        list's best entries, or of all that can reach the cutoff, one more than k as the own row is among them. Scores are
        put together for these entries alone; self.resolved counts them."""
        parts = self.partials(c)
        kept = np.zeros((len(self.ids), len(ids)), bool)
        if self.cutoff is None:
            for p in parts:
                at = np.argpartition(-p.astype(np.float64), min(self.k + 1, p.shape[1]) - 1, axis=1)[:, : self.k + 1]
                np.put_along_axis(kept, at, True, axis=1)
        else:
            limit = self.cutoff[:, None]
            for p in parts:  # phase two: the uniform threshold; compared without division
                kept |= p * len(parts) >= limit
        q, at = np.nonzero(kept)
        self.resolved += len(q)
        total = sum((p[q, at] for p in parts[1:]), parts[0][q, at])
        if self.cutoff is not None:  # phase three
            stays = (total >= self.cutoff[q]).astype(bool)
            q, at, total = q[stays], at[stays], total[stays]
        # of what is left, no more than k and its own row for each query and candidate tile, the best first
        order = np.lexsort((ids[at], -total.astype(np.float64), q)) if total.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -total[i], ids[at[i]])), dtype=np.int64)
        q, at, total = q[order], at[order], total[order]
        best = np.arange(len(q)) - np.searchsorted(q, q, "left") <= self.k
        q, at, total = q[best], at[best], total[best]
        itself = self.ids[q] == ids[at]
        itself[itself] = (self.x[q[itself]] == c[at[itself]]).all(1)
        yield q, at, total, itself


def _pass(candidates: DataFrame, block: Queries) -> DataFrame:
    """(query's place, vec_id, score, itself) of search() over all candidates, at most k + 1 for each query and tile."""

    def scan(batches):
        for b in batches:
            for a in range(0, b.num_rows, TILE):
                part = b.slice(a, TILE)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for q, at, score, itself in block.search(_matrix(part.column(1).to_pylist(), block.x.shape[1]), ids):
                    columns = [pa.array(q, pa.int32()), pa.array(ids[at], pa.int64()), pa.array([int(s) for s in score], pa.decimal128(38, 0)), pa.array(itself)]
                    yield pa.RecordBatch.from_arrays(columns, ["q", "vec_id", "score", "itself"])

    return candidates.mapInArrow(scan, "q int, vec_id long, score decimal(38,0), itself boolean")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, slices: int = 4, vec_id: str = "vec_id", vector: str = "embedding", block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of floor(scale * x) for each row of queries
    among all rows of vectors but its own; ties go to the smaller id. Both have the columns vec_id, vector.

    Vectors that are null or hold null or non-finite parts take no part, nor do rows without an id. Of vectors of
    different lengths the missing parts count as 0. Repeated rows are candidates each, of which one is a query's own; other
    rows with a query's id are candidates too, and repeated queries are answered each. With fewer candidates than k all are returned; no rows give no rows. Extra columns don't matter."""
    spark = vectors.sparkSession

    def read(df):
        return pick(df, vec_id=vec_id, x=vector).filter("vec_id IS NOT NULL").mapInArrow(lambda it: quantise(it, scale), "vec_id long, x binary")

    asked = saved(read(queries))
    numbers, dims, n = asked.select(F.coalesce(F.sum(F.length("x")), F.lit(0)), F.coalesce(F.max(F.length("x")), F.lit(0)), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = saved(read(vectors))
    dims = max(1, dims // 8)
    blocks = max(1, -(-n * dims // block_numbers))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows = sorted((r.vec_id, bytes(r.x)) for r in dealt.filter(F.col("block") == b).select("vec_id", "x").collect())
        if not rows:
            continue
        ids, x = np.array([r[0] for r in rows], np.int64), _matrix([r[1] for r in rows], dims)
        # phase one: the lists' best entries, resolved; the k-th best exact score is the cutoff, or none if there are fewer
        first = _best(_pass(candidates, Queries(ids, x, slices, k)), k + 1).filter(F.col("rank") == k + 1).select("q", "score").collect()
        cutoff = np.full(len(rows), -np.inf)
        exact = {r.q: int(r.score) for r in first}
        big = any(abs(v) >= EXACT for v in exact.values())
        if big:
            cutoff = cutoff.astype(object)
        for q, v in exact.items():
            cutoff[q] = v
        found = _best(_pass(candidates, Queries(ids, x, slices, k, cutoff)), k + 1)
        copies = F.row_number().over(Window.partitionBy("q", "itself").orderBy("rank"))
        best = _best(found.withColumn("copy", copies).filter("NOT (itself AND copy = 1)").drop("rank"), k)
        of = spark.createDataFrame([(i, v) for i, v in enumerate(ids.tolist())], "q int, query_id long")
        best = best.join(F.broadcast(of), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
        best = saved(best) if blocks > 1 else best
        out = best if out is None else out.unionByName(best)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score, c.r
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.r <> c.r
), n AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 5
"""
