"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles. Each unit of an element's weight is a strip over a line of ranks, and
darts fall on the strip as a Poisson process of rate one that depends on the element alone; those beyond the weight
don't count. Each dart belongs to one of the signature's coordinates, which keeps its earliest dart. Only darts up to a
rank of about (coordinates / total weight) have to be thrown, so a long document costs one draw per element and a fixed
number of darts. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Equal texts are one node. Nodes that agree in a band of coordinates are candidates; each bucket's members are compared
with its most central member first, then, where a bucket still holds several classes, blockwise with each other. Links
are decided by the exact similarity of the sets of shingles, and classes are the connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import _arrow as A
from ._spark import held, pick, release, saved, table

SHINGLE = 5
#: Bands of rows: a pair of similarity 0.8 is missed with probability (1 - 0.8^4)^28 = 4e-7.
BANDS, ROWS = 28, 4
K = BANDS * ROWS
THRESHOLD = 0.8
#: Pairs that agree in fewer coordinates aren't compared in blocks: 0.8 less five standard errors.
LEAST_AGREE = int(K * (THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5))
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 1024
#: Candidates' rows up to this number are found by broadcast (16 bytes each), more by a shuffle of the documents.
BROADCAST_ROWS = 1_000_000
_C = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(doc: np.ndarray, h: np.ndarray, i: int, j: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each shingle. A document of fewer words than a shingle has one, of all its words."""
    cuts = np.searchsorted(doc, np.arange(i, j + 1))
    n = np.diff(cuts)
    x = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        x = x * A.BASE + h[k : len(h) - size + 1 + k] if len(x) else x
    ok = doc[: len(x)] == doc[size - 1 :] if len(x) else np.zeros(0, bool)
    docs, out = [doc[: len(x)][ok]], [A.mix(x[ok])]
    for k in range(1, size):
        at = cuts[:-1][n == k]
        if len(at):
            y = np.full(len(at), k, np.uint64)
            for m in range(k):
                y = y * A.BASE + h[at + m]
            docs.append(doc[at])
            out.append(A.mix(y ^ _C[4]))
    return np.concatenate(docs), np.concatenate(out)


def weighted(docs: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each document, in order, and how often each occurs."""
    order = np.lexsort((x, docs))
    d, x = docs[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[first], x[first], np.diff(np.append(first, len(d)))


def dart_signatures(d: np.ndarray, x: np.ndarray, w: np.ndarray, n: int, k: int = K, mean: float = 6.0) -> np.ndarray:
    """n rows of k 32-bit coordinates for documents 0 to n-1 with elements x of weight w > 0 (real numbers, too)."""
    out = np.zeros((n, k), np.uint32)
    total = np.bincount(d, w, n)
    todo = total > 0
    theta = np.zeros(n)
    theta[todo] = k * mean / total[todo]
    while todo.any():
        own = todo[d]
        units = np.ceil(w[own]).astype(np.int64)
        e = np.repeat(np.flatnonzero(own), units)
        m = np.arange(len(e)) - np.repeat(np.cumsum(units) - units, units)  # the unit of weight
        seed = A.mix(x[e] + m.astype(np.uint64) * _C[0])
        rank, number = np.zeros(len(e)), 0
        keys, ranks, values = [], [], []
        limit, weight, of = theta[d[e]], w[e], d[e]
        while len(seed):
            number += 1
            v = A.mix(seed + np.uint64(number * int(_C[1]) & (2**64 - 1)))
            rank = rank - np.log(A.unit(v))
            live = rank <= limit
            seed, rank, limit, m, weight, of, v = (a[live] for a in (seed, rank, limit, m, weight, of, v))
            inside = m + A.unit(A.mix(v ^ _C[2])) < weight if (weight != np.floor(weight)).any() else np.ones(len(v), bool)
            c = A.mix(v[inside] ^ _C[3])
            keys.append(of[inside] * k + (c >> np.uint64(32)).astype(np.int64) % k)
            ranks.append(rank[inside])
            values.append((c & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        key, value = np.concatenate(keys), np.concatenate(values)
        late = np.argsort(-np.concatenate(ranks), kind="stable")
        flat, seen = out.reshape(-1), np.zeros(n * k, bool)
        flat[key[late]] = value[late]  # the earliest is written last
        seen[key] = True
        todo &= ~seen.reshape(n, k).all(1)
        theta[todo] *= 2
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _C[0], x.shape[:2]).copy()
    for r in range(ROWS):
        key = A.mix(key ^ x[:, :, r]) + _C[r]
    return key.view(np.int64)


def _nodes(doc: np.ndarray, h: np.ndarray, i: int, j: int) -> np.ndarray:
    """A 64-bit hash of each text's words in order. (Of 10^9 texts, some two meet with probability 0.03.)"""
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    place = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    out = np.zeros(j - i, np.uint64)
    if len(doc):
        out[doc[begin] - i] = np.add.reduceat(A.mix(h + place.astype(np.uint64) * _C[1]), begin)
    return A.mix(out).view(np.int64)


def signed(docs: DataFrame, counts: bool = False) -> DataFrame:
    """doc_id, tx, node, sig of (doc_id, text): the hash of the text, of its words, and the signature.
    A null text has no node. One without words has a node of its characters, and no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, valid = A.buffers(b.column(2))
            for i, j, doc, _, _, h in A.words(data, off):
                node = _nodes(doc, h, i, j)
                d, x, n = weighted(*shingles(doc - i, h, 0, j - i))
                sig = dart_signatures(d, x, n.astype(float) if counts else np.ones(len(x)), j - i)
                some = np.bincount(doc - i, minlength=j - i) > 0
                for t in np.flatnonzero(~some):
                    node[t] = hash_bytes(bytes(data[off[i + t] : off[i + t + 1]]))
                raw = sig.tobytes()
                rows = [raw[a * K * 4 : (a + 1) * K * 4] if o else None for a, o in enumerate(some)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(node, pa.int64(), mask=~valid[i:j]), pa.array(rows, pa.binary())], ["doc_id", "tx", "node", "sig"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tx"), "text").mapInArrow(run, f"doc_id {kind}, tx long, node long, sig binary")


def hash_bytes(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=b"no words").digest(), "little", signed=True)


def sets(docs: DataFrame) -> DataFrame:
    """node, and the sorted 32-bit hashes of its distinct shingles, of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = A.buffers(b.column(0))
            for i, j, doc, _, _, h in A.words(data, off):
                d, x, _ = weighted(*((lambda a, y: (a, y >> np.uint64(32)))(*shingles(doc - i, h, 0, j - i))))
                cuts = np.searchsorted(d, np.arange(j - i + 1))
                raw = x.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(doc, h, i, j), pa.int64()), pa.array([raw[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())], ["node", "set"])

    return docs.select("text").mapInArrow(run, "node long, set binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


@F.pandas_udf(DoubleType())
def _jaccard_udf(a, b):  # noqa: ANN001, ANN202
    return a.combine(b, lambda x, y: jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))).astype(float)


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node of each connected component, for all nodes of edges (a, b), by large and small stars."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = saved(e)
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = saved(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        e = saved(joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select("v", "m")).distinct())
        del both, large, least, joined
        release(edges.sparkSession)
        # done when all are stars: each node has one other, and none of these has one itself
        several = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        if not several.union(e.select("u").intersect(e.select("v"))).limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _blockwise(rest: DataFrame, payload: DataFrame) -> DataFrame:
    """Links (a, b) between classes that share a bucket: rest has key, node, comp, n_comp (members of the class in the
    bucket), n_small (members of small classes in it); payload has node, sig, set, and is joined at last. Members come in blocks of about BLOCK, large classes' apart, and
    each pair of blocks that isn't all of one class is a group of its own."""
    large = F.col("n_comp") >= BLOCK // 8
    count = F.when(large, F.col("n_comp")).otherwise(F.col("n_small"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.ceil(count / BLOCK)))
    blocked = saved(rest.withColumn("blk", F.xxhash64(F.when(large, F.col("comp")).otherwise(F.lit(0)), large, part)))
    blocks = saved(blocked.groupBy("key", "blk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    other = blocks.toDF("key", "blk2", "lo2", "hi2")
    pairs = blocks.join(other, "key").filter("blk <= blk2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)").select("key", "blk", "blk2")
    pairs = saved(pairs.withColumn("pair", F.xxhash64("key", "blk", "blk2")))
    each = pairs.select("key", "pair", "blk", F.lit(0).alias("side")).union(pairs.filter("blk <> blk2").select("key", "pair", "blk2", F.lit(1)))
    rows = saved(blocked.join(each, ["key", "blk"]).select("pair", "key", "side", "node", "comp")).join(payload, "node")

    def compare(t: pa.Table) -> pa.Table:
        node, comp, key, side = (t.column(c).to_numpy() for c in ("node", "comp", "key", "side"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, K)
        bands = band_keys(sig)
        own = [np.frombuffer(s, np.uint32) for s in t.column("set").to_pylist()]
        here = bands == key[:, None]
        at = int(here.any(0).argmax())  # which band this bucket is of
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        best: dict[int, int] = {}

        def root(c: int) -> int:
            while best.setdefault(c, c) != c:
                best[c] = c = best[best[c]]
            return c

        links = []
        for i in left:
            agree = (sig[right] == sig[i]).sum(1)
            earlier = (bands[right, :at] == bands[i, :at]).any(1) if at else np.zeros(len(right), bool)
            near = right[(agree >= LEAST_AGREE) & (comp[right] != comp[i]) & ~earlier]
            for j in near[np.argsort(-agree[np.isin(right, near)], kind="stable")]:
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b and jaccard(own[i], own[j]) >= THRESHOLD:
                    best[a] = b
                    links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return rows.groupBy("pair").applyInArrow(compare, "a long, b long")


def classes_of(docs: DataFrame, counts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row of (doc_id, text), and (node, comp) of the nodes with links to others."""
    rows = saved(signed(docs, counts))
    nodes = saved(rows.filter("sig IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig"), F.min(F.struct("doc_id", "tx")).alias("row")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, K)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).reshape(-1)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "node"])

    bands = nodes.select("node", "sig").mapInArrow(spread, "key long, node long")
    sizes = saved(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = saved(bands.join(sizes, "key"))
    # a bucket's most central member: the one that shares most with others over all bands
    central = saved(members.groupBy("node").agg(F.sum("n").alias("score")))
    leaders = saved(members.join(central, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("x")).select("key", F.col("x.node").alias("b")))
    edges = saved(members.join(leaders, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct())

    wanted = central.join(nodes, "node").select(F.col("row.doc_id").alias("w_id"), F.col("row.tx").alias("w_tx"))
    wanted = saved(wanted)
    small = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda x: x
    chosen = docs.join(small(wanted), (F.xxhash64("text") == F.col("w_tx")) & docs["doc_id"].eqNullSafe(F.col("w_id")), "left_semi")
    own = saved(sets(chosen.select("text")).dropDuplicates(["node"]))
    tested = edges.join(own.toDF("a", "set_a"), "a").join(own.toDF("b", "set_b"), "b")
    release(docs.sparkSession)
    links = saved(tested.filter(_jaccard_udf("set_a", "set_b") >= THRESHOLD).select("a", "b"))
    comps = saved(components(links))

    # buckets of three or more that still hold several classes
    named = members.filter("n > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = saved(named)
    by_comp = named.groupBy("key", "comp").agg(F.count("*").alias("n_comp"))
    by_comp = saved(by_comp)
    mixed = by_comp.groupBy("key").agg(F.count("*").alias("n_comps"), F.sum(F.when(F.col("n_comp") < BLOCK // 8, F.col("n_comp")).otherwise(0)).alias("n_small")).filter("n_comps > 1")
    mixed = saved(mixed.drop("n_comps"))
    rest = named.select("key", "node", "comp").join(mixed, "key").join(by_comp, ["key", "comp"])
    wide = rest.select("node").distinct()
    payload = saved(wide.join(nodes.select("node", "sig"), "node").join(own, "node"))
    more = saved(_blockwise(rest, payload))
    release(docs.sparkSession)
    if more.limit(1).count():
        comps = saved(components(links.union(more)))
    return rows.select("doc_id", "node"), comps


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """doc_id, class_id, class_size for each row of docs.

    class_id is the least doc_id of the rows that are linked, over any number of steps, by a Jaccard similarity of 0.8
    or more of their sets of five-word shingles; class_size the number of those rows. Words are [0-9a-z] and characters
    beyond ASCII, lower-cased; a text of fewer than five words has one shingle, of all. Texts without a word are linked
    if they are equal; a null text is alone. With counts=True candidates are found by shingles' counts as weights. A
    class whose ids are all null has a null id; repeated rows are in one class; no rows give no rows."""
    rows, comps = classes_of(pick(docs, doc_id=doc_id, text=text), counts)
    with_class = rows.filter("node IS NOT NULL").join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp"))
    with_class = saved(with_class)
    least = saved(with_class.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    alone = rows.filter("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return with_class.join(least, "comp").select("doc_id", "class_id", "class_size").union(alone)


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of near duplicates: that with the least id (then by text); the columns stay."""
    names = docs.columns
    read = pick(docs, doc_id=doc_id, text=text)
    rows, comps = classes_of(read)
    with_class = rows.filter("node IS NOT NULL").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    kept = saved(with_class.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x")).select(F.col("x.doc_id").alias("k_id"), F.col("x.node").alias("k_node")))
    out = held(docs)
    i, t, n = names.index(doc_id), names.index(text), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, valid = A.buffers(b.column(t))
            for a, z, doc, _, _, h in A.words(data, off):
                node = _nodes(doc, h, a, z)
                for x in np.flatnonzero(np.bincount(doc - a, minlength=z - a) == 0):
                    node[x] = hash_bytes(bytes(data[off[a + x] : off[a + x + 1]]))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in b.columns], pa.array(node, pa.int64(), mask=~valid[a:z])], [*b.schema.names, "__node"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    noded = out.mapInArrow(run, f"{fields}, __node long")
    stays = noded.join(kept, (F.col("__node") == F.col("k_node")) & F.col(f"_{i}").eqNullSafe(F.col("k_id")), "left_semi")
    # rows that repeat an id and its words: one of them
    one = F.row_number().over(Window.partitionBy("__node", f"_{i}").orderBy(*[F.col(f"_{k}") for k in [t, *range(n)] if out.schema[k].dataType.simpleString() not in ("map", "variant")]))
    stays = stays.withColumn("__one", one).filter("__one = 1").drop("__one", "__node").union(out.filter(F.col(f"_{t}").isNull()))
    return stays.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
