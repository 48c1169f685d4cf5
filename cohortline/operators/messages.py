"""Trained aggregation over neighbours: two hops of messages with learned weights.

A node's features become its state; twice, a node's new state is made from its own and the mean of its neighbours' states.
The parameters, a few matrices of the hidden width, are on the driver; their gradients are sums over partitions.

For a fit the nodes are dealt once to blocks of near features, each with the neighbours of its nodes and theirs in turn: all
that the losses of a block's nodes depend on. A round is then one pass over the blocks, without a shuffle, and so is a
prediction over blocks of the nodes that it is for. Where nodes have
many edges, or edges don't lead to near nodes, so that blocks would repeat most of the graph, messages go along the edges by a
join and an aggregate, and their gradients back the same way: four passes over all edges a round. Either gives the same
gradients. Nothing of an edge reaches the driver, and of nodes a bounded sample of features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import saved

Parameters = dict[str, np.ndarray]

#: Nodes of a block, about; rows that borders of blocks come from, at most, and of them those of one block, at least.
BLOCK, BORDER_ROWS, LEAF_ROWS = 8192, 65536, 16
#: Most edges of a node, and members of blocks for each node that is learned from, with which there are blocks.
MOST_EDGES, MOST_COPIES = 16, 5


def initial(features: int, width: int, seed: int = 7) -> Parameters:
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.normal(size=(a, b)) * np.sqrt(2.0 / a)
    p = {"in": draw(features, width), "in_b": np.zeros(width)}
    for hop in (1, 2):
        p |= {f"own{hop}": draw(width, width), f"near{hop}": draw(width, width), f"b{hop}": np.zeros(width)}
    return p | {"out": draw(width, 1)[:, 0], "out_b": np.zeros(1)}


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def shaped(x: np.ndarray, like: Parameters) -> Parameters:
    cuts = np.cumsum([v.size for v in like.values()])[:-1]
    return {n: part.reshape(v.shape) for (n, v), part in zip(like.items(), np.split(x, cuts))}


def _array(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers; a null row is zeros."""
    out = np.zeros((len(column), width))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _mapped(df: DataFrame, columns: list[str], made: dict[str, int], f) -> DataFrame:
    """df[columns] with columns of numbers made by f(arrays by name); widths: 0 for a number, else a list's length."""
    kept = df.select(*columns)
    schema = T.StructType(list(kept.schema.fields))
    for n, w in made.items():
        schema = schema.add(n, T.ArrayType(T.DoubleType()) if w else T.DoubleType())

    def run(batches):
        for b in batches:
            out = f({n: c for n, c in zip(b.schema.names, b.columns)})
            more = [_lists(out[n]) if w else pa.array(out[n], pa.float64()) for n, w in made.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *made])

    return kept.mapInArrow(run, schema)


def _summed(edges: DataFrame, at: str, to: str, values: DataFrame, column: str, width: int, name: str) -> DataFrame:
    """id and the weighted sums of a column of numbers that the edges bring from their `at` to their `to` end."""
    v = values.select(F.col("id").alias(at), column)
    sums: list[Column] = [F.sum(F.col(column)[i] * F.col("w")) for i in range(width)]
    return edges.join(v, at).groupBy(F.col(to).alias("id")).agg(F.array(*sums).alias(name))


def weighted_edges(edges: DataFrame) -> DataFrame:
    """node, neighbour, w: edges (vec_id, neighbour) with the share of each in its node's mean."""
    e = edges.select(F.col("vec_id").alias("node"), "neighbour")
    return saved(e.join(e.groupBy("node").agg((1 / F.count("*")).alias("w")), "node"))


def _forward(nodes: DataFrame, edges: DataFrame, p: Parameters, width: int) -> DataFrame:
    """nodes with their states h0, h1, h2, the means m1, m2 of their neighbours' states, and the log odds z."""
    features = p["in"].shape[0]
    relu = lambda a: np.maximum(a, 0.0)
    kept = ["id", "x", "y", "learn"]
    h = _mapped(nodes, kept, {"h0": width}, lambda c: {"h0": relu(_array(c["x"], features) @ p["in"] + p["in_b"])})
    for hop in (1, 2):
        here, mean, then = f"h{hop - 1}", f"m{hop}", f"h{hop}"
        met = h.join(_summed(edges, "neighbour", "node", h, here, width, mean), "id", "left")
        kept = [*kept, here, mean]

        def step(c, here=here, mean=mean, then=then, hop=hop):
            h_next = relu(_array(c[here], width) @ p[f"own{hop}"] + _array(c[mean], width) @ p[f"near{hop}"] + p[f"b{hop}"])
            return {then: h_next} | ({"z": h_next @ p["out"] + p["out_b"][0]} if hop == 2 else {})

        h = _mapped(met, kept, {then: width} | ({"z": 0} if hop == 2 else {}), step)
    return h


def predicted(nodes: DataFrame, edges: DataFrame, p: Parameters, name: str = "prediction") -> DataFrame:
    """id, y and the probability of label 1."""
    h = _forward(nodes, edges, p, len(p["out"]))
    return h.select("id", "y", (1 / (1 + F.exp(-F.col("z")))).alias(name))


def gradients(nodes: DataFrame, edges: DataFrame, p: Parameters) -> tuple[float, Parameters]:
    """The mean log loss over the nodes that are learned from, and its gradient. nodes: id, x, y, learn (0 or 1)."""
    width = len(p["out"])
    on = lambda c, n: (_array(c[n], width) > 0)

    def last(c):
        z, y, learn = (c[n].to_numpy(zero_copy_only=False).astype(float) for n in ("z", "y", "learn"))
        rest = np.where(learn > 0, 1 / (1 + np.exp(-z)) - np.nan_to_num(y), 0.0)
        return {"rest": rest, "d2": rest[:, None] * p["out"] * on(c, "h2")}

    states = ["id", "x", "y", "learn", "h0", "m1", "h1", "m2", "h2", "z"]
    back = saved(_mapped(_forward(nodes, edges, p, width), states, {"rest": 0, "d2": width}, last))
    columns = [*states, "rest", "d2"]
    for hop in (2, 1):
        d, below, sent = f"d{hop}", f"d{hop - 1}", f"s{hop}"
        outgoing = _mapped(back, ["id", d], {"g": width}, lambda c, d=d, hop=hop: {"g": _array(c[d], width) @ p[f"near{hop}"].T})
        met = back.join(_summed(edges, "node", "neighbour", outgoing, "g", width, sent), "id", "left")

        def step(c, d=d, below=below, sent=sent, hop=hop):
            return {below: (_array(c[d], width) @ p[f"own{hop}"].T + _array(c[sent], width)) * on(c, f"h{hop - 1}")}

        columns = [*columns, sent]
        back = _mapped(met, columns, {below: width}, step)
        columns = [*columns, below]
        back = saved(back) if hop == 2 else back

    def sums(batches):
        total, features = None, p["in"].shape[0]
        for b in batches:
            c = {n: v for n, v in zip(b.schema.names, b.columns)}
            a = {n: _array(c[n], width) for n in ("h0", "m1", "h1", "m2", "h2", "d0", "d1", "d2")}
            x, rest = _array(c["x"], features), c["rest"].to_numpy(zero_copy_only=False)
            z, y, learn = (c[n].to_numpy(zero_copy_only=False).astype(float) for n in ("z", "y", "learn"))
            loss = np.where(learn > 0, np.logaddexp(0.0, z) - np.nan_to_num(y) * z, 0.0).sum()
            g = {"in": x.T @ a["d0"], "in_b": a["d0"].sum(0)}
            for hop in (1, 2):
                d = a[f"d{hop}"]
                g |= {f"own{hop}": a[f"h{hop - 1}"].T @ d, f"near{hop}": a[f"m{hop}"].T @ d, f"b{hop}": d.sum(0)}
            g |= {"out": a["h2"].T @ rest, "out_b": np.array([rest.sum()])}
            part = np.concatenate([[learn.sum(), loss], flat(g)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    return _collected(back.mapInArrow(sums, "k long, v double"), p)


def _collected(parts: DataFrame, p: Parameters) -> tuple[float, Parameters]:
    """The mean loss and gradient from partitions' sums (k, v): of rows, of losses, and of each parameter's gradients."""
    total = np.zeros(2 + flat(p).size)
    for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():  # one for each parameter
        total[r.k] = r.v
    n = max(total[0], 1.0)
    return total[1] / n, shaped(total[2:] / n, p)


def _borders(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each inner node of a binary tree, in heap order from 1, the feature of the greatest deviation and its median."""
    feature, cut = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    parts = {1: np.arange(len(x))}
    for node in range(1, 1 << depth):
        rows = parts.pop(node)
        if len(rows):
            feature[node] = x[rows].std(0).argmax()
            cut[node] = np.median(x[rows, feature[node]])
        above = x[rows, feature[node]] > cut[node]
        parts[2 * node], parts[2 * node + 1] = rows[~above], rows[above]
    return feature, cut


def _dealt(nodes: DataFrame, n: int) -> DataFrame:
    """nodes with the number of their block: a box of features, or where many are alike, a part of one by a hash."""
    few = nodes.select("x").orderBy(F.xxhash64("id")).limit(min(BORDER_ROWS, max(LEAF_ROWS, n)))
    sample = np.array([r.x for r in few.collect()], float)
    depth = max(0, int(np.ceil(np.log2(max(1.0, min(n / BLOCK, len(sample) / LEAF_ROWS))))))
    feature, cut = _borders(sample, depth)

    def leaves(c):
        x, at = _array(c["x"], sample.shape[1]), np.ones(len(c["x"]), np.int64)
        for _ in range(depth):
            at = 2 * at + (x[np.arange(len(x)), feature[at]] > cut[at])
        return {"leaf": at.astype(float)}

    boxes = _mapped(nodes, nodes.columns, {"leaf": 0}, leaves)
    parts = boxes.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts").cast("long"))
    return boxes.join(F.broadcast(parts), "leaf").withColumn("block", F.col("leaf").cast("long") * (1 << 32) + part).drop("leaf", "parts")  # as few rows as boxes


def _packed(t: pa.Table) -> pa.Table:
    """A block as one row of arrays. Nodes that are learned from come first, then their neighbours, then those of these."""
    level, ids = t["level"].to_numpy(), t["id"].to_numpy()
    order = np.lexsort((ids, -level))
    t = t.take(pa.array(order)).combine_chunks()
    level, ids = level[order], ids[order]
    a, b, c = int((level == 2).sum()), int((level >= 1).sum()), len(level)
    near = t["near"].combine_chunks().slice(0, b)
    size = near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends, flat_ids = near.flatten().to_numpy(zero_copy_only=False), np.sort(ids)
    where = np.minimum(np.searchsorted(flat_ids, ends), c - 1)
    found = np.where(flat_ids[where] == ends, np.argsort(ids)[where], c)  # c: no node
    table = np.full((b, max(1, size.max(initial=0))), c, np.int32)
    row = np.repeat(np.arange(b), size)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = found
    w = 1 / np.maximum(t["edges"].fill_null(1).to_numpy()[:b], 1)
    x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    y = t["y"].to_numpy()[:a]  # NaN for null
    values = {"a": a, "b": b, "c": c, "x": x.astype(float).tobytes(), "near": table.tobytes(), "w": w.astype(float).tobytes(), "y": y.astype(float).tobytes()}
    own = t["id"].combine_chunks().slice(0, a)
    return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in values.items()} | {"ids": pa.ListArray.from_arrays(pa.array([0, a], pa.int32()), own)})


def dealt(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Nodes (id, x, y, learn) with the block of each, its neighbours by edges (vec_id, neighbour) and their number; None where
    they can't be in blocks."""
    size = nodes.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("learn").alias("learn")).first()
    near = saved(edges.filter("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("edges"), F.slice(F.collect_list("neighbour"), 1, MOST_EDGES).alias("near")))
    if not size["learn"] or size["ids"] < size["n"] or (near.agg(F.max("edges")).first()[0] or 0) > MOST_EDGES:
        return None
    return saved(_dealt(nodes, size["n"]).join(near, "id", "left"))


def packed(rows: DataFrame, wanted: Column) -> DataFrame | None:
    """Packed blocks of the wanted ones of dealt nodes; None where they wouldn't be small."""
    level = lambda k: F.lit(k).alias("level")
    members = lambda parts: saved(parts.groupBy("block", "id").agg(F.max("level").alias("level")))
    own = rows.filter(wanted)
    n, learn = rows.agg(F.count_if(wanted), F.count_if(F.col("learn") > 0)).first()
    one = members(own.select("block", "id", level(2)).unionByName(own.select("block", F.explode("near").alias("id"), level(1))))
    if one.count() > MOST_COPIES * max(n, learn):
        return None
    further = one.join(rows.select("id", "near"), "id").select("block", F.explode("near").alias("id"), level(0))
    all_ = members(one.unionByName(further)).join(rows.drop("block", "learn"), "id")
    out = all_.select("block", "level", "id", "x", "y", "edges", "near").groupBy("block").applyInArrow(_packed, f"a long, b long, c long, x binary, near binary, w binary, y binary, ids array<{dict(rows.dtypes)['id']}>")
    return saved(out.repartition(8 + n // (4 * BLOCK)))  # few to a partition, which is read as one batch


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Packed blocks of the nodes that are learned from; None where they wouldn't be small."""
    rows = dealt(nodes, edges)
    return None if rows is None else packed(rows, F.col("learn") > 0)


def _means(h: np.ndarray, near: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(near), h.shape[1]))
    for k in range(near.shape[1]):
        out += h[near[:, k]]
    return out * w[:, None]


def _returned(d: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
    """Rows of d added up at all their neighbours, of which there are n."""
    at = near.ravel()
    return np.stack([np.bincount(at, np.repeat(d[:, j], near.shape[1]), n) for j in range(d.shape[1])], axis=1)


def _states(r: dict, p: Parameters) -> tuple[np.ndarray, ...]:
    """Of a block: features, shares, neighbours of all that have any and of the first nodes, the states and means, log odds."""
    a, b, c = r["a"], r["b"], r["c"]
    x, w, near = np.frombuffer(r["x"]).reshape(c, -1), np.frombuffer(r["w"]), np.frombuffer(r["near"], np.int32).reshape(b, -1)
    last = np.minimum(near[:a], b)  # neighbours of the first nodes are among the first b, or no nodes
    none = np.zeros((1, len(p["out"])))
    h0 = np.maximum(x @ p["in"] + p["in_b"], 0.0)
    m1 = _means(np.concatenate([h0, none]), near, w)
    h1 = np.maximum(h0[:b] @ p["own1"] + m1 @ p["near1"] + p["b1"], 0.0)
    m2 = _means(np.concatenate([h1, none]), last, w[:a])
    h2 = np.maximum(h1[:a] @ p["own2"] + m2 @ p["near2"] + p["b2"], 0.0)
    return x, w, near, last, h0, m1, h1, m2, h2, h2 @ p["out"] + p["out_b"][0]


def block_predicted(packed: DataFrame, p: Parameters, name: str = "prediction") -> DataFrame:
    """predicted() from blocks, for their own nodes."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for i, r in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                own = ids.slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([own, pa.array(np.frombuffer(r["y"]), from_pandas=True), pa.array(1 / (1 + np.exp(-_states(r, p)[-1])))], ["id", "y", name])

    return packed.mapInArrow(run, f"id {kind}, y double, {name} double")


def block_gradients(packed: DataFrame, p: Parameters) -> tuple[float, Parameters]:
    """gradients() from blocks."""

    def run(batches):
        total = np.zeros(2 + flat(p).size)
        for batch in batches:
            for r in batch.drop_columns(["ids"]).to_pylist():
                a, b, c = r["a"], r["b"], r["c"]
                x, w, near, last, h0, m1, h1, m2, h2, z = _states(r, p)
                y = np.frombuffer(r["y"])
                rest = 1 / (1 + np.exp(-z)) - y
                d2 = rest[:, None] * p["out"] * (h2 > 0)
                d1 = _returned(d2 @ p["near2"].T * w[:a, None], last, b + 1)[:b]
                d1[:a] += d2 @ p["own2"].T
                d1 *= h1 > 0
                d0 = _returned(d1 @ p["near1"].T * w[:, None], near, c + 1)[:c]
                d0[:b] += d1 @ p["own1"].T
                d0 *= h0 > 0
                g = {"in": x.T @ d0, "in_b": d0.sum(0)}
                g |= {"own1": h0[:b].T @ d1, "near1": m1.T @ d1, "b1": d1.sum(0), "own2": h1[:a].T @ d2, "near2": m2.T @ d2, "b2": d2.sum(0)}
                g |= {"out": h2.T @ rest, "out_b": np.array([rest.sum()])}
                total += np.concatenate([[a, (np.logaddexp(0.0, z) - y * z).sum()], flat(g)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    return _collected(packed.mapInArrow(run, "k long, v double"), p)


@dataclass
class Trained:
    parameters: Parameters
    losses: list[float]
    nodes: DataFrame
    edges: DataFrame
    rows: DataFrame | None = None

    def others(self, name: str = "prediction") -> DataFrame:
        """id, y and the probability of label 1 of the nodes that weren't learned from."""
        own = None if self.rows is None else packed(self.rows, F.col("learn") == 0)
        if own is not None:
            return block_predicted(own, self.parameters, name)
        got = predicted(self.nodes, weighted_edges(self.edges), self.parameters, name)
        return got.join(self.nodes.filter("learn = 0").select("id"), "id")


def fit(nodes: DataFrame, edges: DataFrame, *, width: int = 8, rounds: int = 25, rate: float = 0.05, seed: int = 7) -> Trained:
    """Parameters after so many steps along the gradient of all nodes, each scaled by its moments, and the losses before them.

    nodes: id, x (lists of one length, without nulls), y (null where unknown), learn; edges: vec_id, neighbour, of which an
    end that is no node counts as zeros. Nodes without edges have a mean of zeros; no nodes leave the parameters as drawn."""
    nodes = saved(nodes.select("id", "x", F.col("y").cast("double").alias("y"), (F.coalesce(F.col("learn"), F.lit(0)) * F.col("y").isNotNull().cast("int")).cast("double").alias("learn")))
    rows = dealt(nodes, edges)
    near = None if rows is None else packed(rows, F.col("learn") > 0)
    weighted = weighted_edges(edges) if near is None else None
    first = nodes.select(F.size("x")).first()
    p = initial(first[0] if first else 1, width, seed)
    x, m, v, losses = flat(p), 0.0, 0.0, []
    for t in range(1, rounds + 1):
        loss, g = gradients(nodes, weighted, shaped(x, p)) if near is None else block_gradients(near, shaped(x, p))
        losses.append(loss)
        m, v = 0.9 * m + 0.1 * flat(g), 0.99 * v + 0.01 * flat(g) ** 2
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Trained(shaped(x, p), losses, nodes, edges, rows)
