"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tillspark.llm.common import Shipped, components
from tillspark.session import materialize

SIMILAR = 0.93
PIVOTS = 128
NEAREST = 12
SHARED = 2
BLOCK = 2048
_STRIPE = 256


def _packed(dtype: str):
    """Vectors as bytes; null where a vector links with nothing."""

    def pack(frames):
        for frame in frames:
            out = []
            for vector in frame["vector"]:
                values = None if vector is None else np.array([np.nan if x is None else x for x in vector], np.float64)
                good = values is not None and len(values) and np.isfinite(values).all() and values.any()
                out.append(values.astype(dtype).tobytes() if good else None)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "packed": out}).astype({"vec_id": "Int64"})

    return pack


class Index:
    """Pivots by dimension, and what describes a vector by them."""

    def __init__(self, pivots: dict[int, np.ndarray], nearest: int, dtype: str):
        self.pivots, self.nearest, self.dtype = pivots, nearest, dtype

    def unit(self, packed) -> np.ndarray:
        x = np.stack([np.frombuffer(p, self.dtype) for p in packed]).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def nearest_pivots(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, the first first; ties by number."""
        close = x @ self.pivots[x.shape[1]].T
        return np.argsort(-close, axis=1, kind="stable")[:, : self.nearest].astype(np.int32)


def _masks(order: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(order), words), np.uint64)
    for column in order.T:
        np.bitwise_or.at(out, (np.arange(len(order)), column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return out


def _links(frame: pd.DataFrame, index: Index, similar: float, shared: int) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Linked (listed, asking) positions of one block of a pivot's list.

    A pair may meet in the home lists of both; where it does, the one whose
    listed node has the smaller name counts.
    """
    frame = frame.reset_index(drop=True)
    x = index.unit(frame["packed"])
    order = np.stack(frame["pivots"].to_numpy())
    masks = _masks(order, -(-len(index.pivots[x.shape[1]]) // 64))
    home, node = order[:, 0], frame["node"].to_numpy()
    listed = np.flatnonzero(frame["listed"].to_numpy())
    asking = np.flatnonzero(~frame["listed"].to_numpy())
    found = []
    for low in range(0, len(listed), _STRIPE):
        mine = listed[low:low + _STRIPE]
        common = sum(np.bitwise_count(masks[mine, None, k] & masks[None, asking, k]) for k in range(masks.shape[1]))
        i, j = np.nonzero(common >= min(shared, order.shape[1]))
        a, b = mine[i], asking[j]
        returns = (masks[a, home[b] // 64] >> (home[b] % 64).astype(np.uint64)) & np.uint64(1) == 1
        keep = (node[a] < node[b]) | (~returns & (node[a] != node[b]))
        a, b = a[keep], b[keep]
        for at in range(0, len(a), 1 << 16):
            s = slice(at, at + (1 << 16))
            near = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= similar
            found.append((a[s][near], b[s][near]))
    pairs = [np.concatenate(p) for p in zip(*found)] if found else [np.zeros(0, int)] * 2
    return pairs[0], pairs[1], frame


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position linked with each of n positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def similar_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    similar: float = SIMILAR, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label and length link if their cosine is at least
    `similar`. Each is described by its `nearest` pivots in order of
    closeness; the pivots are `pivots` vectors drawn by hash, and every
    vector is indexed. A vector is listed under its first pivot and asks at
    the lists of all its pivots; those that share `shared` pivots or more
    are verified in double precision. Lists above BLOCK rows are cut into
    blocks that meet pairwise, so no task holds a long list. A block sends
    link counts and a spanning forest, not its links.

    Equal vectors are one node and count as links of each other. Null, empty
    and zero vectors, vectors with null or non-finite components and rows
    without a label link with nothing: n_links 0 and a component of their
    own. Repeated rows count as further vectors; rows without an id take
    part. Other columns are ignored.
    """
    spark = vectors.sparkSession
    dtype = "<f8" if "double" in dict(vectors.dtypes)[vector_col] else "<f4"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("vector"),
    )
    named = rows.mapInPandas(_packed(dtype), "vec_id long, label string, packed binary").withColumn(
        "node",
        F.when(F.col("label").isNotNull() & F.col("packed").isNotNull(), F.md5(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("packed")))),
    )
    named = materialize(named, "vectors")
    nodes = materialize(
        named.filter("node is not null").groupBy("node", "label", "packed")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("size")),
        "nodes",
    )
    drawn = nodes.select(F.length("packed").alias("bytes"), "node", "packed").withColumn(
        "rank", F.row_number().over(Window.partitionBy("bytes").orderBy("node"))
    )
    by_size: dict[int, list[bytes]] = {}
    for row in drawn.filter(F.col("rank") <= pivots).orderBy("node").collect():  # `pivots` for each vector length
        by_size.setdefault(row["bytes"], []).append(bytes(row["packed"]))
    index = Index({}, nearest, dtype)
    for packed in by_size.values():
        x = index.unit(packed)
        index.pivots[x.shape[1]] = x
    shipped = Shipped(spark, index)

    def describe(frames):
        for frame in frames:
            order = [None] * len(frame)
            sizes = frame["packed"].map(len).to_numpy()
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                near = shipped.value.nearest_pivots(shipped.value.unit(frame["packed"].iloc[mine]))
                for i, o in zip(mine, near):
                    order[i] = o
            yield frame.assign(pivots=order)

    described = nodes.select("node", "label", "packed", "size").mapInPandas(
        describe, "node string, label string, packed binary, size long, pivots array<int>"
    )
    described = materialize(described.withColumn("bytes", F.length("packed")), "described")
    listed = described.withColumn("pivot", F.col("pivots")[0])
    asking = described.withColumn("pivot", F.explode("pivots"))
    key = ["label", "bytes", "pivot"]
    lists = (
        described.select("label", "bytes", F.posexplode("pivots").alias("at", "pivot"))
        .groupBy(*key).agg(
            F.ceil(F.sum((F.col("at") == 0).cast("int")) / BLOCK).cast("int").alias("rows"),
            F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("columns"),
        ).filter("rows > 0")
    )
    place = F.xxhash64("node", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = (
        listed.join(lists, key).withColumn("row", F.pmod(place, F.col("rows")).cast("int")).withColumn("column", every("columns"))
        .withColumn("listed", F.lit(True))
        .unionByName(
            asking.join(lists, key).withColumn("column", F.pmod(place, F.col("columns")).cast("int"))
            .withColumn("row", every("rows")).withColumn("listed", F.lit(False))
        )
        .select(*key, "row", "column", "node", "packed", "size", "pivots", "listed")
    )

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["listed"].all() or not frame["listed"].any():
            return pd.DataFrame({"node": [], "other": [], "links": []})
        a, b, frame = _links(frame, shipped.value, similar, shared)
        size = frame["size"].to_numpy()
        # A node may stand here twice, as listed and as asking.
        codes, names = pd.factorize(frame["node"])
        ca, cb = codes[a], codes[b]
        count = np.bincount(ca, size[b], len(names)) + np.bincount(cb, size[a], len(names))
        root = _forest(ca, cb, len(names))
        linked = np.flatnonzero(count)
        return pd.DataFrame({"node": names[linked], "other": names[root[linked]], "links": count[linked].astype(np.int64)})

    found = materialize(
        grid.groupBy(*key, "row", "column").applyInPandas(link, "node string, other string, links long"), "found"
    )
    labels = components(found.filter("node <> other").select("node", "other"), "node", "other")
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = (
        nodes.select("node", "first", "size").join(degrees, "node", "left").join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    joined = materialize(joined, "joined")
    firsts = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    answers = joined.join(firsts, "component").select(
        "node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = named.filter("node is not null").select("vec_id", "node").join(answers, "node").select("vec_id", "n_links", "component_id")
    alone = named.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
