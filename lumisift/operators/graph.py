"""Similarity graphs: cosine pairs, mutual top-k edges, k-core, components, and what is kept.

Edges are symmetric rows (src, dst, sim); isolated nodes live only in the node table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, discard
from .numbering import numbered

DIGITS = 9  # cosines are rounded before they are ranked or compared


def cosine_pairs(vectors: DataFrame, floor: float, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 16_384) -> DataFrame:
    """(src, dst, sim), src < dst, of all pairs with a cosine of at least ``floor``; exact.

    Every vector is set against every other in blocks: a block meets the blocks from its own
    number on, each meeting being one task of two bounded matrices, and only pairs at the
    floor leave it. A block travels as a few large rows, once to each other block; products are taken in single precision,
    and what comes near the floor again in double. Norms are guarded by 1e-12. Null, empty or non-finite vectors and
    vectors of a length other than the most frequent one are left out. The work is quadratic: for approximate search at scale use an index.
    """
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    ok = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = ok.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).filter("size(v) > 0")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("sim"))
    dim, dtype = size.d, np.float32 if kind == "float" else np.float64
    rows = rows.filter(F.size("v") == dim)
    blocks = max(1, -(-rows.count() // block))

    def pack(batches):
        for p in batches:
            ids, x, to = p["id"].to_numpy(), np.array(p["v"].tolist(), dtype=dtype).reshape(-1, dim), p["b"].to_numpy()
            for k in np.unique(to):
                m = to == k
                yield pd.DataFrame({"b": [k], "ids": [ids[m].tobytes()], "vecs": [x[m].tobytes()]})

    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packed = rows.withColumn("b", mine).mapInPandas(pack, "b int, ids binary, vecs binary")
    met = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("b", "ids", "vecs", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def cross(t: pa.Table) -> pa.Table:
        b = t.column("b").to_numpy()
        ids, vecs = t.column("ids").to_pylist(), t.column("vecs").to_pylist()

        def unit(k):
            rows_ = np.flatnonzero(b == k)
            m = np.frombuffer(b"".join(vecs[i] for i in rows_), dtype=dtype).reshape(-1, dim).astype(float)
            return np.frombuffer(b"".join(ids[i] for i in rows_), dtype=np.int64), m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]

        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        (i, a), (j, c) = unit(x), unit(y)
        src, dst, sim = [], [], []
        small = c.astype(np.float32).T
        for lo in range(0, len(a), 1024):
            near = a[lo : lo + 1024].astype(np.float32) @ small >= np.float32(floor - 1e-5)
            r, k = np.nonzero(near)
            r += lo
            if x == y:
                up = i[r] < j[k]
                r, k = r[up], k[up]
            s = np.concatenate([np.round(np.einsum("ij,ij->i", a[r[h : h + 65536]], c[k[h : h + 65536]]), DIGITS) for h in range(0, len(r), 65536)] or [np.empty(0)])
            r, k, s = r[s >= floor], k[s >= floor], s[s >= floor]
            src.append(np.minimum(i[r], j[k]))
            dst.append(np.maximum(i[r], j[k]))
            sim.append(s)
        cols = [np.concatenate(v) if v else np.empty(0, dtype=d) for v, d in ((src, np.int64), (dst, np.int64), (sim, float))]
        return pa.table({"src": cols[0], "dst": cols[1], "sim": cols[2]})

    return met.groupBy("x", "y").applyInArrow(cross, "src long, dst long, sim double")


def symmetric(pairs: DataFrame) -> DataFrame:
    both = F.array(F.struct("src", "dst", "sim"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    return pairs.select(F.explode(both).alias("e")).select("e.*")


def top_k(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, sim, rank): each node's first k by (similarity descending, id)."""
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mutual_top_k(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, sim), src < dst: pairs that are in each other's top k. A floor applied
    before ranking leaves the same edges as one applied after it."""
    best = top_k(symmetric(pairs), k).select("src", "dst", "sim")
    back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return best.filter("src < dst").join(back, ["src", "dst"], "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def k_core(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(node) of the k-core: rounds that remove all nodes of fewer than k neighbors at once, until none is.

    Each round is one aggregation and two semi-joins over the remaining edges, written out. k <= 0 keeps every node.
    """
    if k <= 0:
        return nodes.select("node")
    left, n = cut(symmetric(edges).select("src", "dst"), "core"), -1
    while (m := left.count()) not in (0, n):
        strong = left.groupBy("src").agg(F.count("*").alias("d")).filter(F.col("d") >= k).select("src")
        new = cut(left.join(strong, "src", "left_semi").join(strong.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"), "core")
        discard(left)
        left, n = new, m
    return left.select(F.col("src").alias("node")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, size): components numbered from 1 by (size descending, smallest node).

    Labels fall to the smallest label next to them, and twice to their label's own label, until they rest; each
    round is written out.
    """
    label = cut(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    e = cut(symmetric(edges).select("src", "dst"), "edges")
    while True:
        near = e.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        new = label.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        for _ in range(2):
            jump = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        new = cut(new, "labels")
        rests = new.filter("label <> old").isEmpty()
        discard(label)
        label = new.select("node", "label")
        label.cut_path = new.cut_path
        if rests:
            break
    size = label.groupBy("label").agg(F.count("*").alias("size"))
    order = numbered(size, [F.desc("size"), F.col("label")], "component", 1)
    return label.join(order, "label").select("node", "component", "size")


def keep_largest(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(kept, audit): the nodes of the largest component of the k-core (none if the core is empty), and the counts."""
    core = cut(k_core(nodes, edges, k), "core")
    inside = edges.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi")
    comp = cut(components(core, inside), "components")
    counts = (("nodes", nodes, F.count("*")), ("edges", edges, F.count("*")), ("nodes_with_edges", symmetric(edges), F.countDistinct("src")), ("core_nodes", core, F.count("*")), ("components", comp, F.countDistinct("component")))
    rows = None
    for name, df, what in counts:
        row = df.agg(what.alias("n")).select(F.lit(name).alias("name"), "n")
        rows = row if rows is None else rows.union(row)
    audit = rows.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name, _, _ in counts))
    return comp.filter("component = 1").select("node"), audit


def bypassed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, audit) of a graph filter that is switched off: every node, counted as one component without edges."""
    zero = F.lit(0).cast("long")
    n = F.count("*")
    return nodes.select("node"), nodes.agg(n.alias("nodes"), zero.alias("edges"), zero.alias("nodes_with_edges"), n.alias("core_nodes"), F.when(n > 0, 1).otherwise(0).cast("long").alias("components"))


def accounting(sizes: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: how many clusters, and images in them, a filter keeps and excludes, of sizes (cluster_id, size) and kept (node)."""
    t = sizes.select("cluster_id", "size").join(kept.select(F.col("node").alias("cluster_id"), F.lit(True).alias("in_")).distinct(), "cluster_id", "left")
    has = F.col("in_").isNotNull()
    images = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    return t.agg(F.count_if(has).alias("kept_clusters"), F.count_if(~has).alias("excluded_clusters"), images(has).alias("kept_images"), images(~has).alias("excluded_images"))
