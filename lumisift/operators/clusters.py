"""Clusters of near-identical records: complete linkage, medoid, backups, audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linkage import complete_linkage
from ..storage import cut
from .graph import components, cosine_pairs
from .numbering import numbered


def complete_linkage_clusters(vectors: DataFrame, floor: float, id_col: str = "vec_id", vec_col: str = "embedding", path_col: str | None = None, largest: int = 8000, pairs: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id): complete-linkage clusters cut at cosine ``floor``, numbered from 0 by their first path.

    A cluster lies inside one component of the graph of pairs at the floor, so components are
    linked apart: one of at most ``largest`` distinct vectors in one task, a larger one by rounds of joins
    (:func:`link_by_rounds`). Equal vectors are folded into their smallest id first, as they are joined first
    anyway. Of one cluster no pair is below the floor. Records whose vector
    cannot be compared are singletons; an empty table gives no rows.

    Without ``pairs`` all distinct vectors are compared (:func:`graph.cosine_pairs`, exact and quadratic). Larger
    collections hand in ``pairs`` (src, dst, sim), src < dst, between the smallest ids of equal vectors, from an index.
    """
    ids = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = usable.filter("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")
    size = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    usable = usable.filter(F.size("v") == (size.d if size else 0))
    # Folded are vectors of cosine 1 with themselves: finite ones that are not all but zero.
    equal = usable.withColumn("whole", F.forall("v", lambda x: F.abs(x) < 1e150) & F.exists("v", lambda x: F.abs(x) > 1e-12))
    first = cut(equal.groupBy("v", F.when(~F.col("whole"), F.col("id")).alias("own")).agg(F.min("id").alias("node"), F.collect_set("id").alias("ids")), "equal")
    of = first.select("node", F.explode("ids").alias("id"))
    pairs = cut(cosine_pairs(first.select("node", F.col("v").cast(vectors.schema[vec_col].dataType).alias("v")), floor, "node", "v") if pairs is None else pairs.filter(F.col("sim") >= floor).select("src", "dst", "sim"), "pairs")
    nodes = first.select("node").union(ids.join(of, "id", "left_anti").select(F.col("id").alias("node")))
    comp = cut(components(nodes, pairs), "components")
    inside = pairs.join(comp.select(F.col("node").alias("src"), "component", F.col("size").alias("n")), "src")
    alone = comp.filter("size = 1").select(F.col("node").alias("id"), F.col("node").alias("first"))

    def link(p: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[p.src, p.dst])
        s = np.full((len(ids), len(ids)), -2.0)
        a, b = np.searchsorted(ids, p.src), np.searchsorted(ids, p.dst)
        s[a, b] = s[b, a] = p["sim"]
        return pd.DataFrame({"id": ids, "first": ids[complete_linkage(s, floor)]})

    linked = inside.filter(F.col("n") <= largest).drop("n").groupBy("component").applyInPandas(link, "id long, first long").union(alone)
    if not comp.filter(F.col("size") > largest).isEmpty():
        label = link_by_rounds(cut(inside.filter(F.col("n") > largest).select(F.col("src").alias("a"), F.col("dst").alias("b"), "sim"), "large"))
        rest = comp.filter(F.col("size") > largest).select(F.col("node").alias("id")).join(label.select("id"), "id", "left_anti")
        linked = linked.union(label.select("id", "cluster")).union(rest.select("id", F.col("id").alias("first")))
    linked = linked.withColumnRenamed("id", "node").join(of, "node", "left").select(F.coalesce("id", "node").alias("id"), "first")
    if path_col is None:
        named = linked.withColumn("path", F.lpad(F.col("id").cast("string"), 20, "0"))
    else:
        named = linked.join(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path")), "id")
    return number(named.select("id", "path", F.col("first").alias("group"))).select("id", "cluster_id")


def link_by_rounds(pairs: DataFrame) -> DataFrame:
    """(id, cluster): complete linkage of (a, b, sim) by rounds of joins, for graphs of any size.

    Pairs not listed are below the threshold. In each round every cluster names its best
    partner in the same total order as the in-task linkage; two that name each other
    are joined, and a joined cluster keeps a partner only if all its parts had it. The
    lowest similarity never rises by joining, so the order of joins elsewhere is free.
    """
    edges, label = pairs, None
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))).alias("e")).select("e.*")
        order = F.struct("sim", -F.least("a", "b"), -F.greatest("a", "b"))
        best = both.groupBy("a").agg(F.max_by("b", order).alias("b"))
        merge = cut(best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).filter("a < b"), "merge")
        if merge.isEmpty():
            break
        to = merge.select(F.col("b").alias("old"), F.col("a").alias("new"))
        step = merge.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("cluster")), F.struct(F.col("b").alias("id"), F.col("a").alias("cluster")))).alias("m")).select("m.*")
        if label is None:
            label = cut(step, "label")
        else:
            moved = label.join(to, F.col("cluster") == F.col("old"), "left").select("id", F.coalesce("new", "cluster").alias("cluster"))
            label = cut(moved.union(step.join(label.select(F.col("cluster").alias("id")), "id", "left_anti").join(label.select("id"), "id", "left_anti")), "label")
        grown = merge.select(F.col("a").alias("k"))
        e = edges
        for side in ("a", "b"):
            e = e.join(to.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}")), side, "left")
        for side in ("a", "b"):
            e = e.join(grown.select(F.col("k").alias(f"x_{side}")), F.coalesce(f"new_{side}", side) == F.col(f"x_{side}"), "left")
        e = e.select(F.coalesce("new_a", "a").alias("p"), F.coalesce("new_b", "b").alias("q"), "sim", (F.when(F.col("x_a").isNotNull(), 2).otherwise(1) * F.when(F.col("x_b").isNotNull(), 2).otherwise(1)).alias("parts")).filter("p <> q")
        e = e.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "sim", "parts")
        edges = cut(e.groupBy("a", "b", "parts").agg(F.min("sim").alias("sim"), F.count("*").alias("n")).filter("n = parts").select("a", "b", "sim"), "edges")
    if label is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("cluster")).limit(0)
    return label


def number(members: DataFrame) -> DataFrame:
    """Adds cluster_id to (id, path, group): 0, 1, 2 ... by the first path of each group.

    Only one row a group takes part in the ordering; groups that share a first path go by group.
    """
    first = members.groupBy("group").agg(F.min("path").alias("first"))
    ids = numbered(first, ["first", "group"], "cluster_id")
    return members.join(ids.select("group", "cluster_id"), "group")


def _totals(members: DataFrame) -> DataFrame:
    """(cluster_id, total): the sum of each cluster's vectors; each batch is summed before the shuffle."""

    def partial(batches):
        for p in batches:
            for _, q in p.groupby(p["v"].map(len)):  # a cluster's vectors are of one length, those of singletons may differ
                code, ids = pd.factorize(q["cluster_id"])
                part = np.zeros((len(ids), len(q["v"].iloc[0])))
                np.add.at(part, code, np.array(q["v"].tolist(), dtype=float))
                yield pd.DataFrame({"cluster_id": ids, "part": list(part)})

    parts = members.select("cluster_id", "v").mapInPandas(partial, "cluster_id long, part array<double>")
    cells = parts.select("cluster_id", F.posexplode("part").alias("k", "x")).groupBy("cluster_id", "k").agg(F.sum("x").alias("x"))
    return cells.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("total"))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _lowest(members: DataFrame, block: int = 4096) -> DataFrame:
    """(cluster_id, lowest): the least dot product between two members of every cluster of two or more; exact.

    A cluster's blocks meet each other once, one bounded product a task, of which only the minimum leaves it.
    """
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1").select("cluster_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    t = members.select("cluster_id", "id", "v").join(size, "cluster_id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = t.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster_id", "v", "mine", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"))

    def least(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p.x.iloc[0], p.y.iloc[0]
        matrix = lambda k: np.array(p.v[p.mine == k].tolist(), dtype=float)
        a, b, low = matrix(x), matrix(y), 1.0
        for lo in range(0, len(a), 1024) if len(b) else ():
            s = a[lo : lo + 1024] @ b.T
            if x == y:
                s[np.arange(len(s)), lo + np.arange(len(s))] = 1.0
            low = min(low, float(s.min()))
        return pd.DataFrame({"cluster_id": [p.cluster_id.iloc[0]], "low": [max(low, -1.0)]})

    return met.groupBy("cluster_id", "x", "y").applyInPandas(least, "cluster_id long, low double").groupBy("cluster_id").agg(F.min("low").alias("lowest"))


def medoids(members: DataFrame) -> DataFrame:
    """(cluster_id, id, role, rank, sim_to_medoid, size, lowest) of members (cluster_id, id, path, pos, v).

    The medoid has the highest sum of dot products, ties to the first position; backups are ranked by
    (similarity to the medoid descending, path). ``lowest`` is the least similarity within the cluster, 1 for one member.
    A member's sum of products is its product with the cluster's sum, so clusters of any size are
    handled by joins; only ``lowest`` compares all pairs, in blocks.
    """
    m = members.select("cluster_id", "id", "path", "pos", "v")
    scored = m.join(_totals(m), "cluster_id").select("cluster_id", "id", "path", "pos", "v", F.round(_dot("v", "total"), 9).alias("s"))
    best = scored.groupBy("cluster_id").agg(F.max_by(F.struct("id", "v"), F.struct("s", -F.col("pos"))).alias("best"), F.count("*").alias("size"))
    to = m.join(best.select("cluster_id", F.col("best.id").alias("medoid"), F.col("best.v").alias("centre"), "size"), "cluster_id").join(_lowest(m), "cluster_id", "left")
    sim = F.greatest(F.least(_dot("v", "centre"), F.lit(1.0)), F.lit(-1.0))
    d = to.select("cluster_id", "id", "path", (F.col("id") == F.col("medoid")).alias("is_medoid"), sim.alias("sim_to_medoid"), "size", F.coalesce("lowest", F.lit(1.0)).alias("lowest"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("is_medoid"), F.round("sim_to_medoid", 9).desc(), "path")
    ranked = d.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.select("cluster_id", "id", F.when(F.col("is_medoid"), "medoid").otherwise("member").alias("role"), "rank", "sim_to_medoid", "size", "lowest")


def singletons(records: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Clustering switched off: every record is its own cluster and medoid."""
    ids = records.select(F.col(id_col).alias("id")).distinct()
    return numbered(ids, ["id"], "cluster_id").select("cluster_id", "id", F.lit("medoid").alias("role"))


def audit(ranked: DataFrame) -> DataFrame:
    """One row a cluster: size, lowest similarity, and the members in order with role and similarity."""
    member = F.struct("rank", "id", "role", F.round("sim_to_medoid", 6).alias("sim"))
    return ranked.groupBy("cluster_id").agg(F.first("size").alias("size"), F.first("lowest").alias("min_similarity"), F.array_sort(F.collect_list(member)).alias("members"))
