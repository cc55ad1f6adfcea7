"""Problem 6: clusters of mutually similar records, with size and medoid.

Two forms share one plan: shared keys give candidate pairs, an exact similarity
verifies them, connected components join them, and loose components are split.

* Vectors: candidates come from the hash-prefix forest (a MinHash of a dense vector
  has no meaning), the similarity is the cosine, and a component is split by complete
  linkage, which is what the cluster definition of this project asks for.
* Sets: keys of rare items that no pair at the floor escapes (in place of MinHash bands, which
  miss some), exact Jaccard, and splitting around highest-degree medoids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linkage import complete_linkage
from ..operators.clusters import link_by_rounds
from ..storage import cut
from .groups import components
from .vectors import SCALE, Bucket, Forest, borders, classes, forest_map, passes, unpack, usable


def _roots(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest index of every index's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, r, root[c])
        np.minimum.at(low, c, root[r])
        low = low[low]
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _link_kernel(floor: float):
    """A star per component of a bucket, instead of all its pairs."""
    least = round(floor * SCALE)

    def kernel(b: Bucket):
        root, rs, cs, n = np.arange(len(b.ids)), [], [], 0

        def joined():
            r, c = root[np.concatenate(rs)], root[np.concatenate(cs)]
            return _roots(len(root), r, c)[root]

        for q, m in b.meetings():
            r, c = np.nonzero(b.u[q] @ b.u[m].T >= np.float32(floor - 3e-6))
            r, c = q[r], m[c]
            new = root[r] != root[c]
            r, c = r[new], c[new]
            ok = b.exact(r, c) >= least
            rs.append(r[ok])
            cs.append(c[ok])
            n += int(ok.sum())
            if n > 4 * len(root):
                root, rs, cs, n = joined(), [], [], 0
        if n:
            root = joined()
        of = np.flatnonzero(root != np.arange(len(root)))
        if len(of):
            yield b.ids[root[of]], b.ids[of]

    return kernel


def _cluster_component(ids: np.ndarray, x: np.ndarray, copies: np.ndarray, floor: float):
    """(id, medoid, size) rows of the clusters of one component's distinct vectors."""
    order = np.argsort(ids)
    ids, x, copies = ids[order], x[order], copies[order]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.rint(u @ u.T * SCALE).astype(np.int32)
    label = complete_linkage(s, round(floor * SCALE))
    out_id, out_medoid, out_size = [], [], []
    for k in np.unique(label):
        m = np.flatnonzero(label == k)
        if copies[m].sum() < 2:
            continue
        sums = (s[np.ix_(m, m)].astype(np.int64) * copies[m]).sum(1)  # whole millionths, so sums are exact
        out_id += ids[m].tolist()
        out_medoid += [int(ids[m[sums.argmax()]])] * len(m)
        out_size += [int(copies[m].sum())] * len(m)
    return out_id, out_medoid, out_size


def similar_clusters(df: DataFrame, id_col: str, vec_col: str, floor: float = 0.90, forest: Forest = Forest(), largest: int = 4096) -> DataFrame:
    """(id, medoid_id, size): a row per record in a cluster of two or more.

    Complete linkage only joins records whose every similarity reaches ``floor``, so each
    cluster lies inside one connected component of the graph of such pairs and components
    do not touch each other: the result is that of linking all records at once.
    Components of more than ``largest`` distinct vectors are linked by rounds of joins
    over their pairs (:func:`link_by_rounds`) instead of in one task. Ids without a usable vector,
    repeated rows and empty tables give no rows; copies share a cluster.
    """
    reps, members, n = classes(usable(df, id_col, vec_col, forest.dim))
    forest = forest.sized(n)
    tries = borders(reps, forest, n)
    links = [cut(forest_map(reps, forest, t, _link_kernel(floor), "a long, b long").distinct(), "links") for t in passes(forest, tries)]
    comp = cut(components(reduce(DataFrame.union, links)), "components")
    copies = members.groupBy("cid").agg(F.count("*").alias("copies"))
    size = comp.groupBy("group_id").agg(F.count("*").alias("n"))
    large = size.filter(F.col("n") > largest).select("group_id")
    rows = comp.join(large, "group_id", "left_anti").join(reps, "id").join(copies.withColumnRenamed("cid", "id"), "id", "left")
    rows = rows.select("group_id", "id", "vec", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    dim = forest.dim

    def run(batches):
        g, ids, x, w = (np.empty(0, dtype=np.int64),) * 2 + (np.empty((0, dim), dtype=np.float32), np.empty(0, dtype=np.int64))
        done = object()
        for b in _chain(batches, done):
            if b is not done:
                if not b.num_rows:
                    continue
                g, ids = (np.concatenate([old, b.column(c).to_numpy(zero_copy_only=False)]) for old, c in ((g, "group_id"), (ids, "id")))
                x, w = np.vstack([x, unpack(b.column("vec"), dim)]), np.concatenate([w, b.column("copies").to_numpy(zero_copy_only=False)])
            at = np.flatnonzero(np.diff(g)) + 1
            ends = [*at] if b is not done else [*at, len(g)]
            res = ([], [], [])
            lo = 0
            for hi in ends:
                if hi > lo:
                    for into, got in zip(res, _cluster_component(ids[lo:hi], x[lo:hi], w[lo:hi], floor)):
                        into.extend(got)
                lo = hi
            g, ids, x, w = g[lo:], ids[lo:], x[lo:], w[lo:]
            if res[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in res], names=["cid", "medoid_id", "size"])

    linked = rows.repartition("group_id").sortWithinPartitions("group_id").mapInArrow(run, "cid long, medoid_id long, size long")
    if not large.isEmpty():
        linked = linked.union(_large_components(reps, comp.join(large, "group_id", "left_semi"), copies, floor, forest))
    linked = cut(linked, "linked")
    # Classes of copies that no other vector is near form clusters by themselves.
    alone = copies.join(comp.select(F.col("id").alias("cid")), "cid", "left_anti").select("cid", F.col("cid").alias("medoid_id"), F.col("copies").alias("size"))
    return linked.union(alone).join(members, "cid", "left").select(F.coalesce("id", "cid").alias("id"), "medoid_id", "size")


def _chain(batches, last):
    yield from batches
    yield last


def pairs_within(rows: DataFrame, floor: float, dim: int, block: int = 2048) -> DataFrame:
    """(a, b, sim), a < b, of all pairs at the floor within each group_id of (group_id, id, vec); exact.

    A group's blocks of about ``block`` rows meet each other once, one bounded product a task; a
    row is sent once per block of its group, and only pairs at the floor leave a task.
    """
    least = round(floor * SCALE)
    size = rows.groupBy("group_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    t = rows.join(size, "group_id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = t.select("group_id", "id", "vec", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("group_id", "id", "vec", "mine", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"))

    def cross(p: pd.DataFrame) -> pd.DataFrame:
        def unit(q):
            m = np.frombuffer(b"".join(map(bytes, q.vec)), dtype="<f4").reshape(-1, dim).astype(np.float64)
            return q.id.to_numpy(), m / np.linalg.norm(m, axis=1)[:, None]

        x, y = int(p.x.iloc[0]), int(p.y.iloc[0])
        (i, u), (j, v) = unit(p[p.mine == x]), unit(p[p.mine == y])
        s = np.rint(u @ v.T * SCALE).astype(np.int32)
        r, c = np.nonzero(s >= least)
        if x == y:
            r, c = r[i[r] < j[c]], c[i[r] < j[c]]
        return pd.DataFrame({"a": np.minimum(i[r], j[c]), "b": np.maximum(i[r], j[c]), "sim": s[r, c]})

    return met.groupBy("group_id", "x", "y").applyInPandas(cross, "a long, b long, sim int")


def _large_components(reps, comp, copies, floor, forest) -> DataFrame:
    """Clusters of components too large for one task, from all their pairs at the floor."""
    pairs = cut(pairs_within(cut(reps.join(comp, "id"), "large").select("group_id", "id", "vec"), floor, forest.dim), "pairs")
    label = link_by_rounds(pairs)  # (id, cluster): members of clusters of two or more distinct vectors
    weight = lambda k: copies.select(F.col("cid").alias(k), F.col("copies").alias(f"w_{k}"))
    inside = pairs.join(label.select(F.col("id").alias("a"), F.col("cluster")), "a").join(label.select(F.col("id").alias("b"), F.col("cluster").alias("other")), "b").filter("cluster = other")
    inside = inside.join(weight("a"), "a", "left").join(weight("b"), "b", "left").na.fill(1, ["w_a", "w_b"])
    sums = inside.select(F.explode(F.array(F.struct("cluster", F.col("a").alias("id"), (F.col("sim") * F.col("w_b")).alias("s")), F.struct("cluster", F.col("b").alias("id"), (F.col("sim") * F.col("w_a")).alias("s")))).alias("r")).select("r.*").groupBy("cluster", "id").agg(F.sum("s").alias("s"))
    every = label.join(weight("id"), "id", "left").na.fill(1, ["w_id"]).join(sums, ["cluster", "id"])
    best = every.groupBy("cluster").agg(F.max_by("id", F.struct(F.col("s") + SCALE * F.col("w_id"), -F.col("id"))).alias("medoid_id"), F.sum("w_id").alias("size"))
    one = copies.join(comp.select(F.col("id").alias("cid")), "cid", "left_semi").join(label.select(F.col("id").alias("cid")), "cid", "left_anti").select("cid", F.col("cid").alias("medoid_id"), F.col("copies").alias("size"))
    return label.join(best, "cluster").select(F.col("id").alias("cid"), "medoid_id", "size").union(one)


def jaccard_pairs(reps: DataFrame, floor: float) -> DataFrame:
    """(a, b), a < b: every pair of (id, items) with a Jaccard similarity of at least ``floor``; exact.

    Items are put in one order, rarest first. Sets at the floor share at least ``floor`` of each
    one's items, so if they share two or more, the first two they share are among the first
    size - ceil(floor * size) + 2 of both: every two items of these prefixes are a key, and sets meet by key.
    Sets so small that one shared item can do also meet by single items. Of the sets that meet, those whose
    sizes, or 128 parity bits of the items, differ too much for the floor are dropped; the rest is verified.
    """
    item = reps.select("id", F.explode("items").alias("item"))
    often = item.groupBy("item").agg(F.count("*").alias("n"))
    code = item.join(often, "item").select("id", "n", F.xxhash64("item").alias("x")).withColumn("bit", F.pmod("x", F.lit(128)))
    flag = lambda lo: F.bit_xor(F.when((F.col("bit") >= lo) & (F.col("bit") < lo + 64), F.expr(f"shiftleft(1L, int(bit - {lo}))")).otherwise(F.lit(0).cast("long")))
    sets = code.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("c"), F.count("*").alias("s"), flag(0).alias("lo"), flag(64).alias("hi"))
    least = F.ceil(floor * F.col("s") - 1e-9)  # items that any set at the floor shares with this one
    sets = sets.withColumns({"one": (F.col("s") + least) * floor <= 1 + floor + 1e-9, "p": F.slice("c.x", F.lit(1), (F.col("s") - least + 2).cast("int"))})
    kept = ["id", "s", "lo", "hi"]
    two = sets.select(*kept, F.posexplode("p").alias("i", "x"), "p").select(*kept, "x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
    single = sets.filter("one").select(*kept, F.explode("c.x").alias("x"))
    keys = cut(two.select(F.xxhash64("x", "y").alias("key"), *kept).union(single.select(F.xxhash64("x").alias("key"), *kept)).distinct(), "keys")
    other = keys.select("key", *(F.col(k).alias(f"{k}_b") for k in kept))
    differ = F.bit_count(F.col("lo").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("hi_b")))
    both = F.col("s") + F.col("s_b")
    may = (F.col("id") < F.col("id_b")) & (F.least("s", "s_b") + 1e-9 >= floor * F.greatest("s", "s_b")) & (differ * (1 + floor) <= (1 - floor) * both + 1e-9)
    cand = keys.join(other, "key").filter(may).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()
    side = lambda k: reps.select(F.col("id").alias(k), F.col("items").alias(f"s_{k}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    return cand.join(side("a"), "a").join(side("b"), "b").filter(common >= floor * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def set_clusters(records: DataFrame, floor: float = 0.8) -> DataFrame:
    """(id, medoid_id, size): clusters of records (id, items array) by Jaccard similarity of their item sets.

    Equal sets are one class. All pairs of classes at the floor are found (:func:`jaccard_pairs`); components
    of these pairs are clusters, and a component that is
    not tight around its highest-degree member (ties: smaller id) is split: members of
    higher degree than all they are linked to keep those, the rest goes on among itself, until no link
    is left. Null or empty sets and null ids give no rows; a repeated id must carry one set.
    """
    base = records.filter("id IS NOT NULL AND size(items) > 0").select("id", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).filter("size(items) > 0")
    base = base.groupBy("id").agg(F.min("items").alias("items")).withColumn("h", F.unhex(F.md5(F.to_json(F.struct("items")))))
    base = cut(base, "sets")
    cls = cut(base.groupBy("h").agg(F.min("id").alias("cid"), F.count("*").alias("n")), "setclasses")
    reps = base.select("id", "items").join(cls.select(F.col("cid").alias("id"), "n"), "id")
    edges = cut(jaccard_pairs(reps.select("id", "items"), floor), "jaccard")
    rank = F.struct("d", (-F.col("id")).alias("neg"))

    def ranked(links):
        """Both directions of the links, each end with its rank: (degree, -id)."""
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        degree = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d")).select("id", rank.alias("r"))
        return both.join(degree.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b").join(degree.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a")

    # A component is tight if its highest-degree member is linked to all others.
    comp = cut(components(edges), "components")
    degree = ranked(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d"))
    heads = comp.join(degree, "id").groupBy("group_id").agg(F.max(rank).alias("r"), F.count("*").alias("n"))
    tight = heads.filter("r.d = n - 1").select("group_id", (-F.col("r.neg")).alias("medoid_id"))
    out = [cut(comp.join(tight, "group_id").select(F.col("id").alias("cid"), "medoid_id"), "tight")]
    left = cut(edges.join(out[0].select(F.col("cid").alias("a")), "a", "left_anti").select("a", "b"), "left")
    while not left.isEmpty():
        both = cut(ranked(left), "ranked")
        tops = both.groupBy("a").agg(F.max("rb").alias("best"), F.first("ra").alias("ra")).filter("ra > best").select("a")
        near = both.join(tops, "a").groupBy("b").agg(F.max("ra").alias("r")).select(F.col("b").alias("cid"), (-F.col("r.neg")).alias("medoid_id"))
        taken = cut(near.union(tops.select("a", F.col("a").alias("medoid_id"))), "taken")
        out.append(taken)
        gone = taken.select("cid")
        left = cut(left.join(gone.withColumnRenamed("cid", "a"), "a", "left_anti").join(gone.withColumnRenamed("cid", "b"), "b", "left_anti").select("a", "b"), "left")
    alone = cls.filter("n > 1").select("cid", F.col("cid").alias("medoid_id"))
    found = cut(reduce(DataFrame.union, out), "found")
    alone = found.union(alone.join(found.select("cid"), "cid", "left_anti"))
    rows_ = alone.join(cls.select("cid", "h"), "cid").join(base.select("id", "h"), "h").select("id", "medoid_id")
    return rows_.join(rows_.groupBy("medoid_id").agg(F.count("*").alias("size")), "medoid_id").select("id", "medoid_id", "size")
