"""Problem 3: the k most similar vectors of every vector, by a hash-prefix forest."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .vectors import SCALE, Bucket, Forest, best_of, borders, classes, forest_map, passes, usable

HELD = 1 << 21  # listed pairs that a task holds before it drops all but the k best


def _best(q, m, s, k):
    """The k best rows of every q by (s descending, m ascending); m is in the order of ids."""
    order = np.lexsort((m, -s, q))
    q, m, s = q[order], m[order], s[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
    return q[keep], m[keep], s[keep]


def _topk_kernel(k: int, floor: float):
    least = round(floor * SCALE)

    def kernel(b: Bucket):
        held, n = [], 0
        for q, m in b.meetings():
            s = b.u[q] @ b.u[m].T
            lowest = np.full(len(q), floor - 3e-6, dtype=np.float32)
            many = np.flatnonzero((s >= lowest[:, None]).sum(1) > k + 1)  # itself, and k others
            if len(many):
                kth = np.partition(s[many], len(m) - k - 1, axis=1)[:, len(m) - k - 1]
                lowest[many] = np.maximum(lowest[many], kth - np.float32(3e-6))
            r, c = np.nonzero(s >= lowest[:, None])
            r, c = q[r], m[c]
            r, c = r[r != c], c[r != c]
            v = b.exact(r, c)
            ok = v >= least
            if ok.any():
                held.append(_best(r[ok], c[ok], v[ok], k))
                n += len(held[-1][0])
            if n > HELD:
                held = [_best(*(np.concatenate(x) for x in zip(*held)), k)]
                n = len(held[0][0])
                if n > HELD // 2:  # so many vectors that each pass over them must pay
                    n = 0
        if held:
            q, m, s = _best(*(np.concatenate(x) for x in zip(*held)), k)
            pair, at = np.unique(np.minimum(q, m).astype(np.int64) * len(b.ids) + np.maximum(q, m), return_index=True)
            yield b.ids[pair // len(b.ids)], b.ids[pair % len(b.ids)], s[at]

    return kernel


def neighbors(df: DataFrame, id_col: str, vec_col: str, k: int = 10, floor: float = 0.82, forest: Forest = Forest()) -> DataFrame:
    """(id, other, sim): of every id its k most similar other ids, sim in millionths and at least ``floor``.

    Ties go to the smaller id. Copies under other ids are each other's neighbors. Ids
    without a usable vector and an empty table give no rows; repeated rows count once.
    The search is approximate (the ascent of one of the two must reach the other in one tree); every
    similarity it reports is exact.
    """
    reps, members, n = classes(usable(df, id_col, vec_col, forest.dim))
    forest = forest.sized(n)
    tries = borders(reps, forest, n)
    found = [cut(forest_map(reps, forest, t, _topk_kernel(k, floor), "a long, b long, sim int").distinct(), "near") for t in passes(forest, tries)]
    pairs = reduce(DataFrame.union, found).distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("b").alias("other"), "sim"), F.struct(F.col("b").alias("cid"), F.col("a").alias("other"), "sim"))).alias("p")).select("p.*")
    ranked = best_of(both, "cid", k)

    # Copies: of each class only its k + 1 smallest ids can be among anyone's k nearest.
    first = members.withColumn("rn", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).filter(F.col("rn") <= k + 1)
    tops = first.groupBy(F.col("cid").alias("other")).agg(F.collect_list("id").alias("ids"))
    own = members.filter("id = cid").select("cid", F.col("cid").alias("other"), F.lit(SCALE).cast("int").alias("sim"))
    spread = ranked.union(own).join(tops, "other", "left").select("cid", "sim", F.explode(F.coalesce("ids", F.array("other"))).alias("other"))
    listed = best_of(spread, "cid", k + 1)
    of = listed.join(members, "cid", "left").select(F.coalesce("id", "cid").alias("id"), "other", "sim")
    return best_of(of.filter("id <> other"), "id", k)
