"""Problem 2: one common id for all records linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbor of u is linked to the smallest of u and its neighbors."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbors are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id): each id of a pair with the smallest id of its component.

    Large-star and small-star alternate through joins until an edge set repeats; every
    component is then a star around its smallest id. Rewrites never add edges, the
    smallest neighbor is found with partial minima before the shuffle, and a hub's join
    partition is split by adaptive execution. Pairs with a null, pairs of an id with
    itself and repeated or mirrored pairs add nothing; no pairs give no rows.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    edges = edges.filter("ok AND u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct()
    seen, mark, old = None, (), None
    while True:
        watch = Observation()
        stars = edges if old is None else _small_star(_large_star(old))
        new = cut(stars.observe(watch, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        seen, mark = mark, (watch.get["n"], watch.get["x"])
        discard(old)
        old = new
        if mark == seen or not mark[0]:
            break
    return old.select(F.col("u").alias("id"), F.col("v").alias("group_id")).union(old.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())
