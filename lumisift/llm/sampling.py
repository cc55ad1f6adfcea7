"""Problem 5: samples whose categories follow target proportions, with deficits reported."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tag_form
from ..storage import cut
from .terms import latest


@dataclass(frozen=True)
class Dimension:
    """A column, its categories, the request column of its shares, and the shares used when that is null."""

    name: str
    target: str
    defaults: tuple[tuple[str, float], ...]

    @property
    def categories(self) -> list[str]:
        return [k for k, _ in self.defaults]


DIMENSIONS = (
    Dimension("people_count", "people_count_target", (("1", 0.85), ("2", 0.12), ("3_plus", 0.03))),
    Dimension("framing", "framing_target", (("full_body", 0.30), ("half_body", 0.50), ("headshot", 0.20))),
    Dimension("outdoors", "outdoors_target", (("true", 0.40), ("false", 0.60))),
)


def needs(target: dict | None, d: Dimension, size: int, least: int) -> dict[str, float] | None:
    """What a request asks of each category of ``d``; None if it asks nothing (its shares sum to 0)."""
    share = dict(d.defaults) if target is None else {k: target.get(k) for k in d.categories}
    share = {k: v if v is not None and v > 0 else 0.0 for k, v in share.items()}  # NaN is not > 0
    total = sum(share[k] for k in d.categories)
    if not total > 0 or np.isinf(total):
        return None
    return {k: max(round(v / total * size, 6), float(least) if v > 0 else 0.0) for k, v in share.items()}


def quotas(cells: list[tuple], counts: np.ndarray, want: list[dict | None], size: int) -> np.ndarray:
    """How many to take of every cell: acceptance raked to the targets, rounded, then corrected exactly.

    The sum is min(size, all there is). Raking scales the cells to each dimension's needs in
    turn, never beyond what a cell holds; whole numbers by largest remainder; then single
    units move between cells as long as that lowers the total shortfall of the categories.
    """
    n = counts.astype(float)
    goal = int(min(max(size, 0), counts.sum()))
    if not goal:
        return np.zeros(len(n), dtype=np.int64)
    groups = []  # by dimension: each cell's category, and what the categories need; what is in none shares the rest
    for k, w in enumerate(want):
        if w is None:
            continue
        place = {name: z for z, name in enumerate(w)}
        asked = sum(w.values())
        groups.append((np.array([place.get(c[k], len(w)) for c in cells]), np.array([*(v * min(1.0, goal / asked) for v in w.values()), max(goal - asked, 0.0)])))
    x, old = n * goal / n.sum(), None
    for _ in range(60):
        if old is not None and np.abs(x - old).max() < 1e-7:
            break
        old = x
        for cat, need in groups:
            have = np.bincount(cat, x, len(need))
            x = np.minimum(x * np.divide(need, have, out=np.ones(len(need)), where=have > 0)[cat], n)
        short = goal - x.sum()
        room = n - x
        if short > 1e-9 and room.sum() > 0:
            x = x + room * short / room.sum()
        elif short < 0:
            x = x * goal / x.sum()
    q = np.floor(x + 1e-9).astype(np.int64)
    order = np.lexsort((np.arange(len(n)), -(x - q)))
    for i in [i for i in order if q[i] < counts[i]] * 2:
        if q.sum() >= goal:
            break
        if q[i] < counts[i]:
            q[i] += 1
    while q.sum() < goal:
        q[np.argmax(counts - q)] += 1
    while q.sum() > goal:
        q[np.argmax(q)] -= 1
    if not groups:
        return q
    member = np.vstack([(cat == np.arange(len(need) - 1)[:, None]) for cat, need in groups]).astype(np.int64)
    need = np.ceil(np.concatenate([[*w.values()] for w in want if w is not None]) - 1e-9)
    reachable = np.minimum(need, member @ counts).astype(np.int64)
    for _ in range(goal * 4):
        moves = exchange(q, counts, member, reachable)
        if not moves:
            break
        for i, j in moves:
            q[i] -= 1
            q[j] += 1
    return q


def exchange(q: np.ndarray, counts: np.ndarray, member: np.ndarray, reachable: np.ndarray) -> list[tuple[int, int]]:
    """The move of one unit between two cells, or if none helps the two moves together, that lower the total shortfall most; none if nothing does."""
    had = member @ q
    base = np.maximum(reachable - had, 0).sum()
    if not base:
        return []
    pairs = np.argwhere((q > 0)[:, None] & (q < counts)[None, :] & ~np.eye(len(q), dtype=bool))
    if not len(pairs):
        return []
    delta = (member[:, pairs[:, 1]] - member[:, pairs[:, 0]]).T
    _, one = np.unique(delta, axis=0, return_index=True)  # cells of the same categories do alike
    pairs, delta = pairs[one], delta[one]
    short = reachable - had
    single = np.maximum(short - delta, 0).sum(1)
    if single.min() < base:
        return [tuple(pairs[single.argmin()])]
    best, found = base, []
    helps = np.flatnonzero((delta[:, short > 0] > 0).any(1))
    for a in helps[np.argsort(single[helps], kind="stable")]:
        both = np.maximum(short - delta[a] - delta, 0).sum(1)
        i, j = pairs[a]
        room = ((pairs[:, 0] != i) | (q[i] > 1)) & ((pairs[:, 1] != j) | (counts[j] - q[j] > 1))
        both = np.where(room, both, base)
        if both.min() < best:
            best, found = both.min(), [(i, j), tuple(pairs[both.argmin()])]
    return found


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn are good; beyond a billion, where numpy's own draw ends, by the normal law."""
    if good + bad < 1_000_000_000:
        return rng.hypergeometric(good, bad, n)
    share = good / (good + bad)
    k = round(rng.normal(n * share, math.sqrt(n * share * (1 - share) * (good + bad - n) / (good + bad - 1))))
    return min(max(k, n - bad, 0), good, n)


def drawn_ranks(n: int, quota: int, rng: np.random.Generator) -> np.ndarray:
    """``quota`` of the ranks 0 .. n - 1: each accepted independently with a probability a little above quota / n, then counted exactly.

    The gaps between accepted ranks are geometric, so the work is that of the accepted, not of the ranks. Of too many
    a random part is dropped, for too few random others follow.
    """
    p = min(1.0, (quota + 4 * math.sqrt(quota) + 4) / n)
    if p >= 1.0:
        return rng.permutation(n)[:quota]
    got = np.empty(0, dtype=np.int64)
    while not len(got) or got[-1] < n:
        gaps = rng.geometric(p, size=int(n * p * 1.1) + 16)
        got = np.r_[got, (got[-1] if len(got) else -1) + np.cumsum(gaps)]
    got = rng.permutation(got[got < n])[:quota]
    while len(got) < quota:
        more = rng.integers(0, n, size=2 * (quota - len(got)) + 8)
        got = np.concatenate([got, np.setdiff1d(more, got)])[:quota]
    return got


def proportional_samples(items: DataFrame, requests: DataFrame, seed: int = 5, dimensions=DIMENSIONS, stretch: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(sample, report): sample (request_id, image_id); report (request_id, dimension,
    category, need, available, chosen, short), a row per category a request asks for.

    Of ``items`` only the newest row of an image counts. Values are compared in TAG FORM;
    unknown and null values belong to no category and fill up a sample only after
    the categories. The images of a cell (the combination of its categories within a group) are ranked
    once, in random order; for each request every rank of a cell is accepted independently with a probability set a
    little above the cell's quota, and the accepted are then counted exactly (:func:`drawn_ranks`). Only
    accepted ranks meet images, so the work is that of the samples, not of requests times images.
    A request with no images, a null group or size 0 gives an empty sample and its needs;
    repeated requests count once. Large cells are ranked by many tasks, and large quotas drawn by many.
    """
    spark, names = items.sparkSession, [d.name for d in dimensions]
    known = lambda d: F.when(tag_form(F.col(d.name)).isin(d.categories), tag_form(F.col(d.name))).otherwise("")
    now = latest(items, "image_id", ["tagged_at", "loaded_at"], ["job_id", *names])
    now = cut(now.select("image_id", "job_id", *(known(d).alias(d.name) for d in dimensions)), "items")
    cells = now.groupBy("job_id", *names).agg(F.count("*").alias("n")).groupBy("job_id").agg(F.collect_list(F.struct(*names, "n")).alias("cells"))
    wish = ["job_id", "target_size", "min_per_category", *(d.target for d in dimensions)]
    asked = latest(requests, "request_id", ["submitted_at"], wish)
    joined = asked.join(cells, "job_id", "left")
    keys = ", ".join(f"{n} string" for n in names)
    schema = f"request_id long, job_id string, {keys}, n long, quota long, dimension string, category string, need double"

    def plan(batches):
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                size = 0 if pd.isna(r.target_size) else max(int(r.target_size), 0)
                least = 0 if pd.isna(r.min_per_category) else int(r.min_per_category)
                as_map = lambda v: None if v is None else dict(v)
                want = [needs(as_map(getattr(r, d.target)), d, size, least) for d in dimensions]
                have = [] if r.cells is None else sorted((tuple(c[n] for n in names), int(c["n"])) for c in r.cells)
                for d, w in zip(dimensions, want):
                    out += [(r.request_id, r.job_id, *[None] * len(names), None, None, d.name, k, v) for k, v in (w or {}).items()]
                if have:
                    counts = np.array([c for _, c in have])
                    q = quotas([k for k, _ in have], counts, want, size)
                    out += [(r.request_id, r.job_id, *k, c, int(z), None, None, None) for (k, c), z in zip(have, q)]
            frame = pd.DataFrame(out, columns=["request_id", "job_id", *names, "n", "quota", "dimension", "category", "need"])
            yield frame.astype({"n": "Int64", "quota": "Int64"})

    wide = 4 * spark.sparkContext.defaultParallelism
    planned = cut(joined.repartition(wide, "request_id").mapInPandas(plan, schema), "quotas")
    on = ["job_id", *names]

    def shared(batches):
        """The quota of each stretch of a cell's ranks, drawn without replacement over the stretches."""
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                left, lo, rng = r.quota, 0, np.random.default_rng([seed, zlib.crc32(repr(tuple(r)).encode())])
                while lo < r.n and left:
                    m = min(stretch, r.n - lo)
                    k = left if m == r.n - lo else int(hypergeometric(rng, m, r.n - lo - m, left))
                    if k:
                        out.append((*r, lo, m, k))
                    left, lo = left - k, lo + m
            yield pd.DataFrame(out, columns=[*p.columns, "lo", "m", "k"])

    def draw(batches):
        def rows(p, got):
            of = np.repeat(np.arange(len(p)), [len(g) for g in got])
            return p.iloc[of][["request_id", *on]].assign(rank=np.concatenate(got))[["rank", "request_id", *on]]

        for p in batches:
            got, first, held = [], 0, 0
            for at, r in enumerate(p.itertuples(index=False)):
                got.append(r.lo + drawn_ranks(r.m, r.k, np.random.default_rng([seed, zlib.crc32(repr(tuple(r)).encode())])))
                held += r.k
                if held > 1 << 18:
                    yield rows(p.iloc[first : at + 1], got)
                    got, first, held = [], at + 1, 0
            if got:
                yield rows(p.iloc[first:], got)

    quota = planned.filter("quota > 0").select("request_id", *on, "n", "quota")
    parts = quota.mapInPandas(shared, f"request_id long, job_id string, {keys}, n long, quota long, lo long, m long, k long")
    ranks = parts.repartition(wide, "request_id", *on, "lo").mapInPandas(draw, f"rank long, request_id long, job_id string, {keys}")

    # Ranks within cells: salted, so that a cell of a third of all rows is sorted by as many tasks as it has stretches.
    sized = now.join(planned.filter("n IS NOT NULL").groupBy(*on).agg(F.first("n").alias("n")), on)
    order = F.xxhash64("image_id", F.lit(seed))
    salted = cut(sized.withColumn("salt", F.pmod(order, F.ceil(F.col("n") / stretch)).cast("int")), "salted")
    sizes = salted.groupBy(*on, "salt").agg(F.count("*").alias("c"))
    offset = sizes.withColumn("offset", F.coalesce(F.sum("c").over(Window.partitionBy(*on).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    within = F.row_number().over(Window.partitionBy(*on, "salt").orderBy(order, "image_id"))
    ranked = salted.withColumn("k", within).join(offset, [*on, "salt"]).select(*on, "image_id", (F.col("offset") + F.col("k") - 1).alias("rank"))
    chosen = cut(ranks.join(ranked, [*on, "rank"]).select("request_id", "image_id", *names), "sample")

    def cell_sums(df, group, value):
        pairs = F.explode(F.array(*(F.struct(F.lit(d.name).alias("dimension"), F.col(d.name).alias("category")) for d in dimensions)))
        return df.select(*group, value.alias("_v"), pairs.alias("_p")).select(*group, "_v", "_p.*").groupBy(*group, "dimension", "category").agg(F.sum("_v").alias("_v"))

    there = cell_sums(planned.filter("n IS NOT NULL"), ["request_id"], F.col("n")).withColumnRenamed("_v", "available")
    took = cell_sums(chosen, ["request_id"], F.lit(1)).withColumnRenamed("_v", "chosen")
    on = ["request_id", "dimension", "category"]
    report = planned.filter("dimension IS NOT NULL").select(*on, "need").join(there, on, "left").join(took, on, "left")
    report = report.na.fill(0, ["available", "chosen"]).withColumn("short", F.col("available") < F.col("need"))
    return chosen.select("request_id", "image_id"), report
