"""Problem 9: drawing documents of several sources to target shares of tokens.

A source whose target asks for w uses of each document gets floor(w) uses of all of them
and one more of a sample with inclusion probability w - floor(w). The sample is drawn by
the cube method: inclusion probabilities move through the null space of the constraints
(number of documents, number of tokens) until they are 0 or 1. Blocks of a source are
handled apart; what stays fractional in them, two documents a block at most, is gathered
and moved again, until one block a source is left and its last documents are landed.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped_lower
from ..storage import cut
from .tokens import VOCABULARY, token_counts

EPS = 1e-9


def flight(pi: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``pi`` until at most two entries are fractional, keeping sum(pi) and sum(pi * n).

    Long documents are settled first, so that what stays open is short.
    """
    pi = pi.astype(float).copy()
    order = rng.permutation(np.flatnonzero((pi > EPS) & (pi < 1 - EPS)))
    order = order[np.argsort(n[order], kind="stable")].tolist()  # taken from the end
    draws, open_ = iter(rng.random(len(order) + 3).tolist()), []
    while True:
        while len(open_) < 3 and order:
            open_.append(order.pop())
        if len(open_) == 3:
            a, b, c = (float(n[k]) for k in open_)
            u = [c - b, a - c, b - a]
            if u == [0.0, 0.0, 0.0]:
                u = [1.0, -1.0, 0.0]
        elif len(open_) == 2 and n[open_[0]] == n[open_[1]]:
            u = [1.0, -1.0]
        else:
            break
        up = min(((1 - pi[k]) if d > 0 else pi[k]) / abs(d) for k, d in zip(open_, u) if d)
        down = min((pi[k] if d > 0 else (1 - pi[k])) / abs(d) for k, d in zip(open_, u) if d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for k, d in zip(open_, u):
            pi[k] += step * d
        open_ = [k for k in open_ if EPS < pi[k] < 1 - EPS]
    pi[pi <= EPS], pi[pi >= 1 - EPS] = 0.0, 1.0
    return pi


def land(pi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Round the last fractional entries the way that changes the tokens least; ties keep more documents."""
    pi = pi.copy()
    k = np.flatnonzero((pi > 0) & (pi < 1))
    want = (pi[k] * n[k]).sum()
    best = min(range(1 << len(k)), key=lambda z: (abs(sum(n[i] for j, i in enumerate(k) if z >> j & 1) - want), -z), default=0)
    for j, i in enumerate(k):
        pi[i] = best >> j & 1
    return pi


def settle(pi: np.ndarray, n: np.ndarray, rng: np.random.Generator, large: float = 0.02) -> np.ndarray:
    """0 or 1 for every entry: flight and landing, long documents first.

    The last long documents cannot be landed without moving the tokens by a good part of
    one; what they add or lack is made good in the inclusion probabilities of the shorter ones.
    """
    pi, out = pi.astype(float).copy(), np.zeros(len(pi))
    rest = np.ones(len(pi), dtype=bool)
    while rest.any():
        big = rest & (n > large * max((pi[rest] * n[rest]).sum(), 1.0))
        if not big.any():
            big = rest
        out[big] = land(flight(pi[big], n[big], rng), n[big])
        gap = ((pi[big] - out[big]) * n[big]).sum()
        rest = rest & ~big
        have = (pi[rest] * n[rest]).sum()
        if have > 0:
            pi[rest] = np.clip(pi[rest] * (1 + gap / have), 0.0, 1.0)
    return out


def mix(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, block: int = 4096, seed: int = 9, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(draw, report). draw: (id, source, n, uses) of every drawn document. report, a row per
    target: (source, target_share, max_repeats, need, available, drawn, actual_share, short).

    The draw is as large as all usable documents together (T tokens): ``need`` is
    target_share * T. Sources are compared stripped and lower-cased, documents with a
    null source or a null or blank text are left out, ids are unique; a source without a
    target is not drawn. ``available`` is max_repeats times the source's tokens; a source
    with less than its need is used max_repeats times throughout and reported ``short``.
    ``targets`` is the request itself, a small table; it is collected.
    """
    text, source = F.col(text_col), stripped_lower(F.col(source_col))
    rows = df.withColumn("_source", source).filter(F.col("_source").isNotNull() & (stripped_lower(text) != ""))
    sizes = cut(token_counts(rows, id_col, text_col, ("_source",), vocabulary).withColumnRenamed("_source", "source"), "sizes")
    goal = targets.select(stripped_lower(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goal = goal.na.fill(0)
    names = [r.source for r in goal.select("source").collect()]
    by_source = sizes.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    have = {r.source: (r.tokens, r.docs) for r in by_source.filter(F.col("source").isin(names)).collect()}
    plan = []
    for r in goal.collect():
        tokens, docs = have.get(r.source, (0, 0))
        need, available = r.target_share * total, r.max_repeats * tokens
        w = min(float(r.max_repeats), need / tokens) if tokens else 0.0
        plan.append((r.source, r.target_share, r.max_repeats, need, available, int(w + EPS), max(w - int(w + EPS), 0.0), max(-(-docs // block), 1)))
    spark = df.sparkSession
    schema = "source string, target_share double, max_repeats long, need double, available long, base long, pi double, blocks long"
    plan = spark.createDataFrame(plan, schema)
    units = sizes.join(F.broadcast(plan.select("source", "base", "pi", "blocks")), "source")  # one row per target
    units = cut(units.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks"))), "units")

    def fly(last):
        def run(p):
            if not len(p):
                return p
            p = p.sort_values("id", kind="stable")
            key = zlib.crc32(f"{p.source.iloc[0]}/{int(p.block.iloc[0])}/{last}".encode())
            n = p.n.to_numpy(float)
            move = settle if last else flight
            return p.assign(pi=move(p.pi.to_numpy(float), n, np.random.default_rng([seed, key])))

        return run

    open_, settled = units.filter("pi > 0").select("id", "source", "n", "base", "pi", "block"), []
    blocks = max((r.blocks for r in plan.collect()), default=1)
    while True:
        last = blocks == 1
        moved = cut(open_.groupBy("source", "block").applyInPandas(fly(last), "id long, source string, n long, base long, pi double, block long"), "moved")
        settled.append(moved.filter("pi = 0 OR pi = 1"))
        if last:
            break
        blocks = -(-blocks * 2 // block)
        open_ = moved.filter("pi > 0 AND pi < 1").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(blocks)))
    drawn = units.filter("pi = 0").select("id", "source", "n", F.col("base").alias("uses"))
    for part in settled:
        drawn = drawn.union(part.select("id", "source", "n", (F.col("base") + F.col("pi")).cast("long")))
    drawn = drawn.filter("uses > 0")
    sums = cut(drawn.groupBy("source").agg(F.sum(F.col("n") * F.col("uses")).alias("drawn")), "drawn")
    every = sums.agg(F.sum("drawn")).first()[0] or 0
    report = plan.join(sums, "source", "left").select("source", "target_share", "max_repeats", "need", "available", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.coalesce("drawn", F.lit(0)) / F.lit(float(every or 1))).alias("actual_share"), (F.col("available") < F.col("need")).alias("short"))
    return drawn, report
