"""Problem 7: items that appear together more often than chance.

Chance is a bipartite configuration model: record b holds item i with probability
x_i y_b / (1 + x_i y_b), fitted so that every item's frequency and every record's
number of items are met on average. Under it the number of records with both items
is a sum of independent trials; its upper tail is the p-value of the exact count.
"""

from __future__ import annotations

import math
import warnings
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..storage import cut


def binned(histogram: dict[int, int], alone: int = 512, ratio: float = 1.01) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) of a histogram: values up to ``alone`` as they are, larger ones by their mean in bins of 1 %.

    At most some 2,600 bins for values below 10^13, however many distinct values there are.
    """
    v, c = np.array(sorted(histogram), float), np.array([histogram[k] for k in sorted(histogram)], float)
    key = np.where(v <= alone, v, alone + 1 + np.floor(np.log(np.maximum(v, 1) / alone) / math.log(ratio)))
    _, of = np.unique(key, return_inverse=True)
    n = np.bincount(of, c) if len(v) else c
    return (np.bincount(of, v * c) / n if len(v) else v), n


def fit_null(item_degrees: dict[int, int], sizes: dict[int, int], rounds: int = 2000, tol: float = 1e-9):
    """(degrees, x, sizes, y, how many records of each size), from the two histograms, see :func:`binned`.

    A fit that does not meet the degrees to one in a thousand warns.
    """
    (d, c), (s, m) = binned(item_degrees), binned(sizes)
    total = max((d * c).sum(), 1.0)
    x, y = d / math.sqrt(total), s / math.sqrt(total)
    for _ in range(rounds):
        new = np.minimum(d / ((m * y) / (1 + x[:, None] * y)).sum(1), 1e9)
        y = np.minimum(s / ((c * new)[:, None] / (1 + new[:, None] * y)).sum(0), 1e9)
        done = np.abs(new - x).max(initial=0) <= tol * max(1.0, new.max(initial=0))
        x = new
        if done:
            break
    met = (m * (x[:, None] * y / (1 + x[:, None] * y))).sum(1)
    off = np.abs(met / d - 1).max(initial=0)
    if off > 1e-3:
        warnings.warn(f"the null model meets the item frequencies only to {off:.3g}", RuntimeWarning, stacklevel=2)
    return d, x, s, y, m


def _mills(w: np.ndarray) -> np.ndarray:
    """(1 - Phi(w)) / phi(w)."""
    out = np.empty_like(w)
    big = w > 8
    z = w[big]
    out[big] = (1 - 1 / z**2 + 3 / z**4 - 15 / z**6) / z
    z = w[~big]
    erfc = np.array([math.erfc(v / math.sqrt(2)) for v in z]) if len(z) else z
    out[~big] = 0.5 * erfc * np.sqrt(2 * np.pi) * np.exp(z * z / 2)
    return out


def log_tail(q: np.ndarray, m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """ln P(X >= c) for X a sum of m[s] trials of probability q[row, s].

    Saddle-point tail of a sum of independent trials (Lugannani-Rice, lattice form);
    counts at or below the mean get the normal tail.
    """
    q = np.clip(q, 1e-300, 1 - 1e-12)
    mean, var = (m * q).sum(1), (m * q * (1 - q)).sum(1)
    out = np.zeros(len(c))
    low = c <= mean + 0.5 * np.sqrt(var) * 0.05 + 1e-9
    z = np.maximum((c - 0.5 - mean) / np.sqrt(np.maximum(var, 1e-300)), -8.0)
    out[low] = np.log([0.5 * math.erfc(v / math.sqrt(2)) for v in z[low]]) if low.any() else 0
    full = ~low & (c >= m.sum() - 0.5)
    out[full] = (m * np.log(q[full])).sum(1)
    k = np.flatnonzero(~low & ~full)
    if len(k):
        q, c, mean = q[k], c[k].astype(float), mean[k]
        lo, hi = np.zeros(len(k)), np.full(len(k), 1.0)
        rate = lambda t: (m * (q * np.exp(t)[:, None] / (1 - q + q * np.exp(t)[:, None]))).sum(1)
        for _ in range(60):
            short = rate(hi) < c
            if not short.any():
                break
            hi[short] *= 2
        hi = np.minimum(hi, 600.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            up = rate(mid) < c
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        t = np.maximum((lo + hi) / 2, 1e-8)
        e = np.exp(t)[:, None]
        p = q * e / (1 - q + q * e)
        cgf, curve = (m * np.log1p(q * (e - 1))).sum(1), (m * p * (1 - p)).sum(1)
        w = np.sqrt(np.maximum(2 * (t * c - cgf), 1e-16))
        u = -np.expm1(-t) * np.sqrt(np.maximum(curve, 1e-300))
        out[k] = -w * w / 2 - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(_mills(w) - 1 / w + 1 / u, 1e-300))
    return np.minimum(out, 0.0)


def together(records: DataFrame, n: int, least: int = 5, least_share: str = "0.002", rate: float = 0.05, lift_floor: int | None = None) -> DataFrame:
    """(a, b, both, n_a, n_b, expected, ln_p, surprising): pairs of terms in at least
    ``least`` records and ``least_share`` of all ``n`` records, a before b by code point.

    ``records`` is (id, term), distinct. Counts are exact: a term in fewer records than a
    pair needs is in no such pair, and with ``lift_floor`` neither is a term in more than
    n / lift_floor records, so only the remaining terms are paired. With ``least`` 1 and
    ``least_share`` 0 every pair that is together at all is returned. Pairs
    are counted within each task before the shuffle. ``surprising`` holds at a
    false-discovery rate of ``rate`` (Benjamini-Hochberg, the number of tests being that of
    all two terms of ``records``: a pair that is never together is a test with p-value 1; pairs dropped
    for their counts are held to be none of the discoveries). No
    records, or none with two kept terms, give an empty result.
    """
    share = Fraction(least_share)
    need = max(least, math.ceil(share * n), 1)
    items = records.groupBy("term").agg(F.count("*").alias("n"))
    items = cut(items, "items")
    degrees = {r.n: r.c for r in items.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most sqrt(2 * rows) entries
    sizes = {r.k: r.c for r in records.groupBy("id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("c")).collect()}
    terms = sum(degrees.values())
    d, x, _, y, m = fit_null(degrees, sizes)
    lx, ld = np.log(np.maximum(x, 1e-300)), np.log(np.maximum(d, 1e-300))

    kept = items.filter(F.col("n") >= need)
    if lift_floor:
        kept = kept.filter(F.col("n") * lift_floor <= n)
    kept = cut(numbered(kept, ["term"], "code", 1), "codes")
    baskets = records.join(kept.select("term", "code"), "term").groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("c")).filter(F.size("c") > 1)
    first = baskets.select(F.posexplode("c").alias("i", "a"), "c").filter(F.col("i") < F.size("c") - 1)
    pairs = first.select("a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("both")).filter(F.col("both") >= need)
    name = lambda k: kept.select(F.col("code").alias(k), F.col("term").alias(f"t_{k}"), F.col("n").alias(f"n_{k}"))
    named = counts.join(name("a"), "a").join(name("b"), "b").select(F.col("t_a").alias("a"), F.col("t_b").alias("b"), "both", "n_a", "n_b")

    def chance(batches):
        for p in batches:
            # Pairs of the same three counts have the same chance: each case is worked out once.
            case, of = np.unique(np.c_[np.minimum(p.n_a, p.n_b), np.maximum(p.n_a, p.n_b), p["both"]].reshape(-1, 3), axis=0, return_inverse=True)
            xa, xb = (np.exp(np.interp(np.log(case[:, c]), ld, lx)) for c in (0, 1))
            expected, ln_p = np.empty(len(case)), np.empty(len(case))
            for lo in range(0, len(case), 4096):
                a, b = xa[lo : lo + 4096, None] * y, xb[lo : lo + 4096, None] * y
                q = a / (1 + a) * (b / (1 + b))
                expected[lo : lo + 4096] = (m * q).sum(1)
                ln_p[lo : lo + 4096] = log_tail(q, m, case[lo : lo + 4096, 2].astype(float))
            of = of.reshape(-1)
            yield p.assign(expected=expected[of], ln_p=ln_p[of])

    tested = cut(named.mapInPandas(chance, "a string, b string, both long, n_a long, n_b long, expected double, ln_p double"), "pairs")
    return tested.withColumn("surprising", F.col("ln_p") <= F.lit(bh_limit(tested, rate, terms * (terms - 1) // 2)))


def bh_limit(tested: DataFrame, rate: float, total: int | None = None) -> float:
    """ln of the largest p-value that Benjamini-Hochberg accepts, found by counting alone.

    From p = rate on, p becomes rate * (tests with p-value <= p) / tests until it rests;
    it falls monotonically to the procedure's own limit. ``total``: the number of tests, if not all are rows.
    """
    total = tested.count() if total is None else total
    limit, last = math.log(rate), None
    while total and limit != last:
        c = tested.filter(F.col("ln_p") <= limit).count()
        last, limit = limit, math.log(rate * c / total) if c else -math.inf
        if not c:
            break
    return limit
