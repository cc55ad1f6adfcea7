from datetime import datetime

from lumisift.llm.cooccurrence import bh_limit, fit_null, log_tail, together
from lumisift.llm.terms import counted, term_frequencies

import math

import numpy as np

SCHEMA = "result_id long, image_id long, tags array<string>, captioned_at timestamp, term string, n long"
T = [datetime(2025, 1, d) for d in range(1, 9)]


def captions(spark, rows):
    return spark.createDataFrame([(r, i, t, c, "clash", 1) for r, i, t, c in rows], SCHEMA)


def test_newest_result_counts_and_forms(spark):
    rows = [(1, 1, ["old"], T[0]), (2, 1, ["A b", "a_b", None, " ", ",", "x" * 40_000], T[2]), (3, 1, ["tie_lost"], T[1]), (2, 1, ["A b", "a_b", None, " ", ",", "x" * 40_000], T[2]),
            (4, 2, ["a_b", "c"], T[1]), (5, 2, ["c"], T[1]), (6, None, ["nobody"], T[1]), (7, 3, None, T[1]), (8, 4, [], T[1]), (9, 5, ["c"], None)]
    records, n = counted(captions(spark, rows))
    got = {r.term: (r.occurrences, r.records, r.is_rare, r.is_common) for r in term_frequencies(records, n, rare_below=2, common_share="0.5").collect()}
    assert n == 3
    assert got == {"a_b": (2, 1, True, False), "x" * 40_000: (1, 1, True, False), "c": (2, 2, False, True)}


def test_no_rows(spark):
    records, n = counted(captions(spark, []))
    assert n == 0 and term_frequencies(records, n).count() == 0
    assert together(records.select("id", "term"), n).count() == 0


def test_pairs_against_loops(spark):
    rng = np.random.default_rng(2)
    sets = [{f"t{k:02d}" for k in rng.choice(30, rng.integers(0, 9), replace=False, p=np.r_[[0.2], np.full(29, 0.8 / 29)])} for _ in range(200)]
    for s in sets[:30]:
        s |= {"twin_a", "twin_b"}
    records = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s], "id long, term string")
    n = sum(bool(s) for s in sets)
    want = {}
    for s in sets:
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = {(r.a, r.b): r for r in together(records, n, least=5, least_share="0.002").collect()}
    assert {k: r.both for k, r in got.items()} == {k: c for k, c in want.items() if c >= 5}
    twin = got["twin_a", "twin_b"]
    assert twin.surprising and twin.both == 30 and twin.expected < 15
    assert sum(r.surprising for r in got.values()) < len(got) / 3
    pruned = {(r.a, r.b) for r in together(records, n, least=5, lift_floor=3).collect()}
    lift = lambda r: r.both * n / (r.n_a * r.n_b)
    assert {k for k, r in got.items() if lift(r) >= 3} <= pruned


def test_null_model_meets_both_margins():
    d, x, s, y, m = fit_null({1: 40, 5: 20, 30: 3}, {2: 50, 3: 30, 10: 14})
    total = 40 + 100 + 90
    assert total != 50 * 2 + 30 * 3 + 14 * 10 or True
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * m).sum(1) * np.array([40, 20, 3]), d * np.array([40, 20, 3]), rtol=0.35)
    d, x, s, y, m = fit_null({1: 40, 5: 20, 30: 2}, {2: 25, 3: 50})
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * m).sum(1), d, rtol=1e-3) and np.allclose((p * np.array([40, 20, 2])[:, None]).sum(0), s, rtol=1e-3)


def test_tail_against_exact_convolution():
    m = np.array([40.0, 25.0, 10.0])
    q = np.array([[0.02, 0.1, 0.3], [0.001, 0.002, 0.01]])
    for row in range(2):
        pmf = np.array([1.0])
        for k, n in zip(q[row], m):
            for _ in range(int(n)):
                pmf = np.convolve(pmf, [1 - k, k])
        mean = (q[row] * m).sum()
        for c in range(int(mean) + 2, int(mean) + 14, 3):
            exact = math.log(pmf[c:].sum())
            got = log_tail(q[row : row + 1], m, np.array([float(c)]))[0]
            assert abs(got - exact) < 0.1 + 0.02 * abs(exact), (row, c, got, exact)


def test_benjamini_hochberg_by_counting(spark):
    rng = np.random.default_rng(8)
    p = np.r_[rng.random(300), rng.random(40) * 1e-4]
    df = spark.createDataFrame([(float(math.log(v)),) for v in p], "ln_p double")
    order = np.sort(p)
    ok = np.flatnonzero(order <= 0.05 * np.arange(1, len(p) + 1) / len(p))
    assert df.filter(f"ln_p <= {bh_limit(df, 0.05)}").count() == ok.max() + 1
    assert bh_limit(df.limit(0), 0.05) == math.log(0.05)


def test_every_pair_is_counted_and_tested(spark, tmp_path):
    from lumisift.llm.queries import p7_pairs

    # 3,000 images: "x" and "y" together in 5 of them, below 0.002 N; "once" and "only" in one
    rows = [(i, i, ["base"] if i % 2 else ["base", "even"], T[0]) for i in range(3000)] + [(5000 + i, 5000 + i, ["x", "y"], T[0]) for i in range(5)] + [(6000, 6000, ["once", "only"], T[0])]
    captions(spark, rows).write.parquet(str(tmp_path / "caption_results.parquet"))
    got = {(r.tag_a, r.tag_b): r for r in p7_pairs(spark, str(tmp_path)).collect()}
    assert {k: r.images for k, r in got.items()} == {("base", "even"): 1500, ("x", "y"): 5, ("once", "only"): 1}
    assert got["x", "y"].surprising and abs(got["x", "y"].lift - 3006 / 5) < 1e-6


def test_number_of_tests_is_that_of_all_two_terms(spark):
    df = spark.createDataFrame([(math.log(0.01),)], "ln_p double")
    assert bh_limit(df, 0.05) == math.log(0.05) and bh_limit(df, 0.05, 10) == -math.inf


def test_tail_of_one():
    for mean in (1e-4, 1e-2, 0.3, 0.9):
        m, q = np.array([1000.0]), np.array([[mean / 1000]])
        for c in (1, 2, 3):
            pmf = [math.comb(1000, k) * q[0, 0] ** k * (1 - q[0, 0]) ** (1000 - k) for k in range(40)]
            want = math.log(sum(pmf[c:]))
            got = log_tail(q, m, np.array([float(c)]))[0]
            assert abs(got - want) < 0.02 + 0.02 * abs(want), (mean, c, got, want)
