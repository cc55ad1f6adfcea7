from datetime import datetime

import numpy as np

from lumisift.llm.sampling import DIMENSIONS, drawn_ranks, exchange, hypergeometric, needs, proportional_samples, quotas

T = [datetime(2025, 1, d) for d in range(1, 9)]
REQ = "request_id long, job_id string, target_size int, people_count_target map<string,double>, framing_target map<string,double>, outdoors_target map<string,double>, min_per_category int, submitted_at timestamp, n long"
ITEM = "image_id long, job_id string, people_count string, framing string, outdoors string, tagged_at timestamp, loaded_at timestamp, quota string"


def run(spark, items, requests):
    sample, report = proportional_samples(spark.createDataFrame(items, ITEM), spark.createDataFrame(requests, REQ))
    got = {}
    for r in sample.collect():
        got.setdefault(r.request_id, []).append(r.image_id)
    return got, {(r.request_id, r.dimension, r.category): r for r in report.collect()}


def test_needs():
    d = DIMENSIONS[0]
    assert needs(None, d, 100, 4) == {"1": 85.0, "2": 12.0, "3_plus": 4.0}
    assert needs({"1": -1.0, "2": 30.0, "x": 5.0}, d, 10, 2) == {"1": 0.0, "2": 10.0, "3_plus": 0.0}
    assert needs({}, d, 10, 2) is None and needs({"1": float("nan"), "2": None}, d, 10, 1) is None


def test_quotas_meet_every_reachable_target():
    cells = [("1", "full_body", "true"), ("2", "half_body", "false"), ("3_plus", "headshot", "true"), ("", "", "")]
    want = [{"1": 8.0, "2": 1.0, "3_plus": 0.9}, {"full_body": 8.0, "half_body": 1.0, "headshot": 0.9}, None]
    q = quotas(cells, np.array([100, 100, 100, 100]), want, 10)
    assert q.tolist() == [8, 1, 1, 0]
    q = quotas(cells, np.array([2, 0, 1, 50]), want, 10)
    assert q.tolist() == [2, 0, 1, 7]
    assert quotas(cells, np.array([2, 0, 1, 1]), want, 10).sum() == 4 and quotas(cells, np.array([5, 5, 5, 5]), want, 0).sum() == 0


def test_samples_and_deficits(spark):
    items = []
    for k in range(600):
        people = ["1", " 2 ", "3 Plus", None, "unknown"][k % 5]
        items.append((k, "hot", people, ["full_body", "HALF_BODY", "headshot"][k % 3], ["true", "False"][k % 2], T[1], T[1], "x"))
        items.append((k, "old", "1", "headshot", "true", T[0], T[5], "x"))
    items += [(1000, "tiny", "1", None, None, None, None, "x"), (1001, None, "1", "headshot", "true", T[0], T[0], "x"), (None, "hot", "1", "headshot", "true", T[0], T[0], "x")]
    half = {"1": 0.5, "2": 0.5, "3_plus": 0.0}
    requests = [(1, "hot", 60, half, None, {"true": 1.0}, 2, T[0], 1), (1, "hot", 60, half, None, {"true": 1.0}, 2, T[0], 1), (2, "tiny", 5, None, None, None, 1, T[0], 1), (3, "none", 5, None, {}, None, 0, T[0], 1), (4, None, None, None, None, None, None, None, 1), (5, "old", 10, None, None, None, 0, T[0], 1)]
    got, report = run(spark, items, requests)
    assert len(got[1]) == len(set(got[1])) == 60 and got[2] == [1000] and set(got) == {1, 2}
    r = report[1, "people_count", "1"]
    assert (r.need, r.available, r.chosen, r.short) == (30.0, 120, 30, False) and report[1, "outdoors", "true"].chosen == 60
    assert report[2, "people_count", "1"].chosen == 1 and report[2, "framing", "headshot"].short and report[5, "framing", "headshot"].available == 0
    assert not any(k[:2] == (3, "framing") for k in report) and report[4, "people_count", "1"].need == 0 and not report[4, "people_count", "1"].short


def test_empty(spark):
    got, report = run(spark, [], [])
    assert got == {} and report == {}


def test_ranks_are_drawn_evenly_and_exactly():
    hits = np.zeros(300)
    for k in range(3000):
        got = drawn_ranks(300, 20, np.random.default_rng(k))
        assert len(got) == 20 == len(set(got.tolist())) and got.min() >= 0 and got.max() < 300
        hits[got] += 1
    assert abs(hits - 200).max() < 80  # 200 expected, deviation about 14
    for n, q in ((1, 1), (5, 5), (10, 9), (1_000_000, 3)):
        assert len(set(drawn_ranks(n, q, np.random.default_rng(1)).tolist())) == q
    rng = np.random.default_rng(2)
    assert 4_000_000 < hypergeometric(rng, 10**12, 10**12, 10**7) < 6_000_000 and hypergeometric(rng, 3, 0, 2) == 2


def test_two_moves_together():
    # no single move helps: a unit for category 0 costs category 1, which only a second move gives back
    member = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 1, 1, 0]])
    q, counts, reach = np.array([0, 1, 0, 1]), np.array([1, 2, 2, 1]), np.array([1, 1, 1])
    while moves := exchange(q, counts, member, reach):
        for i, j in moves:
            q[i], q[j] = q[i] - 1, q[j] + 1
    assert (member @ q >= reach).all() and q.sum() == 2


def test_large_cells_and_quotas_are_drawn_in_stretches(spark):
    items = spark.createDataFrame([(k, "hot", "1" if k % 3 else "2", "full_body", "true", T[1], T[1], "x") for k in range(2000)], ITEM)
    requests = spark.createDataFrame([(7, "hot", 900, {"1": 0.5, "2": 0.5}, None, {"true": 1.0}, 0, T[0], 1), (8, "hot", 5000, None, None, None, 0, T[0], 1)], REQ)
    sample, report = proportional_samples(items, requests, stretch=64)
    got = [(r.request_id, r.image_id) for r in sample.collect()]
    assert len(got) == len(set(got)) == 2900 and sum(1 for r, i in got if r == 7 and i % 3 == 0) == 450
