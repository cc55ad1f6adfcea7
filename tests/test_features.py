import random

from lumisift.operators import features

TARGETS = {"people": {"1": 0.5, "2": 0.3, "3_plus": 0.2}, "framing": {"full_body": 0.3, "half_body": 0.5, "headshot": 0.2}, "outdoors": {"true": 0.4, "false": 0.6}}


def derive(spark, tags):
    rows = [(i, t, float(s)) for i, m in enumerate(tags) for t, s in m.items()]
    return {r.image_id: r for r in features.derive(spark.createDataFrame(rows, "image_id long, tag string, score double")).collect()}


def test_ties_and_sources(spark):
    got = derive(spark, [
        {"1girl": 0.8, "2girls": 0.8, "group": 0.8, "full_body": 0.5, "cowboy_shot": 0.5},
        {"1girl": 0.8, "1boy": 0.7, "2girls": 0.3, "solo": 0.1, "upper_body": 0.6, "cowboy_shot": 0.6},
        {"4boys": 0.9, "1boy": 0.2, "close_up": 0.4, "close-up": 0.4},
        {"1girl": 0.34, "outdoors": 0.5, "bedroom": 0.46},
        {"12others": 0.4, "outdoors": 0.6, "classroom": 0.2},
        {"tree": 0.9, "office": 0.9},
    ])
    assert [got[i].people for i in range(6)] == ["3_plus", "1", "3_plus", "unknown", "3_plus", "unknown"]
    assert [got[i].people_source for i in range(6)] == ["group", "1girl", "4boys", None, "12others", None]
    assert [got[i].framing_source for i in range(3)] == ["full_body", "cowboy_shot", "close-up"]
    assert [got[i].outdoors for i in range(6)] == [None, None, None, None, True, False]
    assert (got[3].people_confidence, got[3].people_status, got[3].outdoors_confidence, got[5].outdoors_status) == (0.34, "unknown", 0.5, "high")
    mixed = derive(spark, [{"1girl": 0.7, "1boy": 0.69, "duo": 0.1}])[0]
    assert (mixed.people, mixed.people_source) == ("1", "1girl")


def naive(items, size):
    limit, left, taken, out = min(size, len(items)), dict(items), {}, []
    t = {d: features.normalized(v) for d, v in TARGETS.items()}
    for rank in range(1, limit + 1):
        def key(i):
            score, conf = 0.0, []
            for k, d in enumerate(("people", "framing", "outdoors")):
                v, c = left[i][k]
                if v != "unknown":
                    want = t[d][v] * limit
                    score += features.WEIGHTS[d] * max(want - taken.get((d, v), 0), 0.0) / max(want, 1.0)
                    conf.append(c)
            mean = sum(conf) / len(conf) if conf else 0.0
            return score + 0.1 * mean, mean, i

        best = max(left, key=key)
        for k, d in enumerate(("people", "framing", "outdoors")):
            v = left[best][k][0]
            taken[d, v] = taken.get((d, v), 0) + 1
        del left[best]
        out.append((best, rank))
    return out


def test_queues_select_what_the_greedy_loop_selects(spark):
    rng = random.Random(5)
    items = {i: [(rng.choice(v), rng.randint(35, 40) / 100) for v in features.DOMAIN.values()] for i in range(60)}
    rows = [(i, p[0], p[1], f[0], f[1], {"true": True, "false": False}.get(o[0]), o[1]) for i, (p, f, o) in items.items()]
    df = spark.createDataFrame(rows, "image_id long, people string, people_confidence double, framing string, framing_confidence double, outdoors boolean, outdoors_confidence double")
    for size in (0, 1, 17, 100):
        assert [tuple(r) for r in features.select(df, size, TARGETS).orderBy("rank").collect()] == naive(items, size)
    cells = {(r.dimension, r.value): r.n for r in features.distribution(df).collect()}
    assert len(cells) == 11 and sum(n for (d, _), n in cells.items() if d == "people") == 60
    sets = {(r.dimension, r.value): r.n for r in features.distribution_sets(df).collect()}
    assert sets == {k: n for k, n in cells.items() if n}
