import random

from lumisift.llm.groups import components


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "a long, b long, u string, v int")
    return {r.id: r.group_id for r in components(df).collect()}


def naive(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in list(root)}


def test_chain_hub_and_odd_pairs(spark):
    chain = [(k, k + 1) for k in range(1000, 1060)]
    hub = [(5, k) for k in range(100, 300)] + [(7, 299)]
    odd = [(None, 1), (2, None), (3, 3), (100, 5), (100, 5), (-4, 1010)]
    pairs = chain[::-1] + hub + odd
    assert run(spark, pairs) == naive(pairs)


def test_random_graph(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    assert run(spark, pairs) == naive(pairs)


def test_no_pairs(spark):
    assert run(spark, []) == {} == run(spark, [(1, 1), (None, None)])
