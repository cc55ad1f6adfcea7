import numpy as np
import pyarrow as pa
import pytest

from lumisift.llm import clusters as C
from lumisift.llm import vectors as V
from lumisift.llm.neighbors import neighbors
from lumisift.llm.vectors import Forest, usable

SMALL = Forest(trees=6, bucket=64, leaf=8, axes=8, letters=6, trees_per_pass=6)


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, 1, "x") for i, v in rows], "image_id long, embedding array<float>, id int, vec string")


def planted(seed=4, groups=25, size=6, dim=64, noise=0.055):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            rows.append((c + noise * rng.standard_normal(dim)) * rng.choice([1.0, 7.5]))
    return [(10 * k + 3, np.float32(v).tolist()) for k, v in enumerate(rows)]


def odd(dim=64):
    one = [1.0] + [0.0] * (dim - 1)
    return [(900001, None), (900002, []), (900003, one[:-1]), (900004, one + [1.0]), (900005, [0.0] * dim), (900006, [float("nan")] + one[1:]), (900007, [float("inf")] + one[1:]), (900008, [None] + one[1:]), (None, one)]


def cosines(rows):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return ids, np.rint(x @ x.T * 1e6).astype(np.int64)


def naive_neighbors(rows, k, floor):
    ids, s = cosines(rows)
    out = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= round(floor * 1e6))[:k]
        out |= {(int(ids[i]), int(j), int(-v)) for v, j in near}
    return out


def test_usable(spark):
    rows = [(1, [1.0] * 64), (1, [1.0] * 64), (2, [0.0] * 63 + [-2.0])] + odd()
    got = {r.id: np.frombuffer(bytes(r.vec), "<f4") for r in usable(table(spark, rows), "image_id", "embedding").collect()}
    assert sorted(got) == [1, 2] and got[2][63] == -2


@pytest.mark.parametrize("copies", [0, 40])
def test_neighbors_against_brute_force(spark, copies):
    rows = planted()
    rows += [(5 + 10 * k, rows[7][1]) for k in range(copies)]  # a hot group of equal vectors
    got = {(r.id, r.other, r.sim) for r in neighbors(table(spark, rows + rows[:20] + odd()), "image_id", "embedding", 10, 0.82, SMALL).collect()}
    want = naive_neighbors(rows, 10, 0.82)
    assert len(want & got) >= 0.97 * len(want) and len(want & got) >= 0.97 * len(got)


def test_nothing_to_search(spark):
    assert neighbors(table(spark, []), "image_id", "embedding", forest=SMALL).count() == 0
    assert neighbors(table(spark, odd()), "image_id", "embedding", forest=SMALL).count() == 0
    assert C.similar_clusters(table(spark, odd()), "image_id", "embedding", forest=SMALL).count() == 0


def naive_clusters(rows, floor):
    ids, s = cosines(rows)
    order = np.argsort(ids)
    ids, s = ids[order], s[np.ix_(order, order)]
    groups = [[i] for i in range(len(ids))]
    while len(groups) > 1:
        best = max(((s[np.ix_(a, b)].min(), -a[0], -b[0], i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] < round(floor * 1e6):
            break
        i, j = best[3:]
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
        groups.sort()
    out = set()
    for g in groups:
        if len(g) > 1:
            sums = s[np.ix_(g, g)].sum(1)
            medoid = int(ids[g[int(sums.argmax())]])
            out |= {(int(ids[i]), medoid, len(g)) for i in g}
    return out


@pytest.mark.parametrize("largest", [4096, 3])
def test_clusters_against_naive_linkage(spark, largest):
    rows = planted(seed=9, groups=12, size=7, noise=0.04)
    rows += [(7, rows[0][1]), (8, rows[0][1]), (9, [1.0] + [0.0] * 63), (11, [1.0] + [0.0] * 63), (12, [0.0, 1.0] + [0.0] * 62)]
    got = {tuple(r) for r in C.similar_clusters(table(spark, rows + rows[:9] + odd()), "image_id", "embedding", 0.90, SMALL, largest).collect()}
    want = naive_clusters(rows, 0.90)
    assert got == want and len({m for _, m, _ in want}) < len(want) and any(n > 2 for _, _, n in want)


def test_set_clusters(spark):
    base = [f"w{k}" for k in range(20)]
    sets = [(1, base), (2, base[:19]), (3, base[1:]), (4, base), (5, ["lone"]), (6, ["other", None]), (7, ["other"]), (8, []), (9, None), (None, base), (10, base[:18])] + [(100 + k, [f"q{k}_{j}" for j in range(6)]) for k in range(20)]
    df = spark.createDataFrame([(i, s, "x") for i, s in sets], "id long, items array<string>, band string")
    got = {r.id: (r.medoid_id, r["size"]) for r in C.set_clusters(df, 0.8).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7, 10} and got[1] == got[4] and got[6] == got[7] == (6, 2)
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for i, (m, _) in got.items():
        assert sim([x for x in dict(sets)[i] if x], [x for x in dict(sets)[m] if x]) >= 0.8
    assert C.set_clusters(df.limit(0)).count() == 0


def test_every_pair_of_a_large_bucket_is_verified(spark):
    # 140 sets around the same 8 items, each similar to its one twin only (9 of 17 items)
    twins = {}
    for k in range(70):
        twins[k] = {f"c{j}" for j in range(8)} | {f"o{k}_{j}" for j in range(5)}
        twins[1000 - k] = {f"c{j}" for j in range(8)} | {f"o{k}_0"} | {f"z{k}_{j}" for j in range(4)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in twins.items()], "id long, items array<string>")
    assert {tuple(r) for r in C.set_clusters(df, 0.5).collect()} == {(i, k, 2) for k in range(70) for i in (k, 1000 - k)}


@pytest.mark.parametrize("floor", [0.3, 0.5, 0.8])
def test_set_pairs_against_brute_force(spark, floor):
    rng = np.random.default_rng(3)
    sets = sorted({frozenset(f"r{j}" for j in rng.choice(14, rng.integers(1, 9), replace=False)) for _ in range(250)}, key=sorted)
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= floor * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<string>")
    assert {(r.a, r.b) for r in C.jaccard_pairs(df, floor).collect()} == want and len(want) > 5


def test_pairs_exactly_at_the_floor_are_found(spark):
    # 100 pairs of Jaccard 0.5; 40 bands of 4 hashes find 92 of 100 on average
    sets = [(2 * k + s, [f"c{k}_{j}" for j in range(6)] + [f"{'ab'[s]}{k}_{j}" for j in range(3)]) for k in range(100) for s in (0, 1)]
    got = {tuple(r) for r in C.set_clusters(spark.createDataFrame(sets, "id long, items array<string>"), 0.5).collect()}
    assert got == {(2 * k + s, 2 * k, 2) for k in range(100) for s in (0, 1)}


def test_trees_grow_with_the_letters_of_a_bucket():
    f = Forest()
    assert [f.sized(n).trees for n in (0, 1, 1_000_000, 61_000_000)] == [9, 9, 9, 18]


@pytest.mark.parametrize("bucket, letters", [(1024, 1), (128, 2), (16, 3)])
def test_recall_with_several_letters_in_use(spark, bucket, letters):
    # 16 letters; buckets so small that their strings differ in one, two or three of them
    rows = planted(seed=21, groups=1000, size=4, noise=0.05)
    f = Forest(bucket=bucket, leaf=max(bucket // 8, 4), axes=8, letters=6, trees_per_pass=30)
    assert 16 ** (letters - 1) < len(rows) / bucket * 4 <= 16**letters
    got = {(r.id, r.other, r.sim) for r in neighbors(table(spark, rows), "image_id", "embedding", 10, 0.82, f).collect()}
    want = naive_neighbors(rows, 10, 0.82)
    assert len(want & got) >= 0.9 * len(want) and len(got - want) == 0


def cone(n, spread=0.02, seed=6):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal(64)
    return np.float32(c / np.linalg.norm(c) + spread * rng.standard_normal((n, 64)))


def test_a_dense_cone_is_cut_into_bounded_buckets_and_leaves():
    f = Forest(bucket=16_384)
    x = cone(100_000)
    u = V.unit(x)
    trie, label, n = V.grow(u[::4], f, 0, f.bucket / 4)
    assert np.bincount(trie.route(u)).max() < 1.5 * f.bucket and (trie.route(u[::4]) == label).all() and trie.deeper
    b = V.Bucket(f, 0, np.arange(16_384), V.encode(u[:16_384], f, V._rotations(f, 0, 0)), x[:16_384])
    sizes = [(len(q), len(m)) for q, m in b.meetings()]
    assert max(m for _, m in sizes) <= f.leaf and sum(m for _, m in sizes) == 16_384 and sum(q for q, _ in sizes) == 16_384 * 7
    assert max(len(m) for _, m in V.Bucket(f, 0, np.arange(5000), np.zeros(5000, dtype=np.int64), np.ones((5000, 64), dtype=np.float32)).meetings()) <= f.leaf


def test_a_dense_cone_of_100_000_is_searched_and_linked(spark):
    x = cone(100_000)
    raw = spark.createDataFrame(pa.table({"image_id": np.arange(100_000), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    f = Forest(trees=1, bucket=16_384)
    near = neighbors(raw, "image_id", "embedding", 3, 0.82, f)
    assert near.count() >= 299_900
    reps, _, n = V.classes(usable(raw, "image_id", "embedding"))
    stars = V.forest_map(reps, f, V.borders(reps, f, n), C._link_kernel(0.9), "a long, b long")
    assert stars.count() >= 99_900


def test_leaves_do_not_depend_on_arrival(spark):
    rows = planted(seed=3, groups=120, size=4)
    got = [{tuple(r) for r in neighbors(table(spark, r).repartition(n), "image_id", "embedding", 5, 0.82, SMALL).collect()} for r, n in ((rows, 1), (rows[::-1], 7))]
    assert got[0] == got[1]
