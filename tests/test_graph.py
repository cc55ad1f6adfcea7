import numpy as np

from lumisift.operators import clusters, graph
from lumisift.functions.linkage import complete_linkage


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")


def nodes(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "node long")


def test_equal_vectors_form_one_component(spark):
    v = vectors(spark, [[1, 0]] * 4)
    edges = graph.mutual_top_k(graph.cosine_pairs(v, 0.9), 3).cache()
    kept, audit = graph.keep_largest(nodes(spark, 4), edges, 3)
    assert sorted(r.node for r in kept.collect()) == [0, 1, 2, 3]
    assert audit.first().asDict() == {"nodes": 4, "edges": 6, "nodes_with_edges": 4, "core_nodes": 4, "components": 1}


def test_empty_core_keeps_nothing(spark):
    v = vectors(spark, [[1, 0], [0, 1], [1, 0.01]])
    kept, audit = graph.keep_largest(nodes(spark, 3), graph.mutual_top_k(graph.cosine_pairs(v, 0.5), 3), 3)
    assert kept.count() == 0 and audit.first().components == 0


def test_core_and_components(spark):
    # a square with a tail, and a triangle; the square has more nodes
    e = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (5, 6), (6, 7), (5, 7)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, sim double")
    assert sorted(r.node for r in graph.k_core(nodes(spark, 9), edges, 2).collect()) == [0, 1, 2, 3, 5, 6, 7]
    comp = {r.node: (r.component, r["size"]) for r in graph.components(nodes(spark, 9), edges).collect()}
    assert comp == {**{i: (1, 5) for i in range(5)}, **{i: (2, 3) for i in (5, 6, 7)}, 8: (3, 1)}


def test_equal_sizes_go_to_the_smaller_node(spark):
    edges = spark.createDataFrame([(2, 3, 1.0), (0, 1, 1.0)], "src long, dst long, sim double")
    comp = {r.node: r.component for r in graph.components(nodes(spark, 4), edges).collect()}
    assert comp == {0: 1, 1: 1, 2: 2, 3: 2}


def test_blocks_find_the_same_pairs(spark):
    rng = np.random.default_rng(1)
    v = vectors(spark, rng.standard_normal((60, 5)))
    one = {(r.src, r.dst, r.sim) for r in graph.cosine_pairs(v, 0.4).collect()}
    assert one == {(r.src, r.dst, r.sim) for r in graph.cosine_pairs(v, 0.4, block=7).collect()} and len(one) > 20


def test_unusable_vectors_and_empty_tables(spark):
    v = vectors(spark, [[1, 0], None, [1, 0], [], [1, 2, 3], [float("nan"), 1]])
    assert [(r.src, r.dst) for r in graph.cosine_pairs(v, 0.9).collect()] == [(0, 2)]
    assert graph.cosine_pairs(vectors(spark, [None]).limit(0), 0.9).count() == 0


def naive_linkage(sim, least):
    groups = [[i] for i in range(len(sim))]
    while len(groups) > 1:
        best = max(((min(sim[x][y] for x in a for y in b), -a[0], -b[0], i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] < least:
            break
        i, j = best[3:]
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
        groups.sort()
    return sorted(groups)


def test_linkage_against_naive():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 12, 25):
        for _ in range(12):
            x = rng.integers(0, 6, (n, 3)) + 1.0
            x /= np.linalg.norm(x, axis=1)[:, None]
            s = np.rint(x @ x.T * 100).astype(np.int64)  # many ties
            label = complete_linkage(s, 95)
            got = sorted([np.flatnonzero(label == k).tolist() for k in np.unique(label)])
            assert got == naive_linkage(s.tolist(), 95)


def test_clusters_medoid_and_audit(spark):
    v = vectors(spark, [[1, 0, 0, 0], [0.99, 0.1, 0, 0], [0, 1, 0, 0]])
    got = {r.id: r.cluster_id for r in clusters.complete_linkage_clusters(v, 0.90).collect()}
    assert got == {0: 0, 1: 0, 2: 1}
    members = spark.createDataFrame([(0, 0, "a", 0, [1.0, 0.0]), (0, 1, "b", 1, [0.8, 0.6]), (1, 2, "c", 2, [0.0, 1.0])], "cluster_id long, id long, path string, pos long, v array<double>")
    a = {r.cluster_id: r for r in clusters.audit(clusters.medoids(members)).collect()}
    assert (a[0]["size"], round(a[0].min_similarity, 6), a[1].min_similarity) == (2, 0.8, 1.0)
    assert [(m.id, m.role) for m in a[0].members] == [(0, "medoid"), (1, "member")]
    assert clusters.singletons(v, "vec_id").count() == 3


def test_components_over_the_bound_are_linked_too(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.standard_normal((30, 3)), np.tile([[1.0, 2.0, 3.0]], (20, 1)), np.zeros((3, 3))]  # copies, and zeros that equal nothing
    v = vectors(spark, [*x.tolist(), [1, 2], [1, 2], None])
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    want = {tuple(g) for g in naive_linkage(np.round(u @ u.T, 9).tolist(), 0.6)} | {(53,), (54,), (55,)}

    def found(largest):
        groups = {}
        for r in clusters.complete_linkage_clusters(v, 0.6, largest=largest).collect():
            groups.setdefault(r.cluster_id, []).append(r.id)
        return {tuple(sorted(g)) for g in groups.values()}

    assert found(3) == want == found(8000) and max(map(len, want)) >= 20


def test_long_paths_and_deep_peeling(spark):
    e = [(i, i + 1, 1.0) for i in range(40)] + [(50, 51, 1.0), (51, 52, 1.0), (50, 52, 1.0), (40, 50, 1.0)]
    edges = spark.createDataFrame(e, "src long, dst long, sim double")
    assert sorted(r.node for r in graph.k_core(nodes(spark, 60), edges, 2).collect()) == [50, 51, 52]
    comp = {r.node: r.component for r in graph.components(nodes(spark, 60), edges).collect()}
    assert {k for k, c in comp.items() if c == 1} == {*range(41), 50, 51, 52} and len(set(comp.values())) == 17


def test_a_large_cluster_is_handled_by_joins(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    of = np.where(np.arange(300) % 3 == 0, 7, np.arange(300) % 5)
    rows = [(int(of[i]), i, f"p{i:03d}", i, x[i].tolist()) for i in range(300)]
    m = spark.createDataFrame(rows, "cluster_id long, id long, path string, pos long, v array<double>").repartition(5)
    got = {}
    for r in clusters.medoids(m).collect():
        got.setdefault(r.cluster_id, []).append((r["rank"], r.id, r.role, r.sim_to_medoid, r["size"], r.lowest))
    low = {r.cluster_id: r.lowest for r in clusters._lowest(m.select("cluster_id", "id", "v"), block=7).collect()}
    for c in np.unique(of):
        k = np.flatnonzero(of == c)
        s = x[k] @ x[k].T
        med = k[s.sum(1).round(9).argmax()]
        order = sorted(k, key=lambda i: (i != med, -round(float(x[i] @ x[med]), 9), f"p{i:03d}"))
        mine = sorted(got[c])
        assert [i for _, i, *_ in mine] == order and mine[0][2] == "medoid" and mine[0][4] == len(k)
        assert abs(mine[0][5] - s[~np.eye(len(k), dtype=bool)].min()) < 1e-9 and abs(low[c] - mine[0][5]) < 1e-9


def test_given_pairs_take_the_place_of_the_search(spark):
    v = vectors(spark, [[1, 0], [1, 0.01], [0, 1], [0.01, 1]])
    pairs = spark.createDataFrame([(0, 1, 0.99), (2, 3, 0.2)], "src long, dst long, sim double")
    got = {r.id: r.cluster_id for r in clusters.complete_linkage_clusters(v, 0.9, pairs=pairs).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}


def test_a_filter_switched_off_and_its_accounts(spark):
    kept, audit = graph.bypassed(nodes(spark, 3))
    assert kept.count() == 3 and audit.first().asDict() == {"nodes": 3, "edges": 0, "nodes_with_edges": 0, "core_nodes": 3, "components": 1}
    assert graph.bypassed(nodes(spark, 3).limit(0))[1].first().components == 0
    sizes = spark.createDataFrame([(0, 5), (1, 2), (2, 1)], "cluster_id long, size long")
    assert graph.accounting(sizes, nodes(spark, 2)).first().asDict() == {"kept_clusters": 2, "excluded_clusters": 1, "kept_images": 7, "excluded_images": 1}
    assert graph.accounting(sizes.limit(0), nodes(spark, 2)).first().asDict() == {"kept_clusters": 0, "excluded_clusters": 0, "kept_images": 0, "excluded_images": 0}


def test_singletons_of_other_lengths(spark):
    rows = [(0, 0, "a", 0, [1.0, 0.0]), (0, 1, "b", 1, [0.0, 1.0]), (1, 2, "c", 2, [0.0]), (2, 3, "d", 3, [1.0, 0.0, 0.0])]
    m = spark.createDataFrame(rows, "cluster_id long, id long, path string, pos long, v array<double>").coalesce(1)
    assert {(r.cluster_id, r.id, r["rank"], r["size"], r.lowest) for r in clusters.medoids(m).collect()} == {(0, 0, 0, 2, 0.0), (0, 1, 1, 2, 0.0), (1, 2, 0, 1, 1.0), (2, 3, 0, 1, 1.0)}
