import random

import pytest

from lumisift.operators import hierarchy as H


def rules(spark, rows):
    return spark.createDataFrame([(c, d, a, "noise") for c, d, a in rows], "child string, direct array<string>, every array<string>, node string")


def run(spark, rows, **kw):
    return {(r.node, r.kind, r.root, r.depth, r.path) for r in H.hierarchy(rules(spark, rows), "child", ["direct", "every"], **kw).collect()}


def naive(links, nodes):
    up = {n: set() for n in nodes}
    changed = True
    while changed:
        changed = False
        for c, p in links:
            new = {p} | up[p]
            if not new <= up[c]:
                up[c] |= new
                changed = True
    cyc = {n for n in nodes if n in up[n]}
    below = {n for n in nodes if n not in cyc and up[n] & cyc}
    out = {(n, "cycle", min(a for a in up[n] if n in up.get(a, ())), -1, "") for n in cyc} | {(n, "below", "", -1, "") for n in below}
    good = nodes - cyc - below
    parents = {n: {p for c, p in links if c == n} for n in good}
    parents = {n: {p for p in ps if not any(p in up[q] for q in ps if q != p)} for n, ps in parents.items()}

    def ways(n):
        return [(n,)] if not parents[n] else [w + (n,) for p in parents[n] for w in ways(p)]

    return out | {(n, "path", w[0], len(w) - 1, "/".join(w)) for n in good for w in ways(n)}


def test_odd_input(spark):
    rows = [(" Plaid Skirt,", ["skirt", None, " ", "SKIRT"], None), ("plaid_skirt", None, ["clothes", "skirt"]), ("skirt", ["clothes"], []), ("alone", None, None), (None, ["x_y"], None), ("", ["lost"], None), ("loop", ["loop"], None), ("child", ["loop"], None), ("long" * 3000, ["skirt"], None)]
    got = run(spark, rows)
    assert {r for r in got if len(r[0]) < 100} == {
        ("clothes", "path", "clothes", 0, "clothes"), ("skirt", "path", "clothes", 1, "clothes/skirt"), ("plaid_skirt", "path", "clothes", 2, "clothes/skirt/plaid_skirt"),
        ("alone", "path", "alone", 0, "alone"), ("x_y", "path", "x_y", 0, "x_y"), ("lost", "path", "lost", 0, "lost"), ("loop", "cycle", "loop", -1, ""), ("child", "below", "", -1, "")}
    assert len(got) == 9
    assert run(spark, []) == set()


@pytest.mark.parametrize("fragment", [10_000, 12])
def test_random_graphs(spark, fragment):
    rng = random.Random(fragment)
    names = [f"n{i:02d}" for i in range(40)]
    links = {(f"n{c:02d}", f"n{p:02d}") for c in range(1, 34) for p in rng.sample(range(c), min(c, rng.choice([1, 1, 1, 2])))}
    links |= {("n36", "n37"), ("n37", "n38"), ("n38", "n36"), ("n39", "n38"), ("n05", "n35")}
    rows = [(c, [p], None) for c, p in links]
    nodes = {x for link in links for x in link}
    assert run(spark, rows, fragment=fragment) == naive(links, nodes) and names


def test_a_long_chain_in_small_fragments(spark):
    links = [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 60)]
    got = run(spark, [(c, [p], None) for c, p in links], fragment=10)
    assert ("c059", "path", "c000", 59, "/".join(f"c{i:03d}" for i in range(60))) in got and len(got) == 60


def levels_of(monkeypatch):
    seen, real = [], H.fragments

    def counted(links, *a):
        got = real(links, *a)
        seen.append((links.count(), got[1]))
        return got

    monkeypatch.setattr(H, "fragments", counted)
    return seen


def test_every_level_keeps_less_than_half_of_deep_chains(spark, monkeypatch):
    seen = levels_of(monkeypatch)
    links = [(f"{c}_{i:04d}", f"{c}_{i - 1:04d}") for c in "abcdef" for i in range(1, 300)]
    df = spark.createDataFrame(links, "child string, parent string")
    assert H.ancestors(df, fragment=40).count() == 6 * 299 * 300 // 2
    assert [p for _, p in seen][-1] == 1 and len(seen) >= 2 and all(2 * b < a for (a, _), (b, _) in zip(seen, seen[1:])), seen
    seen.clear()
    nodes = df.selectExpr("explode(array(child, parent)) AS node").distinct()
    got = {(r.node, r.depth) for r in H.paths(df, nodes, fragment=40).collect()}
    assert got == {(f"{c}_{i:04d}", i) for c in "abcdef" for i in range(300)}
    assert len(seen) >= 2 and all(2 * b < a for (a, _), (b, _) in zip(seen, seen[1:])), seen


def test_a_hub_is_spread_and_dense_links_end(spark, monkeypatch):
    seen = levels_of(monkeypatch)
    hub = [(f"leaf{i}", "hub") for i in range(500)] + [("hub", "top")]
    df = spark.createDataFrame(hub, "child string, parent string")
    tagged, parts = H.fragments(df, 50, 0)
    assert parts == 11 and max(r["count"] for r in tagged.groupBy("part").count().collect()) < 260
    assert H.ancestors(df, fragment=50).count() == 1001
    seen.clear()
    dense = [(f"n{i:02d}", f"n{j:02d}") for i in range(40) for j in range(i)]  # contraction leaves almost all of them
    assert H.ancestors(spark.createDataFrame(dense, "child string, parent string"), fragment=20).count() == 780
    assert [p for _, p in seen] == [39, 19, 9, 4, 2, 1]


def test_a_cycle_over_many_fragments(spark):
    ring = [(f"r{i:03d}", f"r{(i + 1) % 200:03d}") for i in range(200)] + [("tail", "r000"), ("r100", "above")]
    got = run(spark, [(c, [p], None) for c, p in ring], fragment=20)
    assert got == {(f"r{i:03d}", "cycle", "r000", -1, "") for i in range(200)} | {("tail", "below", "", -1, ""), ("above", "path", "above", 0, "above")}
