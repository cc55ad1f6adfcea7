"""Parent-child links to full hierarchies: ancestors, cycles, and every path from the top.

Both operators contract. Links are put into fragments of bounded size that hold whole stretches of parent
chains (:func:`fragments`); each fragment follows its own links in one task up to the parents outside it (its
exits); the links between exits form a smaller quotient that is solved the same way; and the fragments' results
are expanded by joins. A cycle is seen in a fragment that holds all of it, or in the quotient in which its
fragments' exits meet.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tag_form
from ..storage import cut

FRAGMENT = 4096  # links a task follows by itself
STRETCH = 6  # one in so many nodes begins a stretch of a chain
JUMPS = 4  # doublings of the pointers that look for the beginning: 16 links


def links_of(df: DataFrame, child: str, parents: list[str]) -> tuple[DataFrame, DataFrame]:
    """(links, nodes): distinct (child, parent) and distinct (node), names in TAG FORM; blank names are no nodes."""
    name = tag_form(F.col(child))
    none = F.array().cast("array<string>")
    both = F.concat(*(F.coalesce(F.col(p), none) for p in parents))
    raw = df.select(name.alias("child"), F.explode_outer(both).alias("p")).select("child", tag_form(F.col("p")).alias("parent"))
    links = raw.filter("child <> '' AND parent <> ''").distinct()
    nodes = raw.select(F.explode(F.array("child", "parent")).alias("node")).filter("node <> ''").distinct()
    return links, nodes


def _components(adj: dict) -> tuple[list[list], dict]:
    """Strongly connected components of node -> parents, parents' components first (Tarjan, without recursion)."""
    index, low, on, stack, out, of = {}, {}, set(), [], [], {}
    for start in adj:
        if start in index:
            continue
        work = [(start, iter(adj[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(adj.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        of[w] = len(out)
                        if w == v:
                            break
                    out.append(comp)
    return out, of


def _local_ancestors(p: pd.DataFrame) -> pd.DataFrame:
    inside, outside = defaultdict(list), defaultdict(set)
    for c, q, own in zip(p.child, p.parent, p.own):
        if own:
            inside[c].append(q)
            inside[q]
        else:
            inside[c]
            outside[c].add(q)
    comps, of = _components(inside)
    reach, leave, rows = [], [], []
    for comp in comps:
        near, far = set(), set()
        cyclic = len(comp) > 1
        for v in comp:
            far |= outside.get(v, set())
            for q in inside[v]:
                cyclic |= q == v
                if of[q] != of[v]:
                    near.add(q)
                    near |= reach[of[q]]
                    far |= leave[of[q]]
        if cyclic:
            near |= set(comp)
        reach.append(near)
        leave.append(far)
        for v in comp:
            rows += [(v, a, False) for a in near] + [(v, a, True) for a in far]
    return pd.DataFrame(rows, columns=["node", "anc", "exit"])


def fragments(links: DataFrame, fragment: int, level: int, most: int | None = None) -> tuple[DataFrame, int]:
    """(links with ``part`` and ``own``, parts): fragments of about ``fragment`` of the distinct (child, parent, ...).

    A link belongs to its child's fragment and is ``own`` if the parent lies there too. A hash marks one node in ``STRETCH``; each node
    is put with the nearest marked node on its chain of first parents, which a few pointer doublings find. Stretches of long chains
    thus lie in one fragment. What hangs on one node in greater number (a hub's leaves) is spread by hash. Rows with a null parent are kept, not own.
    At most ``most`` fragments: each level of contraction has at most half of the one before, so that links which do
    not become fewer are met by larger fragments, not by more levels.
    """
    n = links.count()
    parts = max(1, -(-n // fragment))
    parts = parts if most is None else max(1, min(parts, most))
    inner = F.col("parent").isNotNull()
    if parts == 1:
        return links.withColumns({"part": F.lit(0), "own": inner}), 1
    first = links.filter(inner).groupBy("child").agg(F.min("parent").alias("to"), F.count("*").alias("n"))
    begins = F.pmod(F.xxhash64("child", F.lit(level)), F.lit(STRETCH)) == 0
    at = cut(first.select(F.col("child").alias("node"), F.when(begins, F.col("child")).otherwise(F.col("to")).alias("at"), "n"), "chains")
    for k in range(JUMPS):
        further = at.select(F.col("node").alias("at"), F.col("at").alias("next"))
        at = at.join(further, "at", "left").select("node", F.coalesce("next", "at").alias("at"), "n")
        at = cut(at, "chains") if k % 2 else at  # two doublings a table
    pieces = at.groupBy("at").agg(F.ceil(F.sum("n") / fragment).cast("int").alias("pieces"))
    spot = lambda label, piece: F.pmod(F.xxhash64(label, piece, F.lit(level)), F.lit(parts)).cast("int")
    where = cut(at.join(pieces, "at").select("node", spot("at", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).alias("spot")), "spots")
    side = lambda c: where.select(F.col("node").alias(c), F.col("spot").alias(f"_{c}"))
    alone = lambda c: F.coalesce(F.col(f"_{c}"), spot(c, F.lit(0)))
    both = links.join(side("child"), "child", "left").join(side("parent"), "parent", "left")
    return both.select(*links.columns, alone("child").alias("part"), F.coalesce(alone("child") == alone("parent"), F.lit(False)).alias("own")).withColumn("own", F.col("own") & inner), parts


def ancestors(links: DataFrame, fragment: int = FRAGMENT, level: int = 0, most: int | None = None) -> DataFrame:
    """(node, anc): every ancestor of every node of distinct, non-null (child, parent); a node is its own exactly if it is on a cycle."""
    tagged, parts = fragments(links.select("child", "parent"), fragment, level, most)
    local = tagged.groupBy("part").applyInPandas(_local_ancestors, "node string, anc string, exit boolean")
    if parts == 1:
        return local.select("node", "anc")
    local = cut(local, "fragments")
    exits, inner = local.filter("exit").select("node", "anc"), local.filter("NOT exit").select("node", "anc")
    border = exits.select(F.col("anc").alias("node")).distinct()
    quotient = cut(exits.join(border, "node", "left_semi").select(F.col("node").alias("child"), F.col("anc").alias("parent")), "quotient")
    solved = ancestors(quotient, fragment, level + 1, parts // 2)
    further = exits.join(solved.select(F.col("node").alias("anc"), F.col("anc").alias("top")), "anc").select("node", F.col("top").alias("anc"))
    met = cut(exits.union(further).distinct(), "met")
    beyond = met.join(inner.select(F.col("node").alias("anc"), F.col("anc").alias("top")), "anc").select("node", F.col("top").alias("anc"))
    return inner.union(met).union(beyond).distinct()


def _local_ways(p: pd.DataFrame) -> pd.DataFrame:
    rows = defaultdict(list)
    for c, q, own, seg, steps in zip(p.child, p.parent, p.own, p.seg, p.steps):
        rows[c].append((q, bool(own), seg, steps))
    comps, _ = _components({c: [q for q, own, _, _ in r if own and q in rows] for c, r in rows.items()})
    ways = {}
    for (c,) in comps:  # parents first
        here = []
        for q, own, seg, steps in rows[c]:
            if own and q in ways:
                here += [(t, f"{s}/{seg}", k + steps) for t, s, k in ways[q]]
            else:
                here.append((q, seg, steps))
        ways[c] = here
    return pd.DataFrame([(c, *w) for c, r in ways.items() for w in r], columns=["child", "parent", "seg", "steps"])


_WAY = "child string, parent string, seg string, steps int"


def _ways(rows: DataFrame, fragment: int, level: int, most: int | None = None) -> DataFrame:
    tagged, parts = fragments(rows, fragment, level, most)
    local = tagged.groupBy("part").applyInPandas(_local_ways, _WAY)
    if parts == 1:
        return local.filter("parent IS NULL")
    local = cut(local, "ways")
    border = local.filter("parent IS NOT NULL").select(F.col("parent").alias("child")).distinct()
    quotient = cut(local.join(border, "child", "left_semi"), "quotient")
    solved = _ways(quotient, fragment, level + 1, parts // 2)
    up = solved.select(F.col("child").alias("parent"), F.col("parent").alias("top"), F.col("seg").alias("head"), F.col("steps").alias("more"))
    via = local.filter("parent IS NOT NULL").join(up, "parent").select("child", F.col("top").alias("parent"), F.concat_ws("/", "head", "seg").alias("seg"), (F.col("steps") + F.col("more")).alias("steps"))
    return local.filter("parent IS NULL").union(via)


def paths(links: DataFrame, nodes: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """(node, root, depth, path): one row for each way from a node without parents down to each node; links must be acyclic and distinct."""
    roots = nodes.join(links.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    rows = links.select("child", "parent", F.col("child").alias("seg"), F.lit(1).alias("steps"))
    rows = rows.union(roots.select("node", F.lit(None).cast("string"), "node", F.lit(0)))
    done = _ways(cut(rows, "rows"), fragment, 0)
    return done.select(F.col("child").alias("node"), F.split_part(F.col("seg"), F.lit("/"), F.lit(1)).alias("root"), F.col("steps").alias("depth"), F.col("seg").alias("path"))


def reduced(links: DataFrame, closure: DataFrame) -> DataFrame:
    """Acyclic links without those to a parent that is also an ancestor of another parent of the same child."""
    several = links.groupBy("child").agg(F.count("*").alias("n")).filter("n > 1").select("child")
    many = links.join(several, "child", "left_semi")
    implied = many.join(closure.select(F.col("node").alias("parent"), "anc"), "parent").select("child", F.col("anc").alias("parent")).distinct()
    return links.join(implied, ["child", "parent"], "left_anti")


def hierarchy(df: DataFrame, child: str, parents: list[str], fragment: int = FRAGMENT) -> DataFrame:
    """(node, kind, root, depth, path) of every name in ``child`` or ``parents``.

    Kind ``cycle``: the node is its own ancestor; root is the smallest node that is both
    its ancestor and its descendant, depth -1, path ''. Kind ``below``: an ancestor is on
    a cycle; root '', depth -1, path ''. Kind ``path``: implied links are left out and every way from the
    top is a row. Null and blank names and null arrays are nothing; repeated rows and
    links count once; an empty table gives no rows. A parent that a third of all nodes
    share is a join key whose partition adaptive execution splits.
    """
    links, nodes = links_of(df, child, parents)
    links, nodes = cut(links, "links"), cut(nodes, "nodes")
    up = cut(ancestors(links, fragment), "ancestors")
    on = cut(up.filter("node = anc").select("node"), "cyclic")
    ring = up.join(on, "node", "left_semi").join(on.select(F.col("node").alias("anc")), "anc", "left_semi").select("node", "anc")
    cyc = ring.join(ring.select(F.col("anc").alias("node"), F.col("node").alias("anc")), ["node", "anc"]).groupBy("node").agg(F.min("anc").alias("root"))
    below = up.join(on.select(F.col("node").alias("anc")), "anc", "left_semi").select("node").distinct().join(on, "node", "left_anti")
    bad = cut(on.union(below), "bad")
    good = nodes.join(bad, "node", "left_anti")
    kept = links.join(bad.select(F.col("node").alias("child")), "child", "left_anti")
    straight = cut(reduced(kept, up), "reduced")
    flat = lambda d, kind, root: d.select("node", F.lit(kind).alias("kind"), root.alias("root"), F.lit(-1).alias("depth"), F.lit("").alias("path"))
    ways = paths(straight, good, fragment).select("node", F.lit("path").alias("kind"), "root", "depth", "path")
    return ways.union(flat(cyc, "cycle", F.col("root"))).union(flat(below, "below", F.lit("")))
