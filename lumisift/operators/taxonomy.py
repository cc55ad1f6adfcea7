"""The tag taxonomy: aliases, closure, reduction, and the offline compiler's set operations.

Tables: alias (src, dst), edges (child, parent), names in TAG FORM.
"""

from __future__ import annotations

import hashlib
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..sources.files import edges_of, rules_json
from ..storage import cut
from .hierarchy import ancestors, reduced
from .numbering import numbered
from .tagrules import folded


class TaxonomyError(ValueError):
    pass


def validated(edges: DataFrame) -> DataFrame:
    """Normalized distinct edges; an empty name or an edge of a tag to itself is an error."""
    e = cut(edges.select(folded(F.col("child")).alias("child"), folded(F.col("parent")).alias("parent")).distinct(), "edges")
    bad = e.filter("child IS NULL OR parent IS NULL OR child = '' OR parent = '' OR child = parent").first()
    if bad:
        raise TaxonomyError(f"not an edge: {bad.child!r} -> {bad.parent!r}")
    return e


def alias_closure(aliases: DataFrame) -> DataFrame:
    """(src, dst): every alias with the end of its chain; a chain that comes back to itself is an error."""
    a = aliases.select(folded(F.col("src")).alias("src"), folded(F.col("dst")).alias("dst")).filter("src <> dst").distinct()
    up = cut(ancestors(a.select(F.col("src").alias("child"), F.col("dst").alias("parent"))), "aliases")
    ring = up.filter("node = anc").first()
    if ring:
        raise TaxonomyError(f"alias cycle at {ring.node!r}")
    end = up.join(a.select(F.col("src").alias("anc")), "anc", "left_anti")
    return end.groupBy(F.col("node").alias("src")).agg(F.min("anc").alias("dst"))


def canonical_edges(edges: DataFrame, aliases: DataFrame, strict: bool = True) -> DataFrame:
    """Edges between canonical names; one that aliases turn into a self-edge is an error, or dropped if not strict."""
    for side in ("child", "parent"):
        edges = edges.join(aliases.select(F.col("src").alias(side), F.col("dst").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    e = edges.select("child", "parent").distinct()
    if strict:
        loop = e.filter("child = parent").first()
        if loop:
            raise TaxonomyError(f"aliases join both ends of an edge: {loop.child!r}")
    return e.filter("child <> parent")


def cycles(edges: DataFrame) -> DataFrame:
    """(tag, partner): tags on cycles; of a two-cycle the other tag, else null."""
    up = ancestors(edges.select("child", "parent").distinct())
    on = up.filter("node = anc").select(F.col("node").alias("tag"))
    two = edges.join(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"]).groupBy(F.col("child").alias("tag")).agg(F.min("parent").alias("partner"))
    return on.join(two, "tag", "left")


def cycle_path(edges: DataFrame) -> list[str] | None:
    """The tags of a shortest cycle through the smallest tag that is on any, that tag first and last; None without cycles.

    A search by levels from the tag upwards, within what is both above and below it; each level is a join.
    """
    e = cut(edges.select("child", "parent").distinct(), "edges")
    up = cut(ancestors(e), "ancestors")
    start = up.filter("node = anc").agg(F.min("node")).first()[0]
    if start is None:
        return None
    ring = up.filter(F.col("node") == start).select(F.col("anc").alias("tag")).join(up.filter(F.col("anc") == start).select(F.col("node").alias("tag")), "tag")
    inner = cut(e.join(ring.withColumnRenamed("tag", "child"), "child", "left_semi").join(ring.withColumnRenamed("tag", "parent"), "parent", "left_semi"), "ring")
    levels, front, seen = [], e.sparkSession.createDataFrame([(start,)], "child string"), None
    while not levels or levels[-1].filter(F.col("tag") == start).isEmpty():
        step = inner.join(front, "child").groupBy(F.col("parent").alias("tag")).agg(F.min("child").alias("by"))
        step = step if seen is None else step.join(seen, "tag", "left_anti")
        levels.append(cut(step, "level"))
        here = levels[-1].select("tag")
        seen = here if seen is None else seen.union(here)
        front = here.withColumnRenamed("tag", "child")
    path = [start]
    for level in reversed(levels):
        path.append(level.filter(F.col("tag") == path[-1]).first().by)
    return path[::-1]


def require_acyclic(edges: DataFrame, what: str = "cycle") -> DataFrame:
    """The edges; two tags that are each other's parent are named first, else a whole longer cycle."""
    e = edges.select("child", "parent").distinct()
    two = e.join(e.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"]).orderBy("child", "parent").first()
    if two:
        raise TaxonomyError(f"{what} {two.child!r} <-> {two.parent!r}")
    path = cycle_path(e)
    if path:
        raise TaxonomyError(f"{what} through {' -> '.join(map(repr, path))}")
    return edges


def closure(edges: DataFrame) -> DataFrame:
    """(child, parent): every ancestor of every child, in distinct edges."""
    return ancestors(edges.select("child", "parent").distinct()).select(F.col("node").alias("child"), F.col("anc").alias("parent"))


def reduction(edges: DataFrame) -> DataFrame:
    """Edges whose parent is no ancestor of another parent of the child."""
    up = closure(edges).select(F.col("child").alias("node"), F.col("parent").alias("anc"))
    return reduced(edges.select("child", "parent").distinct(), cut(up, "closure"))


def load_v2(direct: DataFrame, blocked: DataFrame, aliases: DataFrame) -> DataFrame:
    """Runtime edges of schema 2: closure of the direct edges without the blocked ones.

    The direct edges must be acyclic, reduced and not blocked themselves.
    """
    a = cut(alias_closure(aliases), "aliases")
    d, b = (cut(canonical_edges(validated(e), a), "edges") for e in (direct, blocked))
    require_acyclic(d)
    if not d.exceptAll(reduction(d)).isEmpty():
        raise TaxonomyError("direct edges are not reduced")
    if not d.intersect(b).isEmpty():
        raise TaxonomyError("a direct edge is blocked")
    return closure(d).join(b, ["child", "parent"], "left_anti")


def load_v1(closed: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(direct, runtime edges) of schema 1, whose edges are closed and nothing is blocked."""
    e = require_acyclic(cut(canonical_edges(validated(closed), cut(alias_closure(aliases), "aliases")), "edges"))
    return reduction(e), closure(e)


def relation_counts(direct: DataFrame, runtime: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row: how many direct, runtime and blocked relations there are."""
    kinds = {"direct": direct, "runtime": runtime, "blocked": blocked}
    rows = reduce(DataFrame.union, (df.select(F.lit(k).alias("k")) for k, df in kinds.items()))
    return rows.agg(*(F.count_if(F.col("k") == k).alias(k) for k in kinds))


def no_rules(spark: SparkSession) -> dict:
    """The rule set without rules."""
    pairs = lambda a, b: spark.createDataFrame([], f"{a} string, {b} string")
    return {"schema_version": 2, "general_tag_count": 0, "aliases": pairs("src", "dst"), "direct": pairs("child", "parent"), "blocked": pairs("child", "parent"), "runtime": pairs("child", "parent")}


_LOADED: dict = {}


def load_rules(spark: SparkSession, path: str, strict: bool = False) -> dict:
    """A rule file: schema_version, general_tag_count, source, and the tables aliases, direct, blocked and runtime.

    Schema 2 holds direct and blocked relations and must not hold closed ones; schema 1 holds closed
    ones. What is wrong raises if ``strict``, else warns and gives the set without rules. Sets are kept
    by session, path and strictness for as long as the process runs.
    """
    key = (spark.sparkContext.applicationId, path, strict)
    if key not in _LOADED:
        try:
            _LOADED[key] = {**_rules(spark, path), "source": path}
        except Exception as e:  # whatever the file holds
            if strict:
                raise TaxonomyError(f"no rules from {path}: {e}") from e
            warnings.warn(f"no rules from {path}, going on without: {e}", RuntimeWarning, stacklevel=2)
            _LOADED[key] = {**no_rules(spark), "source": path}
    return _LOADED[key]


def _rules(spark: SparkSession, path: str) -> dict:
    raw = rules_json(spark, path)
    head = raw.select("schema_version", "general_tag_count", F.col("child_to_parents").isNotNull().alias("closed")).first()
    if head is None or head.schema_version not in (1, 2):
        raise TaxonomyError("schema_version must be 1 or 2")
    aliases = raw.select(F.explode("aliases").alias("src", "dst"))
    odd = aliases.filter("src IS NULL OR dst IS NULL OR trim(src) = '' OR trim(dst) = ''").first()
    if odd:
        raise TaxonomyError(f"not an alias: {odd.src!r} -> {odd.dst!r}")
    got = {"schema_version": head.schema_version, "general_tag_count": head.general_tag_count or 0, "aliases": cut(alias_closure(aliases), "aliases")}
    if head.schema_version == 1:
        direct, runtime = load_v1(edges_of(raw, "child_to_parents"), aliases)
        return {**got, "direct": cut(direct, "direct"), "blocked": no_rules(spark)["blocked"], "runtime": cut(runtime, "runtime")}
    if head.closed:
        raise TaxonomyError("schema 2 must hold direct relations only, not child_to_parents")
    parts = {k: edges_of(raw, f"{column}") for k, column in (("direct", "child_to_direct_parents"), ("blocked", "blocked_child_to_parents"))}
    runtime = cut(load_v2(parts["direct"], parts["blocked"], aliases), "runtime")
    named = {k: cut(canonical_edges(validated(e), got["aliases"]), k) for k, e in parts.items()}
    return {**got, **named, "runtime": runtime}


def without_parents(tags: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, ord, tag, score) without canonical duplicates (first position, highest score) and without parents of present tags."""
    t = tags.select("id", "ord", folded(F.col("tag")).alias("src"), "score").filter("src <> ''").join(aliases, "src", "left")
    t = t.groupBy("id", F.coalesce("dst", "src").alias("tag")).agg(F.min("ord").alias("ord"), F.max("score").alias("score"))
    gone = t.select("id", F.col("tag").alias("child")).join(edges, "child").select("id", F.col("parent").alias("tag")).distinct()
    return t.join(gone, ["id", "tag"], "left_anti").select("id", "ord", "tag", "score")


# The compiler


def vocabulary(rows: DataFrame) -> DataFrame:
    """(tag) of the general category of a vocabulary of (name, category)."""
    return rows.filter(F.trim(F.col("category").cast("string")) == "0").select(folded(F.col("name")).alias("tag")).filter("tag <> ''").distinct()


def active_relationships(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, ignored): (antecedent, consequent) of active rows, under either spelling of the keys, and one row (ignored)
    with the number of rows that are not active, lack an end or have equal ends."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in have))
    r = rows.select((F.lower(F.col("status")) == "active").alias("active"), folded(first("antecedent_name", "antecedent")).alias("antecedent"), folded(first("consequent_name", "consequent")).alias("consequent"))
    good = F.coalesce(F.col("active") & F.expr("antecedent <> '' AND consequent <> '' AND antecedent <> consequent"), F.lit(False))
    return r.filter(good).select("antecedent", "consequent").distinct(), r.agg(F.count_if(~good).alias("ignored"))


def structural_candidates(vocab: DataFrame) -> DataFrame:
    """(child, parent): every proper suffix of a tag, cut at underscores, that is a tag itself."""
    parts = F.split("tag", "_")
    n = F.size(parts)
    cut_ = vocab.filter(n > 1).select(F.col("tag").alias("child"), F.explode(F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), "_"))).alias("parent"))
    return cut_.filter("parent <> ''").distinct().join(vocab.select(F.col("tag").alias("parent")), "parent", "left_semi").select("child", "parent")


def implication_candidates(relations: DataFrame, vocab: DataFrame, aliases: DataFrame) -> DataFrame:
    e = canonical_edges(relations.select(F.col("antecedent").alias("child"), F.col("consequent").alias("parent")), aliases, strict=False)
    for side in ("child", "parent"):
        e = e.join(vocab.select(F.col("tag").alias(side)), side, "left_semi")
    return e.select("child", "parent")


def provenance(**sources: DataFrame) -> DataFrame:
    """(child, parent, sources): which candidate tables hold each pair."""
    rows = None
    for name, df in sorted(sources.items()):
        part = df.select("child", "parent", F.lit(name).alias("source"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("child", "parent").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def merged_aliases(active: DataFrame, manual: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, unknown): manual entries override active ones; both ends must be in the vocabulary, and unequal.

    ``unknown`` holds the pairs left out because of a name outside the vocabulary. An alias chain that returns to itself is an error.
    """
    both = active.select(folded(F.col("src")).alias("src"), folded(F.col("dst")).alias("dst"), F.lit(0).alias("p")).union(manual.select(folded(F.col("src")), folded(F.col("dst")), F.lit(1)))
    pick = cut(both.groupBy("src").agg(F.max_by("dst", F.struct("p", "dst")).alias("dst")), "aliases")
    known = pick
    for side in ("src", "dst"):
        known = known.join(vocab.select(F.col("tag").alias(side)), side, "left_semi")
    require_acyclic(known.filter("src <> dst").select(F.col("src").alias("child"), F.col("dst").alias("parent")), "alias cycle")
    return known.filter("src <> dst").select("src", "dst"), pick.join(known, ["src", "dst"], "left_anti")


def override_relations(pairs: DataFrame, aliases: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, unknown): (child, parent) pairs between canonical names; self-relations are dropped.

    ``unknown`` (tag) lists the names outside the vocabulary, whose relations are left out.
    """
    named = canonical_edges(pairs.select(folded(F.col("child")).alias("child"), folded(F.col("parent")).alias("parent")), aliases, strict=False)
    named = cut(named, "overrides")
    names = named.select(F.explode(F.array("child", "parent")).alias("tag")).distinct()
    unknown = cut(names.join(vocab.select("tag"), "tag", "left_anti"), "unknown")
    known = named
    for side in ("child", "parent"):
        known = known.join(unknown.select(F.col("tag").alias(side)), side, "left_anti")
    return known.select("child", "parent"), unknown


def compile_rules(additions: DataFrame, removals: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(direct, runtime, review): only additions reach the runtime; what is neither accepted nor removed is left for review."""
    clash = additions.select("child", "parent").intersect(removals.select("child", "parent")).first()
    if clash:
        raise TaxonomyError(f"both added and removed: {clash.child!r} -> {clash.parent!r}")
    require_acyclic(additions)
    direct = cut(reduction(additions), "direct")
    accepted = cut(closure(direct), "accepted")
    review = candidates.join(accepted, ["child", "parent"], "left_anti").join(removals, ["child", "parent"], "left_anti")
    return direct, accepted.join(removals, ["child", "parent"], "left_anti"), review


def _refuse(faults: dict[str, DataFrame]) -> None:
    """Raise the first fault, if any: each entry is a table (batch, detail) of what breaks the rule of that name."""
    rows = [df.select(F.lit(k).alias("k"), F.lit(what).alias("what"), F.col("batch").cast("string").alias("batch"), F.col("detail").cast("string").alias("detail")) for k, (what, df) in enumerate(faults.items())]
    bad = reduce(DataFrame.union, rows).orderBy("k", "batch", "detail").first()
    if bad:
        raise TaxonomyError(f"{bad.batch}: {bad.what} ({bad.detail})")


def _kind(relation_type: Column) -> Column:
    """The kind that a relation type is a name of; null for others."""
    return F.coalesce(*(F.when(relation_type.isin(*names), kind) for kind, names in V.RELATION_TYPES.items()))


def high_confidence(confidence: Column) -> Column:
    """"high" in any case, or a number of at least .90."""
    return F.coalesce((F.lower(confidence) == "high") | (confidence.try_cast("double") >= 0.9), F.lit(False))


def _pair(a: str, b: str) -> Column:
    return F.concat_ws(" -> ", a, b).alias("detail")


def merge_reviews(batches: DataFrame, vocab: DataFrame, removed: DataFrame, existing: DataFrame, model: str | None = None) -> dict[str, DataFrame]:
    """Merge review batches, rows as :func:`files.batches_json` reads them, over the sorted vocabulary (tag).

    A batch reviews the tags from place ``range_start`` to ``range_end``, both included. Every rule a batch breaks
    is an error: schema and model, the range, its tags and their number, ranges that overlap, children and aliases outside their batch,
    relations and aliases without high confidence, of unknown type, without parents, or to names that are no other tag.
    Relations removed by hand (``removed``) are blocked. Cycles are looked for among accepted and ``existing`` relations, and among aliases.

    Result: accepted and blocked (child, parent, evidence), aliases (alias, canonical, evidence), ambiguous (child, possible_parent, batch, rationale),
    gaps (tag, i) that no batch covers.
    """
    b = cut(batches, "batches")
    order = cut(numbered(vocab.select("tag").distinct(), ["tag"], "i"), "vocabulary")
    n = order.count()
    said = cut(b.select("batch", F.posexplode("reviewed_tags").alias("k", "tag"), (F.col("range_start") + F.col("k")).cast("long").alias("i")), "said")
    rel = cut(b.select("batch", F.explode("accepted").alias("e")).select("batch", "e.*").withColumn("kind", _kind(F.col("relation_type"))), "relations")
    ali = cut(b.select("batch", F.explode("aliases").alias("e")).select("batch", "e.*"), "aliases")
    unsure = b.select("batch", F.explode("ambiguous").alias("e")).select("batch", "e.*")
    pairs = cut(rel.select("batch", "child", F.explode("parents").alias("parent"), "kind", "rationale"), "pairs")
    fits = "range_start >= 0 AND range_end >= range_start AND range_end < " + str(n)
    length = "range_end - range_start + 1"
    children = rel.select("batch", F.col("child").alias("tag")).union(ali.select("batch", "alias")).union(unsure.select("batch", "child"))
    other = lambda df, a, c: df.join(order.select(F.col("tag").alias(c), F.lit(True).alias("known")), c, "left").filter(f"known IS NULL OR {a} = {c}")
    _refuse({
        "another schema": b.filter("schema_version IS DISTINCT FROM 1").select("batch", F.col("schema_version").alias("detail")),
        "another model": b.filter(F.lit(False) if model is None else ~F.col("model").eqNullSafe(F.lit(model))).select("batch", F.col("model").alias("detail")),
        "range outside the vocabulary": b.filter(f"NOT coalesce({fits}, false)").select("batch", F.concat_ws("..", "range_start", "range_end").alias("detail")),
        "reviewed_tags are not the vocabulary's slice": said.join(order.select("i", F.col("tag").alias("is")), "i", "left").filter("NOT coalesce(is = tag, false)").select("batch", F.col("tag").alias("detail"))
        .union(b.filter(f"NOT coalesce(size(reviewed_tags) = {length}, false)").select("batch", F.size("reviewed_tags").cast("string"))),
        "reviewed_tag_count is wrong": b.filter(f"NOT coalesce(reviewed_tag_count = {length}, false)").select("batch", F.col("reviewed_tag_count").alias("detail")),
        "ranges overlap": said.groupBy("i").agg(F.count("*").alias("n"), F.max("batch").alias("batch")).filter("n > 1").select("batch", F.col("i").alias("detail")),
        "a child is outside its batch": children.join(said.select("batch", "tag"), ["batch", "tag"], "left_anti").select("batch", F.col("tag").alias("detail")),
        "not of high confidence, or of an unknown type": rel.filter(~high_confidence(F.col("confidence")) | F.col("kind").isNull()).select("batch", F.col("child").alias("detail")),
        "no parents": rel.filter("parents IS NULL OR size(parents) = 0").select("batch", F.col("child").alias("detail")),
        "not a relation": other(pairs, "child", "parent").select("batch", _pair("child", "parent")),
        "not an alias of high confidence": other(ali, "alias", "canonical").select("batch", _pair("alias", "canonical")).union(ali.filter(~high_confidence(F.col("confidence"))).select("batch", _pair("alias", "canonical"))),
    })
    found = pairs.groupBy("child", "parent").agg(F.array_sort(F.collect_list(F.struct("batch", F.col("kind").alias("relation_type"), "rationale"))).alias("evidence"))
    found = cut(found.join(removed.select("child", "parent", F.lit(True).alias("gone")).distinct(), ["child", "parent"], "left"), "found")
    accepted, blocked = found.filter("gone IS NULL").drop("gone"), found.filter("gone").drop("gone")
    require_acyclic(existing.select("child", "parent").union(accepted.select("child", "parent")), "relation cycle")
    named = ali.groupBy("alias", "canonical").agg(F.array_sort(F.collect_list(F.struct("batch", "rationale"))).alias("evidence"))
    require_acyclic(named.select(F.col("alias").alias("child"), F.col("canonical").alias("parent")), "alias cycle")
    gaps = order.join(said.select("i"), "i", "left_anti").select("tag", "i")
    return {"accepted": accepted, "blocked": blocked, "aliases": named, "ambiguous": unsure.select("child", "possible_parent", "batch", "rationale"), "gaps": gaps}


def finalize_validations(reviews: DataFrame, validations: DataFrame, protected: DataFrame, existing: DataFrame, require_complete: bool = True, model: str | None = None) -> dict[str, DataFrame]:
    """Second pass over review and validation batches, rows as :func:`files.batches_json` reads them.

    Each validation names its review batch, which no other does, and decides every relation of it exactly once: accept, ambiguous or
    reject, in any case. ``require_complete``: every review batch must have one. Of a relation in several batches the last batch's decision
    holds. Promoted are the accepted pairs that are not ``protected`` removals; ``existing`` additions that were not accepted are discarded; the
    final relations are the transitive reduction of the promoted, the removals the protected and all pairs not accepted.

    Result: final, remove, promoted, blocked, discarded (child, parent), decisions (child, parent, batch, validation, decision, rationale), missing (batch).
    """
    r, v = cut(reviews.select("batch", "accepted"), "reviews"), cut(validations.withColumnRenamed("batch", "validation").withColumnRenamed("source_batch", "batch"), "validations")
    source = cut(r.select("batch", F.explode("accepted").alias("e")).select("batch", "e.child", F.explode("e.parents").alias("parent")), "source")
    own = cut(v.join(r.select("batch"), "batch", "left_semi"), "own")
    said = cut(own.select("batch", "validation", F.explode("decisions").alias("e")).select("batch", "validation", "e.child", "e.parent", F.lower("e.decision").alias("decision"), "e.rationale"), "decisions")
    keys = ["batch", "child", "parent"]
    twice = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select("batch", _pair("child", "parent"))
    asked = source.join(own.select("batch"), "batch", "left_semi")
    lacking = cut(r.select("batch").join(own.select("batch"), "batch", "left_anti"), "lacking")
    number = own.join(source.groupBy("batch").agg(F.count("*").alias("n")), "batch", "left")
    _refuse({
        "a validation names no batch": v.filter("coalesce(batch, '') = ''").select("batch", F.col("validation").alias("detail")),
        "two validations": v.groupBy("batch").agg(F.count("*").alias("n"), F.max("validation").alias("detail")).filter("n > 1").select("batch", "detail"),
        "a relation stands twice": twice(source),
        "another model": own.filter(F.lit(False) if model is None else ~F.col("model").eqNullSafe(F.lit(model))).select("batch", F.col("model").alias("detail")),
        "unknown decision": said.filter("NOT coalesce(decision IN ('accept', 'ambiguous', 'reject'), false)").select("batch", F.col("decision").alias("detail")),
        "a relation has two decisions": twice(said),
        "decisions and relations differ": said.join(asked, keys, "left_anti").union(asked.join(said, keys, "left_anti").select(*keys, *(F.lit(None) for _ in said.columns[3:]))).select("batch", _pair("child", "parent")),
        "reviewed_relation_count is wrong": number.filter("NOT coalesce(reviewed_relation_count = coalesce(n, 0), false)").select("batch", F.col("reviewed_relation_count").alias("detail")),
        "no validation": lacking.filter(F.lit(require_complete)).select("batch", F.col("batch").alias("detail")),
    })
    last = cut(said.groupBy("child", "parent").agg(F.max_by(F.struct("batch", "validation", "decision", "rationale"), "batch").alias("d")).select("child", "parent", "d.*"), "last")
    accepted = last.filter("decision = 'accept'").select("child", "parent")
    shield = protected.select("child", "parent").distinct()
    promoted = cut(accepted.join(shield, ["child", "parent"], "left_anti"), "promoted")
    require_acyclic(promoted)
    return {
        "final": reduction(promoted), "promoted": promoted, "blocked": accepted.join(shield, ["child", "parent"], "left_semi"), "decisions": last, "missing": lacking,
        "remove": shield.union(last.filter("decision <> 'accept'").select("child", "parent")).distinct(),
        "discarded": existing.select("child", "parent").distinct().join(accepted, ["child", "parent"], "left_anti"),
    }


def fingerprint(**tables: DataFrame) -> str:
    """SHA-256 over name, size and an order-free hash of the rows of every input."""
    parts = []
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *sorted(df.columns))).alias("y")).first()
        parts.append(f"{name}:{sorted(df.columns)}:{row.n}:{row.x}:{row.y}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def stamped(rules: dict, print_: str, previous: dict | None, now: str) -> dict:
    """``rules`` with fingerprint and generated_at, which stays as it was while the fingerprint does."""
    same = previous is not None and previous.get("fingerprint") == print_
    return {**rules, "fingerprint": print_, "generated_at": previous["generated_at"] if same and "generated_at" in previous else now}


def report(examples: int = 25, **tables: DataFrame) -> dict:
    """Of every table its number of rows and its first rows in the order of their columns."""
    return {name: {"count": df.count(), "examples": [list(r) for r in df.orderBy(*df.columns).limit(examples).collect()]} for name, df in sorted(tables.items())}
