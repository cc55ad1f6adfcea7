import json

import pytest

from lumisift.operators import taxonomy as X
from lumisift.sources import files


def edges(spark, rows, a="child", b="parent"):
    return spark.createDataFrame(list(rows), f"{a} string, {b} string")


def pairs(df):
    return {(r[0], r[1]) for r in df.collect()}


DIAMOND = [("leaf", "left"), ("leaf", "right"), ("left", "root"), ("right", "root")]


def test_diamond_with_a_block(spark):
    none = edges(spark, [], "src", "dst")
    run = X.load_v2(edges(spark, DIAMOND), edges(spark, [("leaf", "root")]), none)
    assert pairs(run) == set(DIAMOND)
    direct, closed = X.load_v1(edges(spark, DIAMOND + [("leaf", "root")]), none)
    assert pairs(direct) == set(DIAMOND) and pairs(closed) == set(DIAMOND) | {("leaf", "root")}
    with pytest.raises(X.TaxonomyError, match="not reduced"):
        X.load_v2(edges(spark, DIAMOND + [("leaf", "root")]), edges(spark, []), none)
    with pytest.raises(X.TaxonomyError, match="blocked"):
        X.load_v2(edges(spark, DIAMOND), edges(spark, [("leaf", "left")]), none)


def test_cycles_and_self_edges(spark):
    with pytest.raises(X.TaxonomyError, match="<->"):
        X.require_acyclic(edges(spark, [("a", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x")]))
    with pytest.raises(X.TaxonomyError, match="cycle through 'x' -> 'y' -> 'z' -> 'x'"):
        X.require_acyclic(edges(spark, [("x", "y"), ("y", "z"), ("z", "x")]))
    with pytest.raises(X.TaxonomyError, match="not an edge"):
        X.validated(edges(spark, [("a", " A ")]))
    with pytest.raises(X.TaxonomyError, match="alias cycle"):
        X.alias_closure(edges(spark, [("a", "b"), ("b", "a")], "src", "dst"))
    assert pairs(X.alias_closure(edges(spark, [("a", "b"), ("b", "c")], "src", "dst"))) == {("a", "c"), ("b", "c")}
    with pytest.raises(X.TaxonomyError, match="aliases join"):
        X.canonical_edges(edges(spark, [("a", "b")]), edges(spark, [("a", "b")], "src", "dst"))


def test_compiler_files_and_candidates(spark, tmp_path):
    (tmp_path / "tags.csv").write_text("﻿name,category\nplaid_skirt,0\nskirt, 0\nSkirt,0\nmiku,4\nlong_hair,0\nhair,0\n", encoding="utf-8")
    rows = files.vocabulary_csv(spark, str(tmp_path / "tags.csv"))
    vocab = X.vocabulary(rows).cache()
    assert {r.tag for r in vocab.collect()} == {"plaid_skirt", "skirt", "long_hair", "hair"}
    assert pairs(X.structural_candidates(vocab)) == {("plaid_skirt", "skirt"), ("long_hair", "hair")}
    (tmp_path / "rel.json").write_text('[{"antecedent_name":"","antecedent":"plaid_skirt","consequent_name":"skirt","status":"Active"},{"antecedent_name":"hair","consequent_name":"skirt","status":"deleted"},{"antecedent":"a","consequent":"a","status":"active"}]')
    active, ignored = X.active_relationships(files.relationships_json(spark, str(tmp_path / "rel.json")))
    assert ignored.first().ignored == 2
    (tmp_path / "one.json").write_text("{}")
    with pytest.raises(TypeError, match="array"):
        files.relationships_json(spark, str(tmp_path / "one.json"))
    assert pairs(active) == {("plaid_skirt", "skirt")}
    none = edges(spark, [], "src", "dst")
    implied = X.implication_candidates(active, vocab, none)
    got = {(r.child, r.parent): r.sources for r in X.provenance(structural=X.structural_candidates(vocab), implication=implied).collect()}
    assert got == {("plaid_skirt", "skirt"): ["implication", "structural"], ("long_hair", "hair"): ["structural"]}
    (tmp_path / "over.json").write_text('{"schema_version":1,"aliases":{"s":"skirt"},"add":{"plaid_skirt":"skirt"},"remove":{"long_hair":["hair"]}}')
    o = files.overrides_json(spark, str(tmp_path / "over.json"))
    direct, run, review = X.compile_rules(o["add"], o["remove"], X.structural_candidates(vocab))
    assert pairs(direct) == pairs(run) == {("plaid_skirt", "skirt")} and pairs(review) == set() and pairs(o["aliases"]) == {("s", "skirt")}
    with pytest.raises(X.TaxonomyError, match="both added and removed"):
        X.compile_rules(o["add"], o["add"], implied)


TAGS = ["apple", "fruit", "green_apple", "hat", "pear", "red_hat", "thing"]


def review(name, lo, hi, folder, **more):
    body = {"schema_version": 1, "model": "m", "range_start": lo, "range_end": hi, "reviewed_tags": TAGS[lo : hi + 1], "reviewed_tag_count": hi - lo + 1, "accepted": [], "aliases": [], "ambiguous": []}
    folder.mkdir(exist_ok=True)
    (folder / f"batch_{name}.json").write_text(json.dumps({**body, **more}))


def accepts(child, *parents, kind="strict_subtype", confidence="High"):
    return {"child": child, "parents": list(parents), "relation_type": kind, "confidence": confidence, "rationale": f"why {child}"}


def merged(spark, folder, removed=(), existing=()):
    vocab = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    return X.merge_reviews(files.batches_json(spark, str(folder)), vocab, edges(spark, removed), edges(spark, existing), "m")


def test_review_batches_are_merged(spark, tmp_path):
    review("0", 0, 2, tmp_path / "r", accepted=[accepts("apple", "fruit", "thing", kind="attribute_refinement"), accepts("green_apple", "apple", confidence=0.95)], aliases=[{"alias": "fruit", "canonical": "pear", "confidence": "high", "rationale": "r"}])
    review("1", 4, 5, tmp_path / "r", accepted=[accepts("red_hat", "hat", "thing", kind="strong_state_refinement")], ambiguous=[{"child": "pear", "possible_parent": "fruit", "rationale": "?"}])
    got = merged(spark, tmp_path / "r", removed=[("apple", "thing")], existing=[("hat", "thing")])
    evidence = {(r.child, r.parent): [tuple(e) for e in r.evidence] for r in got["accepted"].collect()}
    assert evidence == {("apple", "fruit"): [("batch_0.json", "specific_attribute", "why apple")], ("green_apple", "apple"): [("batch_0.json", "strict_subtype", "why green_apple")], ("red_hat", "hat"): [("batch_1.json", "strong_state", "why red_hat")], ("red_hat", "thing"): [("batch_1.json", "strong_state", "why red_hat")]}
    assert pairs(got["blocked"]) == {("apple", "thing")} and pairs(got["aliases"]) == {("fruit", "pear")}
    assert [tuple(r) for r in got["ambiguous"].collect()] == [("pear", "fruit", "batch_1.json", "?")]
    assert sorted(map(tuple, got["gaps"].collect())) == [("hat", 3), ("thing", 6)]


BAD_REVIEWS = [
    ("another schema", dict(schema_version=2)), ("another model", dict(model="other")), ("range outside", dict(range_end=7, reviewed_tags=TAGS, reviewed_tag_count=8)), ("range outside", dict(range_start=-1)), ("range outside", dict(range_start=None)),
    ("slice", dict(reviewed_tags=["apple", "fruit", "hat"])), ("slice", dict(reviewed_tags=["apple", "fruit"])), ("slice", dict(reviewed_tags=None)), ("reviewed_tag_count", dict(reviewed_tag_count=2)),
    ("outside its batch", dict(accepted=[accepts("hat", "thing")])), ("outside its batch", dict(ambiguous=[{"child": "pear"}])), ("outside its batch", dict(aliases=[{"alias": "hat", "canonical": "thing", "confidence": "high"}])),
    ("unknown type", dict(accepted=[accepts("apple", "fruit", kind="looks_like")])), ("high confidence", dict(accepted=[accepts("apple", "fruit", confidence=0.89)])), ("high confidence", dict(accepted=[accepts("apple", "fruit", confidence=None)])), ("no parents", dict(accepted=[accepts("apple")])),
    ("not a relation", dict(accepted=[accepts("apple", "banana")])), ("not a relation", dict(accepted=[accepts("apple", "apple")])), ("not an alias", dict(aliases=[{"alias": "apple", "canonical": "banana", "confidence": "high"}])), ("not an alias", dict(aliases=[{"alias": "apple", "canonical": "fruit", "confidence": "low"}])),
    ("relation cycle through 'apple' -> 'thing' -> 'hat' -> 'apple'", dict(accepted=[accepts("apple", "thing")])), ("alias cycle 'apple' <-> 'fruit'", dict(aliases=[{"alias": a, "canonical": b, "confidence": "high"} for a, b in (("apple", "fruit"), ("fruit", "apple"))])),
]


@pytest.mark.parametrize("message, change", BAD_REVIEWS, ids=[f"{k}-{m[:12]}" for k, (m, _) in enumerate(BAD_REVIEWS)])
def test_bad_reviews_are_refused(spark, tmp_path, message, change):
    review("0", 0, 2, tmp_path / "r", **change)
    with pytest.raises(X.TaxonomyError, match=message):
        merged(spark, tmp_path / "r", existing=[("thing", "hat"), ("hat", "apple")])


def test_overlaps_and_missing_batches_are_refused(spark, tmp_path):
    review("0", 0, 2, tmp_path / "r")
    review("1", 2, 3, tmp_path / "r")
    with pytest.raises(X.TaxonomyError, match="overlap"):
        merged(spark, tmp_path / "r")
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.batches_json(spark, str(tmp_path / "none"))


def validation(name, source, folder, decisions, **more):
    folder.mkdir(exist_ok=True)
    body = {"schema_version": 1, "model": "m", "source_batch": source, "reviewed_relation_count": len(decisions), "decisions": [{"child": c, "parent": p, "decision": d, "rationale": ""} for c, p, d in decisions]}
    (folder / f"batch_{name}.json").write_text(json.dumps({**body, **more}))


def finalized(spark, folder, protected=(), existing=(), complete=True):
    return X.finalize_validations(files.batches_json(spark, str(folder / "r")), files.batches_json(spark, str(folder / "v"), files.VALIDATION), edges(spark, protected), edges(spark, existing), complete, "m")


DECIDED = [("green_apple", "apple", "accept"), ("green_apple", "fruit", "Accept"), ("apple", "fruit", "accept")]


def reviewed(folder):
    review("0", 0, 2, folder / "r", accepted=[accepts("green_apple", "apple", "fruit"), accepts("apple", "fruit")])
    review("1", 3, 5, folder / "r", accepted=[accepts("red_hat", "hat")])


def test_validations_are_finalized(spark, tmp_path):
    reviewed(tmp_path)
    validation("a", "batch_0.json", tmp_path / "v", DECIDED)
    validation("b", "batch_1.json", tmp_path / "v", [("red_hat", "hat", "ambiguous")])
    validation("c", "batch_9.json", tmp_path / "v", [("x", "y", "accept")])  # of no review batch
    got = finalized(spark, tmp_path, existing=[("q", "r"), ("apple", "fruit"), ("red_hat", "hat")])
    assert pairs(got["final"]) == {("green_apple", "apple"), ("apple", "fruit")} and pairs(got["promoted"]) == {(c, p) for c, p, _ in DECIDED}
    assert pairs(got["remove"]) == {("red_hat", "hat")} and pairs(got["discarded"]) == {("q", "r"), ("red_hat", "hat")} and got["missing"].count() == 0
    got = finalized(spark, tmp_path, protected=[("apple", "fruit")])
    assert pairs(got["final"]) == {("green_apple", "apple"), ("green_apple", "fruit")} and pairs(got["remove"]) == {("red_hat", "hat"), ("apple", "fruit")} and pairs(got["blocked"]) == {("apple", "fruit")}
    (tmp_path / "v/batch_b.json").unlink()
    with pytest.raises(X.TaxonomyError, match="no validation"):
        finalized(spark, tmp_path)
    got = finalized(spark, tmp_path, complete=False)
    assert [r.batch for r in got["missing"].collect()] == ["batch_1.json"] and got["remove"].count() == 0


BAD_VALIDATIONS = [
    ("names no batch", DECIDED, dict(source_batch="")), ("another model", DECIDED, dict(model="x")), ("unknown decision", [*DECIDED[:2], ("apple", "fruit", "maybe")], {}), ("two decisions", [*DECIDED, DECIDED[0]], {}),
    ("differ", DECIDED[:2], {}), ("differ", [*DECIDED, ("hat", "thing", "reject")], {}), ("reviewed_relation_count", DECIDED, dict(reviewed_relation_count=2)), ("two validations", DECIDED, None),
]


@pytest.mark.parametrize("message, decisions, change", BAD_VALIDATIONS, ids=[str(k) for k in range(len(BAD_VALIDATIONS))])
def test_bad_validations_are_refused(spark, tmp_path, message, decisions, change):
    reviewed(tmp_path)
    validation("a", "batch_0.json", tmp_path / "v", decisions, **(change or {}))
    if change is None:
        validation("b", "batch_0.json", tmp_path / "v", decisions)
    with pytest.raises(X.TaxonomyError, match=message):
        finalized(spark, tmp_path, complete=False)


def test_rule_files(spark, tmp_path):
    def written(name, **body):
        (tmp_path / name).write_text(json.dumps(body))
        return str(tmp_path / name)

    two = {"schema_version": 2, "general_tag_count": 9, "aliases": {"foliage": "leaf"}, "child_to_direct_parents": {"foliage": ["left", "right"], "left": ["root"], "right": ["root"], "lone": []}, "blocked_child_to_parents": {"leaf": ["root"]}}
    got = X.load_rules(spark, written("two.json", **two), strict=True)
    assert pairs(got["direct"]) == pairs(got["runtime"]) == set(DIAMOND) and pairs(got["blocked"]) == {("leaf", "root")} and pairs(got["aliases"]) == {("foliage", "leaf")}
    assert X.relation_counts(got["direct"], got["runtime"], got["blocked"]).first().asDict() == {"direct": 4, "runtime": 4, "blocked": 1} and got["general_tag_count"] == 9
    assert X.load_rules(spark, str(tmp_path / "two.json"), strict=True) is got
    one = X.load_rules(spark, written("one.json", schema_version=1, child_to_parents={"leaf": ["left", "root"], "left": ["root"]}), strict=True)
    assert pairs(one["direct"]) == {("leaf", "left"), ("left", "root")} and pairs(one["runtime"]) == {("leaf", "left"), ("left", "root"), ("leaf", "root")}
    bad = {"closed": {**two, "child_to_parents": {}}, "version": {"schema_version": 3}, "kind": {**two, "aliases": ["x"]}, "unreduced": {**two, "aliases": {}, "child_to_direct_parents": {"a": ["b", "c"], "b": ["c"]}}, "blank": {**two, "child_to_direct_parents": {"a": [" "]}}, "alias": {**two, "aliases": {"a": ""}}}
    for name, body in bad.items():
        with pytest.raises(X.TaxonomyError):
            X.load_rules(spark, written(f"{name}.json", **body), strict=True)
    with pytest.warns(RuntimeWarning):
        assert X.load_rules(spark, str(tmp_path / "nowhere.json"))["runtime"].count() == 0


def test_aliases_and_overrides_of_unknown_names(spark):
    vocab = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    known, unknown = X.merged_aliases(edges(spark, [("apple", "pear"), ("hat", "cap"), ("pear", "pear")], "src", "dst"), edges(spark, [("Apple", "fruit")], "src", "dst"), vocab)
    assert pairs(known) == {("apple", "fruit")} and pairs(unknown) == {("hat", "cap")}
    rel, names = X.override_relations(edges(spark, [("apple", "thing"), ("fruit", "apple"), ("cap", "hat"), ("Red Hat", "hat")]), known, vocab)
    assert pairs(rel) == {("fruit", "thing"), ("red_hat", "hat")} and {r.tag for r in names.collect()} == {"cap"}
    with pytest.raises(X.TaxonomyError, match="alias cycle"):
        X.merged_aliases(edges(spark, [("apple", "pear"), ("pear", "apple")], "src", "dst"), edges(spark, [], "src", "dst"), vocab)


def test_newest_vocabulary(tmp_path):
    import os

    env = {"HF_HUB_CACHE": str(tmp_path / "a"), "HF_HOME": str(tmp_path)}
    roots = files.cache_roots(env)
    assert roots[:2] == [str(tmp_path / "a"), str(tmp_path / "hub")] and len(roots) == 3
    for k, d in enumerate(("a/m/snapshots/1", "hub/m/snapshots/2")):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "selected_tags.csv").write_text("name,category")
        os.utime(tmp_path / d / "selected_tags.csv", ns=(k, k))
    assert files.newest_vocabulary(roots[:2]) == str(tmp_path / "hub/m/snapshots/2/selected_tags.csv") and files.newest_vocabulary([str(tmp_path / "none")]) is None


def test_parent_cleanup_keeps_order_and_scores(spark):
    tags = spark.createDataFrame([(1, 0, "skirt", 0.9), (1, 1, "Plaid Skirt", 0.5), (1, 2, "plaid_skirt", 0.7), (1, 3, "hat", 0.4)], "id long, ord long, tag string, score double")
    got = X.without_parents(tags, edges(spark, [("plaid_skirt", "skirt")]), edges(spark, [], "src", "dst"))
    assert [(r.tag, r.ord, r.score) for r in got.orderBy("ord").collect()] == [("plaid_skirt", 1, 0.7), ("hat", 3, 0.4)]


def test_fingerprint_and_report(spark):
    a, b = edges(spark, [("x", "y"), ("p", "q")]), edges(spark, [("p", "q"), ("x", "y")])
    one = X.fingerprint(add=a)
    assert one == X.fingerprint(add=b) != X.fingerprint(add=edges(spark, [("x", "y")])) and one != X.fingerprint(remove=a)
    old = X.stamped({"v": 1}, one, None, "monday")
    assert X.stamped({"v": 1}, one, old, "tuesday")["generated_at"] == "monday" and X.stamped({}, "other", old, "tuesday")["generated_at"] == "tuesday"
    assert X.report(examples=1, add=a) == {"add": {"count": 2, "examples": [["p", "q"]]}}
