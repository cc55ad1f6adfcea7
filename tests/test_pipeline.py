import os

import pytest

from lumisift.operators.tagrules import CaptionLimits
from lumisift.plans import pipeline
from lumisift.plans.jobs import Stages
from lumisift.plans.providers import from_table

IMAGES = [(1, "in/a.png", "h1", 1200, 1200), (2, "in/b.png", "h1", 1200, 1200), (3, "in/c.png", "h2", 100, 100), (4, "in/d.png", "h3", 1300, 900), (5, "in/e.png", "h4", None, None), (6, "in/f.png", "h5", 1000, 1000)]


def filtered(spark, stages, vectors=None, boxes=()):
    images = spark.createDataFrame(IMAGES, "image_id long, path string, sha256 string, width int, height int")
    v = vectors and spark.createDataFrame(vectors, "image_id long, embedding array<double>")
    look = from_table(spark.createDataFrame(list(boxes), "id long, boxes array<array<double>>"))
    none = from_table(spark.createDataFrame([], "id long, boxes array<array<double>>"))
    return pipeline.filter_images(images, v, look, none, pipeline.Settings(stages=stages, core_degree=1, graph_similarity=0.5))


def test_everything_switched_off(spark):
    got = filtered(spark, Stages(deduplicate=False, resolution_filter=False, embedding=False, locate=False))
    assert sorted(r.id for r in got["manifest"].collect()) == [1, 2, 3, 4, 6] and got["counters"] is None
    assert got["graph_audit"].first().asDict() == {"nodes": 5, "edges": 0, "nodes_with_edges": 0, "core_nodes": 5, "components": 1}
    assert got["accounts"].first().asDict() == {"kept_clusters": 5, "excluded_clusters": 0, "kept_images": 5, "excluded_images": 0}
    assert {r.candidate_role for r in got["manifest"].collect()} == {"locate_bypassed"}


def test_clusters_graph_retry_and_captions(spark):
    vectors = [(1, [1.0, 0.0]), (4, [0.99, 0.1]), (6, [0.8, 0.6])]
    got = filtered(spark, Stages(), vectors, [(1, [[0.0, 0.0, 1.0, 1.0]])])
    rows = {r.cluster_id: (r.id, r.candidate_role, r.status) for r in got["manifest"].collect()}
    assert rows == {0: (4, "backup_retry", "passed"), 1: (6, "medoid", "passed")} or rows == {0: (4, "medoid", "passed"), 1: (6, "medoid", "passed")}
    assert got["stats"].first().embedding_candidates == 3 and got["graph_audit"].first().core_nodes == 2
    tags = spark.createDataFrame([(4, 0, "1girl", 0.9), (4, 1, "smile", 0.8), (6, 0, "outdoors", 0.9), (1, 0, "gone", 0.9)], "image_id long, ord long, tag string, score double")
    empty = lambda a, b: spark.createDataFrame([], f"{a} string, {b} string")
    done = pipeline.curate(got["manifest"], tags, empty("src", "dst"), empty("child", "parent"), pipeline.Settings(target_size=5, limits=CaptionLimits()))
    assert {r.image_id: r.caption for r in done["captions"].collect()} == {4: "style, 1girl, solo, smile", 6: "style, outdoors"}
    assert sorted(r["rank"] for r in done["selection"].collect()) == [1, 2]


def test_a_passed_image_without_tags_goes_on_as_unknown(spark):
    manifest = spark.createDataFrame([(1, "passed"), (2, "passed"), (3, "watermark")], "id long, status string")
    tags = spark.createDataFrame([(1, 0, "1girl", 0.9), (3, 0, "smile", 0.9)], "image_id long, ord long, tag string, score double")
    empty = lambda a, b: spark.createDataFrame([], f"{a} string, {b} string")
    done = pipeline.curate(manifest, tags, empty("src", "dst"), empty("child", "parent"), pipeline.Settings(target_size=5))
    assert {r.image_id: (r.people, r.framing, r.outdoors) for r in done["features"].collect()} == {1: ("1", "unknown", None), 2: ("unknown", "unknown", None)}
    assert {r.image_id for r in done["selection"].collect()} == {1, 2}
    assert {r.image_id: r.caption for r in done["captions"].collect()} == {1: "style, 1girl, solo", 2: "style"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship_tags_the_images_it_curates(spark, monkeypatch):
    from lumisift.plans import flagship

    seen = {}
    monkeypatch.setattr(flagship.pipeline, "filter_images", lambda images, *_: {"manifest": images})
    monkeypatch.setattr(flagship.pipeline, "curate", lambda manifest, tags, *_: seen.update(images=manifest, tags=tags) or {"selection": manifest.selectExpr("image_id", "1 AS rank"), "captions": manifest.selectExpr("image_id", "'' AS caption")})
    flagship.curate(spark, "/root/testdata/sf0.001")
    ids = {r.image_id for r in seen["images"].collect()}
    assert ids and {r.image_id for r in seen["tags"].select("image_id").distinct().collect()} == ids
