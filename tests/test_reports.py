import json

import numpy as np
import pytest

from lumisift.operators import taxonomy
from lumisift.operators.tagrules import CaptionLimits
from lumisift.plans import jobs, providers, reports

MANIFEST = "index long, source string, output string, status string"
TAGS = "image_id long, ord int, tag string, score double"


def some(spark, tmp_path):
    (tmp_path / "out" / "sub").mkdir(parents=True)
    for n in ("a.png", "sub/b.png"):
        (tmp_path / "out" / n).write_text(n)
    manifest = spark.createDataFrame([(1, "s1", str(tmp_path / "out/a.png"), "passed"), (3, "s3", str(tmp_path / "out/sub/b.png"), "passed"), (2, "s2", None, "not_meet"), (4, "s4", "", "passed")], MANIFEST)
    tags = spark.createDataFrame([(1, 1, "outdoors", 0.7), (1, 0, "1girl", 0.9), (1, 2, "smile", 0.7), (2, 0, "1boy", 0.9)], TAGS)
    return manifest, tags


def test_tag_metadata(spark, tmp_path):
    manifest, tags = some(spark, tmp_path)
    items = reports.tagged_items(manifest, tags, str(tmp_path / "out"))
    chosen = spark.createDataFrame([(3, 1)], "image_id long, rank int")
    reports.write_tag_metadata(items, str(tmp_path / "tags.json"), {"job_id": "j", "storage_threshold": 0.1}, chosen)
    got = json.loads((tmp_path / "tags.json").read_text())
    assert (got["job_id"], got["storage_threshold"]) == ("j", 0.1)
    one, two = got["items"]
    assert (one["image_id"], one["path"], one["manifest_index"]) == ("000001", "a.png", 1) and list(one["general_tags"].items()) == [("1girl", 0.9), ("outdoors", 0.7), ("smile", 0.7)]
    assert one["selection_features"]["people_count"] == {"value": "1", "source_tag": "1girl", "confidence": 0.9, "status": "high"} and one["selection_features"]["outdoors"]["value"] is True
    assert (two["path"], two["general_tags"], two["selection"]) == ("sub/b.png", {}, {"selected": True, "rank": 1}) and one["selection"] == {"selected": False, "rank": None}
    assert two["selection_features"]["framing"]["value"] == "unknown"
    reports.write_tag_metadata(items.limit(0), str(tmp_path / "none.json"), {})
    assert json.loads((tmp_path / "none.json").read_text().replace("{", "{", 1)) == {"items": []}


def test_inputs_must_lie_in_the_folder(spark, tmp_path):
    manifest, tags = some(spark, tmp_path)
    with pytest.raises(Exception, match="outside"):
        reports.tagged_items(manifest, tags, str(tmp_path / "out/sub"))
    (tmp_path / "out/a.png").unlink()
    with pytest.raises(Exception, match="FileNotFound"):
        reports.tagged_items(manifest, tags, str(tmp_path / "out"))


def test_selection_report(spark, tmp_path):
    from lumisift.operators import features

    tags = spark.createDataFrame([(i, 0, t, 0.9) for i, ts in {1: ["1girl", "full_body"], 2: ["2girls", "outdoors"], 3: ["smile"]}.items() for t in ts], TAGS)
    f = features.derive(tags)
    request = jobs.FinalizeRequest("style", 5, denylist=("zz", "Aa"))
    (tmp_path / "rules.json").write_text(json.dumps({"schema_version": 2, "general_tag_count": 3, "aliases": {}, "child_to_direct_parents": {"a": ["b"], "b": ["c"]}, "blocked_child_to_parents": {"a": ["c"]}}))
    rules = taxonomy.load_rules(spark, str(tmp_path / "rules.json"), strict=True)
    got = reports.selection_report(f, spark.createDataFrame([(1,), (2,)], "image_id long"), request, "job", CaptionLimits(remove_text=True), rules)
    assert (got["target_size"], got["selected_size"]) == (5, 2) and got["targets"]["people_count"] == {"1": 0.85, "2": 0.12, "3_plus": 0.03}
    assert got["distribution"] == {"people_count": {"1": 1, "2": 1, "3_plus": 0, "unknown": 0}, "framing": {"full_body": 1, "half_body": 0, "headshot": 0, "unknown": 1}, "outdoors": {"true": 1, "false": 0, "unknown": 1}, "total": 2}
    assert got["denylist"] == ["Aa", "zz"] and {"zz", "text", "watermark"} <= set(got["effective_denylist"]) and "text" not in got["default_denylist"]
    assert got["caption_policy"]["parent_rules"] == {"source": str(tmp_path / "rules.json"), "general_tag_count": 3, "direct_relation_count": 2, "blocked_relation_count": 1, "relation_count": 2, "strict_loading": False}
    none = reports.selection_report(f, spark.createDataFrame([], "image_id long"), request, "job", CaptionLimits())
    assert none["selected_size"] == 0 and none["caption_policy"]["parent_rules"]["relation_count"] == 0 and none["caption_policy"]["stages"][0] == "threshold"


def test_prepared_images():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    same = providers.prepared_pixels(np.kron(x, np.ones((2, 2, 1), dtype=np.uint8)), side=448)
    assert same.shape == (448, 448, 3) and abs(int(same[0, 0, 0]) - int(x[0, 0, 0])) <= 1
    assert (providers.prepared_pixels(np.full((7, 9, 1), 50, dtype=np.uint8), side=4) == 50).all()
    clear = np.zeros((4, 4, 4), dtype=np.uint8)
    assert (providers.prepared_pixels(clear, side=4) == 255).all()
    clear[..., 3] = 128
    assert (providers.prepared_pixels(clear, side=4) == 127).all()
    mark = np.zeros((4, 4, 1), dtype=np.uint8)
    mark[0, :2, 0] = 200, 90  # two marks at the upper left tell all eight orientations apart
    seen = {o: providers.prepared_pixels(mark, o, 4)[..., 0] for o in range(1, 9)}
    turned = {1: mark, 2: mark[:, ::-1], 3: mark[::-1, ::-1], 4: mark[::-1], 5: mark.transpose(1, 0, 2), 6: np.rot90(mark, 3), 7: mark[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(mark)}
    assert all((seen[o] == turned[o][..., 0]).all() for o in seen)
    assert providers.preview_size(1024, 256) == (512, 128) and providers.preview_size(10, 4000) == (1, 512) and providers.preview_size(30, 20) == (30, 20)
    assert providers.preview_pixels(np.full((600, 300, 4), 9, dtype=np.uint8)).shape == (512, 256, 3)


def test_tensors_and_png():
    t = np.zeros((3, 2, 2))
    t[0] = 1.0
    assert (providers.pixels_of(t)[..., 0] == 255).all()
    assert (providers.pixels_of(np.full((3, 2, 2), 1.0), mean=[0.5, 0.25, 0], std=[0.5, 0.5, 0.5]) == [255, 191, 128]).all()
    with pytest.raises(ValueError):
        providers.pixels_of(np.zeros((2, 5, 7)))
    from lumisift.sources.images import header_size

    assert header_size(providers.png_bytes(np.zeros((3, 5, 3), dtype=np.uint8))) == (5, 3)
    assert providers.data_url(b"x", "a/b.PNG").startswith("data:image/png;base64,") and providers.data_url(b"x", "a/b").startswith("data:image/jpeg")


def test_detector_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            bad = b"YmFk" in body["messages"][0]["content"][1]["image_url"]["url"].encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"x" * 9000 if bad else json.dumps({"boxes": [[1, 2, 3, 4]]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for n in ("a.jpg", "prep.png", "bad.png"):
        (tmp_path / n).write_bytes(n[:3].encode())
    rows = spark.createDataFrame([(1, f"file://{tmp_path}/a.jpg", None), (2, str(tmp_path / "a.jpg"), str(tmp_path / "prep.png"))], "id long, path string, prepared_path string")
    look = providers.http_detector(f"http://127.0.0.1:{server.server_port}", "m", "find", timeout=20)
    assert {r.id: r.boxes for r in look(rows).collect()} == {1: [[1.0, 2.0, 3.0, 4.0]], 2: [[1.0, 2.0, 3.0, 4.0]]}
    assert sorted(b["messages"][0]["content"][1]["image_url"]["url"][:15] for b in asked) == ["data:image/jpg;", "data:image/png;"] and asked[0]["temperature"] == 0
    with pytest.raises(Exception, match="HTTP 500 for bad.png: x{4000}"):
        look(spark.createDataFrame([(1, str(tmp_path / "bad.png"))], "id long, path string")).collect()
    server.shutdown()


def test_tagger_categories(spark):
    both = spark.createDataFrame([(1, {"general": {"a": 0.5, "b": 0.05, "c": 0.5}, "character": {"miku": 0.9}})], "id long, tags map<string,map<string,double>>")
    assert [(r.ord, r.tag) for r in providers.stored_tags(both).orderBy("ord").collect()] == [(0, "a"), (1, "c")]
    flat = spark.createDataFrame([(1, {"a": 0.1, "b": 0.099})], "id long, tags map<string,double>")
    assert [r.tag for r in providers.stored_tags(flat).collect()] == ["a"]
