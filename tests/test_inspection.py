import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumisift.functions import vocab as V
from lumisift.operators import inspection as I
from lumisift.plans.providers import checked_embedding, from_model, from_table, pixels_of, stored_tags


def boxes(spark, payload, w=1000, h=500):
    df = spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload), w, h)], "p string, w int, h int")
    return df.select(I.boxes_of(F.col("p"), F.col("w"), F.col("h"))).first()[0]


def test_answers_of_detectors(spark):
    chat = {"choices": [{"message": {"content": "a <box><10><20><300><400></box> b <box><1><2></box>"}}]}
    assert boxes(spark, chat) == [[10, 10, 300, 200]] and boxes(spark, chat, None, None) == [[10, 20, 300, 400]]
    assert boxes(spark, {"boxes": [[1, 2, 3, 4]], "results": [{"box": [9]}]}) == [[1, 2, 3, 4]]
    assert boxes(spark, {"detections": [{"bbox": [1, 2, 3, 4]}, {"score": 1}]}) == [[1, 2, 3, 4]] and boxes(spark, {"results": []}) == []
    assert boxes(spark, [[5, 6, 7, 8]]) == [[5, 6, 7, 8]] and boxes(spark, []) == []
    with pytest.raises(PySparkException):
        boxes(spark, {"message": "none"})


def test_display_boxes(spark):
    df = spark.createDataFrame([([[44.8, 89.6, 224.0, 448.0], [100.0, 200.0, 900.0, 1000.0], [0.1, 0.2, 0.3, 1.0], [1.0]], 448, 448)], "b array<array<double>>, w int, h int")
    got = df.select(I.display_boxes(F.col("b"), F.col("w"), F.col("h"))).first()[0]
    assert [[round(v, 9) for v in b] for b in got] == [[0.1, 0.2, 0.5, 1.0], [0.1, 0.2, 0.9, 1.0], [0.1, 0.2, 0.3, 1.0]]


def test_locate_with_a_seeded_retry(spark):
    ranked = spark.createDataFrame([(c, 10 * c + k, "medoid" if k == 0 else "member", k) for c in range(6) for k in range(1 + c % 4)], "cluster_id long, id long, role string, rank int")
    one = [[0.0, 0.0, 1.0, 1.0]]
    wm = from_table(spark.createDataFrame([(i, one) for i in (10, 20, 40, 21, 22)], "id long, boxes array<array<double>>"))
    comic = from_table(spark.createDataFrame([(30, one + one), (50, one), (11, one)], "id long, boxes array<array<double>>"))
    manifest, counters = I.locate(ranked, wm, comic, seed=4)
    rng = random.Random(4)
    draw = {c: rng.choice(range(n)) for c, n in ((1, 1), (2, 2), (3, 3))}  # cluster 4 has no backup and draws nothing
    got = {r.cluster_id: (r.id, r.candidate_role, r.locate_attempt, r.status, r.reason) for r in manifest.collect()}
    assert got[0] == (0, "medoid", 1, "passed", None) and got[5] == (50, "medoid", 1, "passed", None)
    assert got[1] == (11, "backup_retry", 2, "passed", None)
    assert got[2] == (21 + draw[2], "dropped", 2, "not_meet", "watermark_detected")
    assert got[3] == (31 + draw[3], "backup_retry", 2, "passed", None) and got[4] == (40, "dropped", 1, "not_meet", "watermark_detected")
    assert counters.first().asDict() == {"checked": 6, "primary_pass": 2, "retried": 3, "retry_pass": 2, "dropped": 2}
    off = I.locate(ranked, wm, comic, seed=4, retry=False)[1].first()
    assert (off.retried, off.dropped) == (0, 4)
    assert {r.candidate_role for r in I.bypass(ranked).collect()} == {"locate_bypassed"}


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    length = from_model(lambda: lambda ids, paths: [(i, len(p)) for i, p in zip(ids, paths)], "id long, n int")
    assert {(r.id, r.n) for r in length(rows).collect()} == {(1, 1), (2, 1)}
    assert abs(sum(x * x for x in checked_embedding([3.0] * 1024)) - 1) < 1e-5
    for bad in ([1.0] * 5, [0.0] * 1024, [float("nan")] * 1024):
        with pytest.raises(ValueError):
            checked_embedding(bad)
    assert pixels_of([[[0.0, 1.0]], [[0.5, 0.2]], [[1.0, 2.0]]]).shape == (1, 2, 3)
    tags = spark.createDataFrame([(1, {"b": 0.5, "a": 0.5, "c": 0.09})], "id long, tags map<string,double>")
    assert [(r.ord, r.tag) for r in stored_tags(tags).orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    assert V.WATERMARK_PROMPT.count("</c>") == 5 and V.COMIC_PROMPT.count("</c>") == 3
