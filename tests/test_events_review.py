import json
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumisift.operators import review as R
from lumisift.plans import jobs as J
from lumisift.sources import writers as W
from lumisift.streaming import events as E

T = datetime(2025, 1, 1)
ROWS = [("a", 1, "scan", "running", "", 0.1, T, {"n": "1", "locate_flow": "x"}), ("a", 2, "embed", "running", "", 0.2, T, {"n": "2", "m": "5"}), ("b", 1, "scan", "failed", "", 1.0, T, None), ("a", 3, "done", "completed", "", 1.0, T, {"cluster_audit": "y"})]


def test_fold_and_replay(spark):
    e = spark.createDataFrame(ROWS + ROWS[:1], E.SCHEMA)
    assert {(r.job_id, r.key, r.value, r.id) for r in E.stats(e).collect()} == {("a", "n", "2", 2), ("a", "m", "5", 2)}
    assert {(r.job_id, r.id) for r in E.replay(e, 1).collect()} == {("a", 2), ("a", 3)} and E.replay(e, 0).count() == 4
    assert {(r.job_id, r.status, r.id) for r in E.state(e).collect()} == {("a", "completed", 3), ("b", "failed", 1)}
    assert (E.cursor(3, "7"), E.cursor(None, "x"), E.cursor(9, None)) == (9 - 2, 0, 9)
    assert E.stats(e.limit(0)).count() == 0
    n = E.numbered(e.drop("id").withColumn("message", F.col("stage")))
    assert sorted(r.id for r in n.filter("job_id = 'a'").collect()) == [1, 2, 3, 4]
    assert [round(spark.range(1).select(E.progress(s, F.lit(4), F.lit(10))).first()[0], 3) for s in ("embed", "locate", "tag", "caption")] == [0.26, 0.732, 0.406, 0.41]


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    q = None
    for k in range(0, len(ROWS), 2):
        spark.createDataFrame(ROWS[k : k + 2], E.SCHEMA).write.mode("append").parquet(folder)
        q = q or E.follow_stats(spark, folder, str(tmp_path / "folded"), str(tmp_path / "check"))
        q.processAllAvailable()
    q.stop()
    batch = spark.read.schema(E.SCHEMA).parquet(folder)
    assert {tuple(r) for r in E.read_stats(spark, str(tmp_path / "folded")).collect()} == {tuple(r) for r in E.stats(batch).collect()}
    q = E.follow_replay(spark, folder, 1, str(tmp_path / "out"), str(tmp_path / "check2"))
    q.processAllAvailable()
    q.stop()
    assert {(r.job_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("a", 3)}


def test_sources_are_kept_apart(spark):
    audit = lambda *m: json.dumps({"event": "clusters_ready", "clusters": [{"cluster_id": 0, "members": [{"image_id": i, "role": "medoid", "sim": 1.0, "source": p} for i, p in m]}]})
    rows = [("a", 1, "c", "", "", 0.5, T, {"cluster_audit": audit(("1", "/in/x"), ("2", None), (None, "/in/y"))}), ("a", 2, "c", "", "", 0.5, T, {"cluster_audit": audit(("1", "/in/z")), "n": "1"}), ("a", 3, "c", "", "", 0.5, T, {"cluster_audit": '{"event": "graph_filtered"}'}), ("b", 1, "c", "", "", 0.5, T, None)]
    e = spark.createDataFrame(rows, E.SCHEMA)
    assert [tuple(r) for r in E.audit_sources(e).collect()] == [("a", "1", "/in/z")]
    data = [r.data for r in E.shown(e).orderBy("job_id", "id").collect()]
    assert "/in" not in json.dumps(data) and json.loads(data[0]["cluster_audit"])["clusters"][0]["members"][0] == {"image_id": "1", "role": "medoid", "sim": 1.0}
    assert data[1]["n"] == "1" and data[2] == {"cluster_audit": '{"event": "graph_filtered"}'} and data[3] is None
    assert len(spark.range(1).select(E.top_tags(F.sequence(F.lit(1), F.lit(12)))).first()[0]) == 8


def test_review_log_and_views(spark):
    m = spark.createDataFrame([(0, "passed", "o/0", None, "medoid"), (1, "passed", "o/1", None, "backup_retry"), (2, "not_meet", None, "watermark_detected", "dropped")], "index long, status string, output string, reason string, candidate_role string")
    act = spark.createDataFrame([(1, 0, "remove", T), (2, 0, "restore", T), (3, 1, "remove", T), (4, 2, "remove", T)], "seq long, index long, action string, at timestamp")
    got = {r["index"]: r for r in R.apply_actions(m, act).collect()}
    assert [got[k].status for k in range(3)] == ["passed", "removed_by_review", "not_meet"] and got[1].review_original_output == "o/1" and got[1].output is None
    now = R.apply_actions(m, act)
    assert R.output_count(now).first()[0] == 1
    assert [r.l for r in now.orderBy("index").select(R.result_label(F.col("status"), F.col("candidate_role")).alias("l")).collect()] == ["pass", "removed", "dropped"]
    assert [r["index"] for r in R.gallery_page(m, 9, 1).collect()] == [1] and R.gallery_page(m.limit(0), 3).count() == 0
    text = spark.createDataFrame([("a, b\n\n ,c ", "x/y\\z.png")], "t string, p string")
    row = text.select(R.parse_denylist(F.col("t")), R.file_name(F.col("p")), R.view_boxes(F.array(F.array(F.lit(0.9), F.lit(-1.0), F.lit(0.1), F.lit(2.0))))).first()
    assert row[0] == ["a", "b", "c"] and row[1] == "z.png" and row[2] == [[0.1, 0.0, 0.9, 1.0]]
    counts = spark.createDataFrame([("d", "x", 1), ("d", "y", 7), ("e", "z", 0)], "dimension string, value string, n long")
    assert {r.value: r.percent for r in R.shares(counts).collect()} == {"x": 13, "y": 88, "z": 0}


def test_output_and_training_set(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    for n in ("a.png", "b.png", "sub/a.png"):
        (src / n).write_bytes(n.encode())
    m = spark.createDataFrame([(1, str(src / "a.png"), 0, "medoid", 1, "passed", None), (2, str(src / "b.png"), 1, "dropped", 1, "not_meet", "x"), (3, str(src / "sub/a.png"), 2, "medoid", 1, "passed", None)], "index long, source string, cluster_id long, candidate_role string, locate_attempt int, status string, reason string")
    out = W.write_output(m, "job", str(tmp_path / "out"))
    assert out["output_images"] == 2 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["00001_a.png", "00003_a.png", "manifest.json"]
    assert [i["status"] for i in json.loads((tmp_path / "out/manifest.json").read_text())["items"]] == ["passed", "not_meet", "passed"]
    chosen = spark.createDataFrame([(4, 2, str(src / "sub/a.png"), "two"), (3, 1, str(src / "a.png"), "one")], "manifest_index long, rank int, source string, caption string")
    W.write_training_set(chosen, {"at": T, "tags": {"b", "a"}}, str(tmp_path / "set"))
    assert sorted(p.name for p in (tmp_path / "set").iterdir()) == ["000004_a.png", "000004_a.txt", "a.png", "a.txt", "selection_report.json"]
    assert (tmp_path / "set/a.txt").read_text() == "one" and json.loads((tmp_path / "set/selection_report.json").read_text()) == {"at": T.isoformat(), "tags": ["a", "b"]}
    with pytest.raises(FileExistsError):
        W.write_training_set(chosen, {}, str(tmp_path / "set"))
    with pytest.raises(Exception):
        W.write_training_set(chosen.withColumn("source", F.lit("/nowhere/x.png")), {}, str(tmp_path / "none"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith((".none", "none"))]


def test_review_files(tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "1.png").write_text("x")
    items = [{"status": "passed", "output": str(folder / "1.png"), "reason": None}, {"status": "passed", "output": str(tmp_path / "else.png"), "reason": None}, {"status": "not_meet", "output": None, "reason": "x"}]
    review = W.Review(str(folder), items)
    got = review.remove(0, "monday")
    assert not (folder / "1.png").exists() and review.output_images == 1 and review.items[0] == got
    assert got == {"status": "removed_by_review", "output": None, "reason": "removed_by_review", "review_original_output": str(folder / "1.png"), "review_removed_path": str(review.hidden / "00000/1.png"), "review_removed_at": "monday"}
    assert json.loads((folder / "manifest.json").read_text())["items"][0] == got and Path(got["review_removed_path"]).read_text() == "x"
    (folder / "1.png").write_text("new")
    with pytest.raises(FileExistsError):
        review.restore(0)
    with pytest.raises(ValueError):
        review.remove(0)
    (folder / "1.png").unlink()
    again = W.Review(str(folder), items, review.log)  # the log alone tells the state
    assert again.items == review.items
    review.restore(0)
    assert (folder / "1.png").read_text() == "x" and review.items == items and not review.hidden.exists() and len(review.log) == 2
    for k, error in ((1, PermissionError), (2, ValueError), (3, IndexError), (-1, IndexError)):
        with pytest.raises(error):
            review.remove(k)

    def fail(_):
        raise OSError("disk")

    review.save = fail
    with pytest.raises(OSError):
        review.remove(0)
    assert (folder / "1.png").exists() and review.items == items and len(review.log) == 2
    review.locked = True
    with pytest.raises(ValueError):
        review.remove(0)


def test_json_values(tmp_path):
    import numpy as np

    W.write_json(tmp_path / "a" / "x.json", {"s": {3, 1}, "p": tmp_path, "t": T, "n": np.float32(0.5), "a": np.arange(2), "k": {1: (1, 2)}})
    assert json.loads((tmp_path / "a/x.json").read_text()) == {"s": [1, 3], "p": str(tmp_path), "t": T.isoformat(), "n": 0.5, "a": [0, 1], "k": {"1": [1, 2]}}
    with pytest.raises(TypeError):
        W.write_json(tmp_path / "a" / "y.json", object())
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"]


def test_requests():
    assert J.Stages(embedding=False, locate=False).effective() == J.Stages(embedding=False, clustering=False, graph=False, locate=False, retry=False)
    assert J.Stages(clustering=False).effective().graph
    for bad in (dict(source_dir=" "), dict(source_dir="x", similarity_model="other"), dict(source_dir="x", minimum_pixels=10), dict(source_dir="x", linkage=1.5)):
        with pytest.raises(ValueError):
            J.JobRequest(**bad)
    assert J.FinalizeRequest(" ab-1 ", 5, denylist=(" B", "a", "B", "")).denylist == ("a", "B")
    for bad in (dict(prefix="-x", target_size=1), dict(prefix="x", target_size=0), dict(prefix="x", target_size=1, caption_threshold=0.99), dict(prefix="x", target_size=1, targets={**J.TARGETS, "outdoors": {"true": 1.0}})):
        with pytest.raises(ValueError):
            J.FinalizeRequest(**bad)


def test_job_states():
    fail = {"tag": True, "end": True}

    def tag(job):
        if fail.pop("tag", False):
            raise RuntimeError("model")
        job.event("tag", "running", 0.5, n=1)

    def end(job, request):
        if fail.pop("end", False):
            raise RuntimeError("disk")
        return "set"

    done = threading.Event()
    jobs = J.Jobs(lambda job: done.wait(5) and "ok", tag, end)
    job = jobs.submit(J.JobRequest("x"))
    with pytest.raises(ValueError):
        jobs.curate(job)
    done.set()
    jobs.pool.submit(lambda: None).result()
    while job.status == "running":
        pass
    assert job.status == "completed" and jobs.newest_first() == [job] and len(job.job_id) == 12
    jobs.curate(job).result()
    assert (job.status, job.curation, job.error) == ("completed", "failed", "model")
    jobs.curate(job).result()
    assert job.status == "awaiting_selection"
    request = J.FinalizeRequest("p", 3)
    jobs.finalize(job, request).result()
    assert job.status == "awaiting_selection"
    jobs.finalize(job, request).result()
    assert (job.status, job.curation, job.result) == ("completed", "completed", "set") and [e["id"] for e in job.events] == [1, 2, 3]
    assert Path("x").name == "x"
