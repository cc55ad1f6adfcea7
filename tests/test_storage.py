import threading

from lumisift import storage


def test_settings_come_back_after_overlapping_statements(spark):
    key = storage._FREE_SHUFFLES[0]
    before = spark.conf.get(key, None)
    inside, leave = threading.Event(), threading.Event()

    def hold():
        with storage.freed_shuffles(spark):
            inside.set()
            leave.wait(20)

    t = threading.Thread(target=hold)
    t.start()
    inside.wait(20)
    with storage.freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == "true"  # the other statement is still inside
    leave.set()
    t.join()
    assert spark.conf.get(key, None) == before


def test_cut_and_discard(spark, tmp_path):
    import os

    t = storage.cut(spark.range(5), "some")
    path = t.cut_path[len("file://") :]
    assert sorted(r.id for r in t.collect()) == [0, 1, 2, 3, 4] and os.path.isdir(path) and storage.shared_dir(spark) in t.cut_path
    storage.discard(t)
    storage.discard(spark.range(1))
    assert not os.path.exists(path)
