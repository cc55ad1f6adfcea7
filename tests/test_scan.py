import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumisift.operators import scan
from lumisift.sources import images


def png(w, h):
    head = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\x00" + bytes(9) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + bytes(10)


HEADERS = {
    "png": png(1200, 800),
    "jpeg": jpeg(640, 480),
    "bmp": b"BM" + bytes(12) + struct.pack("<Iii", 40, 33, -44) + bytes(8),
    "webp": b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (199).to_bytes(3, "little") + bytes(4),
    "tiff": b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 70) + struct.pack("<HHIHH", 257, 3, 1, 80, 0),
}


@pytest.mark.parametrize("kind, size", [("png", (1200, 800)), ("jpeg", (640, 480)), ("bmp", (33, 44)), ("webp", (100, 200)), ("tiff", (70, 80))])
def test_headers(kind, size):
    assert images.header_size(HEADERS[kind]) == size
    assert images.header_size(HEADERS[kind][:9]) is None


def test_broken_headers():
    for b in (None, b"", b"not an image", b"\xff\xd8\xff", b"II*\0\xff\xff\xff\xff", png(0, 5)):
        assert images.header_size(b) is None


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    files = {"a.PNG": png(1200, 1200), "b/copy.png": png(1200, 1200), "small.png": png(100, 100), "small2.png": png(100, 100), "bad.jpg": b"x", "worse.jpg": b"x", "note.txt": b"hello", "b.webp": HEADERS["webp"]}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = images.read_images(spark, str(tmp_path))
    names = [r.path.rsplit("/", 1)[1] for r in found.orderBy("image_id").collect()]
    assert names == ["a.PNG", "copy.png", "b.webp", "bad.jpg", "small.png", "small2.png", "worse.jpg"]
    stats = scan.scan_stats(found, 1_000_000).first()
    # two copies of an unreadable file are two invalid ones; the copy of a rejected image is a duplicate
    assert (stats.scanned_images, stats.invalid_images, stats.duplicate_images, stats.unique_images, stats.below_resolution, stats.embedding_candidates) == (7, 2, 2, 3, 2, 1)
    off = scan.scan_stats(found, 1_000_000, deduplicate=False).first()
    assert (off.duplicate_images, off.embedding_candidates) == (0, 2)
    assert {r.path: (r.width, r.height) for r in found.collect() if r.path.endswith("webp")} == {str(tmp_path / "b.webp"): (100, 200)}
    listed = [r.path.rsplit("/", 1)[1] for r in images.list_folder(spark, str(tmp_path), str(tmp_path / "b")).collect()]
    assert listed == ["a.PNG", "b.webp", "bad.jpg", "small.png", "small2.png", "worse.jpg"]
    assert {r.status for r in images.direct_manifest(found.select("path")).collect()} == {"passed"}


def test_boundary_and_label(spark):
    rows = spark.createDataFrame([(1, "a", "h1", 1280, 720), (2, "b", "h2", 1279, 720), (3, "c", "h3", None, 720)], "image_id long, path string, sha256 string, width int, height int")
    assert [r.image_id for r in scan.large_enough(rows, 1280 * 720).collect()] == [1]
    labels = {r.image_id: r.l for r in rows.select("image_id", scan.resolution_label(F.col("width").cast("long") * F.col("height")).alias("l")).collect()}
    assert labels == {1: "720p", 2: "0.92088MP", 3: None}


def test_empty_table(spark):
    rows = spark.createDataFrame([], "image_id long, path string, sha256 string, width int, height int")
    assert scan.scan_stats(rows, 10).first().scanned_images == 0


def test_hidden_names_and_links_are_listed(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "elsewhere"
    for d in (root / "_dir", root / ".deep" / "er", out, root / "set"):
        d.mkdir(parents=True)
    for name in ("b.png", "_a.png", "_dir/c.png", ".deep/er/d.PNG", ".png", "set/e.png"):
        (root / name).write_bytes(png(10, 10))
    (out / "far.png").write_bytes(png(1, 1))
    (root / "link.png").symlink_to(out / "far.png")
    (root / "loop").symlink_to(root, target_is_directory=True)
    found = [r.path[len(str(root)) + 1 :] for r in images.read_images(spark, str(root)).orderBy("image_id").collect()]
    assert found == [".deep/er/d.PNG", "_a.png", "_dir/c.png", "b.png", "link.png", "set/e.png"]
    assert images.read_images(spark, "file://" + str(root)).count() == 6
    direct = [r.path[len(str(root)) + 1 :] for r in images.list_folder(spark, str(root), str(root / "set")).collect()]
    assert direct == [".deep/er/d.PNG", "_a.png", "_dir/c.png", "b.png"]  # the link leads out of the folder
    assert images.list_folder(spark, str(root), str(root)).count() == 5
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no image"):
        images.list_folder(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        images.read_images(spark, str(root / "b.png"))
    assert images.read_images(spark, str(tmp_path / "none")).count() == 0


def test_a_header_far_from_the_beginning(spark, tmp_path):
    long = b"\xff\xd8" + b"".join(b"\xff\xe1\xff\xff" + bytes(65533) for _ in range(40)) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + bytes(10)
    (tmp_path / "long.jpg").write_bytes(long)
    r = images.read_images(spark, str(tmp_path)).first()
    assert (r.width, r.height, r.sha256) == (40, 30, hashlib.sha256(long).hexdigest()) and len(long) > 2 << 20


def test_hot_content(spark):
    rows = [(k, f"d{k % 7}/{k:04d}.png", "same" if k % 3 else f"h{k}", None if k == 10 else 100, 100) for k in range(300)]
    t = spark.createDataFrame(rows, "image_id long, path string, sha256 string, width int, height int")
    by_window = scan.first_copies(t).filter("copy = 1").drop("copy")
    assert sorted(map(tuple, by_window.collect())) == sorted(map(tuple, scan.deduplicated(t).select(t.columns).collect()))
    got = scan.scan_stats(t, 10).first().asDict()
    assert got == {"scanned_images": 300, "invalid_images": 1, "duplicate_images": 198, "unique_images": 101, "below_resolution": 0, "embedding_candidates": 101}
