"""Image folders: recursive scan, content hash, and dimensions from file headers alone."""

from __future__ import annotations

import hashlib
import os
import struct
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..operators.scan import is_image, path_key
from ..storage import cut
from .writers import local


def _png(b):
    if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR" and len(b) >= 24:
        return struct.unpack(">II", b[16:24])


def _bmp(b):
    if b[:2] == b"BM" and len(b) >= 26:
        if struct.unpack("<I", b[14:18])[0] == 12:
            return struct.unpack("<HH", b[18:22])
        w, h = struct.unpack("<ii", b[18:26])
        return w, abs(h)


def _jpeg(b):
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]


def _webp(b):
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP" or len(b) < 30:
        return None
    if b[12:16] == b"VP8 ":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if b[12:16] == b"VP8L":
        n = struct.unpack("<I", b[21:25])[0]
        return (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
    if b[12:16] == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")


def _tiff(b):
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if not order or struct.unpack(order + "H", b[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", b[4:8])[0]
    got = {}
    for k in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        tag, kind, _ = struct.unpack(order + "HHI", b[at + 2 + 12 * k : at + 10 + 12 * k])
        if tag in (256, 257):
            raw = b[at + 10 + 12 * k : at + 14 + 12 * k]
            got[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
    return (got[256], got[257]) if len(got) == 2 else None


def header_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from a PNG, JPEG, WebP, BMP or TIFF header; None if there is none or it is broken."""
    for parse in (_png, _jpeg, _webp, _bmp, _tiff):
        try:
            size = parse(content or b"")
        except (struct.error, IndexError, KeyError):
            size = None
        if size:
            return size if size[0] > 0 and size[1] > 0 else None
    return None


def _store(folder: str):
    """(file system, path) of a folder: a local path, or any URI that Arrow knows."""
    from pyarrow import fs

    if "://" not in folder or folder.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(local(folder))
    return fs.FileSystem.from_uri(folder)


def _entries(store, folder: str):
    """(path, is a folder) of what lies in a folder; links to folders are not followed, other things than files left out."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False) or e.is_file():
                    yield e.path, not e.is_file()
    else:
        for e in store.get_file_info(fs.FileSelector(folder)):
            if e.type in (fs.FileType.File, fs.FileType.Directory):
                yield e.path, e.type == fs.FileType.Directory


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every file under ``folder``, hidden names among them; the folder must exist.

    Spark's own listing leaves out names that begin with a dot or an underscore. Here the folders of one depth
    are listed by many tasks at once, then those of the next depth.
    """
    from pyarrow import fs

    store, root = _store(folder)
    if store.get_file_info(root).type != fs.FileType.Directory:
        raise NotADirectoryError(folder)

    def run(batches):
        store_ = _store(folder)[0]
        for p in batches:
            yield pd.DataFrame([e for d in p["path"] for e in _entries(store_, d)], columns=["path", "folder"])

    wide = spark.sparkContext.defaultParallelism
    level, found = spark.createDataFrame([(root,)], "path string"), []
    while True:
        here = cut(level.mapInPandas(run, "path string, folder boolean"), "listed")
        found.append(here.filter("NOT folder").select("path"))
        level = here.filter("folder").select("path").repartition(wide, "path")
        if level.isEmpty():
            return reduce(DataFrame.union, found)


def _content(store, path: str, block: int = 1 << 20) -> tuple[str, tuple[int, int] | None]:
    """(SHA-256, dimensions) of a file that is read in blocks; dimensions are looked for in the first block, then further on."""
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(path) as f:
        head = f.read(block)
        digest.update(head)
        size = len(head)
        while more := f.read(block):
            digest.update(more)
            size += len(more)
    sides = header_size(head)
    while sides is None and len(head) < size and any(parse_starts(head)):
        with store.open_input_stream(path) as f:
            head = f.read(8 * len(head))
        sides = header_size(head)
    return digest.hexdigest(), sides


def parse_starts(head: bytes):
    """Whether a file begins as the kinds do whose dimensions can stand far from its beginning."""
    return head[:2] == b"\xff\xd8", head[:4] in (b"II*\0", b"MM\0*")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, path, sha256, width, height): all files under ``folder`` with an image suffix, hidden names among them.

    Contents are read in blocks where the files are, hashed and looked through for their dimensions, which are null for files that cannot
    be read as an image. image_id is the place in component-wise path order. A folder without images gives no
    rows; a missing one is an error, and so is a file that cannot be opened.
    """
    paths = list_files(spark, folder).filter(is_image(F.col("path"))).repartition(4 * spark.sparkContext.defaultParallelism, "path")

    def run(batches):
        store = _store(folder)[0]
        for p in batches:
            got = [_content(store, path) for path in p["path"]]
            sides = pd.DataFrame([s or (None, None) for _, s in got], columns=["width", "height"], dtype="Int32")
            yield pd.DataFrame({"path": p["path"], "sha256": [h for h, _ in got]}).join(sides)

    found = paths.mapInPandas(run, "path string, sha256 string, width int, height int")
    return numbered(found, [path_key(F.col("path"))], "image_id").select("image_id", *found.columns)


def list_folder(spark: SparkSession, folder: str, output: str | None = None) -> DataFrame:
    """(path): images of a folder for direct mode, without content, sorted by their lower-cased path within it.

    Links are resolved; what then lies outside the folder, or under ``output`` (if that is another folder), is left out. A folder
    without images is an error.
    """
    store, root = _store(folder)
    paths = list_files(spark, folder).filter(is_image(F.col("path")))
    if type(store).__name__ == "LocalFileSystem":
        real = F.pandas_udf(lambda s: s.map(os.path.realpath), "string")
        paths, root = paths.select(real("path").alias("path")), os.path.realpath(root)
    start = F.lit(root.rstrip("/") + "/")
    paths = paths.filter(F.col("path").startswith(start))
    if output and os.path.realpath(local(output)) != root:
        paths = paths.filter(~F.col("path").startswith(F.lit(os.path.realpath(local(output)).rstrip("/") + "/")))
    paths = cut(paths, "folder")
    if paths.isEmpty():
        raise ValueError(f"{folder} holds no image")
    return paths.orderBy(F.lower(F.substr("path", F.length(start) + 1)), "path")


def direct_manifest(files: DataFrame) -> DataFrame:
    """The manifest of direct mode: every image passed, in no cluster."""
    return files.select(F.col("path").alias("source"), F.lit(-1).cast("long").alias("cluster_id"), F.lit("standalone").alias("candidate_role"), F.lit(0).alias("locate_attempt"), F.lit("passed").alias("status"))
