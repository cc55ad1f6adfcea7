"""What leaves the engine: image copies, captions, manifests and reports, always complete or not at all."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.review import file_name

#: How values that JSON does not know are written.
_FORMS = (((set, frozenset), lambda v: sorted(v, key=str)), (date, lambda v: v.isoformat()), (os.PathLike, os.fspath))


def json_value(value):
    """The encoder's hook: sets sorted, times in ISO form, paths as text, numpy values as their plain ones."""
    for kind, form in _FORMS:
        if isinstance(value, kind):
            return form(value)
    if callable(getattr(value, "tolist", None)):
        return value.tolist()
    raise TypeError(f"not JSON: {type(value)}")


def write_json(path: str | Path, value) -> None:
    """Written beside its place and moved there in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, default=json_value, ensure_ascii=False, indent=2)
        os.replace(part, path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def write_listing(rows: DataFrame, path: str | Path, key: str, head: dict) -> None:
    """One JSON object of ``head`` and, under ``key``, all rows in their order, one to a line.

    Spark writes the rows as texts; they come to the driver a partition at a time and go straight to the file.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("t"))
    fd, part = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            start = json.dumps(head, default=json_value, ensure_ascii=False)[:-1]
            f.write(start + (", " if head else "") + json.dumps(key) + ": [")
            for k, r in enumerate(text.toLocalIterator()):
                f.write((",\n" if k else "\n") + r.t)
            f.write("\n]}\n")
        os.replace(part, path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def inside(path: str | Path, root: str | Path) -> Path:
    """The resolved path, which must lie under ``root``."""
    p = Path(path).resolve()
    if not p.is_relative_to(Path(root).resolve()):
        raise PermissionError(f"{path} is outside {root}")
    return p


def output_names(manifest: DataFrame) -> DataFrame:
    """Adds ``name``: five-digit place in the whole manifest and the file's name; only of passed items."""
    return manifest.withColumn("name", F.when(F.col("status") == "passed", F.concat(F.format_string("%05d", F.col("index").cast("long")), F.lit("_"), file_name(F.col("source")))))


def copy_files(pairs: DataFrame) -> int:
    """Copy (source, target) on the executors, over folders they share; returns how many."""

    def run(batches):
        for p in batches:
            for a, b in zip(p.source, p.target):
                os.makedirs(os.path.dirname(b), exist_ok=True)
                shutil.copy2(local(a), b)
            yield p[["target"]]

    return pairs.select("source", "target").mapInPandas(run, "target string").count()


def write_output(manifest: DataFrame, job_id: str, folder: str) -> dict:
    """Copies of the passed images and manifest.json; ``manifest`` is (index, source, cluster_id, candidate_role, locate_attempt, status, reason)."""
    named = output_names(manifest).withColumn("output", F.when(F.col("name").isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), "name"))).drop("name")
    n = copy_files(named.filter("output IS NOT NULL").select("source", F.col("output").alias("target")))
    path = Path(folder) / "manifest.json"
    write_listing(named.orderBy("index").drop("index"), path, "items", {"job_id": job_id})
    return {"output_images": n, "output_dir": folder, "manifest_path": str(path)}


def training_names(chosen: DataFrame) -> DataFrame:
    """Adds ``training_image`` and ``caption_file``; of equal file names all but the first in rank take the six-digit manifest index before them."""
    name = file_name(F.col("source"))
    again = F.row_number().over(Window.partitionBy("_name").orderBy("rank")) > 1
    t = chosen.withColumn("_name", name).withColumn("training_image", F.when(again, F.concat(F.format_string("%06d", F.col("manifest_index").cast("long")), F.lit("_"), "_name")).otherwise(F.col("_name")))
    return t.withColumn("caption_file", F.concat(F.regexp_replace("training_image", r"\.[^.]*$", ""), F.lit(".txt"))).drop("_name")


def write_training_set(chosen: DataFrame, report: dict, folder: str) -> str:
    """Images, captions and selection_report.json of (manifest_index, rank, source, caption), built beside ``folder`` and
    renamed to it; an existing folder is an error, and a failure leaves nothing."""
    target = Path(folder)
    if target.exists():
        raise FileExistsError(folder)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}-"))
    try:
        named = training_names(chosen)
        root = F.lit(str(part) + "/")
        copy_files(named.select("source", F.concat(root, "training_image").alias("target")))

        def captions(batches):
            for p in batches:
                for f, text in zip(p.caption_file, p.caption):
                    (Path(part) / f).write_text(text or "", encoding="utf-8")
                yield p[["caption_file"]]

        named.select("caption_file", "caption").mapInPandas(captions, "caption_file string").count()
        write_json(part / "selection_report.json", report)
        os.chmod(part, 0o755)
        os.rename(part, target)
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise
    return str(target)


class Review:
    """Review of a finished output folder: an append-only log of actions on its items.

    ``base`` is the manifest as it was written; what holds now follows from the log alone. A file's place is a function of its item's state,
    so an action moves the files whose place differs before and after it, and a failure to save moves them back.
    """

    def __init__(self, folder: str, base: list[dict], log=(), save=None):
        self.folder, self.base, self.log, self.locked = Path(folder).resolve(), tuple(base), tuple(log), False
        self.hidden = self.folder.parent / f".{self.folder.name}_removed"
        self.save = save or (lambda items: write_json(self.folder / "manifest.json", {"items": items}))

    @property
    def items(self) -> list[dict]:
        return self._state(self.log)

    @property
    def output_images(self) -> int:
        return sum(i["status"] == "passed" and bool(i.get("output")) for i in self.items)

    def _state(self, log) -> list[dict]:
        last = {k: (action, at) for k, action, at in log}
        gone = lambda k, item: {
            **item, "output": None, "status": "removed_by_review", "reason": "removed_by_review",
            "review_original_output": item["output"], "review_removed_path": str(self._place(k, True)), "review_removed_at": last[k][1]}
        return [gone(k, item) if last.get(k, ("",))[0] == "remove" else dict(item) for k, item in enumerate(self.base)]

    def _place(self, k: int, removed: bool) -> Path:
        own = Path(self.base[k]["output"])
        return self.hidden / f"{k:05d}" / own.name if removed else own

    def _moved(self, k: int, action: str) -> None:
        """The file of item k to where ``action`` puts it."""
        here, there = (self._place(k, removed) for removed in ((action == "restore"), (action == "remove")))
        here, there = (inside(p, self.hidden if self.hidden in p.parents else self.folder) for p in (here, there))
        if not here.is_file():
            raise FileNotFoundError(here)
        if there.exists():
            raise FileExistsError(there)
        there.parent.mkdir(parents=True, exist_ok=True)
        shutil.move(here, there)
        for empty in (self.hidden / f"{k:05d}", self.hidden):
            if empty.is_dir() and not any(empty.iterdir()):
                empty.rmdir()

    def act(self, k: int, action: str, at: str = "") -> dict:
        """Append ``remove`` or ``restore`` of item k; it must be possible now, and holds only once it is saved."""
        back = {"remove": "restore", "restore": "remove"}[action]
        if self.locked:
            raise ValueError("review is closed")
        now = self.items[k] if 0 <= k < len(self.base) else None
        if now is None:
            raise IndexError(k)
        if now["status"] != {"remove": "passed", "restore": "removed_by_review"}[action] or not self.base[k].get("output"):
            raise ValueError(f"item {k} is {now['status']}")
        log = (*self.log, (k, action, at))
        self._moved(k, action)
        try:
            self.save(self._state(log))
        except BaseException:
            self._moved(k, back)
            raise
        self.log = log
        return self.items[k]

    def remove(self, k: int, at: str = "") -> dict:
        return self.act(k, "remove", at)

    def restore(self, k: int, at: str = "") -> dict:
        return self.act(k, "restore", at)
