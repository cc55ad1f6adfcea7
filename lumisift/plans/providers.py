"""Providers: what computes embeddings, boxes and tags of images. Models plug in here; tests use tables.

A provider is a callable from a DataFrame with ``id`` and ``path`` to one with ``id`` and its results:
embedding (id, v array<double>), detector (id, boxes array<array<double>>), tagger (id, tags map<string,double>).
"""

from __future__ import annotations

import base64
import json
import os
import struct
import zlib
from collections.abc import Callable
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.inspection import boxes_of, candidate_path
from ..sources.writers import local


def from_table(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A provider that looks results up by id."""
    return lambda rows: rows.select("id").join(table, "id")


def from_model(load: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """``load()`` once per task gives ``f(ids, paths) -> list of result tuples``; rows go through in Arrow batches."""
    names = [p.split()[0] for p in schema.split(",")]

    def provider(rows: DataFrame) -> DataFrame:
        def run(batches):
            f = load()
            for p in batches:
                yield pd.DataFrame(f(p["id"].tolist(), p["path"].tolist()), columns=names)

        return rows.select("id", "path").mapInPandas(run, schema)

    return provider


def checked_embedding(v, dim: int = 1024) -> list[float]:
    """L2-normalized; another size, a number that is not finite or a norm near 0 is an error."""
    x = np.asarray(v, dtype=np.float32).reshape(-1)
    n = float(np.linalg.norm(x.astype(np.float64)))
    if x.size != dim or not np.isfinite(x).all() or n <= 1e-12:
        raise ValueError("not a usable embedding")
    return (x / max(n, 1e-12)).tolist()


def pixels_of(tensor, mean=None, std=None) -> np.ndarray:
    """A CHW or HWC float tensor as 8-bit HWC pixels.

    With ``mean`` and ``std`` of the channels the normalization is undone first; values up to 1.5 then count as 0..1.
    """
    x = np.asarray(tensor, dtype=np.float64)
    x = x[0] if x.ndim == 4 else x
    if x.ndim != 3 or not ({x.shape[0], x.shape[2]} & {1, 3, 4}):
        raise ValueError(f"not an image tensor: {x.shape}")
    if x.shape[0] in (1, 3, 4) and x.shape[2] not in (1, 3, 4):
        x = x.transpose(1, 2, 0)
    if mean is not None and std is not None:
        x = x * np.asarray(std, dtype=float) + np.asarray(mean, dtype=float)
    return np.clip(np.rint(x * 255 if x.max(initial=0) <= 1.5 else x), 0, 255).astype(np.uint8)


def png_bytes(pixels: np.ndarray) -> bytes:
    """8-bit HWC pixels of 1, 3 or 4 channels as a PNG file."""
    h, w, c = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), pixels.reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Quarter turns and mirroring (before the turns) that undo each EXIF orientation.
_UPRIGHT = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (3, False), 7: (3, True), 8: (1, False)}


def _scaled(x: np.ndarray, size: int) -> np.ndarray:
    """The first axis brought to ``size`` with triangle weights, as wide as the step where it shrinks."""
    n = len(x)
    step = n / size
    wide = max(step, 1.0)
    at = (np.arange(size) + 0.5) * step
    weight = np.maximum(1 - np.abs(np.arange(n)[None, :] + 0.5 - at[:, None]) / wide, 0)
    return np.tensordot(weight / weight.sum(1, keepdims=True), x, 1)


def prepared_pixels(pixels: np.ndarray, orientation: int = 1, side: int = 448) -> np.ndarray:
    """Decoded 8-bit HWC pixels as the embedding model takes them: upright, transparent parts over white, three channels, a square of ``side``."""
    turns, mirror = _UPRIGHT.get(orientation, (0, False))
    x = np.rot90(pixels[:, ::-1] if mirror else pixels, turns).astype(np.float64)
    c = x.shape[2]
    if c in (2, 4):
        alpha = x[:, :, -1:] / 255
        x = np.rint(x[:, :, :-1] * alpha + 255 * (1 - alpha))
    x = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x
    x = _scaled(_scaled(x, side).transpose(1, 0, 2), side).transpose(1, 0, 2)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def preview_size(width: int, height: int, side: int = 512) -> tuple[int, int]:
    """The size of a preview: within a square of ``side``, in proportion, never enlarged."""
    by = min(1.0, side / max(width, height, 1))
    return max(1, round(width * by)), max(1, round(height * by))


def preview_pixels(pixels: np.ndarray, side: int = 512) -> np.ndarray:
    """8-bit RGB pixels of a preview."""
    h, w, _ = pixels.shape
    width, height = preview_size(w, h, side)
    x = pixels[:, :, :3].astype(np.float64) if pixels.shape[2] >= 3 else np.repeat(pixels[:, :, :1].astype(np.float64), 3, axis=2)
    return np.clip(np.rint(_scaled(_scaled(x, height).transpose(1, 0, 2), width).transpose(1, 0, 2)), 0, 255).astype(np.uint8)


def data_url(content: bytes, path: str) -> str:
    """An image file as a data URL; the kind is that of its suffix, jpeg without one."""
    suffix = os.path.splitext(path)[1].lower().lstrip(".") or "jpeg"
    return f"data:image/{suffix};base64," + base64.b64encode(content).decode("ascii")


def http_detector(endpoint: str, model: str, prompt: str, timeout: float = 180.0, max_tokens: int = 1024) -> Callable[[DataFrame], DataFrame]:
    """A chat-completions detector: image as data URL, temperature 0. Any failure ends the job, its detail cut at 4000 characters.

    Rows are (id, path) with, where known, width, height and prepared_path, which is shown instead of path where there is one.
    """

    def load():
        def ask(ids, paths):
            out = []
            for i, path in zip(ids, paths):
                name = os.path.basename(path)
                with open(local(path), "rb") as f:
                    content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": data_url(f.read(), path)}}]
                body = {"model": model, "messages": [{"role": "user", "content": content}], "max_tokens": max_tokens, "temperature": 0}
                request = Request(endpoint, json.dumps(body).encode(), {"Content-Type": "application/json"})
                try:
                    with urlopen(request, timeout=timeout) as r:
                        out.append((i, r.read().decode()))
                except HTTPError as e:
                    detail = e.read().decode(errors="replace").strip()[:4000] or "<empty response body>"
                    raise RuntimeError(f"HTTP {e.code} for {name}: {detail}") from e
                except TimeoutError as e:
                    raise RuntimeError(f"no answer for {name} after {timeout} s") from e
                except (OSError, HTTPException) as e:
                    raise RuntimeError(f"request for {name} failed: {str(e)[:4000]}") from e
            return out

        return ask

    answers = from_model(load, "id long, payload string")

    def provider(rows: DataFrame) -> DataFrame:
        size = rows.select("id", *(F.col(c) if c in rows.columns else F.lit(None).cast("int").alias(c) for c in ("width", "height")))
        return answers(rows.withColumn("path", candidate_path(rows))).join(size, "id").select("id", boxes_of(F.col("payload"), F.col("width"), F.col("height")).alias("boxes"))

    return provider


def stored_tags(scored: DataFrame, floor: float = 0.10, category: str = "general") -> DataFrame:
    """(image_id, ord, tag, score) of a tagger's (id, tags map): scores of at least the floor, in (score descending, tag) order.

    A tagger may instead give a map of such maps by category (general, character ...), of which only ``category`` is kept.
    """
    if scored.schema["tags"].dataType.simpleString() == "map<string,map<string,double>>":
        scored = scored.select("id", F.col("tags")[category].alias("tags"))
    rows = scored.select("id", F.explode("tags").alias("tag", "score")).filter(F.col("score") >= floor)
    return rows.select(F.col("id").alias("image_id"), (F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "tag")) - 1).alias("ord"), "tag", "score")
