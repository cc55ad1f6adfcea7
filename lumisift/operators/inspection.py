"""Detector results: box parsing, the accept rule, the seeded retry, and counters.

A detector is a provider: a function from rows (id, path, attempt) to rows (id, watermark_boxes, comic_boxes),
run with mapInPandas or, in tests, a lookup table.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .numbering import numbered

BOXES = "array<array<double>>"
_TOKEN = "<box>" + r"<(\d+)>" * 4 + "</box>"
_RESPONSE = "boxes array<array<double>>, choices array<struct<message:struct<content:string>>>, " + ", ".join(f"{k} array<struct<box:array<double>,bbox:array<double>>>" for k in ("results", "detections", "instances"))


def box_tokens(text: Column, width: Column, height: Column) -> Column:
    """Boxes of ``<box><x1><y1><x2><y2></box>`` tokens in 0..1000, in pixels where the size is known."""
    sides = [F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(i)), lambda x: x.cast("double")) for i in (1, 2, 3, 4)]
    known = (width > 0) & (height > 0)
    w, h = (F.when(known, c / 1000.0).otherwise(1.0) for c in (width, height))
    return F.transform(F.arrays_zip(*(s.alias(n) for s, n in zip(sides, "abcd"))), lambda b: F.array(b["a"] * w, b["b"] * h, b["c"] * w, b["d"] * h))


def boxes_of(payload: Column, width: Column, height: Column) -> Column:
    """Boxes of a detector's JSON answer: ``boxes``, else a chat message's tokens, else ``results``, ``detections``
    or ``instances``, else a bare list of lists. Anything else is an error."""
    p = F.from_json(payload, _RESPONSE)
    listed = lambda c: F.filter(F.transform(c, lambda x: F.coalesce(x["box"], x["bbox"])), lambda b: b.isNotNull())
    bare = F.when(F.ltrim(payload).startswith("[") & F.forall(F.coalesce(F.from_json(payload, BOXES), F.array().cast(BOXES)), lambda b: b.isNotNull()), F.from_json(payload, BOXES))
    return F.coalesce(bare, p["boxes"], box_tokens(F.get(p["choices"], F.lit(0))["message"]["content"], width, height), listed(p["results"]), listed(p["detections"]), listed(p["instances"]), F.raise_error(F.lit("no boxes in the detector's answer")).cast(BOXES))


def verdict(watermarks: Column, comics: Column) -> Column:
    """Null for a pass; a watermark box rejects, and so does more than one comic box."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.when(n(watermarks) > 0, "watermark_detected").when(n(comics) > 1, "comic_or_collage_detected")


def candidate_path(rows: DataFrame) -> Column:
    """The image that is looked at: the prepared one where there is one, else the file itself."""
    return F.coalesce(F.nullif(F.col("prepared_path"), F.lit("")), "path") if "prepared_path" in rows.columns else F.col("path")


def display_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes in 0..1: as they are if all are, else of 1000 if any lies beyond the image, else of its size; clamped.

    Boxes of fewer than four numbers are dropped, further numbers cut off.
    """
    four = F.transform(F.filter(boxes, lambda b: F.size(b) >= 4), lambda b: F.slice(b, 1, 4))

    def one(b):
        inside = F.forall(b, lambda v: (v >= 0) & (v <= 1))
        beyond = (F.greatest(F.get(b, F.lit(0)), F.get(b, F.lit(2))) > width) | (F.greatest(F.get(b, F.lit(1)), F.get(b, F.lit(3))) > height)
        by = lambda i, side: F.get(b, F.lit(i)) / F.when(inside, 1.0).when(beyond, 1000.0).otherwise(F.greatest(side, F.lit(1)).cast("double"))
        return F.transform(F.array(by(0, width), by(1, height), by(2, width), by(3, height)), lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))

    return F.transform(four, one)


def inspect(candidates: DataFrame, watermark, comic) -> DataFrame:
    """Two passes over (id, ...): the second detector only sees what the first one found clean."""
    first = candidates.join(watermark(candidates).select("id", F.col("boxes").alias("watermark_boxes")), "id", "left")
    clean = first.filter(F.coalesce(F.size("watermark_boxes"), F.lit(0)) == 0)
    both = first.join(comic(clean).select("id", F.col("boxes").alias("comic_boxes")), "id", "left")
    empty = F.array().cast(BOXES)
    both = both.withColumns({k: F.coalesce(k, empty) for k in ("watermark_boxes", "comic_boxes")})
    reason = verdict(F.col("watermark_boxes"), F.col("comic_boxes"))
    return both.withColumns({"reason": reason, "meets": reason.isNull()})


def retry_choices(failing: DataFrame, seed: int) -> DataFrame:
    """(cluster_id, choice): the position of the backup each failing cluster tries.

    The draws follow one seeded stream in cluster order, and only clusters with backups draw, so a run can be repeated. One task
    draws: the stream's length in numbers depends on the numbers themselves. What passes through it is a row of two
    numbers a failing cluster, in batches, and nothing comes to the driver.
    """

    def draw(batches):
        rng = random.Random(seed)
        for p in batches:
            yield pd.DataFrame({"cluster_id": p["cluster_id"], "choice": [rng.choice(range(b)) for b in p["backups"]]})

    ordered = failing.filter("backups > 0").select("cluster_id", "backups").coalesce(1).sortWithinPartitions("cluster_id")
    return cut(ordered.mapInPandas(draw, "cluster_id long, choice int"), "choices")


def locate(ranked: DataFrame, watermark, comic, seed: int, retry: bool = True) -> tuple[DataFrame, DataFrame]:
    """(manifest, counters) of ranked members (cluster_id, id, role, rank): the medoid, then once a random backup.

    manifest: (cluster_id, id, candidate_role, locate_attempt, status, reason).
    """
    clusters = ranked.groupBy("cluster_id").agg((F.count("*") - 1).cast("int").alias("backups"))
    one = inspect(ranked.filter("rank = 0").select("cluster_id", "id"), watermark, comic)
    failed = one.filter("NOT meets").select("cluster_id").join(clusters, "cluster_id")
    none = one.limit(0).select("cluster_id", "id", "meets", "reason")
    second = none
    if retry:
        chosen = retry_choices(failed, seed)
        tried = ranked.join(chosen, "cluster_id").filter(F.col("rank") == F.col("choice") + 1).select("cluster_id", "id")
        second = inspect(tried, watermark, comic).select("cluster_id", "id", "meets", "reason")
    s = second.select("cluster_id", F.col("id").alias("id2"), F.col("meets").alias("meets2"), F.col("reason").alias("reason2"))
    m = one.join(s, "cluster_id", "left")
    again = F.col("meets2").isNotNull()
    passed = F.col("meets") | F.coalesce("meets2", F.lit(False))
    manifest = m.select(
        "cluster_id", F.when(again, F.col("id2")).otherwise(F.col("id")).alias("id"), F.when(~passed, "dropped").when(again, "backup_retry").otherwise("medoid").alias("candidate_role"),
        F.when(again, 2).otherwise(1).alias("locate_attempt"), F.when(passed, "passed").otherwise("not_meet").alias("status"), F.when(~passed, F.coalesce("reason2", "reason")).alias("reason"), F.col("meets"), F.col("meets2"))
    counters = manifest.agg(
        F.count("*").alias("checked"), F.count_if("meets").alias("primary_pass"), F.count_if(F.col("meets2").isNotNull()).alias("retried"), F.count_if("meets2").alias("retry_pass"), F.count_if(F.col("status") == "not_meet").alias("dropped"))
    return manifest.drop("meets", "meets2"), counters


def bypass(ranked: DataFrame) -> DataFrame:
    """Inspection switched off: every medoid passes."""
    return ranked.filter("rank = 0").select("cluster_id", "id", F.lit("locate_bypassed").alias("candidate_role"), F.lit(0).alias("locate_attempt"), F.lit("passed").alias("status"), F.lit(None).cast("string").alias("reason"))


def manifest_index(manifest: DataFrame) -> DataFrame:
    """Adds the 1-based place in the full manifest, in cluster order."""
    return numbered(manifest, ["cluster_id"], "index", 1)
