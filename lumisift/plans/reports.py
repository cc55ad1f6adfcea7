"""What is written about a run: tag metadata of the tagged images, and the report of a selection."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import features as fea
from ..operators import review, taxonomy
from ..operators.tagrules import CaptionLimits
from ..sources.writers import local, write_listing
from ..storage import cut
from .jobs import FinalizeRequest


def tagged_items(manifest: DataFrame, tags: DataFrame, root: str, workflow: str = "filtering") -> DataFrame:
    """(image_id, path, manifest_index, selection_features, general_tags): the passed items of a manifest (index, source, output, status) with their tags.

    ``tags`` is (image_id, ord, tag, score), image_id being the manifest index. Paths are given within ``root``; an image
    outside it, or one that is no file, is an error. Tags keep their stored order; an item without tags has an empty map and unknown features.
    """
    path = F.col("source" if workflow == "direct" else "output")
    items = review.passed_items(manifest, workflow).select(F.col("index").alias("manifest_index"), path.alias("file"))
    items = cut(items.mapInPandas(_inside(root), "manifest_index long, file string, path string"), "inputs")
    own = tags.withColumnRenamed("image_id", "manifest_index").join(items.select("manifest_index"), "manifest_index", "left_semi")
    listed = own.groupBy("manifest_index").agg(F.array_sort(F.collect_list(F.struct("ord", "tag", "score"))).alias("t"))
    listed = listed.select("manifest_index", F.map_from_entries(F.transform("t", lambda x: F.struct(x["tag"], x["score"]))).alias("general_tags"))
    derived = fea.derive(items.select("manifest_index").join(own, "manifest_index", "left").withColumnRenamed("manifest_index", "image_id"))
    part = lambda d: F.struct(F.col(d).alias("value"), F.col(f"{d}_source").alias("source_tag"), F.col(f"{d}_confidence").alias("confidence"), F.col(f"{d}_status").alias("status"))
    named = derived.select(F.col("image_id").alias("manifest_index"), F.struct(part("people").alias("people_count"), part("framing").alias("framing"), part("outdoors").alias("outdoors")).alias("selection_features"))
    empty = F.create_map().cast("map<string,double>")
    return items.join(named, "manifest_index").join(listed, "manifest_index", "left").select(
        F.format_string("%06d", F.col("manifest_index")).alias("image_id"), "path", "manifest_index", "selection_features", F.coalesce("general_tags", empty).alias("general_tags"))


def _inside(root: str):
    real = os.path.realpath(local(root))

    def run(batches):
        for p in batches:
            files = p["file"].map(lambda f: os.path.realpath(local(f)))
            for given, f in zip(p["file"], files):
                if not f.startswith(real.rstrip("/") + "/"):
                    raise PermissionError(f"{given} is outside {root}")
                if not os.path.isfile(f):
                    raise FileNotFoundError(given)
            yield p.assign(path=files.str.slice(len(real.rstrip("/")) + 1))

    return run


def write_tag_metadata(items: DataFrame, path: str, head: dict, chosen: DataFrame | None = None) -> None:
    """The metadata file of :func:`tagged_items`: ``head`` (job, model, prefix, storage threshold, later the selection report) and all items.

    ``chosen`` is (image_id, rank), image_id being the manifest index: who was selected, and in which place.
    """
    none = items.sparkSession.createDataFrame([], "manifest_index long, rank int")
    ranks = none if chosen is None else chosen.select(F.col("image_id").cast("long").alias("manifest_index"), F.col("rank").cast("int").alias("rank"))
    t = items.join(ranks, "manifest_index", "left").withColumn("selection", F.struct(F.col("rank").isNotNull().alias("selected"), "rank")).drop("rank")
    write_listing(t.orderBy("manifest_index"), path, "items", head)


def selected_counts(features: DataFrame, chosen: DataFrame, targets: dict) -> DataFrame:
    """(dimension, value, target, n, share): what a selection was to hold, and what it holds, with zeros for every value."""
    wanted = [(d, v, fea.normalized(targets[d]).get(v)) for d, values in fea.DOMAIN.items() for v in values]
    goal = features.sparkSession.createDataFrame(wanted, "dimension string, value string, target double")
    have = fea.distribution(features.join(chosen.select("image_id"), "image_id", "left_semi"))
    total = have.groupBy("dimension").agg(F.sum("n").alias("total"))
    return goal.join(have, ["dimension", "value"]).join(total, "dimension").select("dimension", "value", "target", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


#: The names of the dimensions in reports (fixed values).
_NAMES = {"people": "people_count", "framing": "framing", "outdoors": "outdoors"}


def selection_report(features: DataFrame, chosen: DataFrame, request: FinalizeRequest, job_id: str, limits: CaptionLimits, rules: dict | None = None, strict: bool = False) -> dict:
    """The report of a selection: targets and what was reached, how captions are made, and the denylist in force. ``rules``: see :func:`taxonomy.load_rules`."""
    rows = selected_counts(features, chosen, request.targets).collect()  # 11 rows
    reached = {name: {r.value: r.n for r in rows if r.dimension == d} for d, name in _NAMES.items()}
    size = sum(reached["outdoors"].values())
    counts = taxonomy.relation_counts(rules["direct"], rules["runtime"], rules["blocked"]).first() if rules else None
    base = sorted(V.DENYLIST)
    return {
        "target_size": request.target_size, "selected_size": size, "targets": {name: fea.normalized(request.targets[d]) for d, name in _NAMES.items()}, "distribution": {**reached, "total": size},
        "job_id": job_id, "resolved_trigger_prefix": request.prefix, "caption_threshold": request.caption_threshold, "caption_max_tags": limits.soft, "caption_hard_max_tags": limits.hard,
        "caption_policy": {
            "order": ["basic_structure", *V.CATEGORY_ORDER], "stages": V.CAPTION_STAGES, "exclusive_margin": limits.exclusive_margin, "pair_conflict_margin": limits.pair_margin,
            "abstract_threshold": limits.abstract, "remove_all_text_tags": limits.remove_text,
            "parent_rules": {"source": rules["source"] if rules else "", "general_tag_count": rules["general_tag_count"] if rules else 0, **{f"{k}_relation_count" if k != "runtime" else "relation_count": counts[k] if counts else 0 for k in ("direct", "blocked", "runtime")}, "strict_loading": strict},
        },
        "denylist": list(request.denylist), "default_denylist": base, "effective_denylist": sorted({*base, *request.denylist, *(V.OPTIONAL_TEXT if limits.remove_text else ())}),
    }
