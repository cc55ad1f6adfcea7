"""The whole chain as a plan: scan, dedupe, size filter, clusters, graph filter, inspection, features, selection, captions.

Stages are DataFrame to DataFrame; a stage that is switched off is an identity. What is
costly or drawn at random is written once before it is used twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, features, graph, inspection, scan, tagrules
from ..storage import cut
from .jobs import TARGETS, Stages


@dataclass(frozen=True)
class Settings:
    minimum_pixels: int = 1_000_000
    linkage: float = 0.90
    graph_similarity: float = 0.65
    neighbors: int = 20
    core_degree: int = 3
    seed: int = 1
    target_size: int = 100
    targets: dict = field(default_factory=lambda: TARGETS)
    prefix: str = "style"
    limits: tagrules.CaptionLimits = field(default_factory=tagrules.CaptionLimits)
    stages: Stages = field(default_factory=Stages)


def filter_images(images: DataFrame, vectors: DataFrame | None, watermark, comic, s: Settings) -> dict[str, DataFrame]:
    """manifest, clusters (ranked members), counters, graph_audit and accounts (kept and excluded) of ``images`` (image_id, path, sha256, width, height).

    ``vectors`` is (image_id, embedding); an image without a usable one stays a cluster of its own. An
    empty core keeps no cluster, hence no image.
    """
    stages = s.stages.effective()
    stats = scan.scan_stats(images, s.minimum_pixels if stages.resolution_filter else 0, stages.deduplicate)
    kept = scan.deduplicated(images, stages.deduplicate)
    if stages.resolution_filter:
        kept = scan.large_enough(kept, s.minimum_pixels)
    kept = cut(kept, "images")
    if stages.clustering and vectors is not None:
        v = cut(kept.join(vectors, "image_id", "left"), "vectors")
        ids = clusters.complete_linkage_clusters(v, s.linkage, "image_id", "embedding", "path")
        usable = F.coalesce(F.col("embedding").cast("array<double>"), F.array(F.lit(0.0)))
        unit = F.transform(usable, lambda x: x / F.greatest(F.sqrt(F.aggregate(usable, F.lit(0.0), lambda a, b: a + b * b)), F.lit(1e-12)))
        members = ids.join(v.select(F.col("image_id").alias("id"), "path", unit.alias("v")), "id").select(F.col("cluster_id").cast("long").alias("cluster_id"), "id", "path", F.col("id").alias("pos"), "v")
        ranked = cut(clusters.medoids(members), "clusters")
    else:
        ranked = cut(clusters.singletons(kept).withColumns({"rank": F.lit(0), "cluster_id": F.col("cluster_id").cast("long"), "size": F.lit(1).cast("long"), "lowest": F.lit(1.0)}), "clusters")
    nodes = ranked.filter("rank = 0").select(F.col("cluster_id").alias("node"))
    sizes, (nodes, audit) = ranked.filter("rank = 0").select("cluster_id", "size"), graph.bypassed(nodes)
    if stages.graph and vectors is not None:
        medoid = ranked.filter("rank = 0").join(kept.select(F.col("image_id").alias("id")).join(vectors.withColumnRenamed("image_id", "id"), "id"), "id")
        edges = cut(graph.mutual_top_k(graph.cosine_pairs(medoid, s.graph_similarity, "cluster_id", "embedding"), s.neighbors), "edges")
        nodes, audit = graph.keep_largest(nodes, edges, s.core_degree)
    accounts = graph.accounting(sizes, nodes)
    ranked = ranked.join(nodes.select(F.col("node").alias("cluster_id")), "cluster_id", "left_semi")
    if stages.locate:
        manifest, counters = inspection.locate(ranked, watermark, comic, s.seed, stages.retry)
    else:
        manifest, counters = inspection.bypass(ranked), None
    return {"stats": stats, "clusters": ranked, "graph_audit": audit, "accounts": accounts, "manifest": cut(manifest, "manifest"), "counters": counters}


def curate(manifest: DataFrame, tags: DataFrame, aliases: DataFrame, closure: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """features, selection (image_id, rank) and captions of the passed items; ``tags`` is (image_id, ord, tag, score).

    A passed item without tags takes part with unknown features and the prefix as its caption.
    """
    passed = manifest.filter("status = 'passed'").select(F.col("id").alias("image_id")).distinct()
    scored = cut(tags.join(passed, "image_id", "left_semi"), "tags")
    feats = cut(features.derive(passed.join(scored, "image_id", "left")), "features")
    chosen = cut(features.select(feats, s.target_size, s.targets), "selection")
    only = lambda df: df.join(chosen.select("image_id"), "image_id", "left_semi")
    captions, audit = tagrules.captions(only(scored), only(feats), aliases, closure, s.prefix, s.limits)
    return {"features": feats, "selection": chosen, "captions": captions, "audit": audit}
