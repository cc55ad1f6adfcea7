"""The flagship: the whole curation chain over the driver's image tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import taxonomy
from ..operators.tagrules import CaptionLimits
from ..storage import cut, table
from . import pipeline
from . import proxies as P
from .providers import from_table


def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, rank, caption): image records deduplicated, filtered by size, clustered at .90, inspected, tagged with
    the proxy tagger, selected to the default targets and captioned.

    The vectors' groups are too small for the default k-core, so the graph keeps clusters of degree 1 at .45.
    """
    images = P.images(spark, sf_dir)
    found = table(spark, sf_dir, "image_records").filter("size(embedding) = 64 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30) AND exists(embedding, x -> x <> 0)")
    vectors = found.groupBy("image_id").agg(F.min("embedding").alias("embedding"))
    boxes = cut(P.boxes(spark, sf_dir), "boxes")
    look = lambda k: from_table(boxes.select("id", F.col(k).alias("boxes")))
    s = pipeline.Settings(graph_similarity=0.45, core_degree=1, target_size=50, limits=CaptionLimits(threshold=0.40, soft=10, hard=12))
    manifest = pipeline.filter_images(images, vectors, look("watermark_boxes"), look("comic_boxes"), s)["manifest"]
    aliases, closure = cut(taxonomy.alias_closure(P.pairs(spark, P.ALIASES, "src", "dst")), "aliases"), cut(taxonomy.closure(P.pairs(spark, P.EDGES)), "closure")
    got = pipeline.curate(manifest, P.image_tags(spark, sf_dir), aliases, closure, s)
    return got["selection"].join(got["captions"], "image_id").select("image_id", "rank", "caption")
