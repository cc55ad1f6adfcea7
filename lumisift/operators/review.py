"""Review of the finished set, and the queries its views are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def passed_items(manifest: DataFrame, workflow: str = "filtering") -> DataFrame:
    """Items that passed and have a file: the output, or in direct mode the source."""
    path = F.col("source" if workflow == "direct" else "output")
    return manifest.filter((F.col("status") == "passed") & (F.coalesce(path, F.lit("")) != ""))


def output_count(manifest: DataFrame) -> DataFrame:
    return passed_items(manifest).agg(F.count("*").alias("output_images"))


def apply_actions(manifest: DataFrame, actions: DataFrame) -> DataFrame:
    """The manifest (index, ..., status, output, reason) after an action log (seq, index, action remove|restore, at).

    The last action on an item holds. A removal takes away the output, kept as
    review_original_output, and sets status and reason; a restored item is as it was. Actions on
    items that are not part of the final set do nothing.
    """
    last = actions.groupBy("index").agg(F.max_by(F.struct("action", "at"), "seq").alias("a"))
    t = manifest.join(last, "index", "left")
    gone = F.coalesce((F.col("a.action") == "remove") & (F.col("status") == "passed") & F.col("output").isNotNull(), F.lit(False))
    return t.select(
        *(c for c in manifest.columns if c not in ("status", "output", "reason")), F.when(gone, "removed_by_review").otherwise(F.col("status")).alias("status"), F.when(~gone, F.col("output")).alias("output"),
        F.when(gone, "removed_by_review").otherwise(F.col("reason")).alias("reason"), F.when(gone, F.col("output")).alias("review_original_output"), F.when(gone, F.col("a.at")).alias("review_removed_at"))


def audit_view(clusters: DataFrame, kept: DataFrame, show: str = "all") -> DataFrame:
    """Clusters (cluster_id, size) of the view all, kept or excluded."""
    if show == "all":
        return clusters
    return clusters.join(kept.select("cluster_id"), "cluster_id", "left_semi" if show == "kept" else "left_anti")


def gallery_page(manifest: DataFrame, page: int, size: int = 50) -> DataFrame:
    """One page, from 0, of the passed items in manifest order; a page beyond the last shows the last."""
    items = passed_items(manifest)
    last = max(-(-items.count() // size) - 1, 0)
    page = min(max(page, 0), last)
    return items.orderBy("index").offset(page * size).limit(size)


def selected_gallery(items: DataFrame) -> DataFrame:
    return items.filter("selected").orderBy("rank")


def result_label(status: Column, role: Column) -> Column:
    return F.when(status == "removed_by_review", "removed").when(status == "passed", F.when(role == "backup_retry", "retry_pass").otherwise("pass")).otherwise("dropped")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def shares(counts: DataFrame, by: str = "dimension") -> DataFrame:
    """Adds the whole percentage of n among its group; 0 in an empty group."""
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("percent", F.when(total > 0, F.floor(F.col("n") * 100.0 / total + 0.5)).otherwise(F.lit(0)).cast("int"))


def parse_denylist(text: Column) -> Column:
    """Entries between commas and line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[,\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def stored_denylist(entries: Column) -> Column:
    """A request's denylist as it is kept: trimmed, distinct, sorted without regard to case."""
    kept = F.array_distinct(F.filter(F.transform(entries, F.trim), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x).alias("k"), x.alias("x")))), lambda s: s["x"])


def view_boxes(boxes: Column) -> Column:
    """Corners in 0..1 and in order."""
    c = lambda b, i: F.least(F.greatest(F.get(b, F.lit(i)), F.lit(0.0)), F.lit(1.0))
    return F.transform(boxes, lambda b: F.array(F.least(c(b, 0), c(b, 2)), F.least(c(b, 1), c(b, 3)), F.greatest(c(b, 0), c(b, 2)), F.greatest(c(b, 1), c(b, 3))))


def curation_summary(items: DataFrame) -> DataFrame:
    """(image_id, tags: the first 12, audit_count) of (image_id, tags, audit)."""
    return items.select("image_id", F.slice("tags", 1, 12).alias("tags"), F.coalesce(F.size("audit"), F.lit(0)).alias("audit_count"))
