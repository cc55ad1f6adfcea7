"""Exact-content deduplication, the size filter and the scan's bookkeeping, over file records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import IMAGE_SUFFIXES


def is_image(path: Column) -> Column:
    """Whether a path ends in an image suffix; a name that is nothing but a suffix has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(IMAGE_SUFFIXES)


def path_key(path: Column) -> Column:
    """Sorting by it orders paths component by component."""
    return F.split(path, "/")


def first_copies(records: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Adds ``copy``: 1 for the first path of a content among decodable files, 2, 3 ... for its copies;
    null for a file without dimensions, which never stands for its content."""
    valid = F.col("width").isNotNull() & F.col("height").isNotNull()
    if not deduplicate:
        return records.withColumn("copy", F.when(valid, F.lit(1)))
    w = Window.partitionBy("sha256", valid).orderBy(path_key(F.col("path")), "image_id")
    return records.withColumn("copy", F.when(valid, F.row_number().over(w)))


def deduplicated(records: DataFrame, deduplicate: bool = True) -> DataFrame:
    """The first path of each content among decodable files.

    A keyed minimum, combined before the shuffle: a content that a third of all files have costs a row a task.
    """
    if not deduplicate:
        return records.filter("width IS NOT NULL AND height IS NOT NULL")
    rest = [c for c in records.columns if c not in ("path", "image_id", "sha256")]
    row = F.struct(path_key(F.col("path")).alias("_k"), "image_id", "path", *rest)
    first = records.filter("width IS NOT NULL AND height IS NOT NULL").groupBy("sha256").agg(F.min(row).alias("r"))
    return first.select(*(F.col(c) if c == "sha256" else F.col(f"r.{c}").alias(c) for c in records.columns))


def large_enough(records: DataFrame, least: int) -> DataFrame:
    """width * height >= least; null dimensions are not large enough."""
    return records.filter(F.col("width").cast("long") * F.col("height") >= least)


def scan_stats(records: DataFrame, least: int, deduplicate: bool = True) -> DataFrame:
    """One row of counters: a copy is no image of its own, and a first copy that is too small still makes the others copies.

    Contents are counted, and their first copies found, by keyed aggregates.
    """
    big = F.col("width").cast("long") * F.col("height") >= least
    first = F.min(F.struct(path_key(F.col("path")), "image_id", big.alias("big")))["big"]
    valid = F.col("width").isNotNull() & F.col("height").isNotNull()
    key = F.when(valid & F.lit(deduplicate), F.col("sha256"))
    own = F.when(~valid | F.lit(not deduplicate), F.struct("image_id", "path"))
    t = records.withColumn("valid", valid).groupBy("valid", key.alias("k"), own.alias("o")).agg(F.count("*").alias("n"), first.alias("big"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = F.when(F.col("valid"), 1).otherwise(0)
    images = one if deduplicate else F.when(F.col("valid"), F.col("n")).otherwise(0)
    return t.agg(
        total("n").alias("scanned_images"), total(F.when(F.col("valid"), 0).otherwise(F.col("n"))).alias("invalid_images"), total(F.when(F.col("valid"), F.col("n") - images).otherwise(0)).alias("duplicate_images"),
        total(images).alias("unique_images"), total(F.when(~F.col("big"), images).otherwise(0)).alias("below_resolution"), total(F.when(F.col("big"), images).otherwise(0)).alias("embedding_candidates"))


def resolution_label(pixels: Column) -> Column:
    """720p for exactly 921,600 pixels, else megapixels with six significant digits; null for null."""
    mp = pixels / 1e6
    text = F.format_string("%.7f", mp)
    for low, digits in ((0.1, 6), (1, 5), (10, 4), (100, 3)):
        text = F.when(mp >= low, F.format_string(f"%.{digits}f", mp)).otherwise(text)
    short = F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("MP"))
    return F.when(pixels == 921_600, "720p").when(pixels.isNotNull(), short)
