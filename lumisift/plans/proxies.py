"""Views over the driver's tables that stand in for model output, and the same views as DuckDB SQL.

Scored tags: every document, or every image, with a vocabulary of 64 words and hashed scores. Boxes: hashed
from the image id. Events: one job per user. The vocabulary touches every rule group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table

VOCAB = """1girl 1boy 1other solo 2girls 2boys 2others duo couple group multiple_girls 3girls 5boys full_body cowboy_shot
upper_body close-up close_up outdoors indoors bedroom classroom blue_eyes red_eyes brown_eyes heterochromia black_hair
blonde_hair streaked_hair long_hair short_hair open_mouth closed_mouth smile frown standing sitting lying barefoot socks
boots white_background black_background gradient_background simple_background day night watermark signature text
mind_control spiral_eyes pet_play collar leash skirt plaid_skirt pleated_skirt plaid_clothes gray_hair grey_hair
looking_away""".split() + ["Looking  At Viewer", "Blue Eyes"]

ALIASES = [("gray_hair", "grey_hair"), ("blond_hair", "blonde_hair"), ("yellow_hair", "blond_hair")]
EDGES = [("plaid_skirt", "skirt"), ("plaid_skirt", "plaid_clothes"), ("pleated_skirt", "skirt"), ("leaf", "left"), ("leaf", "right"), ("left", "root"), ("right", "root"), ("classroom", "indoors")]
BLOCKED = [("leaf", "root")]


def tags_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id")))


def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tagger over the ids of image_records, which are not those of documents."""
    return _tagged(images(spark, sf_dir).select("image_id"))


def _tagged(ids: DataFrame) -> DataFrame:
    words = F.array(*(F.struct(F.lit(i).cast("long").alias("ord"), F.lit(t).alias("tag")) for i, t in enumerate(VOCAB)))
    t = ids.select("image_id", F.explode(words).alias("w")).select("image_id", "w.*")
    t = t.withColumn("score", F.expr("(image_id * 7919 + ord * 104729 + image_id * ord * 31) % 997") / F.lit(997.0))
    return t.filter("(image_id * 13 + ord * 7) % 5 < 2 AND score >= 0.10D")


def pairs(spark: SparkSession, rows: list[tuple[str, str]], a: str = "child", b: str = "parent") -> DataFrame:
    listed = F.array(*(F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in rows))
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_records, once per id (rows delivered twice are equal but for their arrival)."""
    t = table(spark, sf_dir, "image_records")
    return t.filter("image_id IS NOT NULL").groupBy("image_id").agg(F.min(F.struct("job_id", "path", "sha256", "width", "height")).alias("r")).select("image_id", "r.*")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, job_id, width, height, watermark_boxes, comic_boxes)"""
    box = F.array(F.lit(10.0), F.lit(20.0), F.lit(300.0), F.lit(400.0))
    none = F.array().cast("array<array<double>>")
    wm = F.when(F.col("image_id") * 7919 % 17 == 0, F.array(box)).otherwise(none)
    comic = F.when(F.col("image_id") % 13 == 0, F.array(box, box)).when(F.col("image_id") % 11 == 0, F.array(box)).otherwise(none)
    return images(spark, sf_dir).select(F.col("image_id").alias("id"), "job_id", "width", "height", wm.alias("watermark_boxes"), comic.alias("comic_boxes"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.lit("running").alias("status"), F.lit("").alias("message"), F.lit(0.5).alias("progress"), "ts", F.create_map("event_type", F.col("value").cast("string"), F.lit("locate_flow"), F.lit("x")).alias("data"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


WORDS_SQL = f"words AS (SELECT * FROM (VALUES {_values(enumerate(VOCAB))}) v(ord, tag))"
TAGS_SQL = WORDS_SQL + """,
tags_long AS (SELECT * FROM (SELECT doc_id AS image_id, CAST(ord AS BIGINT) AS ord, tag, ((doc_id * 7919 + ord * 104729 + doc_id * ord * 31) % 997) / 997.0::DOUBLE AS score
  FROM documents, words WHERE (doc_id * 13 + ord * 7) % 5 < 2) WHERE score >= 0.10::DOUBLE)"""
ALIAS_SQL = "aliases(src, dst) AS (VALUES ('gray_hair', 'grey_hair'), ('blond_hair', 'blonde_hair'), ('yellow_hair', 'blonde_hair'))"
EDGES_SQL = f"edges(child, parent) AS (VALUES {_values(EDGES)})"
CLOSURE_SQL = EDGES_SQL + ", closure(child, parent) AS (SELECT child, parent FROM edges UNION SELECT c.child, e.parent FROM closure c JOIN edges e ON c.parent = e.child)"
IMAGES_SQL = "images AS (SELECT image_id, any_value(job_id) AS job_id, any_value(path) AS path, any_value(sha256) AS sha256, any_value(width) AS width, any_value(height) AS height FROM image_records WHERE image_id IS NOT NULL GROUP BY image_id)"
BOXES_SQL = IMAGES_SQL + """,
boxes AS (SELECT image_id AS id, job_id, width, height, CASE WHEN image_id * 7919 % 17 = 0 THEN 1 ELSE 0 END AS wm, CASE WHEN image_id % 13 = 0 THEN 2 WHEN image_id % 11 = 0 THEN 1 ELSE 0 END AS comic FROM images)"""
