"""CSV and JSON inputs of the taxonomy compiler, with declared schemas."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import local

RELATION = "antecedent_name string, consequent_name string, antecedent string, consequent string, status string"
REVIEW = (
    "schema_version int, model string, range_start int, range_end int, reviewed_tag_count int, reviewed_tags array<string>, "
    "accepted array<struct<child:string,parents:array<string>,relation_type:string,confidence:string,rationale:string>>, "
    "aliases array<struct<alias:string,canonical:string,confidence:string,rationale:string>>, ambiguous array<struct<child:string,possible_parent:string,rationale:string>>"
)
VALIDATION = "schema_version int, model string, source_batch string, reviewed_relation_count int, decisions array<struct<child:string,parent:string,decision:string,rationale:string>>"
RULES = "schema_version int, general_tag_count long, aliases map<string,string>, child_to_direct_parents map<string,array<string>>, blocked_child_to_parents map<string,array<string>>, child_to_parents map<string,array<string>>"


def vocabulary_csv(spark: SparkSession, path: str) -> DataFrame:
    """(name, category) of a CSV file with a header, which may start with a byte-order mark."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    if not {"name", "category"} <= set(names):
        raise ValueError("the vocabulary needs the columns name and category")
    return rows.select(F.col(f"`{names['name']}`").alias("name"), F.col(f"`{names['category']}`").alias("category"))


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.trim("category").alias("category")).agg(F.count("*").alias("n"))


def cache_roots(env=os.environ) -> list[str]:
    """The folders in which a model cache keeps its files: those the environment names, then the one in the home folder; each once."""
    home = os.path.join(env["HF_HOME"], "hub") if env.get("HF_HOME") else None
    named = [env.get("HF_HUB_CACHE"), home, os.path.join("~", ".cache", "huggingface", "hub")]
    return list(dict.fromkeys(os.path.realpath(os.path.expanduser(r)) for r in named if r))


def newest_vocabulary(roots: list[str] | None = None, name: str = "selected_tags.csv") -> str | None:
    """The file of that name, under any of the folders (without any: :func:`cache_roots`), that was changed last."""
    roots = cache_roots() if roots is None else roots
    found = [p for r in roots if r and os.path.isdir(r) for p in Path(r).rglob(name) if p.is_file()]
    return str(max(found, key=lambda p: (p.stat().st_mtime_ns, str(p)))) if found else None


def relationships_json(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a relationship snapshot, which must be an array."""
    head = spark.read.text(path, wholetext=True).select(F.ltrim(F.substr("value", F.lit(1), F.lit(1000))).alias("v")).first()
    if head is None or not head.v.lstrip("\ufeff").startswith("["):
        raise TypeError(f"{path} must hold an array")
    return spark.read.schema(RELATION).option("multiLine", True).json(path)


def batches_json(spark: SparkSession, folder: str, schema: str = REVIEW) -> DataFrame:
    """The ``batch_*.json`` files of a folder, with their file names as ``batch``; without any it is an error."""
    if not list(Path(local(folder)).glob("batch_*.json")) and "://" not in folder:
        raise FileNotFoundError(f"no batch_*.json in {folder}")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/batch_*.json")
    return rows.withColumn("batch", F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)))


def rules_json(spark: SparkSession, path: str) -> DataFrame:
    """The one object of a rule file; a value of another kind than declared is an error."""
    return spark.read.schema(RULES).option("multiLine", True).option("mode", "FAILFAST").json(path)


def edges_of(rules: DataFrame, column: str) -> DataFrame:
    """(child, parent) of a map of children to parent lists; null and empty lists give nothing."""
    return rules.select(F.explode(column).alias("child", "parents")).select("child", F.explode("parents").alias("parent"))


def overrides_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """aliases (src, dst), add and remove (child, parent) of a schema-1 override file; a single parent may stand without a list."""
    text = spark.read.text(path, wholetext=True)
    kinds = ("aliases", "add", "remove")
    v = text.select(F.get_json_object("value", "$.schema_version").alias("version"), *(F.from_json(F.get_json_object("value", f"$.{k}"), "map<string,string>").alias(k) for k in kinds), *(F.ltrim(F.get_json_object("value", f"$.{k}")).alias(f"_{k}") for k in kinds))
    first = v.first()
    if first is None or first.version != "1":
        raise ValueError("overrides need schema_version 1")
    for k in kinds:
        if first[f"_{k}"] is not None and not first[f"_{k}"].startswith("{"):
            raise TypeError(f"{k} must be an object")
    pairs = lambda k: v.select(F.explode(k).alias("child", "p")).select("child", F.explode(F.coalesce(F.from_json("p", "array<string>"), F.array("p"))).alias("parent"))
    return {"aliases": v.select(F.explode("aliases").alias("src", "dst")), "add": pairs("add"), "remove": pairs("remove")}
