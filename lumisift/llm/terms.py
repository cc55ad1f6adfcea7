"""Problem 1: how often, and in how many records, every distinct term occurs."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tag_form
from ..storage import cut


def latest(df: DataFrame, key: str, newest: list[str], keep: list[str]) -> DataFrame:
    """One row per non-null ``key``: the columns ``keep`` of the row that is largest in ``newest``; nulls are smallest."""
    row = F.max_by(F.struct(*keep), F.struct(*newest))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_r")).select(key, "_r.*")


def records_of_terms(df: DataFrame, id_col: str = "image_id", terms_col: str = "tags", newest=("captioned_at", "result_id")) -> DataFrame:
    """(id, term, times): the terms of each record's newest row, in TAG FORM.

    Null arrays, null terms and terms with nothing left give no row. The rows stay
    partitioned by id, so counting within a record needs no further shuffle.
    """
    now = latest(df, id_col, list(newest), [terms_col])
    one = now.select(F.col(id_col).alias("id"), F.explode(terms_col).alias("raw"))
    return one.select("id", tag_form(F.col("raw")).alias("term")).filter("term <> ''").groupBy("id", "term").agg(F.count("*").alias("times"))


def term_frequencies(records: DataFrame, n: int, rare_below: int = 5, common_share: str = "0.40") -> DataFrame:
    """(term, occurrences, records, is_rare, is_common) of every distinct term.

    ``records`` is (id, term, times); ``n`` the number of records with a term. Counts
    are combined within each task by hash before the shuffle, so a term that a third
    of all rows hold costs one row per task. A term can be both rare and common.
    """
    s = Fraction(common_share)
    counts = records.groupBy("term").agg(F.sum("times").alias("occurrences"), F.count("*").alias("records"))
    return counts.withColumns({"is_rare": F.col("records") < rare_below, "is_common": F.col("records") * s.denominator >= F.lit(s.numerator * n)})


def counted(df: DataFrame, **kw) -> tuple[DataFrame, int]:
    """The term records of ``df``, written once, and how many records have a term."""
    records = cut(records_of_terms(df, **kw), "terms")
    return records, records.select("id").distinct().count()
