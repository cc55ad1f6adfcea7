"""Problem 8: filling sequences of fixed capacity with documents of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .tokens import VOCABULARY, token_counts

#: Pieces of one length that one task ranks.
RANKED = 50_000


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of equal lengths.

    Rows (length, first rank, how many, first container, items a container, offset): the
    item of a rank within its length goes to container first + (rank - first rank) // items.
    Containers with equal room are handled together, so the work depends on the number of
    distinct lengths, not of documents.
    """
    rows, rooms, keys, made = [], {}, [], 0

    def put(room, start, count):
        if count and room:
            if room not in rooms:
                rooms[room] = []
                insort(keys, room)
            rooms[room].append((start, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(keys, length)
            if k < len(keys):
                room = keys[k]
                start, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], keys[k]
            else:
                room, start = capacity, made
                count = -(-left // (capacity // length))
                made += count
            each = room // length
            whole = min(count, left // each)
            rest = left - whole * each if whole < count else 0
            if whole:
                rows.append((length, rank, whole * each, start, each, capacity - room))
            if rest:
                rows.append((length, rank + whole * each, rest, start + whole, rest, capacity - room))
            put(room - each * length, start, whole)
            put(room - rest * length, start + whole, 1 if rest else 0)
            put(room, start + whole + bool(rest), count - whole - bool(rest))
            left -= whole * each + rest
            rank += whole * each + rest
    return rows


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, n, sequence_id, at): where each document, or each piece of a document
    longer than ``capacity``, lies.

    Lengths are planned on their histogram, of at most ``capacity`` numbers; documents take
    the planned slots by their rank within their length. Ranks are counted within
    (length, salt) and offset by the counts of earlier salts; there are as many salts as the pieces need,
    so a length that a third of all documents have is ranked by many tasks. Ids are unique; null ids, and null or
    empty texts, take no room and give no row. An empty table gives none.
    """
    spark = df.sparkSession
    sizes = token_counts(df.filter(F.col(id_col).isNotNull()), id_col, text_col, vocabulary=vocabulary).filter("n > 0")
    sizes = cut(sizes, "sizes")
    total = sizes.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    salts = max(1, -(-total // RANKED))
    last = F.col("n") % capacity
    pieces = sizes.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1), lambda i: F.when(((i + 1) * F.lit(capacity)) <= F.col("n"), F.lit(capacity)).otherwise(last.cast("int")))).alias("piece", "n"))
    pieces = cut(pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int")), "pieces")
    counts = cut(pieces.groupBy("n", "salt").agg(F.count("*").alias("c")), "lengths")  # at most capacity * salts rows
    histogram = {r.n: r.c for r in counts.groupBy("n").agg(F.sum("c").alias("c")).collect()}
    before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("n", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("n", "salt").orderBy("id", "piece"))
    ranked = pieces.withColumn("k", within).join(offset, ["n", "salt"]).select("id", "piece", "n", (F.col("offset") + F.col("k") - 1).alias("rank"))
    rows = plan_slots(histogram, capacity)
    plan = spark.createDataFrame(rows, "n int, first long, many long, start long, each long, used long")
    slot = F.col("rank") - F.col("first")
    at = ranked.join(plan, "n").filter((slot >= 0) & (slot < F.col("many")))
    return at.select("id", "piece", "n", (F.col("start") + F.floor(slot / F.col("each"))).alias("sequence_id"), (F.col("used") + slot % F.col("each") * F.col("n")).alias("at"))
