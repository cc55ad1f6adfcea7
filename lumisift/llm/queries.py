"""Queries of the training-data problems, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped_lower_sql, tag_form_sql
from ..operators.graph import cosine_pairs
from ..storage import cut, table
from .clusters import set_clusters, similar_clusters
from .cooccurrence import together
from .groups import components
from .languages import document_languages, given_code
from .mixing import mix
from .neighbors import neighbors
from .packing import pack
from .sampling import DIMENSIONS, proportional_samples
from .terms import counted, latest, term_frequencies

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# Problem 1: frequency of every distinct term

_TERMS = f"""
WITH newest AS (
  SELECT image_id, tags, row_number() OVER (PARTITION BY image_id ORDER BY captioned_at DESC NULLS LAST, result_id DESC NULLS LAST) AS rn
  FROM caption_results WHERE image_id IS NOT NULL),
raw AS (SELECT image_id, unnest(tags) AS t FROM newest WHERE rn = 1),
terms AS (SELECT image_id, {tag_form_sql("t")} AS term FROM raw),
rec AS (SELECT image_id, term, count(*) AS times FROM terms WHERE term <> '' GROUP BY ALL),
n AS (SELECT count(DISTINCT image_id) AS n FROM rec),
freq AS (SELECT term, sum(times) AS occurrences, count(*) AS records FROM rec GROUP BY term)
"""


@query("p1_found", _TERMS + """
SELECT term AS tag, 'rare' AS mark FROM freq WHERE records < 5
UNION ALL SELECT term, 'common' FROM freq, n WHERE records * 5 >= n * 2""")
def p1_found(spark, sf_dir):
    records, n = counted(table(spark, sf_dir, "caption_results"))
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return term_frequencies(records, n).select(F.col("term").alias("tag"), F.explode(marks).alias("mark"))


@query("p1_terms", _TERMS + """
SELECT term AS tag, CAST(occurrences AS BIGINT) AS occurrences, records AS images, records < 5 AS is_rare, records * 5 >= n * 2 AS is_common FROM freq, n""")
def p1_terms(spark, sf_dir):
    records, n = counted(table(spark, sf_dir, "caption_results"))
    return term_frequencies(records, n).select(F.col("term").alias("tag"), "occurrences", F.col("records").alias("images"), "is_rare", "is_common")


# Problem 2: pairwise matches into groups


@query("p2_found", """
WITH RECURSIVE ids AS (SELECT DISTINCT image_id FROM image_records WHERE image_id IS NOT NULL),
m AS (SELECT DISTINCT left_id AS a, right_id AS b FROM match_pairs
      WHERE left_id <> right_id AND similarity >= 0.85 AND NOT isnan(similarity)
        AND left_id IN (SELECT image_id FROM ids) AND right_id IN (SELECT image_id FROM ids)),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
reach(id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.g FROM reach r JOIN e ON e.a = r.id WHERE r.g < e.b)
SELECT id AS image_id, min(g) AS group_id FROM reach GROUP BY id""")
def p2_found(spark, sf_dir):
    ids = table(spark, sf_dir, "image_records").select("image_id").distinct()
    m = table(spark, sf_dir, "match_pairs").filter("similarity >= 0.85D AND NOT isnan(similarity) AND left_id <> right_id")
    pairs = m.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(ids.select(F.col("image_id").alias(side)), side, "left_semi")
    return components(pairs).select(F.col("id").alias("image_id"), "group_id")


# Problem 3: most similar vectors


_NEAR = """
WITH v AS (SELECT image_id AS id, any_value(embedding)::DOUBLE[64] AS e FROM image_records WHERE image_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY image_id),
s AS (SELECT a.id, b.id AS other, round(array_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT id, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rn FROM s WHERE sim >= 0.82) WHERE rn <= 10)
"""


@query("p3_found", _NEAR + "SELECT DISTINCT least(id, other) AS image_id, greatest(id, other) AS neighbor_id FROM near")
def p3_found(spark, sf_dir):
    near = neighbors(table(spark, sf_dir, "image_records"), "image_id", "embedding", k=10, floor=0.82)
    return near.select(F.least("id", "other").alias("image_id"), F.greatest("id", "other").alias("neighbor_id")).distinct()


@query("p3_neighbors", _NEAR + "SELECT id AS image_id, other AS neighbor_id, sim AS similarity FROM near WHERE id % 20 = 0")
def p3_neighbors(spark, sf_dir):
    """The listed neighbors of the query set: every image whose id is divisible by 20, searched among all images."""
    near = neighbors(table(spark, sf_dir, "image_records"), "image_id", "embedding", k=10, floor=0.82)
    return near.filter("id % 20 = 0").select(F.col("id").alias("image_id"), F.col("other").alias("neighbor_id"), (F.col("sim") / 1e6).alias("similarity"))


# Problem 6: similarity clusters


@query("p6_found")
def p6_found(spark, sf_dir):
    found = similar_clusters(table(spark, sf_dir, "image_records"), "image_id", "embedding", floor=0.90)
    return found.select(F.col("id").alias("image_id"), "medoid_id")


@query("p6_clusters")
def p6_clusters(spark, sf_dir):
    found = similar_clusters(table(spark, sf_dir, "image_records"), "image_id", "embedding", floor=0.90)
    return found.groupBy("medoid_id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("id")).alias("members"))


@query("p6_checks", "SELECT 'pairs below the floor' AS fault, 0::BIGINT AS n UNION ALL SELECT 'clusters that could be joined', 0::BIGINT UNION ALL SELECT 'wrong sizes', 0::BIGINT UNION ALL SELECT 'medoids that are no members', 0::BIGINT")
def p6_checks(spark, sf_dir):
    """What would be wrong with the clusters, counted against all pairs at the floor by brute force: every pair of a cluster must be
    among them, and of no two clusters, nor of a cluster and a lone image, may all be."""
    images = table(spark, sf_dir, "image_records")
    found = cut(similar_clusters(images, "image_id", "embedding", floor=0.90), "found")
    usable = images.filter("image_id IS NOT NULL AND size(embedding) = 64 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30) AND exists(embedding, x -> x <> 0)")
    vectors = usable.groupBy("image_id").agg(F.min("embedding").alias("embedding"))
    pairs = cosine_pairs(vectors, 0.8999990, "image_id", "embedding").filter(F.round("sim", 6) >= 0.9)
    of = vectors.select("image_id").join(found.withColumnRenamed("id", "image_id"), "image_id", "left").select("image_id", F.coalesce("medoid_id", "image_id").alias("c"))
    size = of.groupBy("c").agg(F.count("*").alias("size"))
    side = lambda k, c: of.select(F.col("image_id").alias(k), F.col("c").alias(c))
    met = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    met = cut(met.join(size.select(F.col("c").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("c").alias("b"), F.col("size").alias("sb")), "b"), "met")
    inner = size.filter("size > 1").join(met.filter("a = b").select(F.col("a").alias("c"), "n"), "c", "left")
    counts = {
        "pairs below the floor": inner.filter("coalesce(n, 0) <> size * (size - 1) / 2"), "clusters that could be joined": met.filter("a <> b AND n = sa * sb"),
        "wrong sizes": found.groupBy("medoid_id").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).filter("n <> lo OR lo <> hi OR n < 2"), "medoids that are no members": found.select("medoid_id").distinct().join(found.filter("id = medoid_id").select("medoid_id"), "medoid_id", "left_anti")}
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("fault"), "n") for k, df in counts.items()))


@query("p6_tag_checks", "SELECT 'members unlike their medoid' AS fault, 0::BIGINT AS n UNION ALL SELECT 'links between images left out', 0::BIGINT")
def p6_tag_checks(spark, sf_dir):
    """What would be wrong with the clusters of tag sets: a member whose Jaccard similarity to its medoid is below the floor, or two images of no cluster that reach it (by brute force over their terms)."""
    records, _ = counted(table(spark, sf_dir, "caption_results"))
    sets = cut(records.groupBy("id").agg(F.collect_set("term").alias("items")), "sets")
    got = cut(set_clusters(sets, floor=0.5), "got")
    m = got.join(sets, "id").join(sets.select(F.col("id").alias("medoid_id"), F.col("items").alias("theirs")), "medoid_id")
    common = F.size(F.array_intersect("items", "theirs"))
    unlike = m.filter(2 * common < F.size("items") + F.size("theirs") - common)
    rest = cut(sets.join(got.select("id"), "id", "left_anti"), "rest").select("id", F.size("items").alias("s"), F.explode("items").alias("t"))
    both = rest.join(rest.select(F.col("id").alias("id_b"), F.col("s").alias("s_b"), "t"), "t").filter("id < id_b").groupBy("id", "id_b").agg(F.count("*").alias("c"), F.first("s").alias("s"), F.first("s_b").alias("s_b")).filter("2 * c >= s + s_b - c")
    return unlike.agg(F.count("*").alias("n")).select(F.lit("members unlike their medoid").alias("fault"), "n").union(both.agg(F.count("*").alias("n")).select(F.lit("links between images left out"), "n"))


@query("p6_tag_clusters")
def p6_tag_clusters(spark, sf_dir):
    """Images whose newest tag sets share at least half their tags: the set form of the operator, over all pairs."""
    records, _ = counted(table(spark, sf_dir, "caption_results"))
    sets = records.groupBy("id").agg(F.collect_set("term").alias("items"))
    return set_clusters(sets, floor=0.5).select(F.col("id").alias("image_id"), "medoid_id", "size")


# Problem 7: items that appear together

_PAIRS = _TERMS + """,
pairs AS (SELECT a.term AS tag_a, b.term AS tag_b, count(*) AS c FROM rec a JOIN rec b ON a.image_id = b.image_id AND a.term < b.term GROUP BY ALL),
named AS (SELECT tag_a, tag_b, c, x.records AS n_a, y.records AS n_b, n.n FROM pairs JOIN freq x ON x.term = tag_a JOIN freq y ON y.term = tag_b, n
  WHERE c >= 5 AND c * 500 >= n.n)
"""


@query("p7_found", _PAIRS + "SELECT tag_a, tag_b FROM named WHERE CAST(c AS HUGEINT) * n >= 3 * CAST(n_a AS HUGEINT) * n_b")
def p7_found(spark, sf_dir):
    records, n = counted(table(spark, sf_dir, "caption_results"))
    pairs = together(records.select("id", "term"), n, least=5, least_share="0.002", lift_floor=3)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    often = wide("both") * F.lit(n) >= wide("n_a") * F.col("n_b").cast("decimal(18,0)") * 3
    return pairs.filter(often).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


@query("p7_pairs")
def p7_pairs(spark, sf_dir):
    """Every pair that is together in any image, with its exact count, lift, expectation under the null, tail and verdict."""
    records, n = counted(table(spark, sf_dir, "caption_results"))
    pairs = together(records.select("id", "term"), n, least=1, least_share="0")
    lift = F.col("both") * F.lit(float(n)) / F.col("n_a") / F.col("n_b")
    return pairs.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), F.col("both").alias("images"), lift.alias("lift"), "expected", "ln_p", "surprising")


@query("p7_lifts", _PAIRS[: _PAIRS.index("named AS")].rstrip().rstrip(",") + " SELECT tag_a, tag_b, c AS images, round(c * n.n::DOUBLE / x.records / y.records, 9) AS lift FROM pairs JOIN freq x ON x.term = tag_a JOIN freq y ON y.term = tag_b, n")
def p7_lifts(spark, sf_dir):
    """The counts and lifts of p7_pairs."""
    return p7_pairs(spark, sf_dir).select("tag_a", "tag_b", "images", F.round("lift", 9).alias("lift"))


@query("p7_counts", _PAIRS + "SELECT tag_a, tag_b, c AS images, n_a, n_b FROM named")
def p7_counts(spark, sf_dir):
    records, n = counted(table(spark, sf_dir, "caption_results"))
    pairs = together(records.select("id", "term"), n, least=5, least_share="0.002")
    return pairs.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), F.col("both").alias("images"), "n_a", "n_b")


# Problem 5: samples of target proportions

def _asks_sql() -> str:
    parts = []
    for d in DIMENSIONS:
        got = {k: f"CASE WHEN {d.target} IS NULL THEN {v!r}::DOUBLE ELSE greatest(coalesce(element_at({d.target}, '{k}')[1], 0::DOUBLE), 0::DOUBLE) END" for k, v in d.defaults}
        total = " + ".join(f"({v})" for v in got.values())
        parts += [f"SELECT request_id, job_id, target_size, min_per_category, '{d.name}' AS dimension, '{k}' AS category, {v} AS share, {total} AS total FROM req" for k, v in got.items()]
    return " UNION ALL ".join(parts)


_SAMPLE = f"""
WITH newest AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tagged_at DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM curated_items),
items AS (SELECT job_id, {tag_form_sql("people_count")} AS people_count, {tag_form_sql("framing")} AS framing, {tag_form_sql("outdoors")} AS outdoors FROM newest WHERE rn = 1),
there AS (SELECT job_id, 'people_count' AS dimension, people_count AS category, count(*) AS available FROM items GROUP BY ALL
  UNION ALL SELECT job_id, 'framing', framing, count(*) FROM items GROUP BY ALL
  UNION ALL SELECT job_id, 'outdoors', outdoors, count(*) FROM items GROUP BY ALL),
req AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY submitted_at DESC) AS rn FROM finalize_requests) WHERE rn = 1),
asks AS ({_asks_sql()}),
wanted AS (SELECT *, greatest(round(share / total * coalesce(target_size, 0), 6), CASE WHEN share > 0 THEN coalesce(min_per_category, 0) ELSE 0 END) AS need FROM asks WHERE total > 0),
report AS (SELECT w.request_id, w.dimension, w.category, w.need, coalesce(t.available, 0) AS available
  FROM wanted w LEFT JOIN there t ON t.job_id = w.job_id AND t.dimension = w.dimension AND t.category = w.category)
"""


@query("p5_found", _SAMPLE + "SELECT request_id, dimension, category FROM report WHERE available < need")
def p5_found(spark, sf_dir):
    _, report = proportional_samples(table(spark, sf_dir, "curated_items"), table(spark, sf_dir, "finalize_requests"))
    return report.filter("short").select("request_id", "dimension", "category")


@query("p5_report", _SAMPLE + "SELECT request_id, dimension, category, round(need, 4) AS need, available FROM report")
def p5_report(spark, sf_dir):
    _, report = proportional_samples(table(spark, sf_dir, "curated_items"), table(spark, sf_dir, "finalize_requests"))
    return report.select("request_id", "dimension", "category", F.round("need", 4).alias("need"), "available")


@query("p5_sizes", _SAMPLE + """, own AS (SELECT job_id, count(*) AS n FROM newest WHERE rn = 1 AND image_id IS NOT NULL GROUP BY job_id)
SELECT request_id, least(coalesce(target_size, 0), own.n) AS images, least(coalesce(target_size, 0), own.n) AS different, least(coalesce(target_size, 0), own.n) AS of_the_job FROM req JOIN own USING (job_id) WHERE target_size > 0""")
def p5_sizes(spark, sf_dir):
    """Of every sample how many images it has, how many different ones, and how many of the request's own job."""
    items, requests = table(spark, sf_dir, "curated_items"), table(spark, sf_dir, "finalize_requests")
    sample = proportional_samples(items, requests)[0]
    of = latest(items, "image_id", ["tagged_at", "loaded_at"], ["job_id"])
    asked = latest(requests, "request_id", ["submitted_at"], ["job_id"]).withColumnRenamed("job_id", "own")
    t = sample.join(of, "image_id").join(asked, "request_id")
    return t.groupBy("request_id").agg(F.count("*").alias("images"), F.countDistinct("image_id").alias("different"), F.count_if(F.col("job_id") == F.col("own")).alias("of_the_job"))


@query("p5_sample")
def p5_sample(spark, sf_dir):
    return proportional_samples(table(spark, sf_dir, "curated_items"), table(spark, sf_dir, "finalize_requests"))[0]


# Problem 8: filling sequences


@query("p8_found")
def p8_found(spark, sf_dir):
    """Documents that had to be split: those with a second piece."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048).filter("piece = 1").select(F.col("id").alias("doc_id"))


@query("p8_packing")
def p8_packing(spark, sf_dir):
    p = pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)
    return p.select(F.col("id").alias("doc_id"), "piece", F.col("n").alias("tokens"), "sequence_id", "at")


@query("p8_checks", "SELECT 'sequences over their capacity' AS what, 0::BIGINT AS n UNION ALL SELECT 'documents that overlap', 0::BIGINT UNION ALL SELECT 'documents with a piece missing', 0::BIGINT UNION ALL SELECT 'documents', count(*) FROM documents WHERE text <> '' UNION ALL SELECT 'sequences beyond the least possible, but for one and one in a thousand', 0::BIGINT")
def p8_checks(spark, sf_dir):
    """What would be wrong with the packing, and how many documents it holds."""
    p = cut(pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048), "packed")
    before = F.lag(F.col("at") + F.col("n")).over(Window.partitionBy("sequence_id").orderBy("at"))
    pieces = p.groupBy("id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("different"))
    least = F.ceil(F.sum("n") * 1.001 / 2048)
    more = p.agg(F.greatest(F.max("sequence_id") + 1 - least - 1, F.lit(0)).cast("long").alias("n"))
    counts = {"sequences over their capacity": p.filter("at + n > 2048"), "documents that overlap": p.withColumn("end", before).filter("at < end"), "documents with a piece missing": pieces.filter("n <> last + 1 OR n <> different"), "documents": pieces}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in counts.items()]
    return reduce(DataFrame.union, [*rows, more.select(F.lit("sequences beyond the least possible, but for one and one in a thousand"), "n")])


@query("p8_fill")
def p8_fill(spark, sf_dir):
    """How full the sequences are."""
    p = pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)
    return p.agg((F.max("sequence_id") + 1).alias("sequences"), F.sum("n").alias("tokens"), (F.sum("n") / ((F.max("sequence_id") + 1) * 2048)).alias("fill"))


# Problem 9: mixing sources


# No source is near its limit in any tokenizer, so characters tell as well as tokens which fall short.
_MIX = f"""
WITH d AS (SELECT {stripped_lower_sql("source")} AS source, length(text) AS n FROM documents WHERE source IS NOT NULL AND {stripped_lower_sql("text")} <> ''),
t AS (SELECT {stripped_lower_sql("source")} AS source, max(target_share) AS share, max(max_repeats) AS repeats FROM source_targets WHERE source IS NOT NULL GROUP BY 1),
s AS (SELECT t.source, share, repeats, coalesce((SELECT sum(n) FROM d WHERE d.source = t.source), 0) AS n, (SELECT sum(n) FROM d) AS total FROM t)
"""


@query("p9_checks", _MIX + "SELECT source, repeats * n < share * total AS short, true AS within_repeats, true AS share_met FROM s")
def p9_checks(spark, sf_dir):
    """Of every source whether it falls short, whether no document is used too often, and whether the draw comes within 1 %, or its longest document, of its need, or of all there is."""
    draw, report = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), "doc_id", "text", "source")
    most = draw.groupBy("source").agg(F.max("uses").alias("most"), F.max("n").alias("longest"))
    goal = F.when(F.col("short"), F.col("available")).otherwise(F.col("need"))
    return report.join(most, "source", "left").select("source", "short", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("drawn") - goal) <= F.greatest(0.01 * goal, F.coalesce("longest", F.lit(0)))).alias("share_met"))


@query("p9_found", _MIX + "SELECT source FROM s WHERE repeats * n < share * total")
def p9_found(spark, sf_dir):
    _, report = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), "doc_id", "text", "source")
    return report.filter("short").select("source")


@query("p9_mix")
def p9_mix(spark, sf_dir):
    draw, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), "doc_id", "text", "source")
    return draw.select(F.col("id").alias("doc_id"), "source", F.col("n").alias("tokens"), "uses")


@query("p9_shares")
def p9_shares(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), "doc_id", "text", "source")[1]


# Problem 10: languages of documents


def _languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs, document_languages(docs, "doc_id", "text", "lang")


@query("p10_found")
def p10_found(spark, sf_dir):
    """Segments of the documents that are mixed or whose label is not their language's code."""
    docs, seg = _languages(spark, sf_dir)
    label = docs.select(F.col("doc_id").alias("id"), given_code(F.col("lang")).alias("label"))
    wrong = (F.col("segments") > 1) | ~F.col("label").eqNullSafe(F.col("lang"))
    return seg.join(label, "id").filter(wrong).select(F.col("id").alias("doc_id"), "segment_no", "lang")


@query("p10_segments")
def p10_segments(spark, sf_dir):
    seg = _languages(spark, sf_dir)[1]
    return seg.select(F.col("id").alias("doc_id"), "segment_no", "lang", "confidence", "sentences")
