"""More queries of the core operators over the driver's tables, each with its SQL twin; importing it registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clusters, features, graph, inspection, review, tagrules, taxonomy
from ..operators import hierarchy as tree
from ..operators.numbering import numbered
from ..sources import writers
from ..storage import cut, table
from ..streaming import events
from . import jobs, oracle, providers, reports
from . import proxies as P
from .queries import _CORE, _FEATS, _KEYS, _LIMITS, _LINKS, _R, _REASON, _TAG_VOCAB, _RULE_EDGES, _acyclic, _candidates, _derived, _graph, _inputs, query

# Providers and projections


@query("stored_tags", "WITH " + P.TAGS_SQL + " SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tag) - 1 AS INTEGER) AS ord, tag, score FROM tags_long")
def stored_tags(spark, sf_dir):
    """Scores as a tagger's maps, and back in stored order."""
    maps = P.tags_long(spark, sf_dir).groupBy(F.col("image_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("tags"))
    return providers.stored_tags(maps)


@query("curation_summary", "SELECT result_id AS image_id, tags[1:12] AS tags, CAST(coalesce(len(tags), 0) AS INTEGER) AS audit_count FROM caption_results")
def curation_summary(spark, sf_dir):
    t = table(spark, sf_dir, "caption_results")
    return review.curation_summary(t.select(F.col("result_id").alias("image_id"), "tags", F.col("tags").alias("audit")))


@query("event_top_tags", "SELECT result_id, tags[1:8] AS tags FROM caption_results")
def event_top_tags(spark, sf_dir):
    return table(spark, sf_dir, "caption_results").select("result_id", events.top_tags(F.col("tags")).alias("tags"))


@query("view_boxes", "WITH b AS (SELECT event_id, value / 50 - 0.5 AS x, (event_id % 30) / 20.0::DOUBLE AS y FROM events) SELECT event_id, [round(least(greatest(least(x, 1), 0), greatest(least(y, 1), 0)), 9), 0.0::DOUBLE, round(greatest(greatest(least(x, 1), 0), greatest(least(y, 1), 0)), 9), 1.0::DOUBLE] AS box FROM b")
def view_boxes(spark, sf_dir):
    x, y = F.col("value") / 50 - 0.5, (F.col("event_id") % 30) / F.lit(20.0)
    box = F.get(review.view_boxes(F.array(F.array(x, F.lit(2.0), y, F.lit(-1.0)))), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.transform(box, lambda v: F.round(v, 9)).alias("box"))


@query("event_progress", "SELECT event_id, round(0.03::DOUBLE + 0.94::DOUBLE * event_id / n, 9) AS tag, round(0.16::DOUBLE + 0.20::DOUBLE * (event_id + 1) / n, 9) AS embed FROM events, (SELECT count(*) AS n FROM events)")
def event_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.lit(e.count())
    return e.select("event_id", F.round(events.progress("tag", F.col("event_id"), n), 9).alias("tag"), F.round(events.progress("embed", F.col("event_id"), n), 9).alias("embed"))


@query("event_sources", "WITH m AS (SELECT job_id, cluster_id, unnest(members) AS image FROM clusters), t AS (SELECT job_id, image::VARCHAR AS image_id, max(cluster_id) AS c FROM m WHERE image IS NOT NULL GROUP BY ALL) SELECT job_id, image_id, 'in/' || c || '/' || image_id AS source FROM t")
def event_sources(spark, sf_dir):
    """The clusters table as the events that tell of finished clusters, and the side map of paths drawn from them."""
    member = lambda c: lambda m: F.struct(m.cast("string").alias("image_id"), F.concat(F.lit("in/"), c.cast("string"), F.lit("/"), m.cast("string")).alias("source"))
    one = F.struct("cluster_id", F.transform("members", member(F.col("cluster_id"))).alias("members"))
    audit = F.to_json(F.struct(F.lit("clusters_ready").alias("event"), F.array(one).alias("clusters")))
    log = table(spark, sf_dir, "clusters").select("job_id", F.col("cluster_id").cast("long").alias("id"), F.create_map(F.lit("cluster_audit"), audit).alias("data"))
    return events.audit_sources(log)


_DIR = "regexp_extract(path, '([^/\\\\]*)$', 1)"


@query("output_names", "WITH " + P.BOXES_SQL + f" SELECT b.id AS index, CASE WHEN {_REASON} IS NULL THEN printf('%05d', b.id) || '_' || {_DIR} END AS name FROM boxes b JOIN images i ON i.image_id = b.id")
def output_names(spark, sf_dir):
    reason = inspection.verdict(F.col("watermark_boxes"), F.col("comic_boxes"))
    b = P.boxes(spark, sf_dir).withColumn("status", F.when(reason.isNull(), "passed").otherwise("not_meet")).select(F.col("id").alias("index"), "status")
    named = b.join(P.images(spark, sf_dir).select(F.col("image_id").alias("index"), F.col("path").alias("source")), "index")
    return writers.output_names(named).select("index", "name")


@query("training_names", "WITH " + P.IMAGES_SQL + f""", n AS (SELECT image_id, {_DIR} AS f FROM images), t AS (SELECT image_id, CASE WHEN row_number() OVER (PARTITION BY f ORDER BY image_id DESC) > 1 THEN printf('%06d', image_id) || '_' || f ELSE f END AS training_image FROM n)
SELECT image_id, training_image, regexp_replace(training_image, '\\.[^.]*$', '') || '.txt' AS caption_file FROM t""")
def training_names(spark, sf_dir):
    chosen = P.images(spark, sf_dir).select("image_id", F.col("path").alias("source"), F.col("image_id").alias("manifest_index"), (-F.col("image_id")).alias("rank"))
    return writers.training_names(chosen).select("image_id", "training_image", "caption_file")


# Clusters and graph switched off, and their accounts


@query("singleton_clusters", "WITH " + P.IMAGES_SQL + " SELECT row_number() OVER (ORDER BY image_id) - 1 AS cluster_id, image_id AS id, 'medoid' AS role FROM images")
def singleton_clusters(spark, sf_dir):
    return clusters.singletons(P.images(spark, sf_dir))


@query("graph_bypass", "SELECT count(DISTINCT vec_id) AS nodes, 0::BIGINT AS edges, 0::BIGINT AS nodes_with_edges, count(DISTINCT vec_id) AS core_nodes, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::BIGINT AS components FROM embeddings")
def graph_bypass(spark, sf_dir):
    return graph.bypassed(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node")).distinct())[1]


@query("cluster_accounting", _CORE + """, kept AS (SELECT DISTINCT e.label FROM label l JOIN sizes s USING (label) JOIN embeddings e ON e.vec_id = l.node WHERE s.component = 1),
c AS (SELECT label, count(*) AS size, label IN (SELECT label FROM kept) AS kept FROM embeddings GROUP BY label)
SELECT count(*) FILTER (kept) AS kept_clusters, count(*) FILTER (NOT kept) AS excluded_clusters, CAST(coalesce(sum(size) FILTER (kept), 0) AS BIGINT) AS kept_images, CAST(coalesce(sum(size) FILTER (NOT kept), 0) AS BIGINT) AS excluded_images FROM c""")
def cluster_accounting(spark, sf_dir):
    """The labels of the vectors as clusters; kept are those with a vector in the largest component of the core."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("cluster_id"))
    kept = graph.keep_largest(*_graph(spark, sf_dir), 3)[0]
    sizes = v.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return graph.accounting(sizes, v.join(kept.withColumnRenamed("node", "vec_id"), "vec_id", "left_semi").select(F.col("cluster_id").alias("node")))


@query("linkage_checks", "SELECT count(DISTINCT vec_id) AS vectors, 0::BIGINT AS loose, 0::BIGINT AS joinable, 0::BIGINT AS misnumbered FROM embeddings")
def linkage_checks(spark, sf_dir):
    """What would be wrong with complete_linkage, counted over all pairs at its floor: clusters with a pair below it, two clusters
    all of whose pairs reach it, and clusters not numbered by their first members."""
    v = table(spark, sf_dir, "embeddings")
    of = cut(clusters.complete_linkage_clusters(v, 0.45).select("id", F.col("cluster_id").alias("c")), "linked")
    size = of.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    side = lambda k, c: of.select(F.col("id").alias(k), F.col("c").alias(c))
    met = graph.cosine_pairs(v, 0.45).join(side("src", "a"), "src").join(side("dst", "b"), "dst").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    met = cut(met, "met")
    loose = size.join(met.filter("a = b").select(F.col("a").alias("c"), "n"), "c", "left").filter("coalesce(n, 0) <> size * (size - 1) / 2")
    joinable = met.filter("a <> b").join(size.select(F.col("c").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("c").alias("b"), F.col("size").alias("sb")), "b").filter("n = sa * sb")
    wrong = size.withColumn("place", F.row_number().over(Window.orderBy("first")) - 1).filter("place <> c")
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in {"vectors": of, "loose": loose, "joinable": joinable, "misnumbered": wrong}.items()]
    t = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return t.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("vectors", "loose", "joinable", "misnumbered")))


# Inspection

_ANSWERS = """SELECT image_id AS id, CASE image_id % 5 WHEN 0 THEN [[1.5::DOUBLE, 2, image_id % 100, 4]] WHEN 1 THEN [[(image_id % 1000)::DOUBLE, 20, 30, 40]] WHEN 2 THEN [[1::DOUBLE, 2, 3, image_id % 7], [5::DOUBLE, 6, 7, 8]]
  WHEN 3 THEN [[9::DOUBLE, image_id % 11, 3, 2]] ELSE []::DOUBLE[][] END AS boxes FROM images"""


@query("box_answers", "WITH " + P.IMAGES_SQL + " " + _ANSWERS)
def box_answers(spark, sf_dir):
    """Detector answers in all their shapes: boxes, a chat message with tokens, results with either key, a bare list, an empty list of results."""
    i, t = F.col("image_id"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    payload = (
        F.when(i % 5 == 0, t('{"boxes": [[1.5, 2, ', i % 100, ", 4]]}")).when(i % 5 == 1, t('{"choices": [{"message": {"content": "see <box><', i % 1000, '><20><30><40></box>"}}]}'))
        .when(i % 5 == 2, t('{"results": [{"box": [1, 2, 3, ', i % 7, ']}, {"bbox": [5, 6, 7, 8]}]}')).when(i % 5 == 3, t("[[9, ", i % 11, ", 3, 2]]")).otherwise(F.lit('{"results": [], "detections": [{"box": [1, 2, 3, 4]}]}')))
    return P.images(spark, sf_dir).select(i.alias("id"), inspection.boxes_of(payload, F.lit(1000), F.lit(1000)).alias("boxes"))


def _jobs_as_clusters(spark, sf_dir):
    b = P.boxes(spark, sf_dir)
    first = b.groupBy("job_id").agg(F.min("id").alias("cluster_id"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("id")) - 1
    ranked = b.join(first, "job_id").select("cluster_id", "id", place.alias("rank")).withColumn("role", F.when(F.col("rank") == 0, "medoid").otherwise("member"))
    look = lambda k: providers.from_table(b.select("id", F.col(k).alias("boxes")))
    return ranked, look("watermark_boxes"), look("comic_boxes")


@query("retry_counters", "WITH " + P.BOXES_SQL + f""", j AS (SELECT job_id, min(id) AS cluster_id, count(*) - 1 AS backups FROM boxes WHERE job_id IS NOT NULL GROUP BY job_id), v AS (SELECT j.*, {_REASON} AS reason FROM j JOIN boxes b ON b.id = j.cluster_id)
SELECT count(*) AS checked, count(*) FILTER (reason IS NULL) AS primary_pass, count(*) FILTER (reason IS NOT NULL AND backups > 0) AS retried FROM v""")
def retry_counters(spark, sf_dir):
    """The images of a job as a cluster: what its first image comes to, and how many of the failing have another to try."""
    return inspection.locate(*_jobs_as_clusters(spark, sf_dir), seed=11)[1].select("checked", "primary_pass", "retried")


@query("retry_outcomes", "WITH " + P.BOXES_SQL + f""", j AS (SELECT job_id, min(id) AS cluster_id, count(*) - 1 AS backups FROM boxes WHERE job_id IS NOT NULL GROUP BY job_id), v AS (SELECT j.*, {_REASON} IS NULL AS meets FROM j JOIN boxes b ON b.id = j.cluster_id)
SELECT cluster_id, CAST(CASE WHEN meets OR backups = 0 THEN 1 ELSE 2 END AS INTEGER) AS attempt, true AS consistent FROM v""")
def retry_outcomes(spark, sf_dir):
    """Of every cluster the attempts made, and whether the image named last, its verdict, role and reason agree with its boxes."""
    ranked, wm, comic = _jobs_as_clusters(spark, sf_dir)
    m = inspection.locate(ranked, wm, comic, seed=11)[0]
    b = P.boxes(spark, sf_dir).select("id", "job_id", inspection.verdict(F.col("watermark_boxes"), F.col("comic_boxes")).alias("own"))
    t = m.join(ranked.select("cluster_id", "id", "rank"), ["cluster_id", "id"], "left").join(b, "id")
    again = F.col("locate_attempt") == 2
    role = F.when(F.col("own").isNotNull(), "dropped").when(again, "backup_retry").otherwise("medoid")
    right = F.col("rank").isNotNull() & (again == (F.col("rank") > 0)) & F.col("reason").eqNullSafe(F.col("own")) & (F.col("candidate_role") == role) & ((F.col("status") == "passed") == F.col("own").isNull())
    return t.select("cluster_id", F.col("locate_attempt").cast("int").alias("attempt"), right.alias("consistent"))


@query("bypass_manifest", "WITH " + P.BOXES_SQL + ", j AS (SELECT min(id) AS cluster_id FROM boxes WHERE job_id IS NOT NULL GROUP BY job_id) SELECT row_number() OVER (ORDER BY cluster_id) AS index, cluster_id, cluster_id AS id, 'locate_bypassed' AS candidate_role, 0 AS locate_attempt, 'passed' AS status FROM j")
def bypass_manifest(spark, sf_dir):
    return inspection.manifest_index(inspection.bypass(_jobs_as_clusters(spark, sf_dir)[0])).select("index", "cluster_id", "id", "candidate_role", "locate_attempt", "status")


# Selection

_SHARES = ", ".join(f"('{d}', '{v}', {jobs.TARGETS[d].get(v, 'NULL')}::DOUBLE)" for d, values in features.DOMAIN.items() for v in values)


@query("selection_report", _FEATS + _KEYS + f""", chosen AS (SELECT k.* FROM keys k JOIN features f USING (image_id) ORDER BY f.people_confidence DESC, image_id LIMIT 200),
c AS (SELECT dimension, value, count(*) AS n FROM (SELECT 'people' AS dimension, people AS value FROM chosen UNION ALL SELECT 'framing', framing FROM chosen UNION ALL SELECT 'outdoors', outdoors FROM chosen) GROUP BY ALL)
SELECT d.dimension, d.value, d.target, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (SELECT count(*) FROM chosen)::DOUBLE, 9) AS share FROM (VALUES {_SHARES}) d(dimension, value, target) LEFT JOIN c USING (dimension, value)""")
def selection_report(spark, sf_dir):
    """The 200 images whose people count is surest as a selection: targets and what was reached."""
    f = cut(_derived(spark, sf_dir), "features")
    chosen = f.orderBy(F.desc("people_confidence"), "image_id").limit(200)
    return reports.selected_counts(f, chosen, jobs.TARGETS).withColumn("share", F.round("share", 9))


# Conflict rules


@query("caption_removals", _R + " " + oracle.removals(_LIMITS))
def caption_removals(spark, sf_dir):
    """What the conflict rules take away, and why."""
    tags, feats, aliases, _ = _inputs(spark, sf_dir)
    t = tagrules.threshold(tagrules.normalize(tags)[0], aliases, _LIMITS)[0]
    t = tagrules.canonicalize(tagrules.override(tagrules.deny(t, aliases, _LIMITS)[0], feats, aliases)[0], aliases)[0]
    return tagrules.resolve_conflicts(t, feats, _LIMITS)[1].select("image_id", F.col("stage").cast("int").alias("stage"), "tag", "score", "reason")


# The compiler over the rule tables

_SUFFIX = _TAG_VOCAB + ", longest AS (SELECT child AS src, arg_max(parent, length(parent)) AS dst FROM cand GROUP BY child)"
_CHAIN = _SUFFIX + ", chain(src, dst) AS (SELECT src, dst FROM longest UNION SELECT c.src, l.dst FROM chain c JOIN longest l ON l.src = c.dst), ends AS (SELECT src, dst FROM chain WHERE dst NOT IN (SELECT src FROM longest))"
_FINE = ", bad AS (SELECT DISTINCT node FROM up WHERE node = anc), fine AS (SELECT * FROM links WHERE child NOT IN (SELECT node FROM bad) AND parent NOT IN (SELECT node FROM bad))"


def _longest(spark, sf_dir):
    cand = _candidates(spark, sf_dir)[1]
    return cut(cand.groupBy(F.col("child").alias("src")).agg(F.max_by("parent", F.length("parent")).alias("dst")), "aliases")


@query("alias_chains", _CHAIN + " SELECT src, dst FROM ends")
def alias_chains(spark, sf_dir):
    """Every tag as an alias of its longest proper suffix that is a tag, chains followed to their ends."""
    return taxonomy.alias_closure(_longest(spark, sf_dir))


@query("canonical_links", _CHAIN + ", named AS (SELECT DISTINCT coalesce(a.dst, l.child) AS child, coalesce(b.dst, l.parent) AS parent FROM links l LEFT JOIN ends a ON a.src = l.child LEFT JOIN ends b ON b.src = l.parent) SELECT child, parent FROM named WHERE child <> parent")
def canonical_links(spark, sf_dir):
    links = _candidates(spark, sf_dir)[0]
    return taxonomy.canonical_edges(links, cut(taxonomy.alias_closure(_longest(spark, sf_dir)), "ends"), strict=False)


@query("implied_candidates", _CHAIN + ", kept AS (SELECT DISTINCT child AS tag FROM links), named AS (SELECT DISTINCT coalesce(a.dst, l.child) AS child, coalesce(b.dst, l.parent) AS parent FROM links l LEFT JOIN ends a ON a.src = l.child LEFT JOIN ends b ON b.src = l.parent) SELECT child, parent FROM named WHERE child <> parent AND child IN (SELECT tag FROM kept) AND parent IN (SELECT tag FROM kept)")
def implied_candidates(spark, sf_dir):
    """The links as active relations, over a vocabulary of the tags that have parents."""
    links = _candidates(spark, sf_dir)[0]
    vocab = links.select(F.col("child").alias("tag")).distinct()
    return taxonomy.implication_candidates(links.select(F.col("child").alias("antecedent"), F.col("parent").alias("consequent")), vocab, cut(taxonomy.alias_closure(_longest(spark, sf_dir)), "ends"))


@query("override_relations", _CHAIN + """, kept AS (SELECT DISTINCT child AS tag FROM links), named AS (SELECT DISTINCT coalesce(a.dst, l.child) AS child, coalesce(b.dst, l.parent) AS parent FROM links l LEFT JOIN ends a ON a.src = l.child LEFT JOIN ends b ON b.src = l.parent),
good AS (SELECT * FROM named WHERE child <> parent), bad AS (SELECT DISTINCT tag FROM (SELECT child AS tag FROM good UNION ALL SELECT parent FROM good) WHERE tag NOT IN (SELECT tag FROM kept))
SELECT child, parent, 'relation' AS kind FROM good WHERE child NOT IN (SELECT tag FROM bad) AND parent NOT IN (SELECT tag FROM bad) UNION ALL SELECT tag, NULL, 'unknown' FROM bad""")
def override_relations(spark, sf_dir):
    links = _candidates(spark, sf_dir)[0]
    vocab = links.select(F.col("child").alias("tag")).distinct()
    rel, unknown = taxonomy.override_relations(links, cut(taxonomy.alias_closure(_longest(spark, sf_dir)), "ends"), vocab)
    return rel.withColumn("kind", F.lit("relation")).union(unknown.select("tag", F.lit(None).cast("string"), F.lit("unknown")))


@query("merged_aliases", _SUFFIX + """, kept AS (SELECT DISTINCT child AS tag FROM links), shortest AS (SELECT child AS src, arg_min(parent, length(parent)) AS dst FROM cand WHERE length(child) > 14 GROUP BY child),
pick AS (SELECT l.src, coalesce(s.dst, l.dst) AS dst FROM longest l LEFT JOIN shortest s USING (src))
SELECT src, dst, src IN (SELECT tag FROM kept) AND dst IN (SELECT tag FROM kept) AS known FROM pick""")
def merged_aliases(spark, sf_dir):
    """Longest suffixes as active aliases, of long tags the shortest ones as manual aliases, over the tags that have parents."""
    links, cand = _candidates(spark, sf_dir)
    manual = cand.filter(F.length("child") > 14).groupBy(F.col("child").alias("src")).agg(F.min_by("parent", F.length("parent")).alias("dst"))
    known, unknown = taxonomy.merged_aliases(_longest(spark, sf_dir), manual, links.select(F.col("child").alias("tag")).distinct())
    return known.withColumn("known", F.lit(True)).union(unknown.select("src", "dst", F.lit(False)))


_CLOSED = ", c(child, parent) AS (SELECT * FROM fine UNION SELECT c.child, f.parent FROM c JOIN fine f ON c.parent = f.child)"
_REDUCED = ", lean AS (SELECT child, parent FROM fine f WHERE NOT EXISTS (SELECT 1 FROM fine q JOIN c ON c.child = q.parent WHERE q.child = f.child AND c.parent = f.parent))"


@query("rules_of_schema_1", _RULE_EDGES + _CLOSED + _REDUCED + " SELECT child, parent, true AS direct FROM lean UNION ALL SELECT child, parent, false FROM c")
def rules_of_schema_1(spark, sf_dir):
    none = P.pairs(spark, [("x", "x")], "src", "dst").limit(0)
    direct, runtime = taxonomy.load_v1(cut(_acyclic(spark, sf_dir), "edges"), none)
    return direct.select("child", "parent", F.lit(True).alias("direct")).union(runtime.select("child", "parent", F.lit(False)))


@query("compiled_rules", _TAG_VOCAB + _FINE.replace("fine AS (SELECT * FROM links WHERE", "fine AS (SELECT * FROM links WHERE length(child) < 14 AND") + _CLOSED + _REDUCED + """,
removed AS (SELECT child, parent FROM cand WHERE length(child) >= 14), runtime AS (SELECT child, parent FROM c EXCEPT SELECT child, parent FROM removed), review AS (SELECT child, parent FROM cand EXCEPT SELECT child, parent FROM c EXCEPT SELECT child, parent FROM removed)
SELECT child, parent, 'direct' AS kind FROM lean UNION ALL SELECT child, parent, 'runtime' FROM runtime UNION ALL SELECT child, parent, 'review' FROM review""")
def compiled_rules(spark, sf_dir):
    """Additions: the acyclic links of short tags; removals: the suffix candidates of long ones; candidates: all suffixes."""
    _, cand = _candidates(spark, sf_dir)
    cand = cut(cand, "candidates")
    additions = cut(_acyclic(spark, sf_dir).filter(F.length("child") < 14), "additions")
    parts = taxonomy.compile_rules(additions, cand.filter(F.length("child") >= 14), cand)
    rows = [df.select("child", "parent", F.lit(kind).alias("kind")) for kind, df in zip(("direct", "runtime", "review"), parts)]
    return rows[0].union(rows[1]).union(rows[2])


def _batches(spark, sf_dir):
    """The acyclic links as review batches over slices of 50 of the sorted vocabulary of all tags."""
    links = _acyclic(spark, sf_dir)
    nodes = cut(tree.links_of(table(spark, sf_dir, "parent_rules"), "child", ["child_to_direct_parents", "child_to_parents"])[1].withColumnRenamed("node", "tag"), "nodes")
    order = cut(numbered(nodes, ["tag"], "i").withColumn("k", F.floor(F.col("i") / 50)), "order")
    entry = links.groupBy("child").agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    per_tag = order.join(entry.withColumnRenamed("child", "tag"), "tag", "left")
    accepted = F.struct(F.col("tag").alias("child"), "parents", F.lit("strict_subtype").alias("relation_type"), F.lit("high").alias("confidence"), F.lit("").alias("rationale"))
    b = per_tag.groupBy("k").agg(F.min("i").cast("int").alias("range_start"), F.max("i").cast("int").alias("range_end"), F.transform(F.array_sort(F.collect_list(F.struct("i", "tag"))), lambda x: x["tag"]).alias("reviewed_tags"), F.collect_list(F.when(F.col("parents").isNotNull(), accepted)).alias("accepted"))
    none = lambda t: F.array().cast(f"array<struct<{t}>>")
    b = b.select(F.format_string("batch_%04d.json", "k").alias("batch"), F.lit(1).alias("schema_version"), F.lit("m").alias("model"), "range_start", "range_end", F.size("reviewed_tags").alias("reviewed_tag_count"), "reviewed_tags", "accepted", none("alias:string,canonical:string,confidence:string,rationale:string").alias("aliases"), none("child:string,possible_parent:string,rationale:string").alias("ambiguous"))
    return cut(b, "batches"), nodes, links


_BATCHED = _RULE_EDGES + ", place AS (SELECT node, printf('batch_%04d.json', (row_number() OVER (ORDER BY node) - 1) // 50) AS batch FROM nodes)"


@query("review_merge", _BATCHED + " SELECT child, parent, batch, length(child) >= 14 AS blocked FROM fine JOIN place ON node = child")
def review_merge(spark, sf_dir):
    """The acyclic links through review batches; those of long tags were removed by hand."""
    b, vocab, links = _batches(spark, sf_dir)
    got = taxonomy.merge_reviews(b, vocab, links.filter(F.length("child") >= 14), links.limit(0), "m")
    part = lambda k, blocked: got[k].select("child", "parent", F.col("evidence")[0]["batch"].alias("batch"), F.lit(blocked).alias("blocked"))
    return part("accepted", False).union(part("blocked", True))


@query("validated_rules", _BATCHED.replace("fine AS (SELECT * FROM links WHERE", "every AS (SELECT * FROM links WHERE child NOT IN (SELECT node FROM bad) AND parent NOT IN (SELECT node FROM bad)), fine AS (SELECT * FROM links WHERE length(child) < 14 AND") + _CLOSED + _REDUCED + """
SELECT child, parent, 'final' AS kind FROM lean UNION ALL SELECT child, parent, 'remove' FROM every WHERE length(child) >= 14""")
def validated_rules(spark, sf_dir):
    """The same batches validated: links of short tags are accepted, those of long ones rejected."""
    b, _, _ = _batches(spark, sf_dir)
    say = lambda e: F.transform(e["parents"], lambda p: F.struct(e["child"].alias("child"), p.alias("parent"), F.when(F.length(e["child"]) < 14, "accept").otherwise("reject").alias("decision"), F.lit("").alias("rationale")))
    v = b.withColumn("decisions", F.flatten(F.transform("accepted", say))).select(F.concat(F.lit("v_"), "batch").alias("batch"), "schema_version", "model", F.col("batch").alias("source_batch"), F.size("decisions").alias("reviewed_relation_count"), "decisions")
    none = P.pairs(spark, [("x", "x")]).limit(0)
    got = taxonomy.finalize_validations(b, cut(v, "validations"), none, none, True, "m")
    return got["final"].select("child", "parent", F.lit("final").alias("kind")).union(got["remove"].select("child", "parent", F.lit("remove")))
