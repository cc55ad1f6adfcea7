"""Queries of the core operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tag_form_sql
from ..operators import clusters, features, graph, inspection, review, scan, tagrules, taxonomy
from ..operators import hierarchy as tree
from ..storage import cut, table
from ..streaming import events
from . import flagship, jobs, oracle, providers
from . import proxies as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# Problem 4: parent-child links to full hierarchies

_LINKS = f"""
WITH RECURSIVE raw AS (
  SELECT child, unnest(list_concat(coalesce(child_to_direct_parents, []), coalesce(child_to_parents, []))) AS p FROM parent_rules),
links AS (SELECT DISTINCT child, parent FROM (SELECT {tag_form_sql("child")} AS child, {tag_form_sql("p")} AS parent FROM raw) WHERE child <> '' AND parent <> ''),
nodes AS (SELECT DISTINCT node FROM (SELECT {tag_form_sql("child")} AS node FROM parent_rules UNION ALL SELECT parent FROM links) WHERE node <> ''),
up(node, anc) AS (SELECT child, parent FROM links UNION SELECT up.node, links.parent FROM up JOIN links ON up.anc = links.child)
"""

_HIERARCHY = _LINKS + """,
cyc AS (SELECT a.node, min(a.anc) AS root FROM up a JOIN up b ON a.node = b.anc AND a.anc = b.node GROUP BY a.node),
below AS (SELECT DISTINCT node FROM up WHERE anc IN (SELECT node FROM cyc) AND node NOT IN (SELECT node FROM cyc)),
good AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM cyc) AND node NOT IN (SELECT node FROM below)),
straight AS (SELECT l.* FROM links l WHERE l.child IN (SELECT node FROM good) AND NOT EXISTS (
  SELECT 1 FROM links q JOIN up ON up.node = q.parent WHERE q.child = l.child AND up.anc = l.parent)),
ways(node, root, depth, path) AS (
  SELECT node, node, 0, node FROM good WHERE node NOT IN (SELECT child FROM straight)
  UNION ALL SELECT s.child, w.root, w.depth + 1, w.path || '/' || s.child FROM ways w JOIN straight s ON s.parent = w.node)
"""


def _rules(spark, sf_dir):
    return table(spark, sf_dir, "parent_rules")


@query("p4_found", _HIERARCHY + """
SELECT node AS tag, 'path' AS kind, root AS root_tag, depth AS tag_depth, path AS tag_path FROM ways
UNION ALL SELECT node, 'cycle', root, -1, '' FROM cyc UNION ALL SELECT node, 'below', '', -1, '' FROM below""")
def p4_found(spark, sf_dir):
    found = tree.hierarchy(_rules(spark, sf_dir), "child", ["child_to_direct_parents", "child_to_parents"])
    return found.select(F.col("node").alias("tag"), "kind", F.col("root").alias("root_tag"), F.col("depth").alias("tag_depth"), F.col("path").alias("tag_path"))


@query("p4_descendants", _LINKS + "SELECT anc AS tag, node AS descendant FROM up")
def p4_descendants(spark, sf_dir):
    """All descendants of every tag; a tag on a cycle is its own."""
    links, _ = tree.links_of(_rules(spark, sf_dir), "child", ["child_to_direct_parents", "child_to_parents"])
    return tree.ancestors(links).select(F.col("anc").alias("tag"), F.col("node").alias("descendant"))


# Scan: deduplication, size filter, counters, path order

_KEY = "string_split(path, '/')"
_COPIES = "WITH " + P.IMAGES_SQL + f""",
copies AS (SELECT *, CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN row_number() OVER (PARTITION BY sha256, width IS NOT NULL AND height IS NOT NULL ORDER BY {_KEY}, image_id) END AS copy FROM images)
"""


@query("scan_dedupe", _COPIES + "SELECT image_id, path, sha256 FROM copies WHERE copy = 1")
def scan_dedupe(spark, sf_dir):
    return scan.deduplicated(P.images(spark, sf_dir)).select("image_id", "path", "sha256")


@query("scan_resolution", _COPIES + "SELECT image_id, path FROM copies WHERE copy = 1 AND CAST(width AS BIGINT) * height >= 1000000")
def scan_resolution(spark, sf_dir):
    return scan.large_enough(scan.deduplicated(P.images(spark, sf_dir)), 1_000_000).select("image_id", "path")


@query("scan_stats", _COPIES + """
SELECT count(*) AS scanned_images, count(*) FILTER (copy IS NULL) AS invalid_images, count(*) FILTER (copy > 1) AS duplicate_images, count(*) FILTER (copy = 1) AS unique_images,
  count(*) FILTER (copy = 1 AND CAST(width AS BIGINT) * height < 1000000) AS below_resolution, count(*) FILTER (copy = 1 AND CAST(width AS BIGINT) * height >= 1000000) AS embedding_candidates FROM copies""")
def scan_stats(spark, sf_dir):
    return scan.scan_stats(P.images(spark, sf_dir), 1_000_000)


@query("extension_filter", "WITH " + P.IMAGES_SQL + r" SELECT image_id, path FROM images WHERE lower(regexp_extract(path, '[^/]\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png')")
def extension_filter(spark, sf_dir):
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return P.images(spark, sf_dir).filter(scan.is_image(F.col("path")) & suffix.isin("jpg", "jpeg", "png")).select("image_id", "path")


@query("path_order", "WITH " + P.IMAGES_SQL + f" SELECT job_id, image_id, row_number() OVER (PARTITION BY job_id ORDER BY {_KEY}, image_id) AS place FROM images")
def path_order(spark, sf_dir):
    w = Window.partitionBy("job_id").orderBy(scan.path_key(F.col("path")), "image_id")
    return P.images(spark, sf_dir).select("job_id", "image_id", F.row_number().over(w).alias("place"))


@query("resolution_label", "WITH " + P.IMAGES_SQL + r""" SELECT image_id, CASE WHEN px = 921600 THEN '720p' ELSE regexp_replace(CASE WHEN px >= 10000000 THEN printf('%.4f', px / 1e6) WHEN px >= 1000000 THEN printf('%.5f', px / 1e6) WHEN px >= 100000 THEN printf('%.6f', px / 1e6) ELSE printf('%.7f', px / 1e6) END, '\.?0+$', '') || 'MP' END AS label
FROM (SELECT image_id, CAST(width AS BIGINT) * height AS px FROM images)""")
def resolution_label(spark, sf_dir):
    return P.images(spark, sf_dir).select("image_id", scan.resolution_label(F.col("width").cast("long") * F.col("height")).alias("label"))


# Similarity graph over the vectors

_COS = "WITH RECURSIVE pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), near AS (SELECT * FROM pairs WHERE sim >= 0.30)"
_MUTUAL = _COS + """,
ways AS (SELECT * FROM near UNION ALL SELECT dst, src, sim FROM near),
best AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM ways),
edges AS (SELECT a.src, a.dst, a.sim FROM best a JOIN best b ON a.src = b.dst AND a.dst = b.src WHERE a.rank <= 20 AND b.rank <= 20 AND a.src < a.dst),
sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""
_CORE = _MUTUAL + """,
peel(round, src, dst) AS (SELECT 0, src, dst FROM sym UNION ALL SELECT round + 1, src, dst FROM
  (SELECT *, count(*) OVER (PARTITION BY src) AS ds, count(*) OVER (PARTITION BY dst) AS dd FROM peel) WHERE ds >= 3 AND dd >= 3 AND round < 60),
core AS (SELECT DISTINCT src AS node FROM peel WHERE round = 60),
inside AS (SELECT s.src, s.dst FROM sym s WHERE s.src IN (SELECT node FROM core) AND s.dst IN (SELECT node FROM core)),
reach(node, label) AS (SELECT node, node FROM core UNION SELECT i.dst, r.label FROM reach r JOIN inside i ON i.src = r.node WHERE r.label < i.dst),
label AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
sizes AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS component FROM label GROUP BY label)"""


def _graph(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    nodes = v.select(F.col("vec_id").alias("node")).distinct()
    return nodes, cut(graph.mutual_top_k(graph.cosine_pairs(v, 0.30), 20), "mutual")


@query("cosine_pairs", _COS + " SELECT src, dst, sim FROM near")
def cosine_pairs(spark, sf_dir):
    return graph.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.30)


@query("topk_neighbors", _MUTUAL + " SELECT src, dst, sim, rank FROM best WHERE rank <= 20")
def topk_neighbors(spark, sf_dir):
    return graph.top_k(graph.symmetric(graph.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.30)), 20)


@query("mutual_topk_edges", _MUTUAL + " SELECT src, dst, sim FROM edges")
def mutual_topk_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query("graph_degree", _MUTUAL + " SELECT vec_id AS node, count(s.src) AS degree FROM embeddings LEFT JOIN sym s ON s.src = vec_id GROUP BY vec_id")
def graph_degree(spark, sf_dir):
    return graph.degrees(*_graph(spark, sf_dir))


@query("k_core", _CORE + " SELECT node FROM core")
def k_core(spark, sf_dir):
    return graph.k_core(*_graph(spark, sf_dir), 3)


@query("components", _CORE + " SELECT node, component, size FROM label JOIN sizes USING (label)")
def components(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    core = cut(graph.k_core(nodes, edges, 3), "core")
    inside = edges.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi")
    return graph.components(core, inside)


@query("largest_component", _CORE + " SELECT node FROM label JOIN sizes USING (label) WHERE component = 1")
def largest_component(spark, sf_dir):
    return graph.keep_largest(*_graph(spark, sf_dir), 3)[0]


@query("graph_audit", _CORE + """ SELECT (SELECT count(DISTINCT vec_id) FROM embeddings) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT src) FROM sym) AS nodes_with_edges,
(SELECT count(*) FROM core) AS core_nodes, (SELECT count(*) FROM sizes) AS components""")
def graph_audit(spark, sf_dir):
    return graph.keep_largest(*_graph(spark, sf_dir), 3)[1]


# Clusters: given labels, and complete linkage

_DOTS = """WITH v AS (SELECT vec_id AS id, label AS cluster_id, embedding::DOUBLE[] AS v FROM embeddings),
dots AS (SELECT a.cluster_id, a.id, b.id AS other, list_dot_product(a.v, b.v) AS d FROM v a JOIN v b ON a.cluster_id = b.cluster_id),
sums AS (SELECT cluster_id, id, round(sum(d), 9) AS s FROM dots GROUP BY ALL),
med AS (SELECT cluster_id, id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, id) AS rn FROM sums) WHERE rn = 1),
ranked AS (SELECT d.cluster_id, d.id, CASE WHEN d.id = m.medoid THEN 'medoid' ELSE 'member' END AS role, greatest(least(d.d, 1), -1) AS sim,
  row_number() OVER (PARTITION BY d.cluster_id ORDER BY d.id = m.medoid DESC, round(greatest(least(d.d, 1), -1), 9) DESC, lpad(d.id::VARCHAR, 9, '0')) - 1 AS rank FROM dots d JOIN med m ON m.cluster_id = d.cluster_id AND d.other = m.medoid)
"""


def _labelled(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("id"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("v"))


@query("cluster_medoid", _DOTS + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, medoid FROM med")
def cluster_medoid(spark, sf_dir):
    return clusters.medoids(_labelled(spark, sf_dir)).filter("rank = 0").select("cluster_id", F.col("id").alias("medoid"))


@query("backups", _DOTS + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, id, rank, round(sim, 6) AS sim FROM ranked WHERE rank > 0")
def backups(spark, sf_dir):
    return clusters.medoids(_labelled(spark, sf_dir)).filter("rank > 0").select("cluster_id", "id", F.col("rank").cast("long").alias("rank"), F.round("sim_to_medoid", 6).alias("sim"))


@query("cluster_audit", _DOTS + """SELECT CAST(r.cluster_id AS BIGINT) AS cluster_id, count(*) AS size, round(any_value(l.low), 6) AS min_similarity, list(r.id ORDER BY r.rank) AS members
FROM ranked r JOIN (SELECT cluster_id, min(greatest(least(d, 1), -1)) AS low FROM dots WHERE id <> other GROUP BY cluster_id) l USING (cluster_id) GROUP BY r.cluster_id""")
def cluster_audit(spark, sf_dir):
    a = clusters.audit(clusters.medoids(_labelled(spark, sf_dir)))
    return a.select("cluster_id", "size", F.round("min_similarity", 6).alias("min_similarity"), F.transform("members", lambda m: m["id"]).alias("members"))


@query("cluster_numbering", "WITH " + P.IMAGES_SQL + " SELECT image_id, dense_rank() OVER (ORDER BY first) - 1 AS cluster_id FROM (SELECT image_id, min(path) OVER (PARTITION BY sha256) AS first FROM images)")
def cluster_numbering(spark, sf_dir):
    m = P.images(spark, sf_dir).select(F.col("image_id").alias("id"), "path", F.col("sha256").alias("group"))
    return clusters.number(m).select(F.col("id").alias("image_id"), F.col("cluster_id").cast("long").alias("cluster_id"))


@query("complete_linkage")
def complete_linkage(spark, sf_dir):
    return clusters.complete_linkage_clusters(table(spark, sf_dir, "embeddings"), 0.45)


# Inspection

_REASON = "CASE WHEN wm > 0 THEN 'watermark_detected' WHEN comic > 1 THEN 'comic_or_collage_detected' END"


@query("inspect_verdict", "WITH " + P.BOXES_SQL + f" SELECT id, {_REASON} AS reason, {_REASON} IS NULL AS meets FROM boxes")
def inspect_verdict(spark, sf_dir):
    reason = inspection.verdict(F.col("watermark_boxes"), F.col("comic_boxes"))
    return P.boxes(spark, sf_dir).select("id", reason.alias("reason"), reason.isNull().alias("meets"))


@query("inspect_counters", "WITH " + P.BOXES_SQL + f", v AS (SELECT {_REASON} AS reason FROM boxes) SELECT count(*) AS checked, count(*) FILTER (reason IS NULL) AS primary_pass, 0 AS retried, 0 AS retry_pass, count(*) FILTER (reason IS NOT NULL) AS dropped FROM v")
def inspect_counters(spark, sf_dir):
    """Every image as its own cluster, without retry, through the two-pass policy."""
    b = P.boxes(spark, sf_dir)
    ranked = b.select(F.col("id").alias("cluster_id"), "id", F.lit("medoid").alias("role"), F.lit(0).alias("rank"))
    look = lambda k: providers.from_table(b.select("id", F.col(k).alias("boxes")))
    c = inspection.locate(ranked, look("watermark_boxes"), look("comic_boxes"), seed=1, retry=False)[1]
    return c.select("checked", "primary_pass", F.col("retried").cast("int").alias("retried"), F.col("retry_pass").cast("int").alias("retry_pass"), "dropped")


@query("retry_choice")
def retry_choice(spark, sf_dir):
    """The manifest of jobs as clusters: the first image, then one seeded random other."""
    b = P.boxes(spark, sf_dir)
    w = Window.partitionBy("job_id").orderBy("id")
    ids = b.groupBy("job_id").agg(F.min("id").alias("cluster_id"))
    ranked = b.join(ids, "job_id").select("cluster_id", "id", (F.row_number().over(w) - 1).alias("rank")).withColumn("role", F.when(F.col("rank") == 0, "medoid").otherwise("member"))
    look = lambda k: providers.from_table(b.select("id", F.col(k).alias("boxes")))
    return inspection.locate(ranked, look("watermark_boxes"), look("comic_boxes"), seed=11)[0]


_TOKENS = "concat('<box><', id % 500, '><', id % 300, '><', id % 400 + 500, '><', id % 200 + 700, '></box> and <box><1><2><3><4></box>')"


@query("box_tokens", "WITH " + P.IMAGES_SQL + ", i AS (SELECT image_id AS id, width, height FROM images) SELECT id, [[round((id % 500) * (width / 1000.0::DOUBLE), 6), round((id % 300) * (height / 1000.0::DOUBLE), 6), round((id % 400 + 500) * (width / 1000.0::DOUBLE), 6), round((id % 200 + 700) * (height / 1000.0::DOUBLE), 6)], [round(width / 1000.0::DOUBLE, 6), round(2 * (height / 1000.0::DOUBLE), 6), round(3 * (width / 1000.0::DOUBLE), 6), round(4 * (height / 1000.0::DOUBLE), 6)]] AS boxes FROM i")
def box_tokens(spark, sf_dir):
    i = P.images(spark, sf_dir).withColumnRenamed("image_id", "id")
    got = inspection.box_tokens(F.expr(_TOKENS), F.col("width"), F.col("height"))
    return i.select("id", F.transform(got, lambda b: F.transform(b, lambda v: F.round(v, 6))).alias("boxes"))


@query("box_normalize", "WITH " + P.IMAGES_SQL + """, b AS (SELECT image_id, width, height, image_id % 1500 AS x, image_id % 900 AS y FROM images)
SELECT image_id, list_transform(CASE WHEN x + 100 > width OR y + 50 > height THEN [x / 1000.0::DOUBLE, y / 1000.0::DOUBLE, (x + 100) / 1000.0::DOUBLE, (y + 50) / 1000.0::DOUBLE] ELSE [x / width::DOUBLE, y / height::DOUBLE, (x + 100) / width::DOUBLE, (y + 50) / height::DOUBLE] END, lambda v: round(greatest(least(v, 1.0::DOUBLE), 0.0::DOUBLE), 9)) AS box FROM b""")
def box_normalize(spark, sf_dir):
    x, y = F.col("image_id") % 1500, F.col("image_id") % 900
    raw = F.array(F.array(*(c.cast("double") for c in (x, y, x + 100, y + 50))), F.array(F.lit(1.0)))
    got = F.get(inspection.display_boxes(raw, F.col("width"), F.col("height")), F.lit(0))
    return P.images(spark, sf_dir).select("image_id", F.transform(got, lambda v: F.round(v, 9)).alias("box"))


# Features and their distribution


def _best_sql(names: list[str], like: str = "") -> str:
    inside = ", ".join(f"'{n}'" for n in names)
    return f"greatest(coalesce(max({{'s': score, 't': tag}}) FILTER (tag IN ({inside}){like}), {{'s': 0.0::DOUBLE, 't': '{max(names)}'}}), {{'s': 0.0::DOUBLE, 't': '{max(names)}'}})"


def _score_sql(name: str) -> str:
    return f"coalesce(max(score) FILTER (tag = '{name}'), 0.0::DOUBLE)"


_FEATURES = f"""agg AS (SELECT image_id, {_best_sql(['1girl', '1boy', '1other', 'solo'])} AS one, {_best_sql(['2girls', '2boys', '2others', 'duo', 'couple'])} AS two,
  least({_score_sql('1girl')}, {_score_sql('1boy')}) AS mixed, {_best_sql(['group', 'multiple_girls', 'multiple_boys', 'multiple_others'], " OR regexp_matches(tag, '^([3-9]|[0-9]{2,})(girls|boys|others)$')")} AS three,
  {_score_sql('full_body')} AS full_, {_score_sql('cowboy_shot')} AS cowboy, {_score_sql('upper_body')} AS upper_, {_score_sql('close-up')} AS c1, {_score_sql('close_up')} AS c2,
  {_score_sql('outdoors')} AS out_, {_best_sql(['indoors', 'bedroom', 'classroom', 'office', 'kitchen', 'bathroom', 'living_room'])} AS ins FROM tags_long GROUP BY image_id),
pre AS (SELECT *, CASE WHEN mixed > two.s THEN {{'s': mixed, 't': '1girl+1boy'}} ELSE two END AS two2, greatest(cowboy, upper_) AS half, greatest(c1, c2) AS head FROM agg),
conf AS (SELECT *, greatest(three.s, two2.s, one.s) AS pc, greatest(full_, half, head) AS fc,
  out_ >= 0.35 AND out_ >= ins.s + 0.05 AS is_out, ins.s >= 0.35 AND ins.s >= out_ + 0.05 AS is_in FROM pre),
features AS (SELECT image_id, CASE WHEN pc < 0.35 THEN 'unknown' WHEN three.s = pc THEN '3_plus' WHEN two2.s = pc THEN '2' ELSE '1' END AS people,
  CASE WHEN pc < 0.35 THEN NULL WHEN three.s = pc THEN three.t WHEN two2.s = pc THEN two2.t ELSE one.t END AS people_source, pc AS people_confidence,
  CASE WHEN fc < 0.35 THEN 'unknown' WHEN full_ = fc THEN 'full_body' WHEN half = fc THEN 'half_body' ELSE 'headshot' END AS framing,
  CASE WHEN fc < 0.35 THEN NULL WHEN full_ = fc THEN 'full_body' WHEN half = fc THEN CASE WHEN cowboy >= upper_ THEN 'cowboy_shot' ELSE 'upper_body' END WHEN c1 >= c2 THEN 'close-up' ELSE 'close_up' END AS framing_source, fc AS framing_confidence,
  CASE WHEN is_out THEN true WHEN is_in THEN false END AS outdoors, CASE WHEN is_out THEN 'outdoors' WHEN is_in THEN ins.t END AS outdoors_source,
  CASE WHEN is_out THEN out_ WHEN is_in THEN ins.s ELSE greatest(out_, ins.s) END AS outdoors_confidence FROM conf)"""
_FEATS = "WITH " + P.TAGS_SQL + ", " + _FEATURES


def _status_sql(conf: str, known: str) -> str:
    return f"CASE WHEN NOT ({known}) THEN 'unknown' WHEN {conf} >= 0.65 THEN 'high' WHEN {conf} >= 0.40 THEN 'medium' ELSE 'low' END"


def _derived(spark, sf_dir):
    return features.derive(P.tags_long(spark, sf_dir))


for _d, _known in (("people", "people <> 'unknown'"), ("framing", "framing <> 'unknown'"), ("outdoors", "outdoors IS NOT NULL")):

    def _one(spark, sf_dir, d=_d):
        return _derived(spark, sf_dir).select("image_id", d, f"{d}_source", f"{d}_confidence", f"{d}_status")

    query(f"features_{_d}", _FEATS + f" SELECT image_id, {_d}, {_d}_source, {_d}_confidence, {_status_sql(f'{_d}_confidence', _known)} AS {_d}_status FROM features")(_one)

_KEYS = ", keys AS (SELECT image_id, people, framing, coalesce(outdoors::VARCHAR, 'unknown') AS outdoors FROM features)"
_COUNTED = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value FROM keys" for d in ("people", "framing", "outdoors"))
_DOMAIN = ", ".join(f"('{d}', '{v}')" for d, vs in features.DOMAIN.items() for v in vs)


@query("distribution", _FEATS + _KEYS + f", c AS (SELECT dimension, value, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL) SELECT d.dimension, d.value, coalesce(c.n, 0) AS n FROM (VALUES {_DOMAIN}) d(dimension, value) LEFT JOIN c USING (dimension, value)")
def distribution(spark, sf_dir):
    return features.distribution(_derived(spark, sf_dir))


@query("distribution_sets", _FEATS + _KEYS + f" SELECT dimension, value, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL")
def distribution_sets(spark, sf_dir):
    return features.distribution_sets(_derived(spark, sf_dir))


@query("distribution_share", _FEATS + _KEYS + f", c AS (SELECT dimension, value, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL) SELECT dimension, value, n, CAST(floor(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dimension) + 0.5) AS INTEGER) AS percent FROM c")
def distribution_share(spark, sf_dir):
    return review.shares(features.distribution_sets(_derived(spark, sf_dir)))


def _greedy_sql(size: int) -> str:
    """The selection step by step: of the heads of all classes the one with the highest score, :func:`features.select`'s rule."""
    known = {d: f"CASE WHEN {d} <> 'unknown' THEN {d}_confidence END" for d in features.DOMAIN}
    total = " + ".join(f"coalesce({k}, 0.0::DOUBLE)" for k in known.values())
    count = " + ".join(f"CASE WHEN {d} <> 'unknown' THEN 1 ELSE 0 END" for d in features.DOMAIN)

    def gain(d):
        want = "(CASE c[i]." + d + " " + " ".join(f"WHEN '{v}' THEN {w!r}::DOUBLE" for v, w in features.normalized(jobs.TARGETS[d]).items()) + " ELSE 0.0::DOUBLE END * lim)"
        taken = f"list_sum(list_transform(range(1, len(c) + 1), lambda j: CASE WHEN c[j].{d} = c[i].{d} THEN took[j] ELSE 0 END))"
        return f"CASE WHEN c[i].{d} = 'unknown' THEN 0.0::DOUBLE ELSE {features.WEIGHTS[d]}::DOUBLE * greatest({want} - {taken}, 0.0::DOUBLE) / greatest({want}, 1.0::DOUBLE) END"

    score = " + ".join(gain(d) for d in features.DOMAIN)
    keys = _KEYS.replace("SELECT image_id,", "SELECT image_id, people_confidence, framing_confidence, outdoors_confidence,")
    return "WITH RECURSIVE " + _FEATS[len("WITH ") :] + keys + f""",
means AS (SELECT *, CASE WHEN {count} > 0 THEN ({total}) / ({count}) ELSE 0.0::DOUBLE END AS m FROM keys),
lists AS (SELECT people, framing, outdoors, list(m ORDER BY m DESC, image_id DESC)[1:{size}] AS ms, list(image_id ORDER BY m DESC, image_id DESC)[1:{size}] AS ids FROM means GROUP BY ALL),
one AS (SELECT list({{'people': people, 'framing': framing, 'outdoors': outdoors, 'ms': ms, 'ids': ids}} ORDER BY people, framing, outdoors) AS c, (SELECT least({size}, count(*)) FROM keys) AS lim FROM lists),
step(rank, image_id, took) AS (SELECT 0, NULL::BIGINT, list_transform(c, lambda x: 0) FROM one
  UNION ALL SELECT rank + 1, best.image, list_transform(range(1, len(took) + 1), lambda i: took[i] + CASE WHEN i = best.i THEN 1 ELSE 0 END) FROM (
    SELECT rank, took, list_sort(list_transform(list_filter(range(1, len(c) + 1), lambda i: took[i] < len(c[i].ids)),
      lambda i: {{'s': {score} + 0.1::DOUBLE * c[i].ms[took[i] + 1], 'm': c[i].ms[took[i] + 1], 'image': c[i].ids[took[i] + 1], 'i': i}}), 'DESC')[1] AS best FROM step, one WHERE rank < lim))
SELECT image_id, rank FROM step WHERE rank > 0"""


@query("select_greedy", _greedy_sql(200))
def select_greedy(spark, sf_dir):
    return features.select(cut(_derived(spark, sf_dir), "features"), 200, jobs.TARGETS)


# Tag rules, stage by stage, then all together

_LIMITS = tagrules.CaptionLimits(threshold=0.40, soft=10, hard=12)
_RULES = P.TAGS_SQL + ", " + _FEATURES + ", " + P.ALIAS_SQL + ", " + oracle.stages(_LIMITS)
_R = "WITH RECURSIVE " + P.CLOSURE_SQL + ", " + _RULES


def _inputs(spark, sf_dir):
    tags = cut(P.tags_long(spark, sf_dir), "tags")
    return tags, cut(features.derive(tags), "features"), cut(taxonomy.alias_closure(P.pairs(spark, P.ALIASES, "src", "dst")), "aliases"), cut(taxonomy.closure(P.pairs(spark, P.EDGES)), "closure")


def _upto(spark, sf_dir, stage: int):
    """(kept, audit of the last stage) after the first ``stage`` stages."""
    tags, feats, aliases, closure = _inputs(spark, sf_dir)
    steps = [
        lambda t: tagrules.normalize(t), lambda t: tagrules.threshold(t, aliases, _LIMITS), lambda t: tagrules.deny(t, aliases, _LIMITS), lambda t: tagrules.override(t, feats, aliases),
        lambda t: tagrules.canonicalize(t, aliases), lambda t: tagrules.resolve_conflicts(t, feats, _LIMITS), lambda t: tagrules.drop_parents(t, closure), lambda t: tagrules.round_robin(t, _LIMITS)]
    log = None
    for s in steps[:stage]:
        tags, log = s(tags)
    return tags, log


for _k, (_name, _table) in enumerate([("tag_normalize", "s1"), ("tag_threshold", "s2"), ("tag_denylist", "s3"), ("tag_override", "s4"), ("tag_alias", "s5"), ("tag_conflicts", "s8"), ("tag_redundant_parents", "s9"), ("tag_round_robin", "s11")], 1):

    def _stage(spark, sf_dir, k=_k):
        return _upto(spark, sf_dir, k)[0].select("image_id", "tag", "score")

    query(_name, _R + f" SELECT image_id, tag, score FROM {_table}")(_stage)


@query("tag_category", _R + f" SELECT DISTINCT tag, {oracle.category('tag')} AS category FROM s9")
def tag_category(spark, sf_dir):
    return _upto(spark, sf_dir, 7)[0].select("tag", tagrules.category(F.col("tag")).alias("category")).distinct()


@query("caption_join", _R + " SELECT f.image_id, 'style' || coalesce(string_agg(', ' || tag, '' ORDER BY pos), '') AS caption FROM features f LEFT JOIN s11 USING (image_id) GROUP BY f.image_id")
def caption_join(spark, sf_dir):
    return tagrules.captions(*_inputs(spark, sf_dir), "style", _LIMITS)[0].select("image_id", "caption")


@query("caption_audit_counts", _R + oracle.AUDIT_COUNTS)
def caption_audit_counts(spark, sf_dir):
    log = tagrules.captions(*_inputs(spark, sf_dir), "style", _LIMITS)[1]
    return log.filter("stage NOT IN (6, 7, 8)").groupBy("stage").agg(F.count("*").alias("n"))


@query("caption_audit")
def caption_audit(spark, sf_dir):
    return tagrules.captions(*_inputs(spark, sf_dir), "style", _LIMITS)[1]


# Taxonomy and its compiler

_RULE_EDGES = _LINKS + ", bad AS (SELECT DISTINCT node FROM up WHERE node = anc), fine AS (SELECT * FROM links WHERE child NOT IN (SELECT node FROM bad) AND parent NOT IN (SELECT node FROM bad))"


def _acyclic(spark, sf_dir):
    links, _ = tree.links_of(_rules(spark, sf_dir), "child", ["child_to_direct_parents", "child_to_parents"])
    links = cut(links, "links")
    bad = cut(taxonomy.cycles(links).select("tag"), "bad")
    for side in ("child", "parent"):
        links = links.join(bad.select(F.col("tag").alias(side)), side, "left_anti")
    return links.select("child", "parent")


@query("dag_cycles", _LINKS + "SELECT DISTINCT node AS tag FROM up WHERE node = anc")
def dag_cycles(spark, sf_dir):
    links, _ = tree.links_of(_rules(spark, sf_dir), "child", ["child_to_direct_parents", "child_to_parents"])
    return taxonomy.cycles(cut(links, "links")).select("tag")


@query("dag_closure", _RULE_EDGES + ", c(child, parent) AS (SELECT * FROM fine UNION SELECT c.child, f.parent FROM c JOIN fine f ON c.parent = f.child) SELECT child, parent FROM c")
def dag_closure(spark, sf_dir):
    return taxonomy.closure(cut(_acyclic(spark, sf_dir), "edges"))


@query("dag_reduction", _RULE_EDGES + """, c(child, parent) AS (SELECT * FROM fine UNION SELECT c.child, f.parent FROM c JOIN fine f ON c.parent = f.child)
SELECT child, parent FROM fine f WHERE NOT EXISTS (SELECT 1 FROM fine q JOIN c ON c.child = q.parent WHERE q.child = f.child AND c.parent = f.parent)""")
def dag_reduction(spark, sf_dir):
    return taxonomy.reduction(cut(_acyclic(spark, sf_dir), "edges"))


@query("alias_closure", "WITH " + P.ALIAS_SQL + " SELECT src, dst FROM aliases")
def alias_closure(spark, sf_dir):
    return taxonomy.alias_closure(P.pairs(spark, P.ALIASES, "src", "dst"))


@query("blocked_closure", "WITH RECURSIVE " + P.CLOSURE_SQL + " SELECT child, parent FROM closure WHERE NOT (child = 'leaf' AND parent = 'root')")
def blocked_closure(spark, sf_dir):
    return taxonomy.load_v2(P.pairs(spark, P.EDGES), P.pairs(spark, P.BLOCKED), P.pairs(spark, P.ALIASES, "src", "dst"))


@query("relation_counts", "WITH RECURSIVE " + P.CLOSURE_SQL + " SELECT (SELECT count(*) FROM edges) AS direct, (SELECT count(*) FROM closure c WHERE NOT (c.child = 'leaf' AND c.parent = 'root')) AS runtime, CAST(1 AS BIGINT) AS blocked")
def relation_counts(spark, sf_dir):
    d, b = P.pairs(spark, P.EDGES), P.pairs(spark, P.BLOCKED)
    run = taxonomy.load_v2(d, b, P.pairs(spark, P.ALIASES, "src", "dst"))
    return taxonomy.relation_counts(d, run, b)


@query("redundant_parents", "WITH RECURSIVE " + P.CLOSURE_SQL + ", " + P.TAGS_SQL + ", " + P.ALIAS_SQL + f""",
n AS (SELECT image_id, {tag_form_sql('tag')} AS t, score FROM tags_long), c AS (SELECT image_id, coalesce(dst, t) AS tag, max(score) AS score FROM n LEFT JOIN aliases ON src = t GROUP BY ALL)
SELECT image_id, tag, score FROM c WHERE NOT EXISTS (SELECT 1 FROM c d JOIN closure x ON x.child = d.tag WHERE d.image_id = c.image_id AND x.parent = c.tag)""")
def redundant_parents(spark, sf_dir):
    tags, _, aliases, closure = _inputs(spark, sf_dir)
    return taxonomy.without_parents(tags.withColumnRenamed("image_id", "id"), closure, aliases).select(F.col("id").alias("image_id"), "tag", "score")


_TAG_VOCAB = _LINKS + ", words AS (SELECT node, string_split(node, '_') AS p FROM nodes), cand AS (SELECT DISTINCT w.node AS child, n.node AS parent FROM (SELECT node, array_to_string(p[i:], '_') AS suffix FROM (SELECT node, p, unnest(range(2, len(p) + 1)) AS i FROM words)) w JOIN nodes n ON n.node = w.suffix)"


def _candidates(spark, sf_dir):
    links, nodes = tree.links_of(_rules(spark, sf_dir), "child", ["child_to_direct_parents", "child_to_parents"])
    return cut(links, "links"), taxonomy.structural_candidates(cut(nodes.withColumnRenamed("node", "tag"), "vocab"))


@query("structural_candidates", _TAG_VOCAB + " SELECT child, parent FROM cand")
def structural_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)[1]


@query("candidate_sources", _TAG_VOCAB + ", s AS (SELECT child, parent, 'structural' AS source FROM cand UNION SELECT child, parent, 'rules' FROM links) SELECT child, parent, list_sort(list(DISTINCT source)) AS sources FROM s GROUP BY ALL")
def candidate_sources(spark, sf_dir):
    links, cand = _candidates(spark, sf_dir)
    return taxonomy.provenance(structural=cand, rules=links)


@query("review_candidates", _TAG_VOCAB + " SELECT child, parent FROM cand WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.node = child AND up.anc = parent)")
def review_candidates(spark, sf_dir):
    links, cand = _candidates(spark, sf_dir)
    return cand.join(taxonomy.closure(links), ["child", "parent"], "left_anti")


# Event log, review and views

_EVENTS = "WITH log AS (SELECT user_id::VARCHAR AS job_id, event_id AS id, event_type AS stage, value FROM events)"


@query("event_latest_state", _EVENTS + " SELECT job_id, arg_max(stage, id) AS stage, max(id) AS id FROM log GROUP BY job_id")
def event_latest_state(spark, sf_dir):
    return events.state(P.events(spark, sf_dir)).select("job_id", "stage", "id")


@query("event_stats_fold", _EVENTS + " SELECT job_id, stage AS key, arg_max(value, id) AS value, max(id) AS id FROM log GROUP BY ALL")
def event_stats_fold(spark, sf_dir):
    return events.stats(P.events(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))


@query("event_replay_after", _EVENTS + " SELECT job_id, id FROM log WHERE id > 5000")
def event_replay_after(spark, sf_dir):
    return events.replay(P.events(spark, sf_dir), 5000).select("job_id", "id")


_MANIFEST = "WITH " + P.BOXES_SQL + f""",
manifest AS (SELECT id AS index, job_id, CASE WHEN {_REASON} IS NULL THEN 'passed' ELSE 'not_meet' END AS status, CASE WHEN {_REASON} IS NULL THEN 'out/' || id END AS output, {_REASON} AS reason, CASE WHEN id % 3 = 0 THEN 'backup_retry' ELSE 'medoid' END AS candidate_role FROM boxes),
actions AS (SELECT event_id AS seq, user_id AS index, CASE WHEN event_type IN ('error', 'view') THEN 'remove' ELSE 'restore' END AS action FROM events),
last AS (SELECT index, arg_max(action, seq) AS action FROM actions GROUP BY index),
reviewed AS (SELECT m.*, coalesce(l.action = 'remove' AND m.status = 'passed', false) AS gone FROM manifest m LEFT JOIN last l USING (index)),
done AS (SELECT index, CASE WHEN gone THEN 'removed_by_review' ELSE status END AS status, CASE WHEN NOT gone THEN output END AS output, CASE WHEN gone THEN 'removed_by_review' ELSE reason END AS reason, candidate_role FROM reviewed)"""


def _manifest(spark, sf_dir):
    reason = inspection.verdict(F.col("watermark_boxes"), F.col("comic_boxes"))
    m = P.boxes(spark, sf_dir).select(F.col("id").alias("index"), F.when(reason.isNull(), "passed").otherwise("not_meet").alias("status"), F.when(reason.isNull(), F.concat(F.lit("out/"), F.col("id").cast("string"))).alias("output"), reason.alias("reason"), F.when(F.col("id") % 3 == 0, "backup_retry").otherwise("medoid").alias("candidate_role"))
    act = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("index"), F.when(F.col("event_type").isin("error", "view"), "remove").otherwise("restore").alias("action"), F.col("ts").alias("at"))
    return review.apply_actions(m, act)


@query("review_latest", _MANIFEST + " SELECT index, status, output, reason FROM done")
def review_latest(spark, sf_dir):
    return _manifest(spark, sf_dir).select("index", "status", "output", "reason")


@query("output_recount", _MANIFEST + " SELECT count(*) AS output_images FROM done WHERE status = 'passed' AND output <> ''")
def output_recount(spark, sf_dir):
    return review.output_count(_manifest(spark, sf_dir))


@query("review_page", _MANIFEST + " SELECT index, output FROM done WHERE status = 'passed' AND output <> '' ORDER BY index LIMIT 50 OFFSET 50")
def review_page(spark, sf_dir):
    return review.gallery_page(cut(_manifest(spark, sf_dir), "manifest"), 1).select("index", "output")


@query("result_label", _MANIFEST + " SELECT index, CASE WHEN status = 'removed_by_review' THEN 'removed' WHEN status = 'passed' AND candidate_role = 'backup_retry' THEN 'retry_pass' WHEN status = 'passed' THEN 'pass' ELSE 'dropped' END AS label FROM done")
def result_label(spark, sf_dir):
    return _manifest(spark, sf_dir).select("index", review.result_label(F.col("status"), F.col("candidate_role")).alias("label"))


_SIZES = "WITH c AS (SELECT DISTINCT job_id, cluster_id, len(members) AS size FROM clusters), kept AS (SELECT DISTINCT job_id, cluster_id FROM clusters WHERE len(members) > 1)"


@query("audit_view", _SIZES + " SELECT 'all' AS show, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS images FROM c UNION ALL SELECT 'kept', count(*), CAST(sum(size) AS BIGINT) FROM c SEMI JOIN kept USING (job_id, cluster_id) UNION ALL SELECT 'excluded', count(*), CAST(sum(size) AS BIGINT) FROM c ANTI JOIN kept USING (job_id, cluster_id)")
def audit_view(spark, sf_dir):
    t = table(spark, sf_dir, "clusters").select(F.struct("job_id", "cluster_id").alias("cluster_id"), F.size("members").alias("size"), F.col("members").isNotNull().alias("ok"))
    c = t.withColumn("size", F.when(F.col("ok"), F.col("size"))).select("cluster_id", "size").distinct()
    kept = c.filter("size > 1").select("cluster_id").distinct()
    out = [review.audit_view(c, kept, s).agg(F.count("*").alias("clusters"), F.sum("size").alias("images")).select(F.lit(s).alias("show"), "clusters", "images") for s in ("all", "kept", "excluded")]
    return out[0].union(out[1]).union(out[2])


@query("selected_gallery", """WITH newest AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tagged_at DESC, loaded_at DESC) AS rn FROM curated_items),
r AS (SELECT image_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY people_confidence DESC NULLS LAST, image_id DESC) AS rank FROM newest WHERE rn = 1) SELECT image_id, job_id, rank FROM r WHERE rank <= 20""")
def selected_gallery(spark, sf_dir):
    """Of every job its 20 most confident images, in rank order."""
    newest = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("tagged_at"), F.desc("loaded_at")))
    one = table(spark, sf_dir, "curated_items").withColumn("rn", newest).filter("rn = 1")
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc_nulls_last("people_confidence"), F.desc("image_id")))
    return review.selected_gallery(one.withColumn("rank", rank).withColumn("selected", F.col("rank") <= 20)).select("image_id", "job_id", "rank")


@query("denylist_parse", r"""SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS entries FROM documents""")
def denylist_parse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", review.parse_denylist(F.col("text")).alias("entries"))


@query("stored_denylist", "SELECT DISTINCT request_id, list_transform(list_sort(list_transform(list_distinct(list_filter(list_transform(denylist, lambda x: trim(x)), lambda x: x <> '')), lambda x: {'k': lower(x), 'x': x})), lambda s: s.x) AS denylist FROM finalize_requests")
def stored_denylist(spark, sf_dir):
    return table(spark, sf_dir, "finalize_requests").select("request_id", review.stored_denylist(F.col("denylist")).alias("denylist")).distinct()


@query("passed_items", "WITH t AS (SELECT job_id, workflow, status, max(started_at) AS at FROM jobs GROUP BY ALL) SELECT job_id, workflow, status FROM t WHERE status = 'completed'")
def passed_items(spark, sf_dir):
    """Completed jobs, through the same predicate as items that passed and have a file."""
    t = table(spark, sf_dir, "jobs").groupBy("job_id", "workflow", "status").agg(F.max("started_at").alias("at"))
    m = t.withColumn("output", F.lit("x")).withColumn("given", F.col("status")).withColumn("status", F.when(F.col("status") == "completed", "passed"))
    return review.passed_items(m).select("job_id", "workflow", F.col("given").alias("status"))


@query("curated_pipeline")
def curated_pipeline(spark, sf_dir):
    return flagship.curate(spark, sf_dir)
