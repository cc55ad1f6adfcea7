"""The event log: append-only rows (job_id, id, stage, status, message, progress, ts, data map), replay, and folded statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "job_id string, id long, stage string, status string, message string, progress double, ts timestamp, data map<string,string>"
TRANSIENT = ["locate_flow", "cluster_audit", "curation_flow"]
TERMINAL = ["completed", "failed", "awaiting_selection"]


def numbered(events: DataFrame, newest: str = "ts") -> DataFrame:
    """Adds the per-job id, from 1 in time order."""
    return events.withColumn("id", F.row_number().over(Window.partitionBy("job_id").orderBy(newest, "message")))


def replay(events: DataFrame, cursor: int, late: str = "1 day") -> DataFrame:
    """Events after the cursor, once each; works on a batch and on a stream.

    A stream remembers an event for ``late`` after the newest time seen; one delivered again later than that is passed on again.
    """
    new = events.filter(F.col("id") > cursor)
    return new.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "id"]) if events.isStreaming else new.dropDuplicates(["job_id", "id"])


def cursor(query: int | None, header: str | None) -> int:
    """The later of the query's and the Last-Event-ID header's cursor; a header that is no number counts as 0."""
    return max(query or 0, int(header) if header and header.strip().isdigit() else 0)


def stats(events: DataFrame) -> DataFrame:
    """(job_id, key, value, id): the last value of every key of ``data`` that is not transient.

    A keyed maximum, so it runs as a batch or, in update mode, as a stream with one state row a job and key.
    """
    rows = events.select("job_id", "id", F.explode("data").alias("key", "value")).filter(~F.col("key").isin(TRANSIENT))
    return rows.groupBy("job_id", "key").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("id"))


def state(events: DataFrame) -> DataFrame:
    """(job_id, stage, status, progress, id): where each job stands."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("stage", "status", "progress"), "id").alias("s"), F.max("id").alias("id"))
    return last.select("job_id", "s.*", "id")


MEMBERS = "clusters array<struct<cluster_id:bigint,members:array<struct<image_id:string,role:string,sim:double,source:string>>>>, event string"


def hidden_sources(members: Column) -> Column:
    """Cluster members without their source paths, as they are shown."""
    return F.transform(members, lambda m: m.dropFields("source"))


def audit_sources(events: DataFrame) -> DataFrame:
    """(job_id, image_id, source): the side map of source paths that the events of finished clusterings carry.

    The last event that names an image holds. Members without an id or a source give nothing.
    """
    audit = events.select("job_id", "id", F.from_json(F.col("data")["cluster_audit"], MEMBERS).alias("a")).filter("a.event = 'clusters_ready'")
    m = audit.select("job_id", "id", F.explode("a.clusters").alias("c")).select("job_id", "id", F.explode("c.members").alias("m"))
    named = m.filter("coalesce(m.image_id, '') <> '' AND coalesce(m.source, '') <> ''")
    return named.groupBy("job_id", F.col("m.image_id").alias("image_id")).agg(F.max_by("m.source", F.struct("id", "m.source")).alias("source"))


def shown(events: DataFrame) -> DataFrame:
    """The events as they are shown: source paths are taken out of cluster audits."""
    a = F.from_json(F.col("data")["cluster_audit"], MEMBERS)
    bare = F.transform(a["clusters"], lambda c: c.withField("members", hidden_sources(c["members"])))
    text = F.when(a["event"] == "clusters_ready", F.to_json(F.struct(bare.alias("clusters"), a["event"].alias("event")))).otherwise(F.col("data")["cluster_audit"])
    return events.withColumn("data", F.transform_values("data", lambda k, v: F.when(k == "cluster_audit", text).otherwise(v)))


def top_tags(tags: Column, n: int = 8) -> Column:
    """The first tags in stored order, as a tagging event tells them."""
    return F.slice(tags, 1, n)


def progress(stage: str, i: Column, n: Column) -> Column:
    """Share done after item i (from 0) of n of a stage."""
    start, span, done = {"embed": (0.16, 0.20, 1), "locate": (0.62, 0.28, 0), "tag": (0.03, 0.94, 0), "caption": (0.05, 0.90, 0)}[stage]
    return F.lit(start) + F.lit(span) * (i + done) / F.greatest(n, F.lit(1))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def follow_stats(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """A running query that keeps ``stats`` of a growing folder of events in the folder ``target``.

    State is one row per job and key. Each trigger writes only the keys that changed, as one
    batch folder, so a repeated trigger writes the same folder again; :func:`read_stats` folds them.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch}")

    return stats(read_stream(spark, folder)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def read_stats(spark: SparkSession, target: str) -> DataFrame:
    """(job_id, key, value, id) as of the last trigger of :func:`follow_stats`."""
    rows = spark.read.parquet(target)
    return rows.groupBy("job_id", "key").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("id"))


def follow_replay(spark: SparkSession, folder: str, after: int, target: str, checkpoint: str, late: str = "1 day"):
    """A running query that appends events after a cursor, once each, to a parquet folder."""
    return replay(read_stream(spark, folder), after, late).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).start()
