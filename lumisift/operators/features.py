"""Features derived from scored tags, their distribution, and quota-greedy selection."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V

FLOOR = 0.35
DOMAIN = {"people": ["1", "2", "3_plus", "unknown"], "framing": ["full_body", "half_body", "headshot", "unknown"], "outdoors": ["true", "false", "unknown"]}
WEIGHTS = {"people": 1.0, "framing": 1.0, "outdoors": 0.5}


def status(confidence: Column, known: Column) -> Column:
    """unknown, or high from .65, medium from .40, else low."""
    return F.when(~known, "unknown").when(confidence >= 0.65, "high").when(confidence >= 0.40, "medium").otherwise("low")


def _best(names: list[str], pattern: str | None = None) -> Column:
    """struct(score, tag) of the best of a set by (score, name); with none there, score 0 and the last name."""
    tag = F.col("tag")
    hit = tag.isin(names) | tag.rlike(pattern) if pattern else tag.isin(names)
    absent = F.struct(F.lit(0.0).alias("score"), F.lit(max(names)).alias("tag"))
    return F.greatest(F.coalesce(F.max(F.when(hit, F.struct("score", "tag"))), absent), absent)


def derive(tags: DataFrame) -> DataFrame:
    """One row per image of (image_id, tag, score): people, framing and outdoors, each with source, confidence and status.

    One aggregation. Ties favor 3_plus, 2, 1 and full_body, half_body, headshot. Values below .35 are ``unknown``
    (outdoors: null) without a source; outdoors and indoors need a lead of .05. Null scores count as absent.
    """
    solo = lambda name: F.coalesce(F.max(F.when(F.col("tag") == name, F.col("score"))), F.lit(0.0))
    agg = tags.groupBy("image_id").agg(
        _best(["1girl", "1boy", "1other", "solo"]).alias("one"), _best(["2girls", "2boys", "2others", "duo", "couple"]).alias("two"),
        F.least(solo("1girl"), solo("1boy")).alias("both"), _best(["group", "multiple_girls", "multiple_boys", "multiple_others"], V.CROWD_PATTERN).alias("three"),
        _best(["full_body"]).alias("full"), solo("cowboy_shot").alias("cowboy"), solo("upper_body").alias("upper"), solo("close-up").alias("close1"), solo("close_up").alias("close2"),
        _best(["outdoors"]).alias("out"), _best(V.INDOOR).alias("inside"))
    c = F.col
    two = F.when(c("both") > c("two.score"), F.struct(c("both").alias("score"), F.lit("1girl+1boy").alias("tag"))).otherwise(c("two"))
    half = F.struct(F.greatest("cowboy", "upper").alias("score"), F.when(c("cowboy") >= c("upper"), "cowboy_shot").otherwise("upper_body").alias("tag"))
    head = F.struct(F.greatest("close1", "close2").alias("score"), F.when(c("close1") >= c("close2"), "close-up").otherwise("close_up").alias("tag"))
    t = agg.withColumns({"two": two, "half": half, "head": head})

    def pick(options, conf):
        value, source = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, s in reversed(options):
            value = F.when(c(f"{s}.score") == conf, name).otherwise(value)
            source = F.when(c(f"{s}.score") == conf, c(f"{s}.tag")).otherwise(source)
        return F.when(conf < FLOOR, "unknown").otherwise(value), F.when(conf >= FLOOR, source)

    people_conf = F.greatest("three.score", "two.score", "one.score")
    people, people_source = pick([("3_plus", "three"), ("2", "two"), ("1", "one")], people_conf)
    framing_conf = F.greatest("full.score", "half.score", "head.score")
    framing, framing_source = pick([("full_body", "full"), ("half_body", "half"), ("headshot", "head")], framing_conf)
    out, inside = c("out.score"), c("inside.score")
    is_out, is_in = (out >= FLOOR) & (out >= inside + 0.05), (inside >= FLOOR) & (inside >= out + 0.05)
    outdoors = F.when(is_out, True).when(is_in, False)
    place_conf = F.when(is_out, out).when(is_in, inside).otherwise(F.greatest(out, inside))
    return t.select(
        "image_id", people.alias("people"), people_source.alias("people_source"), people_conf.alias("people_confidence"), status(people_conf, people_conf >= FLOOR).alias("people_status"),
        framing.alias("framing"), framing_source.alias("framing_source"), framing_conf.alias("framing_confidence"), status(framing_conf, framing_conf >= FLOOR).alias("framing_status"),
        outdoors.alias("outdoors"), F.when(is_out, c("out.tag")).when(is_in, c("inside.tag")).alias("outdoors_source"), place_conf.alias("outdoors_confidence"), status(place_conf, outdoors.isNotNull()).alias("outdoors_status"))


def feature_keys(features: DataFrame) -> DataFrame:
    """people, framing and outdoors as texts, ``unknown`` where there is none."""
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k)
    return features.select("image_id", text("people"), text("framing"), text("outdoors"), "people_confidence", "framing_confidence", "outdoors_confidence")


def distribution(features: DataFrame) -> DataFrame:
    """(dimension, value, n) with zeros for every value of the three domains, in one aggregation."""
    keys = feature_keys(features)
    cells = [(d, v) for d, values in DOMAIN.items() for v in values]
    one = keys.agg(*(F.count_if(F.col(d) == v).alias(f"{d}:{v}") for d, v in cells))
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), F.col(f"`{d}:{v}`").alias("n")) for d, v in cells))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def distribution_sets(features: DataFrame) -> DataFrame:
    """The same counts, without zeros, by grouping sets."""
    keys = feature_keys(features)
    sets = keys.groupingSets([["people"], ["framing"], ["outdoors"]], "people", "framing", "outdoors").agg(F.count("*").alias("n"))
    kind = F.when(F.col("people").isNotNull(), "people").when(F.col("framing").isNotNull(), "framing").otherwise("outdoors")
    return sets.select(kind.alias("dimension"), F.coalesce("people", "framing", "outdoors").alias("value"), "n")


def normalized(targets: dict[str, float]) -> dict[str, float]:
    """Negatives to 0, then shares of 1."""
    t = {k: max(float(v), 0.0) for k, v in targets.items()}
    if not sum(t.values()) > 0:
        raise ValueError("targets must have a positive sum")
    return {k: v / sum(t.values()) for k, v in t.items()}


def select(features: DataFrame, size: int, targets: dict[str, dict[str, float]], n: int | None = None) -> DataFrame:
    """(image_id, rank): greedy selection of ``size`` images toward target shares of people, framing and outdoors.

    A step takes the image with the highest sum over its known dimensions of weight *
    max(target * limit - taken, 0) / max(target * limit, 1), plus a tenth of its mean
    confidence; ties go to the higher mean confidence, then to the larger id. Images of
    the same three values only differ in confidence, so each such class is a queue: Spark
    ranks at most ``size`` of each of the at most 48 classes, and the driver merges the heads.
    """
    t = {d: normalized(v) for d, v in targets.items()}
    keys = feature_keys(features)
    known = [F.when(F.col(d) != "unknown", F.col(f"{d}_confidence")) for d in DOMAIN]
    count = sum(F.when(k.isNotNull(), 1).otherwise(0) for k in known)
    total = F.coalesce(known[0], F.lit(0.0)) + F.coalesce(known[1], F.lit(0.0)) + F.coalesce(known[2], F.lit(0.0))
    keys = keys.withColumn("mean", F.when(count > 0, total / F.greatest(count, F.lit(1))).otherwise(0.0))
    n = keys.count() if n is None else n
    limit = min(max(size, 0), n)
    w = Window.partitionBy("people", "framing", "outdoors").orderBy(F.col("mean").desc(), F.col("image_id").desc())
    heads = keys.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).select("people", "framing", "outdoors", "image_id", "mean", "rn").collect()
    queues = defaultdict(list)
    for r in sorted(heads, key=lambda r: r.rn):
        queues[(r.people, r.framing, r.outdoors)].append((r["mean"], r.image_id))
    taken, at, out = defaultdict(int), defaultdict(int), []
    for rank in range(1, limit + 1):
        best = None
        for cls, q in queues.items():
            if at[cls] >= len(q):
                continue
            mean, image = q[at[cls]]
            score = 0.0
            for d, v in zip(DOMAIN, cls):
                if v != "unknown":
                    want = t[d].get(v, 0.0) * limit
                    score += WEIGHTS[d] * max(want - taken[d, v], 0.0) / max(want, 1.0)
            key = (score + 0.1 * mean, mean, image)
            if best is None or key > best[0]:
                best = (key, cls)
        if best is None:
            break
        (_, _, image), cls = best
        at[cls] += 1
        for d, v in zip(DOMAIN, cls):
            if v != "unknown":
                taken[d, v] += 1
        out.append((image, rank))
    kind = features.schema["image_id"].dataType.simpleString()
    return features.sparkSession.createDataFrame(out, f"image_id {kind}, rank int")
