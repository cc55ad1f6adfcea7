"""The tag rule engine: scored tags to an ordered caption, with every removal audited.

Tags travel as a long table (image_id, ord, tag, score). A stage takes such a table and
returns (kept, audit); audit rows are (image_id, stage, ord, tag, score, reason,
details). What is kept is found by keyed aggregates, the audit by windows that run only if it is asked for. Only
the conflict rules depend on each other's outcome one after the other: they are folded over Arrow
batches of whole images.

Null scores and null or blank tags are no tags; repeated tags keep their first position
and highest score; an image without tags has no row in the long table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import tag_form
from ..storage import cut

AUDIT = ["image_id", "stage", "ord", "tag", "score", "reason", "details"]


@dataclass(frozen=True)
class CaptionLimits:
    threshold: float = 0.50
    soft: int = 48
    hard: int = 64
    exclusive_margin: float = 0.15
    pair_margin: float = 0.15
    abstract: float = 0.65
    remove_text: bool = False
    denylist: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not 8 <= self.soft <= self.hard:
            raise ValueError("limits must satisfy 8 <= soft <= hard")


def folded(c: Column) -> Column:
    """TAG FORM with case folding instead of lower case; they differ in a few letters only."""
    return F.replace(F.replace(tag_form(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def _details(**kw: Column) -> Column:
    """A map of the given texts, without the null ones."""
    return F.map_filter(F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def _audit(df: DataFrame, stage: int, reason: Column | str, details: Column | None = None) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    details = F.create_map().cast("map<string,string>") if details is None else details
    return df.select("image_id", F.lit(stage).alias("stage"), "ord", "tag", "score", reason.alias("reason"), details.alias("details"))


def with_canonical(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical``: the end of the tag's alias chain. ``aliases`` is the closed table (src, dst)."""
    return tags.join(aliases.select(F.col("src").alias("tag"), F.col("dst").alias("_dst")), "tag", "left").withColumn("canonical", F.coalesce("_dst", "tag")).drop("_dst")


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stage 1. One row per normalized tag: first position, highest score; each loser is audited."""
    t = raw.select("image_id", "ord", folded(F.col("tag")).alias("tag"), F.col("score").cast("double").alias("score")).filter("tag <> '' AND score IS NOT NULL")
    w = Window.partitionBy("image_id", "tag")
    before = F.max("score").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    lost = t.withColumn("before", before).filter("before IS NOT NULL").withColumns({"winner": F.greatest("before", "score"), "score": F.least("before", "score")})
    audit = _audit(lost, 1, "normalized_duplicate", _details(winner=F.col("tag"), winner_score=F.col("winner")))
    return t.groupBy("image_id", "tag").agg(F.min("ord").alias("ord"), F.max("score").alias("score")).select("image_id", "ord", "tag", "score"), audit


def required_score(canonical: Column, limits: CaptionLimits) -> Column:
    """The floor of a tag's group: colors .55, sizes .60, high-risk and age the abstract threshold."""
    t = limits.threshold
    return (
        F.when(canonical.isin(V.EYE_COLOR + V.HAIR_COLOR + V.BACKGROUND_COLOR), F.lit(max(t, 0.55)))
        .when(canonical.isin(V.BREAST_SIZE), F.lit(max(t, 0.60)))
        .when(canonical.isin(V.HIGH_RISK + V.AGE), F.lit(max(t, limits.abstract)))
        .otherwise(F.lit(t))
    )


def _other_name(df: DataFrame) -> Column:
    return F.when(F.col("canonical") != F.col("tag"), F.col("canonical"))


def threshold(tags: DataFrame, aliases: DataFrame, limits: CaptionLimits) -> tuple[DataFrame, DataFrame]:
    """Stage 2. Keeps score >= the floor of the canonical tag's group."""
    t = with_canonical(tags, aliases).withColumn("need", required_score(F.col("canonical"), limits))
    audit = _audit(t.filter("score < need"), 2, "below_threshold", _details(required_threshold=F.col("need"), canonical_tag=_other_name(t)))
    return t.filter("score >= need").select("image_id", "ord", "tag", "score"), audit


def deny(tags: DataFrame, aliases: DataFrame, limits: CaptionLimits) -> tuple[DataFrame, DataFrame]:
    """Stage 3. Drops tags whose canonical name is that of a denied one."""
    names = V.DENYLIST + (V.OPTIONAL_TEXT if limits.remove_text else []) + list(limits.denylist)
    listed = tags.sparkSession.range(1).select(F.explode(F.array(*(F.lit(n) for n in names))).alias("tag"))
    denied = listed.select(folded(F.col("tag")).alias("tag")).filter("tag <> ''")
    denied = with_canonical(denied, aliases).select("canonical", F.lit(True).alias("denied")).distinct()
    t = with_canonical(tags, aliases).join(denied, "canonical", "left")
    audit = _audit(t.filter("denied"), 3, "denylisted", _details(canonical_tag=_other_name(t)))
    return t.filter("denied IS NULL").select("image_id", "ord", "tag", "score"), audit


def override(tags: DataFrame, features: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stage 4. People, framing and location tags give way to the derived features, which come last and protected.

    ``kept`` gains ``guard``: the position among the protected tags, or null.
    """
    c = F.col("canonical")
    group = F.when(c.isin(V.PEOPLE) | c.rlike(V.PEOPLE_PATTERN), 1).when(c.isin(V.FRAMING), 2).when(c.isin(V.LOCATION_ROOTS), 3)
    t = with_canonical(tags, aliases).withColumn("grp", group)
    gone = t.filter("grp IS NOT NULL").withColumn("ord", F.row_number().over(Window.partitionBy("image_id").orderBy("grp", "tag")))
    score = lambda name: F.max(F.when(F.col("tag") == name, F.col("score")))
    had = tags.groupBy("image_id").agg(score("1girl").alias("g"), score("1boy").alias("b"), score("1other").alias("o"))
    f = features.join(had, "image_id", "left")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    one = F.when(F.col("people_source").isin("1girl", "1boy", "1other"), F.col("people_source"))
    top = F.greatest(zero("g"), zero("b"), zero("o"))
    one = F.coalesce(one, F.when(top > 0, F.when(zero("g") == top, "1girl").when(zero("b") == top, "1boy").otherwise("1other")))
    score_of = lambda n: F.coalesce(F.when(n == "1girl", F.col("g")).when(n == "1boy", F.col("b")).when(n == "1other", F.col("o")), F.col("people_confidence"))
    pair = lambda n, s: F.struct(n.alias("tag"), s.alias("score"))
    none = F.array().cast("array<struct<tag:string,score:double>>")
    people = (
        F.when(F.col("people") == "1", F.array(pair(one, score_of(one)), pair(F.lit("solo"), F.col("people_confidence"))))
        .when((F.col("people") == "2") & (F.col("people_source") == "1girl+1boy"), F.array(*(pair(F.lit(n), score_of(F.lit(n))) for n in ("1girl", "1boy"))))
        .when(F.col("people").isin("2", "3_plus") & F.col("people_source").isNotNull(), F.array(pair(F.col("people_source"), F.col("people_confidence"))))
        .otherwise(none)
    )
    framing = F.when((F.col("framing") != "unknown") & F.col("framing_source").isNotNull(), F.array(pair(F.col("framing_source"), F.col("framing_confidence")))).otherwise(none)
    place = F.when(F.col("outdoors").isNotNull(), F.array(pair(F.when(F.col("outdoors"), "outdoors").otherwise("indoors"), F.col("outdoors_confidence")))).otherwise(none)
    put = F.filter(F.concat(people, framing, place), lambda x: x["tag"].isNotNull() & (x["tag"] != ""))
    new = f.select("image_id", F.posexplode(put).alias("guard", "n")).select("image_id", (F.lit(1 << 30) + F.col("guard")).alias("ord"), folded(F.col("n.tag")).alias("tag"), F.greatest(F.coalesce("n.score", F.lit(0.0)), F.lit(0.0)).alias("score"), "guard")
    kept = t.filter("grp IS NULL").select("image_id", "ord", "tag", "score", F.lit(None).cast("int").alias("guard"))
    return kept.unionByName(new), _audit(gone, 4, "selection_override")


def canonicalize(tags: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stage 5. Tags take their canonical name; of several the strictly highest score wins, else the earlier one."""
    t = with_canonical(tags, aliases)
    w = Window.partitionBy("image_id", "canonical")
    key = F.struct("score", -F.col("ord"), "tag")
    before = F.max(key).over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    late = t.withColumn("before", before)
    beats = F.col("score") > F.col("before.score")
    lost = late.filter("before IS NOT NULL").select(
        "image_id", "ord", "canonical", F.when(beats, F.col("before.tag")).otherwise(F.col("tag")).alias("tag"), F.least("score", "before.score").alias("score"),
        F.when(beats, F.col("tag")).otherwise(F.col("before.tag")).alias("source"), F.greatest("score", "before.score").alias("winner"))
    audit = _audit(lost, 5, "alias_duplicate", _details(canonical_tag=F.col("canonical"), winner=F.col("canonical"), winner_source=F.col("source"), winner_score=F.col("winner")))
    kept = t.groupBy("image_id", F.col("canonical").alias("tag")).agg(F.min("ord").alias("ord"), F.max("score").alias("score"), F.min("guard").alias("guard"))
    return kept.select("image_id", "ord", "tag", "score", "guard"), audit


# Stages 6 to 8: rules that see each other's outcome


def _rule(kind, stage, members, keep=1, others=(), keep_if=None, margin=0.0, reason="exclusive", solo=False, least=0):
    return dict(kind=kind, stage=stage, members=list(members), keep=keep, others=list(others), keep_if=keep if keep_if is None else keep_if, margin=margin, reason=reason, solo=solo, least=least)


def conflict_rules(limits: CaptionLimits) -> list[dict]:
    """The rules in their order. kind ``only``: keep the best, or drop all if the margin is too small;
    ``prop``: drop others unless enough members are there; ``feet``: barefoot against worn footwear."""
    e, p = limits.exclusive_margin, limits.pair_margin
    all_ = 1 << 20
    rules = []
    for color, odd in ((V.EYE_COLOR, V.EYE_COLOR_EXCEPTIONS), (V.HAIR_COLOR, V.HAIR_COLOR_EXCEPTIONS)):
        rules += [_rule("only", 6, color, others=odd, keep_if=2, margin=e, solo=True), _rule("prop", 6, color, others=odd, least=2, solo=True)]
    rules += [_rule("only", 6, g, margin=e, solo=True) for g in (V.HAIR_LENGTH, V.EYE_STATE, V.MOUTH_STATE)]
    rules.append(_rule("only", 6, V.BREAST_SIZE, others=V.BREAST_SIZE_EXCEPTIONS, keep_if=2, margin=e, solo=True))
    rules.append(_rule("only", 6, V.AGE, margin=float("inf"), reason="age", solo=True))
    rules.append(_rule("feet", 6, V.FOOTWEAR, others=V.FOOTWEAR_EXCEPTIONS, margin=p, reason="pair_conflict", solo=True))
    rules += [_rule("only", 6, pair, margin=p, reason="pair_conflict", solo=True) for pair in V.SOLO_PAIRS]
    rules.append(_rule("only", 7, V.BACKGROUND_COLOR, others=V.BACKGROUND_COLOR_EXCEPTIONS, keep_if=2, margin=e))
    rules.append(_rule("only", 7, V.TIME, others=V.TIME_EXCEPTIONS, keep_if=all_, margin=e))
    rules.append(_rule("only", 7, V.CAMERA_ANGLE, others=V.MULTI_VIEW, keep_if=all_, margin=e))
    rules += [_rule("only", 7, pair, margin=p, reason="pair_conflict") for pair in V.GLOBAL_PAIRS]
    rules += [_rule("prop", 8, need, others=[concept], least=V.SUPPORT_LEAST.get(concept, 1), reason="support") for concept, need in V.SUPPORT.items()]
    return rules


_ENTRY = "array<struct<ord:bigint,tag:string,score:double,guard:int>>"
_RESOLVED = (
    "image_id {id}, ord long, tag string, score double, guard int, stage int, reason string, winners string, winner string, winner_score double, "
    "group string, margin double, least int, found string"
)
_WHY = ["winners", "winner", "winner_score", "group", "margin", "least", "found"]


def _resolver(rules: list[dict]):
    """The fold of all rules over a batch of images, each rule in one pass over all their tags.

    Rows are (image_id, tags, solo); every tag comes out once: kept, without a stage, or with the stage, the
    reason and the circumstances of its removal, ``ord`` then being its place among the removals of its image.
    """
    names = sorted({n for r in rules for n in [*r["members"], *r["others"]]} | {"barefoot"})  # a code orders as its name does
    listed = lambda some: np.array([n in set(some) for n in names] + [False])
    tables = [(r, listed(r["members"]), listed(r["others"])) for r in rules]
    bare = names.index("barefoot")

    def fold(code, score, img, solo):
        alive, place, gone = np.ones(len(code), dtype=bool), np.zeros(len(solo), dtype=np.int64), []

        def text(rows):
            return ",".join(names[c] for c in code[rows])

        def remove(rows, stage, reason, **why):
            for row in rows:
                gone.append((row, place[img[row]], stage, reason, *(why.get(k) for k in _WHY)))
                place[img[row]] += 1
            alive[rows] = False

        def by_image(rows, *order):
            """The rows sorted by image and ``order``, and the borders between images."""
            rows = rows[np.lexsort((*order[::-1], img[rows]))] if len(rows) else rows
            return rows, [*np.flatnonzero(np.r_[True, np.diff(img[rows]) != 0]).tolist(), len(rows)] if len(rows) else [0]

        def only(r, hits, odd):
            rows, cuts = by_image(hits, -score[hits], code[hits])
            with_odd = np.zeros(len(solo), dtype=bool)
            with_odd[img[odd]] = True
            for lo, hi in zip(cuts, cuts[1:]):
                keep = r["keep_if"] if with_odd[img[rows[lo]]] else r["keep"]
                if hi - lo <= keep:
                    continue
                own = rows[lo:hi]
                gap = score[own[keep - 1]] - score[own[keep]]
                pair, age = r["reason"] == "pair_conflict", r["reason"] == "age"
                if gap >= r["margin"]:
                    why = {"winner": names[code[own[0]]], "winner_score": score[own[0]]} if pair else {"winners": text(own[:keep])}
                    remove(own[keep:], r["stage"], "pair_conflict_loser" if pair else "exclusive_loser", margin=None if age else gap, **why)
                else:
                    group = text(own[np.argsort(code[own])] if age else own)
                    remove(own, r["stage"], "pair_conflict_ambiguous" if pair else "exclusive_ambiguous", group=group, margin=None if age else gap)

        def prop(r, hits, odd):
            enough = np.bincount(img[hits], minlength=len(solo)) >= r["least"]
            rows, cuts = by_image(odd[~enough[img[odd]]], code[odd[~enough[img[odd]]]])
            for lo, hi in zip(cuts, cuts[1:]):
                why = {}
                if r["reason"] == "support":
                    own = hits[img[hits] == img[rows[lo]]]
                    why = {"least": r["least"], "found": text(own[np.argsort(code[own])])}
                remove(rows[lo:hi], r["stage"], "missing_support", **why)

        def feet(r, hits, odd):
            foot = np.flatnonzero(alive & (code == bare))
            foot = foot[~np.isin(img[foot], img[odd])]
            foot = foot[np.isin(img[foot], img[hits]) & (solo[img[foot]] | (not r["solo"]))]
            for f in foot:
                worn = hits[img[hits] == img[f]]
                best = worn[np.lexsort((code[worn], score[worn]))[-1]]
                apart = abs(score[f] - score[best])
                worn = worn[np.argsort(code[worn])]
                if apart < r["margin"]:
                    both = np.r_[f, worn]
                    remove(both[np.argsort(code[both])], r["stage"], "pair_conflict_ambiguous", group=text(both), margin=apart)
                elif score[f] > score[best]:
                    remove(worn, r["stage"], "pair_conflict_loser", winner="barefoot", winner_score=score[f], margin=apart)
                else:
                    remove([f], r["stage"], "pair_conflict_loser", winner=names[code[best]], winner_score=score[best], margin=apart)

        for r, member, other in tables:
            may = alive & (solo[img] | (not r["solo"]))
            {"only": only, "prop": prop, "feet": feet}[r["kind"]](r, np.flatnonzero(may & member[code]), np.flatnonzero(may & other[code]))
        return alive, gone

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            tags = b.column("tags")
            ord_, tag, score, guard = tags.flatten().flatten()
            img = np.repeat(np.arange(b.num_rows), tags.value_lengths().to_numpy(zero_copy_only=False))
            code = pc.fill_null(pc.index_in(tag, pa.array(names)), -1).to_numpy(zero_copy_only=False)
            alive, gone = fold(code, score.to_numpy(zero_copy_only=False), img, b.column("solo").to_numpy(zero_copy_only=False))
            kept = np.flatnonzero(alive)
            rows = pa.array(np.r_[kept, [g[0] for g in gone]].astype(np.int64))
            places = pa.concat_arrays([ord_.take(pa.array(kept)), pa.array([g[1] for g in gone], pa.int64())])
            none = pa.nulls
            extra = [pa.concat_arrays([none(len(kept), t), pa.array([g[k] for g in gone], t)]) for k, t in zip(range(2, 11), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.int32(), pa.string()))]
            ids = b.column("image_id").take(pa.array(img)).take(rows)
            yield pa.RecordBatch.from_arrays([ids, places, tag.take(rows), score.take(rows), guard.take(rows), *extra], names=["image_id", "ord", "tag", "score", "guard", "stage", "reason", *_WHY])

    return run


def resolve_conflicts(tags: DataFrame, features: DataFrame, limits: CaptionLimits) -> tuple[DataFrame, DataFrame]:
    """Stages 6 to 8. Exclusive groups, pairs and footwear for single persons; global conflicts; abstract support.

    The rules see each other's outcome, so they are folded in order (:func:`_resolver`), over whole Arrow batches of images.
    """
    rows = tags.groupBy("image_id").agg(F.collect_list(F.struct(F.col("ord").cast("bigint").alias("ord"), "tag", "score", F.col("guard").cast("int").alias("guard"))).cast(_ENTRY).alias("tags"))
    single = features.select("image_id", (F.coalesce(F.col("people") == "1", F.lit(False))).alias("solo"))  # one row per image: merged, as in stage 9
    rows = rows.join(single.hint("merge"), "image_id", "left").withColumn("solo", F.coalesce("solo", F.lit(False)))
    kind = tags.schema["image_id"].dataType.simpleString()
    done = cut(rows.mapInArrow(_resolver(conflict_rules(limits)), _RESOLVED.format(id=kind)), "resolved")  # read twice
    why = _details(winners=F.col("winners"), winner=F.col("winner"), winner_score=F.col("winner_score"), group=F.col("group"), margin=F.col("margin"), minimum_support_count=F.col("least"), support_found=F.col("found"))
    log = done.filter("stage IS NOT NULL").withColumn("details", why).select(*AUDIT)
    return done.filter("stage IS NULL").select("image_id", "ord", "tag", "score", "guard"), log


def drop_parents(tags: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stage 9. Removes every tag that is a parent of a present one (closure: child, parent), the smallest child being credited; seen on the stage's own snapshot.

    Both sides of the join by image hold as many rows as there are tags. Written tags are small files, repeated names as they are, so that
    by file size the planner would gather millions of rows on the driver to broadcast them; the hint keeps the join a merge.
    """
    found = tags.select("image_id", F.col("tag").alias("child")).join(closure.select("child", F.col("parent").alias("tag")), "child")
    by = found.groupBy("image_id", "tag").agg(F.min("child").alias("child"))
    t = tags.join(by.hint("merge"), ["image_id", "tag"], "left")
    gone = t.filter("child IS NOT NULL").withColumn("ord", F.row_number().over(Window.partitionBy("image_id").orderBy("child", "tag")))
    return t.filter("child IS NULL").select(*tags.columns), _audit(gone, 9, "redundant_parent", _details(child=F.col("child")))


def category(tag: Column) -> Column:
    """The first category whose tags, prefixes or tokens match."""
    tokens = F.split(tag, "[_-]+")
    any_of = lambda words: F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in words)))
    starts = tag.startswith(V.INTERACTION_PREFIXES[0])
    for p in V.INTERACTION_PREFIXES[1:]:
        starts = starts | tag.startswith(p)
    return (
        F.when(tag.isin(V.INTERACTION_TAGS) | starts | any_of(V.CONCEPT_TOKENS), "interaction_concept")
        .when(tag.isin(V.ACTION_TAGS) | any_of(V.ACTION_TOKENS), "action_composition")
        .when(tag.isin(V.EXPRESSION_TAGS) | any_of(V.EXPRESSION_TOKENS), "expression_state")
        .when(tag.isin(V.BODY_TAGS), "body_state")
        .when(tag.isin(V.ACCESSORY_TAGS) | any_of(V.ACCESSORY_TOKENS), "accessory_setting")
        .when(any_of(V.APPEARANCE_TOKENS), "key_appearance")
        .when(tag.isin(V.BACKGROUND_TAGS) | any_of(V.BACKGROUND_TOKENS), "background")
        .otherwise("other")
    )


def round_robin(tags: DataFrame, limits: CaptionLimits) -> tuple[DataFrame, DataFrame]:
    """Stages 10 and 11. (kept with ``pos``, audit): protected tags first, then the categories in turn until the budget is full.

    A tag's rank within its category, then the category's place, is exactly the order of the turns.
    """
    budget = min(limits.soft, limits.hard) - 1
    t = tags.withColumn("category", category(F.col("tag")))
    place = F.array_position(F.array(*(F.lit(c) for c in V.CATEGORY_ORDER)), F.col("category"))
    free = F.col("guard").isNull()
    w = Window.partitionBy("image_id")
    t = t.withColumns({"turn": F.row_number().over(Window.partitionBy("image_id", free, "category").orderBy(F.col("score").desc(), "tag")), "place": place, "guarded": F.count("guard").over(w)})
    t = t.withColumn("p", F.row_number().over(Window.partitionBy("image_id", free).orderBy("guard", "turn", "place")))
    fits = ~free | (F.col("p") <= F.greatest(F.lit(budget) - F.col("guarded"), F.lit(0)))
    kept = t.filter(fits).withColumn("pos", F.when(free, F.col("p") + F.col("guarded")).otherwise(F.col("p"))).select("image_id", "tag", "score", "category", "pos")
    return kept, _audit(t.filter(~fits), 11, "over_limit")


def join_caption(ordered: DataFrame, ids: DataFrame, prefix: str, limits: CaptionLimits) -> DataFrame:
    """Stage 12. (image_id, caption, tags): prefix and tags, the caption cut at the hard limit; every id of ``ids`` has one."""
    tags = ordered.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))
    t = ids.join(tags, "image_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return t.select("image_id", F.array_join(F.slice(F.concat(F.array(F.lit(prefix)), "tags"), 1, limits.hard), ", ").alias("caption"), "tags")


def captions(raw: DataFrame, features: DataFrame, aliases: DataFrame, closure: DataFrame, prefix: str, limits: CaptionLimits = CaptionLimits()) -> tuple[DataFrame, DataFrame]:
    """(captions, audit): all stages in their order. ``features`` is one row per image, see :mod:`features`."""
    logs = []

    def step(result):
        logs.append(result[1])
        return result[0]

    t = cut(step(normalize(raw)), "normalized")
    t = step(threshold(t, aliases, limits))
    t = step(deny(t, aliases, limits))
    t = cut(step(override(t, features, aliases)), "overridden")  # every later log starts here
    t = step(canonicalize(t, aliases))
    t = step(resolve_conflicts(t, features, limits))
    t = step(drop_parents(t, closure))
    ordered = step(round_robin(t, limits))
    audit = logs[0]
    for log in logs[1:]:
        audit = audit.unionByName(log)
    return join_caption(ordered, features.select("image_id"), prefix, limits), audit
