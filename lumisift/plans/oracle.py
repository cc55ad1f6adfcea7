"""DuckDB SQL of the tag rules: one common table per stage and rule, the rules written out apart from the engine's."""

from __future__ import annotations

from ..functions import vocab as V
from ..functions.text import tag_form_sql
from ..operators.tagrules import CaptionLimits


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")" if names else "('')"


def category(c: str) -> str:
    token = lambda words: f"list_has_any(string_split_regex({c}, '[_-]+'), [{', '.join(repr(w) for w in words)}])"
    starts = " OR ".join(f"starts_with({c}, '{p}')" for p in V.INTERACTION_PREFIXES)
    return (
        f"CASE WHEN {c} IN {_in(V.INTERACTION_TAGS)} OR {starts} OR {token(V.CONCEPT_TOKENS)} THEN 'interaction_concept' WHEN {c} IN {_in(V.ACTION_TAGS)} OR {token(V.ACTION_TOKENS)} THEN 'action_composition' "
        f"WHEN {c} IN {_in(V.EXPRESSION_TAGS)} OR {token(V.EXPRESSION_TOKENS)} THEN 'expression_state' WHEN {c} IN {_in(V.BODY_TAGS)} THEN 'body_state' "
        f"WHEN {c} IN {_in(V.ACCESSORY_TAGS)} OR {token(V.ACCESSORY_TOKENS)} THEN 'accessory_setting' WHEN {token(V.APPEARANCE_TOKENS)} THEN 'key_appearance' "
        f"WHEN {c} IN {_in(V.BACKGROUND_TAGS)} OR {token(V.BACKGROUND_TOKENS)} THEN 'background' ELSE 'other' END"
    )


def expected_rules(limits: CaptionLimits) -> list[dict]:
    """The conflict rules as the specification orders them, written out here a second time for the SQL."""
    rules = []

    def only(stage, members, odd=(), kept=1, kept_with_odd=None, margin=limits.exclusive_margin, pair=False, solo=True):
        rules.append({"kind": "only", "stage": stage, "members": members, "keep": kept, "others": list(odd), "keep_if": kept if kept_with_odd is None else kept_with_odd, "margin": margin, "reason": "pair_conflict" if pair else "exclusive", "solo": solo, "least": 0})

    def needs(stage, members, losers, least, solo):
        rules.append({"kind": "prop", "stage": stage, "members": members, "others": losers, "least": least, "margin": 0.0, "reason": "support", "solo": solo})

    only(6, V.EYE_COLOR, V.EYE_COLOR_EXCEPTIONS, kept_with_odd=2)
    needs(6, V.EYE_COLOR, V.EYE_COLOR_EXCEPTIONS, 2, True)
    only(6, V.HAIR_COLOR, V.HAIR_COLOR_EXCEPTIONS, kept_with_odd=2)
    needs(6, V.HAIR_COLOR, V.HAIR_COLOR_EXCEPTIONS, 2, True)
    only(6, V.HAIR_LENGTH)
    only(6, V.EYE_STATE)
    only(6, V.MOUTH_STATE)
    only(6, V.BREAST_SIZE, V.BREAST_SIZE_EXCEPTIONS, kept_with_odd=2)
    only(6, V.AGE, margin=1e300)  # more than one age: none is kept
    rules.append({"kind": "feet", "stage": 6, "members": V.FOOTWEAR, "others": V.FOOTWEAR_EXCEPTIONS, "margin": limits.pair_margin, "reason": "pair_conflict", "solo": True})
    for pair in V.SOLO_PAIRS:
        only(6, pair, margin=limits.pair_margin, pair=True)
    only(7, V.BACKGROUND_COLOR, V.BACKGROUND_COLOR_EXCEPTIONS, kept_with_odd=2, solo=False)
    only(7, V.TIME, V.TIME_EXCEPTIONS, kept_with_odd=1000000, solo=False)
    only(7, V.CAMERA_ANGLE, V.MULTI_VIEW, kept_with_odd=1000000, solo=False)
    for pair in V.GLOBAL_PAIRS:
        only(7, pair, margin=limits.pair_margin, pair=True, solo=False)
    for concept, proof in V.SUPPORT.items():
        needs(8, proof, [concept], 2 if concept == "pet_play" else 1, False)
    return rules


def _removal(prev: str, name: str, r: dict) -> str:
    """(image_id, stage, tag, score, reason) of what one rule takes away."""
    gone = f"SELECT p.image_id, {r['stage']} AS stage, p.tag, p.score, "
    without = f" FROM {prev} p ANTI JOIN {name} q USING (image_id, tag)"
    if r["kind"] == "only":
        kind = "pair_conflict" if r["reason"] == "pair_conflict" else "exclusive"
        return f"SELECT g.image_id, {r['stage']} AS stage, g.tag, g.score, CASE WHEN c.clear THEN '{kind}_loser' ELSE '{kind}_ambiguous' END AS reason FROM ({gone}0{without}) g JOIN {name}_g c ON c.image_id = g.image_id"
    if r["kind"] == "prop":
        return gone + "'missing_support' AS reason" + without
    return f"SELECT g.image_id, {r['stage']} AS stage, g.tag, g.score, CASE WHEN abs(bare - worn) < {r['margin']}::DOUBLE THEN 'pair_conflict_ambiguous' ELSE 'pair_conflict_loser' END AS reason FROM ({gone}0{without}) g JOIN {name}_f f ON f.image_id = g.image_id"


def removals(limits: CaptionLimits) -> str:
    """All removals of stages 6 to 8, from the tables of :func:`stages`."""
    out, prev = [], "s5"
    for i, r in enumerate(expected_rules(limits)):
        out.append(_removal(prev, f"r{i}", r))
        prev = f"r{i}"
    return " UNION ALL ".join(out)


def _rule(prev: str, name: str, r: dict) -> str:
    solo = " AND image_id IN (SELECT image_id FROM features WHERE people = '1')" if r["solo"] else ""
    odd = f"image_id IN (SELECT image_id FROM {prev} WHERE tag IN {_in(r['others'])})"
    margin = min(r["margin"], 1e300)
    if r["kind"] == "only":
        return f"""{name}_c AS (SELECT image_id, tag, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tag) AS rn, CASE WHEN {odd} THEN {r['keep_if']} ELSE {r['keep']} END AS k FROM {prev} WHERE tag IN {_in(r['members'])}{solo}),
{name}_g AS (SELECT image_id, k, max(score) FILTER (rn = k) - max(score) FILTER (rn = k + 1) >= {margin}::DOUBLE AS clear FROM {name}_c GROUP BY ALL HAVING count(*) > k),
{name} AS (SELECT * FROM {prev} ANTI JOIN (SELECT image_id, tag FROM {name}_c JOIN {name}_g USING (image_id, k) WHERE rn > k OR NOT clear) USING (image_id, tag))"""
    if r["kind"] == "prop":
        return f"""{name}_n AS (SELECT image_id FROM {prev} WHERE tag IN {_in(r['members'])} GROUP BY image_id HAVING count(*) >= {r['least']}),
{name} AS (SELECT * FROM {prev} ANTI JOIN (SELECT image_id, tag FROM {prev} WHERE tag IN {_in(r['others'])}{solo} AND image_id NOT IN (SELECT image_id FROM {name}_n)) USING (image_id, tag))"""
    return f"""{name}_f AS (SELECT image_id, max(score) FILTER (tag = 'barefoot') AS bare, max(score) FILTER (tag IN {_in(r['members'])}) AS worn FROM {prev} WHERE true{solo} AND NOT {odd} GROUP BY image_id),
{name}_x AS (SELECT p.image_id, p.tag FROM {prev} p JOIN {name}_f f USING (image_id) WHERE bare IS NOT NULL AND worn IS NOT NULL AND (
  (abs(bare - worn) < {margin}::DOUBLE AND tag IN {_in(['barefoot', *r['members']])}) OR (abs(bare - worn) >= {margin}::DOUBLE AND bare > worn AND tag IN {_in(r['members'])}) OR (abs(bare - worn) >= {margin}::DOUBLE AND bare <= worn AND tag = 'barefoot'))),
{name} AS (SELECT * FROM {prev} ANTI JOIN {name}_x USING (image_id, tag))"""


def stages(limits: CaptionLimits) -> str:
    """Tables s1 ... s11 (image_id, ord, tag, score, guard), from tags_long, features, aliases and closure."""
    t = limits.threshold
    need = f"CASE WHEN c IN {_in(V.EYE_COLOR + V.HAIR_COLOR + V.BACKGROUND_COLOR)} THEN {max(t, 0.55)} WHEN c IN {_in(V.BREAST_SIZE)} THEN {max(t, 0.60)} WHEN c IN {_in(V.HIGH_RISK + V.AGE)} THEN {max(t, limits.abstract)} ELSE {t} END::DOUBLE"
    steps, prev = [], "s5"
    for i, r in enumerate(expected_rules(limits)):
        steps.append(_rule(prev, f"r{i}", r))
        prev = f"r{i}"
    budget = min(limits.soft, limits.hard) - 1
    people = f"c IN {_in(V.PEOPLE)} OR regexp_matches(c, '^[0-9]+(girls?|boys?|others?)$') OR c IN {_in(V.FRAMING)} OR c IN {_in(V.LOCATION_ROOTS)}"
    score = lambda n: f"coalesce(max(score) FILTER (tag = '{n}'), 0)"
    return f"""s1 AS (SELECT image_id, min(ord) AS ord, tag, max(score) AS score FROM (SELECT image_id, ord, {tag_form_sql("tag")} AS tag, score FROM tags_long) WHERE tag <> '' GROUP BY image_id, tag),
c1 AS (SELECT s1.*, coalesce(dst, tag) AS c FROM s1 LEFT JOIN aliases ON src = tag),
s2 AS (SELECT * FROM c1 WHERE score >= {need}),
s3 AS (SELECT * FROM s2 WHERE c NOT IN {_in(V.DENYLIST)}),
had AS (SELECT image_id, {score('1girl')} AS g, {score('1boy')} AS b, {score('1other')} AS o FROM s3 GROUP BY image_id),
f4 AS (SELECT f.*, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(o, 0) AS o FROM features f LEFT JOIN had USING (image_id)),
one AS (SELECT *, CASE WHEN people_source IN ('1girl', '1boy', '1other') THEN people_source WHEN greatest(g, b, o) <= 0 THEN NULL WHEN g >= greatest(b, o) THEN '1girl' WHEN b >= o THEN '1boy' ELSE '1other' END AS who FROM f4),
inj AS (SELECT image_id, 1 AS guard, who AS tag, CASE WHEN who = '1girl' AND g > 0 THEN g WHEN who = '1boy' AND b > 0 THEN b WHEN who = '1other' AND o > 0 THEN o ELSE people_confidence END AS score FROM one WHERE people = '1' AND who IS NOT NULL
  UNION ALL SELECT image_id, 2, 'solo', people_confidence FROM one WHERE people = '1'
  UNION ALL SELECT image_id, 1, '1girl', CASE WHEN g > 0 THEN g ELSE people_confidence END FROM one WHERE people = '2' AND people_source = '1girl+1boy'
  UNION ALL SELECT image_id, 2, '1boy', CASE WHEN b > 0 THEN b ELSE people_confidence END FROM one WHERE people = '2' AND people_source = '1girl+1boy'
  UNION ALL SELECT image_id, 1, people_source, people_confidence FROM one WHERE people IN ('2', '3_plus') AND people_source IS NOT NULL AND people_source <> '1girl+1boy'
  UNION ALL SELECT image_id, 3, framing_source, framing_confidence FROM one WHERE framing <> 'unknown' AND framing_source IS NOT NULL
  UNION ALL SELECT image_id, 4, CASE WHEN outdoors THEN 'outdoors' ELSE 'indoors' END, outdoors_confidence FROM one WHERE outdoors IS NOT NULL),
s4 AS (SELECT image_id, ord, tag, score, NULL::INTEGER AS guard FROM s3 WHERE NOT ({people}) UNION ALL SELECT image_id, 1000000 + guard, tag, score, guard FROM inj),
s5 AS (SELECT image_id, min(ord) AS ord, coalesce(dst, tag) AS tag, max(score) AS score, min(guard) AS guard FROM s4 LEFT JOIN aliases ON src = tag GROUP BY image_id, coalesce(dst, tag)),
{", ".join(steps)},
s8 AS (SELECT * FROM {prev}),
gone9 AS (SELECT DISTINCT t.image_id, x.parent AS tag FROM s8 t JOIN closure x ON x.child = t.tag),
s9 AS (SELECT * FROM s8 ANTI JOIN gone9 USING (image_id, tag)),
turns AS (SELECT *, row_number() OVER (PARTITION BY image_id, guard IS NULL, cat ORDER BY score DESC, tag) AS turn, list_position([{', '.join(repr(c) for c in V.CATEGORY_ORDER)}], cat) AS place, count(guard) OVER (PARTITION BY image_id) AS guarded FROM (SELECT *, {category('tag')} AS cat FROM s9)),
placed AS (SELECT *, CASE WHEN guard IS NULL THEN row_number() OVER (PARTITION BY image_id, guard IS NULL ORDER BY turn, place) END AS p FROM turns),
s11 AS (SELECT image_id, tag, score, CASE WHEN guard IS NULL THEN 100 + p ELSE guard END AS pos FROM placed WHERE guard IS NOT NULL OR p <= greatest({budget} - guarded, 0))"""


#: Tags that each stage took away, from the stages' sizes.
AUDIT_COUNTS = """, n AS (SELECT (SELECT count(*) FROM tags_long) AS n0, (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM s2) AS n2, (SELECT count(*) FROM s3) AS n3, (SELECT count(*) FROM s4 WHERE guard IS NULL) AS n4,
  (SELECT count(*) FROM s4) AS n4g, (SELECT count(*) FROM s5) AS n5, (SELECT count(*) FROM s8) AS n8, (SELECT count(*) FROM s9) AS n9, (SELECT count(*) FROM s11) AS n11)
SELECT stage, n FROM (SELECT unnest([1, 2, 3, 4, 5, 9, 11]) AS stage, unnest([n0 - n1, n1 - n2, n2 - n3, n3 - n4, n4g - n5, n8 - n9, n9 - n11]) AS n FROM n) WHERE n > 0"""
