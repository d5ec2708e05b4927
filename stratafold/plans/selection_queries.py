"""Queries from resampled evidence to relation classes and representatives, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, draws, relations, selection
from ..sources.frozen import frozen
from . import event_queries as base
from .event_queries import LINEAGE, PAIRS, PERSIST, RELATED, THIN, WINDOWS, _spearman_sql, query, r6

BY = ["window_id", "source", "target"]
ON = "{0}.window_id = {1}.window_id AND {0}.source = {1}.source AND {0}.target = {1}.target"


def _mix(a: str, b: str, salt: int = 0) -> str:
    return f"(({a} * 2654435761 + {b} * 40503 + {salt}) % 4294967296 * 69069 % 1000003)"


PLACED = """, placed AS (
  SELECT p.window_id, p.source, p.target, p.x, p.y, row_number() OVER (PARTITION BY p.window_id, p.source, p.target ORDER BY p.endpoint) - 1 AS i, count(*) OVER (PARTITION BY p.window_id, p.source, p.target) AS n
  FROM pairs p JOIN rel r ON """ + ON.format("r", "p") + """ WHERE r.strength IS NOT NULL
)"""
BOOT = f""", slots AS (
  SELECT window_id, source, target, n, i, range AS rep, ({_mix('range', '(i // 24)')} % n + i % 24) % n AS at FROM placed, range(500)
), drawn AS (SELECT s.window_id, s.source, s.target, s.rep, q.x, q.y FROM slots s JOIN placed q ON {ON.format('q', 's')} AND q.i = s.at)""" + _spearman_sql("bs", "drawn", "window_id, rep", 3) + f""", boot AS (
  SELECT b.*, ci_high - ci_low AS ci_width, coalesce(CASE WHEN r.sign > 0 THEN ci_low >= 0 WHEN r.sign < 0 THEN ci_high <= 0 END, false) AS interval_keeps_sign FROM (
    SELECT window_id, source, target, count(strength) AS valid, quantile_cont(strength, 0.025) AS ci_low, quantile_cont(strength, 0.5) AS ci_median, quantile_cont(strength, 0.975) AS ci_high FROM bs GROUP BY 1, 2, 3) b JOIN rel r ON {ON.format('r', 'b')}
)"""
MISS = f""", numbered AS (
  SELECT p.*, range AS rep, row_number() OVER (PARTITION BY window_id, source, target, range ORDER BY {_mix('range', 'i', 977)}, i) AS k FROM placed p, range(100)
), fewer AS (SELECT * FROM numbered WHERE k > floor(0.1::DOUBLE * n))""" + _spearman_sql("ms", "fewer", "window_id, rep", 20) + f""", missed AS (
  SELECT m.window_id, m.source, m.target, count(m.strength) AS valid, avg((m.sign = r.sign)::INT) AS sign_fraction, quantile_cont(abs(m.strength - r.strength), 0.5) AS median_change,
         count(m.strength) = 100 AND coalesce(avg((m.sign = r.sign)::INT) >= 0.75, false) AS missingness_robust FROM ms m JOIN rel r ON {ON.format('r', 'm')} GROUP BY 1, 2, 3
)"""
SHIFT = f""", ranked AS (
  SELECT window_id, source, target, i, n, rank() OVER (PARTITION BY window_id, source, target ORDER BY x) + (count(*) OVER (PARTITION BY window_id, source, target, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY window_id, source, target ORDER BY y) + (count(*) OVER (PARTITION BY window_id, source, target, y) - 1) / 2.0::DOUBLE AS ry FROM placed
), offsets AS (
  SELECT window_id, source, target, n, range AS rep, ((n + 9) // 10 + {_mix('range', '1')} % (greatest(floor(0.9::DOUBLE * n)::BIGINT, (n + 9) // 10) - (n + 9) // 10 + 1)) AS shift FROM placed, range(300) WHERE i = 0
), turned AS (
  SELECT o.window_id, o.source, o.target, o.shift, abs(corr(a.rx, b.ry)) AS v FROM (SELECT DISTINCT window_id, source, target, shift FROM offsets) o
  JOIN ranked a ON {ON.format('a', 'o')} JOIN ranked b ON {ON.format('b', 'o')} AND b.i = (a.i + a.n - o.shift) % a.n GROUP BY 1, 2, 3, 4
), nulled AS (
  SELECT o.window_id, o.source, o.target, count(v) AS repetitions, (1 + count(*) FILTER (v >= abs(strength) - 1e-12)) / (1.0::DOUBLE + count(v)) AS p_value, any_value(abs(strength)) - quantile_cont(v, 0.5) AS effect
  FROM offsets o JOIN turned t ON {ON.format('t', 'o')} AND t.shift = o.shift JOIN rel r ON {ON.format('r', 'o')} GROUP BY 1, 2, 3
)"""


def _bootstrap(spark, sf):
    return frozen(spark, "bootstrap", f"{sf}/events.parquet", lambda: draws.bootstrap(base.pair_rows(spark, sf), base.full_relations(spark, sf), ["window_id"], "endpoint"))


def _missing(spark, sf):
    return frozen(spark, "missing", f"{sf}/events.parquet", lambda: draws.missingness(base.pair_rows(spark, sf), base.full_relations(spark, sf), ["window_id"], "endpoint"))


def _shifted(spark, sf):
    return draws.shift_null(base.pair_rows(spark, sf), base.full_relations(spark, sf), ["window_id"], "endpoint")


@query(f"WITH {PAIRS}{PLACED}{BOOT} SELECT window_id, source, target, valid, round(ci_low, 6) AS ci_low, round(ci_median, 6) AS ci_median, round(ci_high, 6) AS ci_high, round(ci_width, 6) AS ci_width, interval_keeps_sign FROM boot")
def block_bootstrap(spark, sf):
    return r6(_bootstrap(spark, sf))


@query(f"WITH {PAIRS}{PLACED}{MISS} SELECT window_id, source, target, valid, round(sign_fraction, 6) AS sign_fraction, round(median_change, 6) AS median_change, missingness_robust FROM missed")
def dropped_rows(spark, sf):
    return r6(_missing(spark, sf))


@query(f"WITH {PAIRS}{PLACED}{SHIFT} SELECT window_id, source, target, repetitions, round(p_value, 6) AS p_value, round(effect, 6) AS effect FROM nulled")
def shift_null(spark, sf):
    return r6(_shifted(spark, sf))


LOO = f""", parts AS (
  SELECT *, (sum(strength) OVER (PARTITION BY window_id, source, target) - strength) / nullif(count(*) OVER (PARTITION BY window_id, source, target) - 1, 0) AS w FROM blk WHERE strength IS NOT NULL
), loo AS (
  SELECT p.window_id, p.source, p.target, coalesce(avg(((CASE WHEN abs(w) <= 1e-12 THEN 0 ELSE sign(w) END) = r.sign)::INT) >= 0.75 AND quantile_cont(abs(abs(w) - abs(r.strength)), 0.5) <= 0.2, false) AS loo_robust
  FROM parts p JOIN rel r ON {ON.format('r', 'p')} GROUP BY 1, 2, 3
)"""
STATUS = PERSIST + PLACED + BOOT + MISS + LOO + f""", tested AS (
  SELECT r.window_id, r.source, r.target, r.pair_id, r.strength, r.sign, k.persistence, b.ci_width, coalesce(r.estimability = 'estimable' AND r.strength IS NOT NULL, false) AS known,
         [coalesce(abs(r.strength) >= 0.3, false), coalesce(estimable_blocks >= 4, false), coalesce(estimable_blocks / blocks::DOUBLE >= 0.75, false), coalesce(sign_preservation >= 0.75, false), coalesce(persistence >= 0.7, false),
          coalesce(ci_width <= 0.5, false), coalesce(interval_keeps_sign, false), coalesce(loo_robust, false), coalesce(missingness_robust, false)] AS e, [coalesce(abs(r.strength) >= 0.2, false), coalesce(persistence >= 0.5, false), coalesce(ci_width <= 0.7, false)] AS c
  FROM rel r LEFT JOIN kept k ON {ON.format('k', 'r')} LEFT JOIN boot b ON {ON.format('b', 'r')} LEFT JOIN loo l ON {ON.format('l', 'r')} LEFT JOIN missed m ON {ON.format('m', 'r')}
), statused AS (
  SELECT *, concat_ws('|', CASE WHEN NOT known THEN 'estimable' END, {', '.join(f"CASE WHEN NOT e[{i}] THEN '{n}' END" for i, n in enumerate(['strength', 'valid_blocks', 'block_fraction', 'sign_preservation', 'persistence', 'ci_width', 'interval_sign', 'leave_one_out', 'missingness'], 1))}) AS failed_eligible,
         concat_ws('|', CASE WHEN NOT known THEN 'estimable' END, {', '.join(f"CASE WHEN NOT c[{i}] THEN '{n}' END" for i, n in enumerate(['strength', 'persistence', 'ci_width'], 1))}) AS failed_candidate FROM tested
), status AS (
  SELECT *, CASE WHEN NOT known THEN 'non_estimable' WHEN failed_eligible = '' THEN 'eligible' WHEN failed_candidate = '' THEN 'candidate' ELSE 'rejected' END AS status FROM statused
)"""


def statuses(spark, sf):
    """The classified relations with the evidence that classified them."""
    full, blocks = base.full_relations(spark, sf), base.block_relations(spark, sf)
    kept = relations.persistence(full, blocks, ["window_id"])
    out = full.drop("n")
    for part in (kept, _bootstrap(spark, sf).drop("valid"), draws.leave_one_out_robust(blocks, full, ["window_id"]), _missing(spark, sf).select(*BY, "missingness_robust")):
        out = out.join(part, BY, "left")
    return selection.full_status(out)


@query(f"WITH {STATUS} SELECT window_id, source, target, status, failed_eligible, failed_candidate FROM status")
def full_relation_status(spark, sf):
    return r6(statuses(spark, sf).select(*BY, "status", "failed_eligible", "failed_candidate"))


@query(f"""WITH {STATUS}, c AS (SELECT window_id, count(*) AS relations, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('eligible', 'candidate', 'rejected', 'non_estimable'))} FROM status GROUP BY 1)
SELECT *, CASE WHEN eligible > 0 THEN 'eligible_relations_identified' WHEN candidate > 0 THEN 'only_candidate_relations' WHEN non_estimable = relations THEN 'all_relations_non_estimable' ELSE 'no_eligible_relations' END AS outcome FROM c""")
def discovery_outcome(spark, sf):
    return selection.discovery_outcome(statuses(spark, sf), ["window_id"])


CONTROLS = ["event_count", "maximum_magnitude", "log_energy"]
_SORTED = sorted(RELATED)
_TRIPLES = ", ".join("('{0}', '{1}', {0}::DOUBLE, {1}::DOUBLE, {2})".format(a, b, ", ".join("0.0::DOUBLE" if c in (a, b) else f"{c}::DOUBLE" for c in CONTROLS)) for i, a in enumerate(_SORTED) for b in _SORTED[i + 1 :])


def _rest(a: str, b: str, c: str, last: bool) -> str:
    bc = f"{b}{c}" if b in "xy" else f"{c}{b}"
    ac = f"{a}{c}" if a in "xy" else f"{c}{a}"
    got = f"CASE WHEN (1 - {ac} * {ac}) * (1 - {bc} * {bc}) > 1e-12 THEN ({a}{b} - {ac} * {bc}) / sqrt((1 - {ac} * {ac}) * (1 - {bc} * {bc})) END"
    return f"{got} AS {a}{b}" if last else f"coalesce({got}, 0) AS {a}{b}"


_NAMES = ["x", "y", "p", "q", "r"]
_COUPLES = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]
REDUNDANT = f""", five AS (
  SELECT window_id, u.* FROM feat, LATERAL (SELECT * FROM (VALUES {_TRIPLES}) v(source, target, x, y, p, q, r)) u WHERE x IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL AND r IS NOT NULL
), five_r AS (
  SELECT window_id, source, target, {', '.join(f"rank() OVER (PARTITION BY window_id, source, target ORDER BY {c}) + (count(*) OVER (PARTITION BY window_id, source, target, {c}) - 1) / 2.0::DOUBLE AS {c}" for c in _NAMES)} FROM five
), zero AS (
  SELECT window_id, source, target, count(*) AS n, {', '.join((f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS xy" if a + b == "xy" else f"coalesce(CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END, 0) AS {a}{b}") for a, b in _COUPLES)} FROM five_r GROUP BY 1, 2, 3
), one AS (SELECT window_id, source, target, n, xy AS strength, {', '.join(_rest(a, b, 'p', a + b == 'xy') for a, b in _COUPLES if 'p' not in (a, b))} FROM zero),
two AS (SELECT window_id, source, target, n, strength, {', '.join(_rest(a, b, 'q', a + b == 'xy') for a, b in _COUPLES if not {'p', 'q'} & {a, b})} FROM one),
three_p AS (SELECT window_id, source, target, n, strength, {_rest('x', 'y', 'r', True)} FROM two),
line AS (SELECT window_id, source, target, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(abs(y)) AS top FROM pairs GROUP BY 1, 2, 3),
flat AS (SELECT l.window_id, l.source, l.target, coalesce(max(abs(y - a * x - b)) <= 1e-10 * greatest(1, any_value(top)), false) AS affine FROM line l JOIN pairs p ON {ON.format('p', 'l')} GROUP BY 1, 2, 3),
redundant AS (
  SELECT t.window_id, t.source, t.target, n, strength, CASE WHEN n >= 20 THEN xy END AS partial_strength, CASE WHEN coalesce(affine, false) OR (n >= 20 AND abs(xy) < 0.15) THEN 'fully_redundant' WHEN n < 20 OR xy IS NULL THEN 'conditional_test_inconclusive' ELSE 'retains_residual_information' END AS redundancy
  FROM three_p t LEFT JOIN flat f ON {ON.format('f', 't')}
)"""


def _redundancy(spark, sf):
    rows = selection.controlled_pairs(base.feature_table(spark, sf), RELATED, CONTROLS, ["window_id"])
    return selection.redundancy(rows, ["window_id"], relations.affine(base.pair_rows(spark, sf), ["window_id"], tolerance=1e-10))


@query(f"WITH {PAIRS}{REDUNDANT} SELECT window_id, source, target, n, round(strength, 6) AS strength, round(partial_strength, 6) AS partial_strength, redundancy FROM redundant")
def conditional_redundancy(spark, sf):
    return r6(_redundancy(spark, sf))


#: Families stated as data: (feature, family).
FAMILY = [
    ("event_count", "activity"), ("log_energy", "activity"), ("maximum_magnitude", "activity"), ("median_interevent_hours", "activity"),
    ("median_depth_km", "space"), ("spatial_dispersion_km", "space"),
]
_FAMILY = ", ".join(f"('{f}', '{g}')" for f, g in FAMILY)
GROUPED = f""", named(feature, family) AS (VALUES {_FAMILY}), kin AS (
  SELECT window_id, pair_id, a.family AS family_id FROM rel JOIN named a ON a.feature = source JOIN named b ON b.feature = target AND b.family = a.family
)"""


def _members(spark, full):
    named = spark.createDataFrame(FAMILY, "feature string, family string")
    a, b = (F.broadcast(named.select(F.col("feature").alias(c), F.col("family").alias(f"_{c}"))) for c in ("source", "target"))  # one row a feature
    return full.join(a, "source").join(b, "target").where("_source = _target").select("window_id", "pair_id", F.col("_source").alias("family_id"))


@query(f"WITH {PAIRS}{GROUPED} SELECT r.window_id, r.pair_id, coalesce(m.family_id, 'single:' || r.window_id || '/' || r.pair_id) AS family_id, m.family_id IS NULL AS singleton FROM rel r LEFT JOIN kin m ON m.window_id = r.window_id AND m.pair_id = r.pair_id")
def relation_membership(spark, sf):
    full = base.full_relations(spark, sf)
    return selection.with_singletons(full, _members(spark, full), ["window_id", "pair_id"])


_MULTI = base.SCALES.split(PAIRS, 1)[1]
_DEPENDS = base.ORACLE["pair_dependency"].split("SELECT a.f AS source", 1)
CHOSEN = STATUS + SHIFT + REDUNDANT + _MULTI + GROUPED + THIN.split(PAIRS, 1)[1] + f""", lineage AS (
  {_DEPENDS[0].replace('WITH l AS (', '', 1).rsplit(')', 1)[0]}
), depends AS (SELECT a.f AS source{_DEPENDS[1].replace(' l a ', ' lineage a ').replace(' l b ', ' lineage b ')}), evidence AS (
  SELECT s.window_id, s.pair_id, s.status, m.family_id, m.family_id = 'activity' AS family_reproducible, d.dependency, CASE WHEN abs(s.strength - f.strength) <= 0.15 THEN 'robust' WHEN abs(s.strength - f.strength) <= 0.3 THEN 'moderate' WHEN abs(s.strength - f.strength) IS NULL THEN 'non_estimable' ELSE 'strong' END AS overlap_class,
    f.sign = s.sign AS sign_preserved, supported_scales, sign_consistent = false AS inconsistent, (p_value <= 0.05)::INT AS nulls_passed, effect AS null_margin, redundancy, s.persistence, s.ci_width
  FROM status s LEFT JOIN kin m ON m.window_id = s.window_id AND m.pair_id = s.pair_id LEFT JOIN depends d ON d.source = s.source AND d.target = s.target LEFT JOIN few f ON {ON.format('f', 's')}
  LEFT JOIN multi u ON u.pair_id = s.pair_id LEFT JOIN nulled n ON {ON.format('n', 's')} LEFT JOIN redundant t ON {ON.format('t', 's')}
), tried AS (
  SELECT *, [status IN ('eligible', 'candidate'), family_id IS NOT NULL, coalesce(family_reproducible, false), coalesce(dependency <> 'directly_derived', true), overlap_class <> 'strong', coalesce(sign_preserved, false), coalesce(supported_scales >= 2, false),
    coalesce(nulls_passed >= 1, false), coalesce(redundancy = 'retains_residual_information', false), coalesce(redundancy <> 'fully_redundant', true)] AS t FROM evidence
), listed AS (
  SELECT *, concat_ws('|', {', '.join(f"CASE WHEN NOT t[{i}] THEN '{n}' END" for i, n in enumerate(['status_allowed', 'family_membership', 'family_reproducible', 'not_directly_derived', 'not_overlap_sensitive', 'sign_preserved', 'supported_scales', 'nulls_exceeded', 'residual_information', 'not_fully_redundant'], 1))}) AS failed_conditions,
    list_sum(t::INT[])::INT AS conditions_met FROM tried
), placed_in AS (
  SELECT *, CASE WHEN failed_conditions = '' THEN row_number() OVER (PARTITION BY family_id, failed_conditions = '' ORDER BY supported_scales DESC NULLS LAST, CASE overlap_class WHEN 'robust' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END DESC, round(null_margin, 9) DESC NULLS LAST,
    CASE redundancy WHEN 'retains_residual_information' THEN 2 ELSE 0 END DESC, round(persistence, 9) DESC NULLS LAST, round(ci_width, 9) NULLS LAST, pair_id, window_id) END AS family_rank FROM listed
), chosen AS (
  SELECT *, CASE WHEN inconsistent THEN 'scale_inconsistent' WHEN overlap_class = 'strong' THEN 'overlap_sensitive' WHEN dependency = 'directly_derived' THEN 'definitionally_constrained' WHEN redundancy = 'fully_redundant' THEN 'redundant_relation'
    WHEN family_rank <= 1 THEN 'family_representative_candidate' WHEN coalesce(family_reproducible, false) THEN 'supporting_relation' ELSE 'insufficient_evidence' END AS state FROM placed_in
)"""


def _chosen(spark, sf):
    rows, full = base.pair_rows(spark, sf), base.full_relations(spark, sf)
    thinned = relations.spearman(rows.where(F.pmod(F.floor(F.unix_micros("endpoint") / 21_600_000_000), F.lit(4)) == 0), ["window_id"])
    signs = thinned.select(*BY, F.col("sign").alias("_sign"))
    depends = relations.dependency(spark.createDataFrame(LINEAGE, "feature string, derived_from array<string>, temporal array<string>, spatial array<string>, events array<string>"))
    nulls = _shifted(spark, sf).select(*BY, (F.col("p_value") <= 0.05).cast("int").alias("nulls_passed"), F.col("effect").alias("null_margin"))
    out = statuses(spark, sf).join(_members(spark, full), ["window_id", "pair_id"], "left").withColumn("family_reproducible", F.col("family_id") == "activity")
    out = out.join(depends, ["source", "target"], "left").join(relations.multiscale(full, list(WINDOWS)).select("pair_id", "supported_scales", "multiscale_class"), "pair_id", "left")
    for part in (audit.overlap(full, thinned, ["window_id"]).select(*BY, "overlap_class"), signs, nulls, _redundancy(spark, sf).select(*BY, "redundancy")):
        out = out.join(part, BY, "left")
    return selection.representatives(out.withColumn("sign_preserved", F.col("_sign") == F.col("sign")))


@query(f"WITH {CHOSEN} SELECT window_id, pair_id, status, family_id, failed_conditions, conditions_met, family_rank, state FROM chosen")
def representative_states(spark, sf):
    return r6(_chosen(spark, sf).select("window_id", "pair_id", "status", "family_id", "failed_conditions", "conditions_met", "family_rank", "state"))


@query(f"""WITH {CHOSEN}, c AS (SELECT count(*) AS relations, count(DISTINCT family_id) FILTER (family_reproducible) AS reproducible_families, count(*) FILTER (state = 'family_representative_candidate') AS representatives, count(*) FILTER (state = 'definitionally_constrained') AS constrained, count(*) FILTER (state = 'overlap_sensitive') AS sensitive FROM chosen)
SELECT *, CASE WHEN reproducible_families > 0 AND representatives > 0 THEN 'families_and_representatives_identified' WHEN reproducible_families > 0 THEN 'families_identified_without_representatives' WHEN constrained = relations THEN 'all_relations_definitionally_constrained' WHEN sensitive = relations THEN 'all_relations_overlap_sensitive' ELSE 'no_reproducible_families' END AS outcome FROM c""")
def selection_outcome(spark, sf):
    return selection.selection_outcome(_chosen(spark, sf))


@query(f"""WITH {PAIRS}, ends AS (SELECT window_id AS scale_id, block AS snapshot, source AS node, abs(strength) AS w FROM blk WHERE strength IS NOT NULL UNION ALL SELECT window_id, block, target, abs(strength) FROM blk WHERE strength IS NOT NULL),
nodes AS (SELECT scale_id, snapshot, node, round(sum(w), 9) AS s FROM ends GROUP BY 1, 2, 3), next AS (SELECT a.scale_id, a.snapshot, a.node, a.s AS x, b.s AS y FROM nodes a JOIN nodes b ON b.scale_id = a.scale_id AND b.snapshot = a.snapshot + 1 AND b.node = a.node),
r AS (SELECT scale_id, snapshot, rank() OVER (PARTITION BY scale_id, snapshot ORDER BY x) + (count(*) OVER (PARTITION BY scale_id, snapshot, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY scale_id, snapshot ORDER BY y) + (count(*) OVER (PARTITION BY scale_id, snapshot, y) - 1) / 2.0::DOUBLE AS ry FROM next),
g AS (SELECT scale_id, snapshot, count(*) AS common_nodes, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS c FROM r GROUP BY 1, 2)
SELECT scale_id, snapshot, common_nodes, CASE WHEN common_nodes >= 3 THEN round(c, 6) END AS topological_continuity, CASE WHEN common_nodes < 3 THEN 'insufficient_common_nodes' WHEN c IS NULL THEN 'non_identifiable_node_role_ranking' END AS reason FROM g""")
def topological_continuity(spark, sf):
    snaps = base.block_relations(spark, sf).select(F.col("window_id").alias("scale_id"), F.col("block").alias("snapshot"), "source", "target", "strength")
    return r6(draws.topological_continuity(snaps))
