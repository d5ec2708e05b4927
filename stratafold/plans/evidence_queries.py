"""Queries of placebo evidence, contracts and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import associate, daily, evidence
from . import event_queries as base
from .event_queries import FEAT, LINK, PAIRS, PROB, query, r6

LEAD = 12
PLACEBO = LINK + """, linked AS (
  SELECT e.episode_id, s, e, count(c.ts) AS n_targets, arg_min(c.cluster_id, c.ts) AS first_cluster_id, (epoch_us(min(c.ts)) - epoch_us(s)) / 3600000000.0::DOUBLE AS lead_hours,
         CASE WHEN min(c.ts) <= e THEN 'overlapping' WHEN count(c.ts) > 0 THEN 'post_episode_associated' ELSE 'unassociated' END AS association
  FROM episode e LEFT JOIN cluster c ON c.ts >= s AND c.ts <= s + INTERVAL 12 HOUR GROUP BY e.episode_id, s, e
), metrics AS (
  SELECT count(*) AS episodes, count(*) FILTER (association <> 'unassociated') AS associated, count(*) FILTER (association = 'overlapping') AS overlapping, count(*) FILTER (association = 'post_episode_associated') AS post_episode,
         count(*) FILTER (association = 'unassociated') AS unassociated, count(DISTINCT first_cluster_id) AS clusters_preceded, quantile_cont(lead_hours, 0.5) AS median_lead_hours FROM linked
), sized AS (SELECT count(*) AS clusters FROM cluster)"""


def _placebo(spark, sf):
    return evidence.placebo_association(associate.associate(base.day_episodes(spark, sf), base.targets(spark, sf), LEAD))


@query(f"WITH {PLACEBO} SELECT episode_id::BIGINT AS episode_id, n_targets, first_cluster_id, round(lead_hours, 6) AS lead_hours, association FROM linked")
def placebo_association(spark, sf):
    return r6(_placebo(spark, sf).select("episode_id", "n_targets", "first_cluster_id", "lead_hours", "association"))


def _metrics(spark, sf):
    size = base.targets(spark, sf).agg(F.count("*").alias("clusters"))
    found = evidence.placebo_metrics(_placebo(spark, sf).crossJoin(F.broadcast(size)), F.col("clusters"), ["clusters"])  # one row
    return found


@query(f"""WITH {PLACEBO} SELECT clusters, episodes, associated, overlapping, post_episode, unassociated, clusters_preceded, round(median_lead_hours, 6) AS median_lead_hours, round(associated / episodes::DOUBLE, 6) AS associated_fraction,
  round(unassociated / episodes::DOUBLE, 6) AS false_discovery_fraction, round(clusters_preceded / clusters::DOUBLE, 6) AS detection_fraction FROM metrics, sized""")
def placebo_metrics(spark, sf):
    return r6(_metrics(spark, sf))


def _shifts(spark, pool: int):
    return spark.range(1, 1001).select(F.col("id").cast("int").alias("repetition"), (F.pmod(F.col("id") * 7919, F.lit(pool)) + 24).alias("shift"))


ORIGIN = "timestamp '2024-01-01'"
CLUSTER_NULL = PLACEBO + """, shifts AS (SELECT range::INT AS repetition, (24 + (range * 7919) % 673)::BIGINT AS shift FROM range(1, 1001)), moved AS (
  SELECT repetition, epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + shift * 3600000000) % (720 * 3600000000::BIGINT) AS t FROM cluster, shifts
), hit AS (
  SELECT repetition, episode_id, count(t) > 0 AS h FROM (SELECT * FROM shifts, episode) x LEFT JOIN moved m USING (repetition) WHERE t >= epoch_us(s) AND t <= epoch_us(s) + 12 * 3600000000::BIGINT GROUP BY 1, 2
), drawn AS (SELECT shifts.repetition, count(episode_id) AS hits FROM shifts LEFT JOIN hit USING (repetition) GROUP BY 1)"""


@query(f"""WITH {CLUSTER_NULL}, d AS (SELECT min(hits) AS minimum, quantile_cont(hits::DOUBLE, 0.5) AS median, avg(hits) AS mean, max(hits) AS maximum, stddev_pop(hits) AS sd, count(*) AS repetitions, (1 + count(*) FILTER (hits >= associated)) / (1.0::DOUBLE + count(*)) AS p FROM drawn, metrics)
SELECT clusters, associated, minimum, round(median, 6) AS median, round(mean, 6) AS mean, maximum, round(sd, 6) AS sd, repetitions, round(p, 6) AS p_value,
  CASE WHEN clusters < 5 THEN 'inconclusive_low_power' WHEN p < 0.05 AND associated > median THEN 'temporally_specific' WHEN p >= 0.05 AND p < 0.1 AND associated > median THEN 'preliminary' WHEN associated <= median THEN 'non_discriminating' ELSE 'preliminary' END AS evidence FROM d, metrics, sized""")
def cluster_shift_null(spark, sf):
    drawn = evidence.placebo_counts(base.day_episodes(spark, sf), base.targets(spark, sf), _shifts(spark, 673), F.expr(ORIGIN), 720, LEAD)
    seen = _metrics(spark, sf).select("clusters", "associated")
    p = associate.empirical_p(drawn.crossJoin(F.broadcast(seen)), "hits", F.col("associated"), ["clusters", "associated"]).drop("repetitions")
    out = evidence.distribution(drawn, "hits").crossJoin(F.broadcast(p))  # one row each
    kind = evidence.placebo_evidence(F.col("clusters"), F.col("associated"), F.col("median"), F.col("p_value"))
    return r6(out.withColumn("evidence", kind))


EPISODE_NULL = PLACEBO + """, shifts AS (SELECT range::INT AS repetition, (24 + (range * 7919) % 672)::BIGINT AS shift FROM range(1, 1001)), moved AS (
  SELECT repetition, episode_id, TIMESTAMP '2024-01-01' + to_hours((((epoch_us(s) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 + shift) % 720)::BIGINT) AS s FROM episode, shifts
), hit AS (SELECT DISTINCT repetition, episode_id FROM moved m JOIN cluster c ON c.ts >= m.s AND c.ts <= m.s + INTERVAL 12 HOUR),
drawn AS (SELECT shifts.repetition, count(episode_id) / any_value(episodes)::DOUBLE AS fraction FROM metrics, shifts LEFT JOIN hit USING (repetition) GROUP BY 1)"""


@query(f"""WITH {EPISODE_NULL}, d AS (SELECT quantile_cont(fraction, 0.5) AS median, any_value(associated / episodes::DOUBLE) AS f, any_value(unassociated / episodes::DOUBLE) AS fdr, count(*) AS repetitions,
  (1 + count(*) FILTER (fraction >= associated / episodes::DOUBLE)) / (1.0::DOUBLE + count(*)) AS p FROM drawn, metrics)
SELECT round(f, 6) AS associated_fraction, round(median, 6) AS null_median, round(fdr, 6) AS false_discovery_fraction, repetitions, round(p, 6) AS p_value,
  CASE WHEN p < 0.05 AND f > median AND fdr < 0.5 THEN 'specific' WHEN f <= median THEN 'non_discriminating' WHEN fdr >= 0.5 THEN 'excessive_false_positives' ELSE 'preliminary' END AS evidence FROM d""")
def episode_shift_evidence(spark, sf):
    e, t = base.day_episodes(spark, sf), base.targets(spark, sf)
    shifts = _shifts(spark, 672)
    moved = associate.shifted(e, shifts, F.expr(ORIGIN), 720)
    found = associate.associate(moved, t.crossJoin(F.broadcast(shifts.select("repetition"))), LEAD, ["repetition"])
    drawn = associate.summary(found, F.lit(1), ["repetition"]).select("repetition", F.col("precision").alias("fraction"))
    seen = _metrics(spark, sf).select("associated_fraction", "false_discovery_fraction")
    p = associate.empirical_p(drawn.crossJoin(F.broadcast(seen)), "fraction", F.col("associated_fraction"), ["associated_fraction", "false_discovery_fraction"])
    out = p.crossJoin(F.broadcast(drawn.agg(F.percentile("fraction", 0.5).alias("null_median"))))  # one row each
    kind = evidence.episode_evidence(F.col("associated_fraction"), F.col("null_median"), F.col("p_value"), F.col("false_discovery_fraction"))
    return r6(out.withColumn("evidence", kind))


@query(f"""WITH {PROB}, n AS (SELECT day, state, row_number() OVER (ORDER BY day) AS i FROM judged), a AS (SELECT *, i - row_number() OVER (ORDER BY day) AS g FROM n WHERE state <> 'quiet')
SELECT strftime(min(day), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(day), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS rows, date_diff('hour', min(day), max(day)) + 24.0::DOUBLE AS duration_hours FROM a GROUP BY g""")
def state_islands(spark, sf):
    return r6(evidence.islands(base._days(spark, sf), "day", F.col("state") != "quiet", 24.0))


@query(
    base.ORACLE["daily_alerts"].split(") SELECT day::VARCHAR")[0]
    + """), alert AS (SELECT * FROM named WHERE reason IS NOT NULL) SELECT max(day)::VARCHAR AS day, arg_max(state, day) AS state, arg_max(reason, day) AS reason,
  count(*) FILTER (day >= (SELECT max(day) FROM judged) - 30) AS recent_alerts FROM alert"""
)
def last_alert(spark, sf):
    days = base._days(spark, sf)
    return r6(evidence.last_alert(daily.alerts(days), days))


AUDITED = ["event_id", "event_type", "user_id", "value", "props"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT), 6) AS missing_fraction, count(DISTINCT {c}) AS distinct_values FROM events" for c in AUDITED))
def quality_audit(spark, sf):
    return r6(evidence.quality_audit(spark.read.parquet(f"{sf}/events.parquet"), AUDITED))


@query("""WITH t AS (SELECT DISTINCT event_type, epoch_us(ts) AS t FROM events), s AS (SELECT event_type, (t - lag(t) OVER (PARTITION BY event_type ORDER BY t)) / 3600000000.0::DOUBLE AS d FROM t), m AS (SELECT event_type, quantile_cont(d, 0.5) AS m, count(d) AS n FROM s WHERE d > 0 GROUP BY 1)
SELECT s.event_type, any_value(n) AS steps, round(any_value(m), 6) AS median_spacing_hours, round(avg((abs(d - m) > greatest(1e-9, m * 1e-6))::INT), 6) AS irregular_fraction FROM s JOIN m ON m.event_type = s.event_type WHERE d > 0 GROUP BY 1""")
def spacing_audit(spark, sf):
    return r6(evidence.spacing(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"], "ts"))


DOMAIN = ["click", "error", "purchase", "retired", "signup", "view"]


@query(f"SELECT d.event_type, count(e.event_id) AS rows FROM (VALUES {', '.join(f'''('{c}')''' for c in DOMAIN)}) d(event_type) LEFT JOIN events e ON e.event_type = d.event_type GROUP BY 1")
def class_counts(spark, sf):
    return evidence.class_counts(spark.read.parquet(f"{sf}/events.parquet"), "event_type", DOMAIN)


@query("""WITH e AS (SELECT (user_id % 40)::VARCHAR AS source, event_type AS target, ts < TIMESTAMP '2024-01-16' AS old FROM events), b AS (SELECT source || '->' || target AS edge, count(*) / (SELECT count(*) FROM e WHERE old)::DOUBLE AS w FROM e WHERE old GROUP BY 1),
c AS (SELECT source || '->' || target AS edge, count(*) / (SELECT count(*) FROM e WHERE NOT old)::DOUBLE AS w FROM e WHERE NOT old GROUP BY 1), i AS (
SELECT count(*) AS baseline_edges, count(c.w) AS common_edges, greatest(0, least(1, 1 - avg(abs(b.w - c.w)))) AS iec, count(c.w) / count(*)::DOUBLE AS inc FROM b LEFT JOIN c ON c.edge = b.edge)
SELECT baseline_edges, common_edges, round(iec, 6) AS iec, round(inc, 6) AS inc, round(iec * inc, 6) AS crm_id, round(1 - iec * inc, 6) AS aps_id, round(sqrt(1 - iec * inc), 6) AS mfac_id FROM i""")
def identity_indices(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.pmod("user_id", F.lit(40)).cast("string").alias("source"), F.col("event_type").alias("target"), (F.col("ts") < F.expr("timestamp '2024-01-16'")).alias("old"))
    counted = events.groupBy("old", "source", "target").agg(F.count("*").alias("n"))
    totals = counted.groupBy("old").agg(F.sum("n").alias("total"))
    edges = counted.join(F.broadcast(totals), "old").withColumn("weight", F.col("n") / F.col("total"))  # two rows
    return r6(evidence.identity_indices(edges.where("old"), edges.where("not old")))


@query(f"WITH {PAIRS} SELECT pair_id, count(*) AS scale_relations, round(avg(abs(strength)), 6) AS mean_weight, round(max(abs(strength)), 6) AS maximum_weight, count(*) FILTER (abs(strength) >= 0.2) AS supported_scales, string_agg(window_id, '|' ORDER BY window_id) AS window_ids FROM rel GROUP BY 1")
def pair_edges(spark, sf):
    return r6(evidence.pair_edges(base.full_relations(spark, sf)))


@query(f"""WITH {FEAT} SELECT count(*) AS rows, count(*) FILTER (window_id IS NULL OR endpoint IS NULL) AS null_keys, count(*) FILTER (event_count IS NULL OR event_count < 0) AS bad_counts, count(*) FILTER ((cumulative_energy = 0) <> (event_count = 0)) AS energy_mismatch,
  count(*) FILTER (event_count = 0 AND coalesce(maximum_magnitude, median_depth_km, centroid_latitude) IS NOT NULL) AS moments_of_nothing, count(*) FILTER (event_count < 3 AND temporal_burstiness IS NOT NULL) AS bursts_of_few, count(*) - count(DISTINCT (window_id, endpoint)) AS duplicate_keys FROM feat""")
def feature_contract(spark, sf):
    return evidence.feature_contract(base.feature_table(spark, sf))
