"""Event clusters, their association with alert episodes, and shift controls.

Interval joins go through time buckets: an episode emits the buckets that its reach
touches, events their own bucket, and the join is on equal buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def clusters(events: DataFrame, gap: str = "24 hours", keys: list[str] = ()) -> DataFrame:
    """Sessions of events: a gap of more than ``gap`` starts a new one.  The largest
    event stands for its cluster, the earliest of equals."""
    best = F.min(F.struct(-F.col("magnitude"), F.col("ts"), F.col("event_id"))).alias("b")
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda m: m["event_id"].cast("string")), ",").alias("member_event_ids")
    found = events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("event_count"), best, members)
    out = found.select(*keys, "start", "end", F.col("b.event_id").alias("representative_id"), F.col("b.ts").alias("representative_ts"), F.round(-F.col("b.col1"), 12).alias("magnitude"), "event_count", "member_event_ids")
    return out.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("start")))


def _bucket(micros: Column, width: int) -> Column:
    return F.floor(micros / width)


def associate(episodes: DataFrame, targets: DataFrame, lead_hours: float, keys: list[str] = ()) -> DataFrame:
    """For each episode the first target at start <= t <= start + lead, how many there
    are, and its class: overlapping within the episode, associated in the lead,
    remote if a target follows later, else unassociated.

    ``keys`` (repetitions, sensitivity cells) are part of every join key.
    """
    lead = int(lead_hours * HOUR)
    t = targets.select(*keys, "cluster_id", F.unix_micros("ts").alias("_t")).withColumn("_b", _bucket(F.col("_t"), lead))
    e = episodes.withColumn("_s", F.unix_micros("start")).withColumn("_e", F.unix_micros("end"))
    reach = e.withColumn("_b", F.explode(F.sequence(_bucket(F.col("_s"), lead), _bucket(F.col("_s") + lead, lead))))
    near = reach.join(t, [*keys, "_b"]).where((F.col("_t") >= F.col("_s")) & (F.col("_t") <= F.col("_s") + lead))
    hits = near.groupBy(*keys, "episode_id").agg(F.count("*").alias("n_targets"), F.min(F.struct("_t", "cluster_id")).alias("first"))
    last = targets.groupBy(*keys).agg(F.max(F.unix_micros("ts")).alias("_last")) if keys else targets.agg(F.max(F.unix_micros("ts")).alias("_last"))
    out = e.join(hits, [*keys, "episode_id"], "left")
    out = out.join(last, keys, "left") if keys else out.crossJoin(F.broadcast(last))
    kind = F.when(F.col("first._t") <= F.col("_e"), "overlapping").when(F.col("first").isNotNull(), "associated").when(F.col("_last") > F.col("_s") + lead, "remote").otherwise("unassociated")
    return out.select(*keys, "episode_id", "start", "end", F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.col("first.cluster_id").alias("first_cluster_id"), ((F.col("first._t") - F.col("_s")) / HOUR).alias("lead_hours"), kind.alias("association"))


def detected(episodes: DataFrame, targets: DataFrame, lead_hours: float) -> DataFrame:
    """Targets that some episode start precedes by at most the lead: a semi join on buckets."""
    lead = int(lead_hours * HOUR)
    s = episodes.select(F.unix_micros("start").alias("_s")).withColumn("_b", F.explode(F.sequence(_bucket(F.col("_s"), lead), _bucket(F.col("_s") + lead, lead))))
    t = targets.withColumn("_t", F.unix_micros("ts"))
    same = (_bucket(t["_t"], lead) == s["_b"]) & (s["_s"] <= t["_t"]) & (s["_s"] >= t["_t"] - lead)
    return t.join(s, same, "left_semi").drop("_t")


def next_target(episodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Forward as-of: the first target at or after each episode's end, by one sort of
    both streams."""
    both = targets.select(F.col("ts"), F.lit(1).alias("_k"), F.struct("ts", "cluster_id").alias("_t"), F.lit(None).cast("bigint").alias("episode_id")).unionByName(
        episodes.select(F.col("end").alias("ts"), F.lit(0).alias("_k"), F.lit(None).cast("struct<ts:timestamp,cluster_id:int>").alias("_t"), F.col("episode_id").cast("bigint"))
    )
    ahead = Window.partitionBy(F.lit(0)).orderBy("ts", "_k").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("n", F.first("_t", ignorenulls=True).over(ahead)).where("_k = 0").select("episode_id", F.col("n.cluster_id").alias("cluster_id"), F.col("n.ts").alias("next_ts"))


def summary(associations: DataFrame, n_targets: Column, keys: list[str] = ()) -> DataFrame:
    hit = F.col("association").isin("overlapping", "associated")
    grouped = associations.groupBy(*keys).agg(F.count("*").alias("episodes"), F.count_if(hit).alias("associated"), F.count_distinct(F.when(hit, F.col("first_cluster_id"))).alias("clusters_hit"), F.percentile(F.when(hit, F.col("lead_hours")), 0.5).alias("median_lead_hours"))
    return grouped.withColumn("precision", F.try_divide("associated", "episodes")).withColumn("false_discovery", 1 - F.col("precision")).withColumn("detection", F.try_divide(F.col("clusters_hit"), n_targets))


def shifted(episodes: DataFrame, shifts: DataFrame, origin: Column, hours: int) -> DataFrame:
    """Every episode under every circular shift (repetition, shift) of whole hours;
    durations stay."""
    s = F.unix_micros("start")
    offset = F.floor((s - F.unix_micros(origin)) / HOUR)
    start = F.unix_micros(origin) + F.pmod(offset + F.col("shift"), F.lit(hours)) * HOUR
    moved = episodes.crossJoin(F.broadcast(shifts))  # each repetition is its own copy of the few episodes
    return moved.select("repetition", "episode_id", F.timestamp_micros(start).alias("start"), F.timestamp_micros(start + F.unix_micros("end") - s).alias("end"))


def empirical_p(null: DataFrame, value: str, observed: Column, keys: list[str] = ()) -> DataFrame:
    """(1 + #{null >= observed}) / (1 + repetitions)."""
    return null.groupBy(*keys).agg(((F.count_if(F.col(value) >= observed) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("repetitions"))


def benjamini_hochberg(p_values: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    """p m / rank, made monotone from the largest rank down, at most 1."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.col(p).asc())
    ranked = p_values.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(group))
    down = group.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q_value", F.least(F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down), F.lit(1.0))).drop("_r", "_m")


def leave_one_out(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The mean of the others for each left-out row: (sum - x) / (n - 1)."""
    every = rows.agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return rows.crossJoin(F.broadcast(every)).select(key, F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).alias("mean_without"))
