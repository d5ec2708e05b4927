"""Placebo evidence, contracts and small audits; all built-in aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .associate import HOUR, associate


def placebo_association(associations: DataFrame) -> DataFrame:
    """overlapping, post_episode_associated or unassociated: what follows after the lead does not count."""
    kind = F.when(F.col("association") == "overlapping", "overlapping").when(F.col("association") == "associated", "post_episode_associated").otherwise("unassociated")
    return associations.withColumn("association", kind)


def placebo_metrics(associations: DataFrame, n_clusters: Column, keys: list[str] = ()) -> DataFrame:
    """Counts and fractions of placebo associations; a cluster counts once, and only if
    it is the first of an episode.  Fractions of nothing are zero."""
    hit = F.col("association") != "unassociated"
    grouped = associations.groupBy(*keys).agg(
        F.count("*").alias("episodes"), F.count_if(hit).alias("associated"), F.count_if(F.col("association") == "overlapping").alias("overlapping"),
        F.count_if(F.col("association") == "post_episode_associated").alias("post_episode"), F.count_if(~hit).alias("unassociated"),
        F.count_distinct(F.when(hit, F.col("first_cluster_id"))).alias("clusters_preceded"), F.percentile(F.when(hit, F.col("lead_hours")), 0.5).alias("median_lead_hours"),
    )

    def share(part: str, whole: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), whole), F.lit(0.0))

    return grouped.withColumns({"associated_fraction": share("associated", F.col("episodes")), "false_discovery_fraction": share("unassociated", F.col("episodes")), "detection_fraction": share("clusters_preceded", n_clusters)})


def shifted_targets(targets: DataFrame, shifts: DataFrame, origin: Column, hours: int) -> DataFrame:
    """Every target under every circular shift (repetition, shift); parts of hours stay."""
    width = hours * HOUR
    moved = F.unix_micros(origin) + F.pmod(F.unix_micros("ts") - F.unix_micros(origin) + F.col("shift") * HOUR, F.lit(width))
    return targets.crossJoin(F.broadcast(shifts)).select("repetition", "cluster_id", F.timestamp_micros(moved).alias("ts"))  # few clusters, once a repetition


def placebo_counts(episodes: DataFrame, targets: DataFrame, shifts: DataFrame, origin: Column, hours: int, lead_hours: float) -> DataFrame:
    """Rows (repetition, hits): associated episodes under each shift of the clusters."""
    every = episodes.crossJoin(F.broadcast(shifts.select("repetition")))
    found = associate(every, shifted_targets(targets, shifts, origin, hours), lead_hours, ["repetition"])
    return found.groupBy("repetition").agg(F.count_if(F.col("association").isin("overlapping", "associated")).alias("hits"))


def distribution(rows: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Least, median, mean, greatest and standard deviation (of the population); NULL if empty."""
    return rows.groupBy(*keys).agg(F.min(value).alias("minimum"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("maximum"), F.stddev_pop(value).alias("sd"), F.count(value).alias("repetitions"))


def episode_evidence(fraction: Column, null_median: Column, p: Column, false_discovery: Column) -> Column:
    """Class of the evidence from shifted episodes."""
    return F.when((p < 0.05) & (fraction > null_median) & (false_discovery < 0.5), "specific").when(fraction <= null_median, "non_discriminating").when(false_discovery >= 0.5, "excessive_false_positives").otherwise("preliminary")


def placebo_evidence(n_clusters: Column, observed: Column, null_median: Column, p: Column, least: int = 5) -> Column:
    """Class of the evidence from shifted clusters; with few clusters there is too little power."""
    return F.when(n_clusters < least, "inconclusive_low_power").when((p < 0.05) & (observed > null_median), "temporally_specific").when((p >= 0.05) & (p < 0.10) & (observed > null_median), "preliminary").when(observed <= null_median, "non_discriminating").otherwise("preliminary")


def islands(levels: DataFrame, order: str, active: Column, step_hours: float, keys: list[str] = ()) -> DataFrame:
    """Runs of rows that are active, from the first to one step past the last."""
    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    numbered = levels.select(*keys, F.col(order).cast("timestamp").alias("_t"), active.alias("_a"), F.row_number().over(ordered).alias("_n")).where("_a")
    run = numbered.withColumn("_g", F.col("_n") - F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_n")))
    found = run.groupBy(*keys, "_g").agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count("*").alias("rows"))
    return found.drop("_g").withColumn("duration_hours", (F.unix_micros("end") - F.unix_micros("start")) / HOUR + step_hours)


def last_alert(alerts: DataFrame, days: DataFrame, recent: int = 30) -> DataFrame:
    """The last alert and how many fall into the last ``recent`` days of the series."""
    end = days.agg(F.max("day").alias("_end"))
    return alerts.crossJoin(F.broadcast(end)).agg(F.max("day").alias("day"), F.max_by("state", "day").alias("state"), F.max_by("reason", "day").alias("reason"), F.count_if(F.col("day") >= F.date_sub("_end", recent)).alias("recent_alerts"))


def quality_audit(table: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing and number of distinct values of each column, in one pass and an unpivot."""
    got = table.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    return got.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("missing_fraction"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])))


def spacing(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Median spacing of the distinct instants in hours and the share of steps that differ from it."""
    distinct = rows.select(*keys, F.unix_micros(F.col(order).cast("timestamp")).alias("_t")).distinct()
    step = (F.col("_t") - F.lag("_t").over(Window.partitionBy(*keys).orderBy("_t"))) / HOUR
    steps = distinct.select(*keys, step.alias("_d")).where("_d > 0")
    middle = steps.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("median_spacing_hours"), F.count("*").alias("steps"))
    odd = F.abs(F.col("_d") - F.col("median_spacing_hours")) > F.greatest(F.lit(1e-9), F.col("median_spacing_hours") * 1e-6)
    return steps.join(middle, keys).groupBy(*keys).agg(F.first("steps").alias("steps"), F.first("median_spacing_hours").alias("median_spacing_hours"), F.avg(odd.cast("double")).alias("irregular_fraction"))


def class_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows of each class of a domain, classes without rows included."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(c,) for c in domain], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count("*").alias("rows")), column, "left").select(column, F.coalesce("rows", F.lit(0)).alias("rows"))


def identity_indices(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Continuity indices of two edge sets (source, target, weight): of the weights of
    common edges, of the edges, their product, its complement and the root of that."""
    edge = F.concat("source", F.lit("->"), "target")
    both = baseline.select(edge.alias("edge"), F.col("weight").alias("b")).join(current.select(edge.alias("edge"), F.col("weight").alias("c")), "edge", "left")
    found = both.agg(F.avg(F.abs(F.col("b") - F.col("c"))).alias("_delta"), F.count("c").alias("common_edges"), F.count("*").alias("baseline_edges"))
    iec = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("_delta", F.lit(1.0))))
    inc = F.coalesce(F.try_divide(F.col("common_edges").cast("double"), F.col("baseline_edges")), F.lit(0.0))
    crm = F.col("iec") * F.col("inc")
    return found.withColumn("iec", iec).withColumn("inc", inc).select("baseline_edges", "common_edges", "iec", "inc", crm.alias("crm_id"), (1 - crm).alias("aps_id"), F.sqrt(1 - crm).alias("mfac_id"))


def pair_edges(relations: DataFrame, weight: str = "strength", least: float = 0.20) -> DataFrame:
    """One graph edge for each pair of features from its relations at all scales."""
    size = F.abs(weight)
    return relations.groupBy("pair_id").agg(
        F.count("*").alias("scale_relations"), F.avg(size).alias("mean_weight"), F.max(size).alias("maximum_weight"), F.count_if(size >= least).alias("supported_scales"), F.array_join(F.array_sort(F.collect_set("window_id")), "|").alias("window_ids")
    )


def feature_contract(features: DataFrame) -> DataFrame:
    """How many rows of a feature table break each rule: keys unique and present, counts
    not negative, energy zero just where nothing happened, moments only of events."""
    keys = features.groupBy("window_id", "endpoint").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    empty, count = F.col("cumulative_energy") == 0, F.col("event_count")
    rules = {
        "null_keys": F.col("window_id").isNull() | F.col("endpoint").isNull(), "bad_counts": count.isNull() | (count < 0), "energy_mismatch": empty != (count == 0),
        "moments_of_nothing": (count == 0) & F.coalesce("maximum_magnitude", "median_depth_km", "centroid_latitude").isNotNull(), "bursts_of_few": (count < 3) & F.col("temporal_burstiness").isNotNull(),
    }
    return features.agg(F.count("*").alias("rows"), *[F.count_if(r).alias(n) for n, r in rules.items()]).crossJoin(F.broadcast(keys))  # one row each
