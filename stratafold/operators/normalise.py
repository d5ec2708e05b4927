"""Robust normalisation against a frozen baseline, continuity metrics, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import directional

COVERAGE = 0.63


def long_form(table: DataFrame, features: list[str]) -> DataFrame:
    """(window_id, endpoint, event_count, feature, value) rows; integers become doubles."""
    wide = table.select("window_id", "endpoint", F.col("event_count").alias("_n"), *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(["window_id", "endpoint", "_n"], features, "feature", "value")


def robust_parameters(long: DataFrame, baseline: Column) -> DataFrame:
    """Median and scale of each (window, feature) over the baseline: 1.4826 MAD, else
    IQR / 1.349, else 1; and the coverage that was available for them."""
    base = long.where(baseline)
    middle = base.groupBy("window_id", "feature").agg(
        F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.75).alias("q75"),
        F.avg(F.when((F.col("feature") == "event_count") | (F.col("_n") > 0), F.col("value").isNotNull().cast("double"))).alias("coverage"),
    )
    off = base.join(F.broadcast(middle.select("window_id", "feature", "median")), ["window_id", "feature"]).groupBy("window_id", "feature").agg(F.percentile(F.abs(F.col("value") - F.col("median")), 0.5).alias("mad"))
    joined = middle.join(off, ["window_id", "feature"])
    by_mad, by_iqr = F.col("mad") * 1.4826, (F.col("q75") - F.col("q25")) / 1.349
    scale = F.when(by_mad > 0, by_mad).when(by_iqr > 0, by_iqr).otherwise(1.0)
    source = F.when(by_mad > 0, "mad").when(by_iqr > 0, "iqr").otherwise("unit")
    return joined.select("window_id", "feature", "median", scale.alias("scale"), source.alias("scale_source"), "coverage", (F.coalesce("coverage", F.lit(0.0)) >= COVERAGE).alias("covered"))


def normalised(long: DataFrame, parameters: DataFrame, directions: dict[str, str]) -> DataFrame:
    """Values with missing flags, imputed by the baseline median, as robust z,
    directional deviation and continuity 1 / (1 + deviation).

    The parameter table has a row for each window and feature, a fixed number.
    """
    joined = long.join(F.broadcast(parameters.select("window_id", "feature", "median", "scale")), ["window_id", "feature"])
    filled = joined.withColumn("missing", F.col("value").isNull()).withColumn("value", F.coalesce("value", "median"))
    z = (F.col("value") - F.col("median")) / F.col("scale")
    side = F.lit(None).cast("double")
    for kind in ("upper", "lower", "two_sided"):
        if names := [f for f, d in directions.items() if d == kind]:
            side = F.when(F.col("feature").isin(*names), directional(F.col("z"), kind)).otherwise(side)
    return filled.withColumn("z", z).withColumn("deviation", side).withColumn("continuity", 1 / (1 + F.col("deviation"))).drop("median", "scale")


def continuity_metrics(norm: DataFrame) -> DataFrame:
    """gamma: the least continuity; sci: their geometric mean, floored at 1e-12."""
    return norm.groupBy("window_id", "endpoint").agg(F.min("continuity").alias("gamma"), F.exp(F.avg(F.ln(F.greatest("continuity", F.lit(1e-12))))).alias("sci"))


def thresholds(metrics: DataFrame, baseline: Column, lower: list[str], upper: list[str] = ()) -> DataFrame:
    """Baseline tail quantiles (window, metric, direction, attention, anomaly, structural)."""
    names = [*lower, *upper]
    long = metrics.where(baseline).select("window_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["window_id"], names, "metric", "value")
    up = F.col("metric").isin(*upper) if upper else F.lit(False)
    grouped = long.groupBy("window_id", "metric").agg(*[F.percentile("value", p).alias(f"p{round(p * 100)}") for p in (0.01, 0.05, 0.10, 0.90, 0.95, 0.99)])
    return grouped.select("window_id", "metric", F.when(up, "upper").otherwise("lower").alias("direction"), F.when(up, F.col("p90")).otherwise(F.col("p10")).alias("attention"), F.when(up, F.col("p95")).otherwise(F.col("p5")).alias("anomaly"), F.when(up, F.col("p99")).otherwise(F.col("p1")).alias("structural"))
