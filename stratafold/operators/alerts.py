"""Window alerts, persistence, global alerts and alert episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flagged, priority

LEVELS = ["attention", "anomaly", "structural"]


def window_alerts(metrics: DataFrame, thresholds: DataFrame, names: list[str], least: int = 2, run: int = 2) -> DataFrame:
    """Level of each (window, endpoint): a level is raw when ``least`` metrics pass its
    threshold, persistent after ``run`` endpoints in a row, and the strongest one wins.

    The threshold table has a row for each window and metric, a fixed number.
    """
    long = metrics.select("window_id", "endpoint", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["window_id", "endpoint"], names, "metric", "value")
    joined = long.join(F.broadcast(thresholds), ["window_id", "metric"])

    def passed(level: str):
        low = flagged(F.col("value"), F.col(level), "lower")
        return F.when(F.col("direction") == "lower", low).otherwise(flagged(F.col("value"), F.col(level), "upper"))

    raw = joined.groupBy("window_id", "endpoint").agg(*[(F.count_if(passed(level)) >= least).alias(level) for level in LEVELS])
    order = Window.partitionBy("window_id").orderBy("endpoint").rowsBetween(1 - run, 0)
    held = raw.select("window_id", "endpoint", *[(F.min(level).over(order) & (F.count("*").over(order) == run)).alias(level) for level in LEVELS])
    return held.withColumn("level", F.when(F.col("structural"), "structural").when(F.col("anomaly"), "anomaly").when(F.col("attention"), "attention").otherwise("normal"))


def global_alerts(windows: DataFrame, primary: str, least: int = 2) -> DataFrame:
    """One level for each endpoint: at least ``least`` windows hold it, and a structural
    alert needs the primary window as well."""
    at = {level: i + 1 for i, level in enumerate(LEVELS)}
    ranked = windows.withColumn("_p", priority(F.col("level")))
    grouped = ranked.groupBy("endpoint").agg(
        *[F.count_if(F.col("_p") >= p).alias(f"_{level}") for level, p in at.items()], F.max((F.col("window_id") == primary) & (F.col("_p") >= 3)).alias("_primary"),
        F.array_sort(F.collect_list(F.when(F.col("_p") > 0, F.col("window_id")))).alias("_who"),
    )
    level = F.when((F.col("_structural") >= least) & F.col("_primary"), "structural").when(F.col("_anomaly") >= least, "anomaly").when(F.col("_attention") >= least, "attention").otherwise("normal")
    return grouped.select("endpoint", level.alias("level"), F.array_join("_who", ",").alias("confirming"))


def episodes(series: DataFrame, reset: int = 3, keys: list[str] = ()) -> DataFrame:
    """Alert episodes of (endpoint, level): normal runs shorter than ``reset`` do not
    end one; it ends at its last row that is not normal."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("endpoint")
    rows = series.withColumn("_n", F.row_number().over(order)).where("level != 'normal'")
    first = F.coalesce(F.col("_n") - F.lag("_n").over(order) - 1 >= reset, F.lit(True))
    marked = rows.withColumn("episode_id", F.sum(first.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy(*keys, "episode_id").agg(F.min("endpoint").alias("start"), F.max("endpoint").alias("end"), F.max_by("level", priority(F.col("level"))).alias("maximum_level"), F.count("*").alias("n_endpoints"))
    return found.withColumn("duration_hours", (F.unix_micros("end") - F.unix_micros("start")) / 3_600_000_000.0)


def lead_time(series: DataFrame, target_time, remote_fraction: float = 0.5) -> DataFrame:
    """Lead from the first structural, else first anomaly, else first attention row
    before a target, and its class."""
    before = series.where(F.col("endpoint") <= target_time)
    firsts = before.agg(*[F.min(F.when(F.col("level") == level, F.col("endpoint"))).alias(level) for level in LEVELS], F.avg((F.col("level") != "normal").cast("double")).alias("alert_fraction"))
    first = F.coalesce("structural", "anomaly", "attention")
    seconds = (F.unix_micros(target_time) - F.unix_micros(first)) / 1e6
    kind = F.when(first.isNull(), "no_signal").when(F.col("alert_fraction") >= remote_fraction, "remote_or_nondiscriminating").when(seconds < 3600, "coincident").when(seconds < 86_400, "short_hours")
    kind = kind.when(seconds < 604_801, "short_days").when(seconds < 2_592_001, "structural").otherwise("remote_or_nondiscriminating")
    return firsts.select(first.alias("first_alert"), (seconds / 3600).alias("lead_hours"), "alert_fraction", kind.alias("lead_class"))
