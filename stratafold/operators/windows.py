"""Left-open trailing windows (E - d, E] on a regular grid, and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import energy_joule, haversine_km

FEATURES = [
    "event_count", "maximum_magnitude", "median_magnitude", "cumulative_energy", "log_energy", "median_depth_km", "depth_mad_km", "centroid_latitude", "centroid_longitude",
    "spatial_dispersion_km", "median_interevent_hours", "interevent_mad_hours", "temporal_burstiness",
]


def grid(catalogue: DataFrame, step: str) -> DataFrame:
    """Endpoints from the first to the last event's step, inclusive."""
    span = catalogue.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a is not null")
    edge = F.window(F.col("a") - F.expr("interval 1 microsecond"), step)
    first = span.select(edge["end"].alias("a"), "b")
    return first.select(F.explode(F.sequence("a", F.window(F.col("b") - F.expr("interval 1 microsecond"), step)["end"], F.expr(f"interval {step}"))).alias("endpoint"))


def assigned(catalogue: DataFrame, windows: dict[str, str], step: str) -> DataFrame:
    """Every event once for each window that holds it.  Spark's windows are [s, e); a
    shift of one microsecond makes them (s, e]."""
    parts = [catalogue.select(F.lit(name).alias("window_id"), F.window(F.col("ts") - F.expr("interval 1 microsecond"), length, step)["end"].alias("endpoint"), "*") for name, length in windows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _median(x: Column) -> Column:
    """Median of an array without nulls; NULL if empty."""
    ordered = F.array_sort(x)
    n = F.size(x)
    half = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, half)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def mad(x: Column) -> Column:
    """Median absolute deviation, unscaled, of an array."""
    return _let(_median(x), lambda m: _median(F.transform(x, lambda v: F.abs(v - m))))


def features(catalogue: DataFrame, windows: dict[str, str], step: str, least_depth: int = 2, least_spatial: int = 2, least_intervals: int = 2) -> DataFrame:
    """Thirteen features for each (endpoint, window); an empty window counts zero
    events and no energy, and all else is NULL.

    One shuffle by (window, endpoint).  Events of a window are one array, so window
    length times event rate bounds a group, not the input.
    """
    x, y, z = (F.cos(F.radians("latitude")) * F.cos(F.radians("longitude")), F.cos(F.radians("latitude")) * F.sin(F.radians("longitude")), F.sin(F.radians("latitude")))
    grouped = assigned(catalogue, windows, step).groupBy("window_id", "endpoint").agg(
        F.count("*").alias("event_count"), F.max("magnitude").alias("maximum_magnitude"), F.percentile("magnitude", 0.5).alias("median_magnitude"),
        F.sum(energy_joule(F.col("magnitude"))).alias("cumulative_energy"), F.percentile("depth_km", 0.5).alias("median_depth_km"),
        F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(z).alias("_z"),
        F.array_sort(F.collect_list(F.struct("ts", "latitude", "longitude", "depth_km"))).alias("_e"),
    )
    grouped = grouped.withColumn("centroid_latitude", F.degrees(F.atan2("_z", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2)))).withColumn("centroid_longitude", F.degrees(F.atan2("_y", "_x")))
    gaps = F.transform(F.slice("_e", 2, F.greatest(F.size("_e") - 1, F.lit(0))), lambda e, i: (F.unix_micros(e["ts"]) - F.unix_micros(F.get("_e", i)["ts"])) / 3_600_000_000.0)
    far = F.transform("_e", lambda e: haversine_km(F.col("centroid_latitude"), F.col("centroid_longitude"), e["latitude"], e["longitude"]))
    depths = F.filter(F.transform("_e", lambda e: e["depth_km"]), lambda d: d.isNotNull())
    lists = grouped.select("*", gaps.alias("_gaps"), far.alias("_far"), depths.alias("_depths"))
    n = F.size("_gaps")
    mean = F.aggregate("_gaps", F.lit(0.0), lambda a, b: a + b) / n
    spread = _let(mean, lambda m: F.struct(m.alias("m"), F.sqrt(F.aggregate("_gaps", F.lit(0.0), lambda a, b: a + (b - m) * (b - m)) / n).alias("s")))
    burst = _let(spread, lambda v: F.when(v["s"] + v["m"] > 0, (v["s"] - v["m"]) / (v["s"] + v["m"])))
    found = lists.select(
        "window_id", "endpoint", "event_count", "maximum_magnitude", "median_magnitude", "cumulative_energy", F.when(F.col("cumulative_energy") > 0, F.log10("cumulative_energy")).alias("log_energy"),
        "median_depth_km", F.when(F.size("_depths") >= least_depth, mad(F.col("_depths"))).alias("depth_mad_km"), "centroid_latitude", "centroid_longitude",
        F.when(F.col("event_count") >= least_spatial, _median(F.col("_far"))).alias("spatial_dispersion_km"), _median(F.col("_gaps")).alias("median_interevent_hours"),
        F.when(n > 0, mad(F.col("_gaps"))).alias("interevent_mad_hours"), F.when(n >= least_intervals, burst).alias("temporal_burstiness"),
    )
    every = grid(catalogue, step).select(F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_id"), "endpoint")
    return every.join(found, ["window_id", "endpoint"], "left").withColumns({"event_count": F.coalesce("event_count", F.lit(0)), "cumulative_energy": F.coalesce("cumulative_energy", F.lit(0.0))})
