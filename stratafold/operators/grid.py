"""Grid cells of a catalogue: activity scores, phases and composite risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import max_scaled

SIZE = 2
#: Weights of energy, acceleration, memory, clustering and magnitude.
RISK = {"energy": 0.28, "accel": 0.22, "memory": 0.20, "neighbours": 0.18, "max_mag": 0.12}


def _cells():
    """All cells: a 2-degree grid has at most 16,200, whatever the events' number."""
    return Window.partitionBy(F.lit(0))


def cell(x: Column, size: int = SIZE) -> Column:
    return (F.floor(x / size) * size).cast("long")


def cells(catalogue: DataFrame, size: int = SIZE) -> DataFrame:
    at = [cell(F.col("latitude"), size).alias("lat_cell"), cell(F.col("longitude"), size).alias("lon_cell")]
    return catalogue.groupBy(*at).agg(F.count("*").alias("n_events"), F.avg("magnitude").alias("avg_mag"))


def toy_phases(found: DataFrame) -> DataFrame:
    """Log activity of each cell against the mean, and a phase.

    Percentiles are of the scaled score while the unscaled one is compared with them;
    results depend on this, so it is kept.
    """
    raw = F.col("n_events") * F.col("avg_mag")
    base = F.avg(raw).over(_cells())
    toy = F.bround(F.greatest(F.log1p(F.when(base > 0, raw / base).otherwise(0.0)), F.lit(0.0)), 3)
    scored = found.withColumn("toy_score", toy)
    low, high = F.min("toy_score").over(_cells()), F.max("toy_score").over(_cells())
    scored = scored.withColumn("norm_score", F.when(high > low, F.bround((F.col("toy_score") - low) / (high - low), 3)).otherwise(0.0))
    cuts = scored.withColumn("_p", F.percentile("norm_score", [0.3, 0.5, 0.7, 0.9]).over(_cells()))
    close = F.abs(F.get("_p", 3) - F.get("_p", 0)) < 0.5
    s = F.col("toy_score")

    def ladder(levels: list) -> Column:
        return F.when(s >= levels[3], "critical").when(s >= levels[2], "high").when(s >= levels[1], "moderate").when(s >= levels[0], "low").otherwise("stable")

    phase = F.when(close, ladder([1.5, 3.0, 5.0, 7.0])).otherwise(ladder([F.get("_p", i) for i in range(4)]))
    return cuts.withColumn("phase", phase).drop("_p")


def neighbours(found: DataFrame, size: int = SIZE, reach: int = 2) -> DataFrame:
    """Occupied cells within ``reach`` steps, as an equi-join on neighbour offsets: each
    cell emits a fixed number of rows, so there is no theta join.  No wrap at 180."""
    steps = [(i * size, j * size) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i, j) != (0, 0)]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    around = found.select("lat_cell", "lon_cell", F.explode(offsets).alias("o")).select((F.col("lat_cell") + F.col("o.i")).alias("lat_cell"), (F.col("lon_cell") + F.col("o.j")).alias("lon_cell"))
    near = around.groupBy("lat_cell", "lon_cell").agg(F.count("*").alias("neighbours"))
    return found.join(near, ["lat_cell", "lon_cell"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def risk(catalogue: DataFrame, now: Column, size: int = SIZE) -> DataFrame:
    """Composite risk of each cell, scaled by the largest, with phase and trend."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("ts")) / 86_400_000_000.0)
    energy = F.pow(F.lit(10.0), F.greatest(F.col("magnitude"), F.lit(0.0)) * 1.5)
    at = [cell(F.col("latitude"), size).alias("lat_cell"), cell(F.col("longitude"), size).alias("lon_cell")]
    found = catalogue.groupBy(*at).agg(
        F.count("*").alias("n_events"), F.sum(energy).alias("energy"), F.sum(energy * F.exp(age * -0.05)).alias("memory"), F.greatest(F.max("magnitude"), F.lit(0.0)).alias("max_mag"),
        F.count_if(age <= 7).alias("recent"), F.count_if((age > 7) & (age <= 30)).alias("previous"),
    )
    rate, before = F.col("recent") / 7.0, F.col("previous") / 23.0
    found = neighbours(found.withColumn("accel", F.when(before > 0, rate / before).when(F.col("recent") > 0, 2.0).otherwise(1.0)), size)
    trend = F.when(F.col("accel") > 1.25, "Rising").when(F.col("accel") < 0.85, "Falling").otherwise("Stable")
    score = sum((max_scaled(F.col(c), _cells()) * w for c, w in RISK.items()), F.lit(0.0))
    scored = found.withColumn("_score", score).withColumn("risk", max_scaled(F.col("_score"), _cells()))
    r = F.col("risk")
    phase = F.when(r < 0.30, "Stable").when(r < 0.50, "Perturbation").when(r < 0.70, "Instability").when(r < 0.90, "Critical Cluster").otherwise("Transition Risk")
    return scored.select("lat_cell", "lon_cell", "n_events", "max_mag", "accel", "neighbours", "risk", trend.alias("trend"), phase.alias("phase"))


def top_cells(scored: DataFrame, n: int, at_least: float | None = None) -> DataFrame:
    kept = scored if at_least is None else scored.where(F.col("risk") >= at_least)
    return kept.orderBy(F.desc("risk"), "lat_cell", "lon_cell").limit(n)
