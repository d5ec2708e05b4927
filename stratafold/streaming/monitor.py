"""The alert path as a stream: watermarked trailing windows, frozen parameters, and a
stateful episode machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import energy_joule


def trailing(events: DataFrame, length: str, step: str, lateness: str) -> DataFrame:
    """Counts, largest magnitude and log energy of windows (end - length, end]; events
    later than the watermark are dropped, as revisions become new records."""
    shifted = events.withWatermark("ts", lateness).withColumn("_t", F.col("ts") - F.expr("interval 1 microsecond"))
    grouped = shifted.groupBy(F.window("_t", length, step).alias("w")).agg(F.count("*").alias("event_count"), F.max("magnitude").alias("maximum_magnitude"), F.log10(F.sum(energy_joule(F.col("magnitude")))).alias("log_energy"))
    return grouped.select(F.col("w.end").alias("endpoint"), "event_count", "maximum_magnitude", "log_energy")


def levels(features: DataFrame, limits: dict[str, dict[str, float]]) -> DataFrame:
    """Level of each row by frozen upper limits {level: {feature: value}}; a level needs
    two features."""
    out = F.lit("normal")
    for level in ("attention", "anomaly", "structural"):
        hits = sum((F.coalesce((F.col(f) >= v).cast("int"), F.lit(0)) for f, v in limits[level].items()), F.lit(0))
        out = F.when(hits >= 2, level).otherwise(out)
    return features.withColumn("level", out)


def episodes(series: DataFrame, reset: int = 3, key: str = "stream") -> DataFrame:
    """Closed alert episodes of a stream (key, endpoint, level).

    State is the open episode and the normal rows since, a few numbers for each key.
    Rows of a batch are taken in time order; an episode is emitted once ``reset``
    normal rows have closed it.
    """
    names = {"normal": 0, "attention": 1, "anomaly": 2, "structural": 3}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, top, quiet = state.get if state.exists else (None, None, 0, 0)
        rows, out = pd.concat(batches).sort_values("endpoint"), []
        for t, level in zip(rows["endpoint"], rows["level"]):
            at = int(t.value // 1000)
            if names[level]:
                start, end, top, quiet = start or at, at, max(top or 0, names[level]), 0
            elif start:
                quiet += 1
                if quiet >= reset:
                    out.append((k[0], pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), [n for n, p in names.items() if p == top][0]))
                    start, end, top, quiet = None, None, 0, 0
        state.update((start, end, top, quiet))
        yield pd.DataFrame(out, columns=[key, "start", "end", "maximum_level"])

    return series.groupBy(key).applyInPandasWithState(step, f"{key} string, start timestamp, end timestamp, maximum_level string", "start long, end long, top int, quiet int", "append", GroupStateTimeout.NoTimeout)


def archive(stream: DataFrame, path: str, checkpoint: str, source: str):
    """Append-only log: each batch is written as Parquet; an empty one leaves a
    DATA_UNAVAILABLE record instead."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("record", F.lit("DATA"))
        if batch.isEmpty():
            stamped = batch.sparkSession.createDataFrame([(batch_id, "DATA_UNAVAILABLE")], "batch_id long, record string")
        stamped.withColumn("source", F.lit(source)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
