"""Event catalogue sources and their contracts."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import haversine_km, normal_header

FEED = "event_id string, time string, latitude string, longitude string, depth string, magnitude string"
CATALOGUE = ["event_id", "ts", "latitude", "longitude", "depth_km", "magnitude"]
#: Accepted names of pipe-separated catalogue columns.
ALIASES = {
    "event_id": ["eventid", "event_id"],
    "time": ["time", "time_utc", "origin_time"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon"],
    "depth": ["depth_km", "depth", "depth_km_"],
    "magnitude": ["magnitude", "mag", "md"],
}


def typed(raw: DataFrame) -> DataFrame:
    """Text columns as a catalogue: what does not parse becomes NULL."""
    number = {c: F.col(c).try_cast("double") for c in ("latitude", "longitude", "depth", "magnitude")}
    return raw.select(
        F.trim("event_id").alias("event_id"), F.try_to_timestamp("time").alias("ts"),
        number["latitude"].alias("latitude"), number["longitude"].alias("longitude"), number["depth"].alias("depth_km"), number["magnitude"].alias("magnitude"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV event feed; rows without time or magnitude are dropped."""
    return typed(spark.read.csv(path, schema=FEED, header=True)).dropna(subset=["ts", "magnitude"])


def read_pipe_text(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated text with a header line that starts with #; ragged rows fail."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#")).limit(1).collect()
    if not header:
        raise ValueError("no header line")
    names = [r["n"] for r in spark.createDataFrame([(c,) for c in header[0]["value"].split("|")], "c string").select(normal_header(F.col("c")).alias("n")).collect()]
    found = {want: next((names.index(a) for a in aliases if a in names), None) for want, aliases in ALIASES.items()}
    if missing := [w for w, at in found.items() if at is None]:
        raise ValueError(f"no column for {missing}")
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", r"\|", -1).alias("p"))
    body = body.select(F.when(F.size("p") == len(names), F.col("p")).otherwise(F.raise_error(F.lit("a ragged row"))).alias("p"))
    return typed(body.select(*[F.element_at("p", at + 1).alias(w) for w, at in found.items()]))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point features with mag, place and epoch milliseconds."""
    point = "id string, properties struct<mag:double,place:string,time:bigint>, geometry struct<coordinates:array<double>>"
    raw = spark.read.json(path, schema=f"features array<struct<{point.replace(' ', ':', 1).replace(', properties ', ',properties:').replace(', geometry ', ',geometry:')}>>", multiLine=True)
    f = raw.select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select(
        F.col("f.id").alias("event_id"), F.timestamp_millis("f.properties.time").alias("ts"), F.get(at, 1).alias("latitude"), F.get(at, 0).alias("longitude"),
        F.get(at, 2).alias("depth_km"), F.col("f.properties.mag").alias("magnitude"), F.col("f.properties.place").alias("place"),
    ).where("magnitude is not null and latitude is not null and longitude is not null")


def time_chunks(start: datetime, end: datetime, days: int = 30) -> list[tuple[datetime, datetime]]:
    """Request ranges [s, min(s + days, end)]; the next starts one second later."""
    out = []
    while start <= end:
        stop = min(start + timedelta(days=days), end)
        out.append((start, stop))
        start = stop + timedelta(seconds=1)
    return out


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def verify_digest(path: str, sidecar: str | None = None) -> str:
    """The file's SHA-256, which must be the first word of its sidecar."""
    digest = file_digest(path)
    with open(sidecar or f"{path}.sha256", encoding="utf-8") as f:
        if f.read().split()[:1] != [digest]:
            raise ValueError(f"digest of {path} differs from its sidecar")
    return digest


def find_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that the frame has, in any case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"none of {candidates} in {df.columns}")


def cleaned(catalogue: DataFrame, cutoff: Column, centre: tuple[float, float], radius_km: float) -> tuple[DataFrame, DataFrame]:
    """Valid rows, first of each id, and one row of counters for what was dropped."""
    far = haversine_km(F.lit(centre[0]), F.lit(centre[1]), F.col("latitude"), F.col("longitude")) > radius_km
    required = F.col("ts").isNull() | F.col("magnitude").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull()
    reason = F.when(F.coalesce(F.trim("event_id"), F.lit("")) == "", "empty_id").when(required, "missing_value").when(F.col("ts") > cutoff, "after_cutoff").when(far, "outside_radius")
    flagged = catalogue.withColumn("_reason", reason)
    good = flagged.where("_reason is null").drop("_reason")
    # First of an id in time order; a struct minimum combines before the shuffle.
    rest = [c for c in good.columns if c not in ("event_id", "ts")]
    unique = good.groupBy("event_id").agg(F.min(F.struct("ts", *rest)).alias("r")).select("event_id", "r.*").select(*catalogue.columns)
    counters = flagged.agg(F.count("*").alias("rows"), *[F.count_if(F.col("_reason") == r).alias(r) for r in ("empty_id", "missing_value", "after_cutoff", "outside_radius")], F.count_if(F.col("_reason").isNull()).alias("valid"), F.count_distinct(F.when(F.col("_reason").isNull(), F.col("event_id"))).alias("distinct_ids"))
    return unique, counters


def contract(df: DataFrame, keys: list[str], required: list[str], expected_rows: int | None = None) -> DataFrame:
    """Violations of a frame's contract as one row of counts, in one pass and one group-by."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required])
    rows = F.coalesce(F.sum("n"), F.lit(0))
    wrong = F.lit(0).cast("long") if expected_rows is None else F.abs(rows - expected_rows)
    return per_key.agg(rows.alias("rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), wrong.alias("row_difference"), *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in required])


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def from_events(events: DataFrame) -> DataFrame:
    """The driver's event stream as a catalogue: sizes become magnitudes, and places
    follow from user ids."""
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1)
    return events.where("value > 0").select(
        F.col("event_id"), F.col("ts").cast(T.TimestampType()).alias("ts"), "event_type", F.log10("value").alias("magnitude"), (F.nullif(k, F.lit("")).cast("double") / 10).alias("depth_km"),
        (F.pmod(F.col("user_id") * 37, F.lit(170)) - 85).cast("double").alias("latitude"), (F.pmod(F.col("user_id") * 53, F.lit(360)) - 180).cast("double").alias("longitude"),
    )
