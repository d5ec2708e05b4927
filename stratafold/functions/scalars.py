"""Scalar column expressions of the event domain; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
#: Priorities of the ordered states.
PRIORITY = {"normal": 0, "attention": 1, "anomaly": 2, "structural": 3, "critical": 4}


def finite(x: Column) -> Column:
    """NULL for NaN and infinities: missing is always NULL here."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def energy_joule(magnitude: Column) -> Column:
    """log10 E = 1.5 M + 4.8."""
    return F.pow(F.lit(10.0), magnitude * 1.5 + 4.8)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def logistic(x: Column, slope: float = 1.0, centre: float = 0.0) -> Column:
    return 1 / (1 + F.exp((x - centre) * -slope))


def clip(x: Column, low: float, high: float) -> Column:
    """Like greatest/least, but NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def directional(z: Column, direction: str) -> Column:
    """Deviation on the side that counts: upper, lower or two-sided."""
    body = {"upper": F.greatest(z, F.lit(0.0)), "lower": F.greatest(-z, F.lit(0.0)), "two_sided": F.abs(z)}[direction]
    return F.when(z.isNotNull(), body)


def flagged(x: Column, threshold: Column, direction: str) -> Column:
    """Closed threshold predicate; missing is not flagged."""
    return F.coalesce(x <= threshold if direction == "lower" else x >= threshold, F.lit(False))


def priority(state: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in PRIORITY.items() for v in p]), state), F.lit(0))


def pair_id(a: Column, b: Column) -> Column:
    """One key for an unordered pair."""
    return F.concat_ws("--", F.array_sort(F.array(a, b)))


def relation_id(a: Column, b: Column, method: str = "spearman") -> Column:
    return F.concat(F.lit(f"{method}::"), pair_id(a, b))


def window_days(window_id: Column) -> Column:
    """Days of a window name such as 7d; NULL for any other text."""
    return F.nullif(F.regexp_extract(window_id, "^([1-9][0-9]*)d$", 1), F.lit("")).try_cast("int")


def normal_header(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, "^#", ""))), "[^a-z0-9]+", "_"), "^_|_$", "")


def iso_utc(ts: Column) -> Column:
    """Text of a UTC instant: seconds, or milliseconds if it has any."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.regexp_replace(F.regexp_replace(text, r"\.000000Z$", "Z"), r"(\.\d{3})000Z$", "$1Z")


def seed_of(token: Column) -> Column:
    """A seed below 2**32 - 1 from the first eight digest bytes of a token."""
    return F.pmod(F.conv(F.substring(F.sha2(token.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit((1 << 32) - 1).cast("decimal(20,0)")).cast("long")


def min_max(x: Column, over) -> Column:
    """Scaled to 0..1; zeros if constant."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.when(x.isNotNull(), 0.0))


def max_scaled(x: Column, over) -> Column:
    """Scaled by the maximum; zeros if that is zero."""
    high = F.max(x).over(over)
    return F.when(high != 0, x / high).otherwise(0.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; NULL, not an error, where one side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
