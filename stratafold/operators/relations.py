"""Pairwise rank relations between features and their audits.

All pairs of a window come from one long table: ranks are windows over (window,
pair), so work is shuffled by pair and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, pair_id, safe_corr

LEAST, UNIQUE = 20, 3


def pairs(table: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, source, target, x, y): complete, finite values of all unordered pairs."""
    names = sorted(features)
    each = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), finite(F.col(a).cast("double")).alias("x"), finite(F.col(b).cast("double")).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return table.select(*keys, F.inline(F.array(*each))).where("x is not null and y is not null")


def sign_of(strength: Column) -> Column:
    """-1, 0 or 1; a strength that is zero but for rounding has the sign 0."""
    return F.when(F.abs(strength) <= 1e-12, 0).otherwise(F.signum(strength)).cast("int")


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def spearman(rows: DataFrame, keys: list[str], least: int = LEAST, unique: int = UNIQUE) -> DataFrame:
    """Strength of each (keys, source, target) with the reason where it has none."""
    by = [*keys, "source", "target"]
    ranked = rows.select(*by, "x", "y", average_rank("x", by).alias("_rx"), average_rank("y", by).alias("_ry"))
    found = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("x").alias("_ux"), F.count_distinct("y").alias("_uy"), safe_corr(F.col("_rx"), F.col("_ry")).alias("_r"))
    state = F.when(F.col("n") < least, "insufficient_observations").when((F.col("_ux") < unique) | (F.col("_uy") < unique), "constant_component").otherwise("estimable")
    r = F.when(state == "estimable", F.least(F.greatest(F.col("_r"), F.lit(-1.0)), F.lit(1.0)))
    return found.select(*keys, "source", "target", pair_id(F.col("source"), F.col("target")).alias("pair_id"), "n", r.alias("strength"), sign_of(r).alias("sign"), state.alias("estimability"))


def persistence(full: DataFrame, blocks: DataFrame, keys: list[str], least: float = 0.20) -> DataFrame:
    """Share of all blocks that keep both sign and strength of the full relation."""
    by = [*keys, "source", "target"]
    joined = blocks.select(*by, "block", F.col("strength").alias("_b"), F.col("sign").alias("_s")).join(full.select(*by, "strength", "sign"), by)
    kept_sign, kept_strength = F.col("_s") == F.col("sign"), F.abs("_b") >= least
    return joined.groupBy(*by).agg(
        F.count("*").alias("blocks"), F.count("_b").alias("estimable_blocks"), F.avg(F.when(F.col("_b").isNotNull(), (kept_sign).cast("double"))).alias("sign_preservation"),
        (F.count_if(kept_sign & kept_strength) / F.count("*")).alias("persistence"), F.percentile("_b", 0.5).alias("median_block_strength"),
    )


def leave_one_block(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Mean block strength without each block, and its sign and change."""
    by = Window.partitionBy(*keys, "source", "target")
    some = blocks.where("strength is not null")
    total, n = F.sum("strength").over(by), F.count("*").over(by)
    without = F.when(n > 1, (total - F.col("strength")) / (n - 1))
    return some.select(*keys, "source", "target", "block", without.alias("without_block"), F.abs(without - total / n).alias("change"), (sign_of(without) == sign_of(total)).alias("same_sign"))


def status(evidence: DataFrame) -> DataFrame:
    """non_estimable > eligible > candidate > rejected, with the eligible conditions
    that failed.  Needs strength, persistence, sign_preservation, blocks and
    estimable_blocks."""
    tests = {
        "full_strength": F.abs("strength") >= 0.30, "block_fraction": F.col("estimable_blocks") / F.col("blocks") >= 0.75,
        "persistence": F.col("persistence") >= 0.70, "sign_preservation": F.col("sign_preservation") >= 0.75,
    }
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()])), "|")
    candidate = (F.abs("strength") >= 0.20) & (F.col("persistence") >= 0.50)
    named = F.when(F.col("strength").isNull(), "non_estimable").when(failed == "", "eligible").when(F.coalesce(candidate, F.lit(False)), "candidate").otherwise("rejected")
    return evidence.withColumn("status", named).withColumn("failed_conditions", failed)


def affine(rows: DataFrame, keys: list[str], tolerance: float = 1e-9, near: float = 0.995) -> DataFrame:
    """Least-squares line of y on x with its largest residual; near-duplicates have
    |rank correlation| of at least ``near``, affine pairs no residual to speak of."""
    by = [*keys, "source", "target"]
    fit = rows.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.max(F.abs("y")).alias("_top"), F.count("*").alias("n"))
    residual = rows.join(fit, by).groupBy(*by).agg(F.max(F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))).alias("max_residual"))
    rank = spearman(rows, keys).select(*by, "strength")
    out = fit.join(residual, by).join(rank, by)
    return out.select(*by, "n", "slope", "intercept", "max_residual", F.coalesce(F.col("max_residual") <= F.greatest(F.lit(1.0), F.col("_top")) * tolerance, F.lit(False)).alias("affine"), F.coalesce(F.abs("strength") >= near, F.lit(False)).alias("near_duplicate"))


def lag1(rows: DataFrame, keys: list[str], value: str, order: str, least: int = 3) -> DataFrame:
    """Lag-1 autocorrelation over values that are not missing."""
    some = rows.where(F.col(value).isNotNull())
    by = Window.partitionBy(*keys).orderBy(order)
    both = some.select(*keys, F.col(value).alias("_x"), F.lag(value).over(by).alias("_p"))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("_p") >= least, safe_corr(F.col("_x"), F.col("_p"))).alias("autocorrelation"))


def strided(rows: DataFrame, keys: list[str], order: str, stride: int) -> DataFrame:
    """Every ``stride``-th row of each key from its first, on a regular grid."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).where(F.pmod("_n", F.lit(stride)) == 0).drop("_n")


def multiscale(relations: DataFrame, scales: list[str]) -> DataFrame:
    """One row for each pair with its strength by scale, how many scales support it and
    whether their signs agree."""
    wide = relations.groupBy("pair_id").pivot("window_id", scales).agg(F.first("strength"))
    values = F.array_compact(F.array(*[F.col(s) for s in scales]))
    signs = F.array_distinct(F.transform(values, sign_of))
    strong = F.size(F.filter(values, lambda v: F.abs(v) >= 0.20))
    consistent = F.size(signs) == 1
    kind = F.when(F.size(values) == 0, "non_estimable").when(~consistent, "scale_inconsistent").when(strong == len(scales), "all_scales").when(strong >= 2, "multi_scale").when(strong == 1, "single_scale").otherwise("unsupported")
    return wide.select("pair_id", *[F.col(s).alias(f"scale_{s}") for s in scales], strong.alias("supported_scales"), F.when(F.size(values) > 0, consistent).alias("sign_consistent"), kind.alias("multiscale_class"))


def dependency(lineage: DataFrame) -> DataFrame:
    """Dependency class of feature pairs from their lineage (feature, derived_from,
    temporal, spatial, events as arrays)."""
    a, b = lineage.alias("a"), lineage.alias("b")
    p = a.join(b, F.col("a.feature") < F.col("b.feature"))

    def shares(c: str) -> Column:
        return F.arrays_overlap(f"a.{c}", f"b.{c}")

    direct = F.array_contains("a.derived_from", F.col("b.feature")) | F.array_contains("b.derived_from", F.col("a.feature"))
    kind = F.when(direct, "directly_derived").when(shares("derived_from"), "partially_derived").when(shares("temporal"), "shared_temporal").when(shares("spatial"), "shared_spatial").when(shares("events"), "shared_event").otherwise("independent")
    return p.select(F.col("a.feature").alias("source"), F.col("b.feature").alias("target"), kind.alias("dependency"))


def node_strength(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.where("strength is not null").select(*keys, F.explode(F.array("source", "target")).alias("node"), F.abs("strength").alias("_w"))
    return both.groupBy(*keys, "node").agg(F.sum("_w").alias("node_strength"), F.count("*").alias("degree"))


def edge_weights(evidence: DataFrame) -> DataFrame:
    """Composite weight of an edge: strength, persistence and supported scales.

    Fixed values: 0.20 strength, 0.20 persistence, 0.20 scales over 4.
    """
    weight = F.coalesce(F.abs("strength"), F.lit(0.0)) * 0.20 + F.coalesce("persistence", F.lit(0.0)) * 0.20 + F.coalesce("supported_scales", F.lit(0)) / 4 * 0.20
    return evidence.withColumn("weight", weight)


def top_by_rank(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def transitions(snapshots: DataFrame, scale: str = "scale_id") -> DataFrame:
    """Continuity between consecutive snapshots (scale, snapshot, pair_id, strength):
    edge, weight and sign continuity and their mean over what is estimable."""
    left = snapshots.select(scale, "snapshot", "pair_id", F.col("strength").alias("a"))
    right = snapshots.select(scale, (F.col("snapshot") - 1).alias("snapshot"), "pair_id", F.col("strength").alias("b"))
    both = left.join(right, [scale, "snapshot", "pair_id"], "full_outer")
    last = snapshots.groupBy(scale).agg(F.min("snapshot").alias("_lo"), F.max("snapshot").alias("_hi"))
    both = both.join(last, scale).where((F.col("snapshot") >= F.col("_lo")) & (F.col("snapshot") < F.col("_hi")))
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    some = F.col("a").isNotNull() | F.col("b").isNotNull()
    grouped = both.groupBy(scale, "snapshot").agg(
        F.try_divide(F.count_if(common).cast("double"), F.count_if(some)).alias("edge_continuity"), safe_corr(F.abs("a"), F.abs("b")).alias("weight_continuity"),
        F.avg(F.when(common, (sign_of(F.col("a")) == sign_of(F.col("b"))).cast("double"))).alias("sign_continuity"), F.count_if(common).alias("common_relations"),
    )
    parts = F.array_compact(F.array("edge_continuity", (F.col("weight_continuity") + 1) / 2, "sign_continuity"))
    return grouped.withColumn("rcs", F.when(F.size(parts) >= 2, F.aggregate(parts, F.lit(0.0), lambda x, y: x + y) / F.size(parts)))
