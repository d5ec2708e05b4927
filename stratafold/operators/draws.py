"""Resampling as joins: draws are rows, so that statistics stay in built-in functions.

A draw's numbers come from a congruential mix of repetition and place, the same on
every run and every cluster.  Rows grow with relations, repetitions and length, and
are shuffled by (relation, repetition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from .relations import average_rank, sign_of, spearman


def mixed(a: Column, b: Column, salt: int = 0) -> Column:
    """A number from 0 to 1,000,002 for a repetition and a place."""
    return (a * F.lit(2654435761) + b * 40503 + salt) % F.lit(4294967296) * 69069 % 1000003


def placed(rows: DataFrame, full: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the estimable relations with their place ``i`` from 0 and their number ``n``."""
    by = [*keys, "source", "target"]
    some = rows.select(*by, order, "x", "y").join(full.where("strength is not null").select(*by), by, "left_semi")
    here = Window.partitionBy(*by)
    return some.select(*by, "x", "y", (F.row_number().over(here.orderBy(order)) - 1).cast("long").alias("i"), F.count("*").over(here).alias("n"))


def repeated(rows: DataFrame, reps: int) -> DataFrame:
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(reps).withColumnRenamed("id", "rep")))  # reps is a parameter


def block_draws(rows: DataFrame, keys: list[str], reps: int = 500, block: int = 24) -> DataFrame:
    """Circular moving-block draws (keys, source, target, rep, x, y) of placed rows."""
    by = [*keys, "source", "target"]
    start = mixed(F.col("rep"), F.floor(F.col("i") / block)) % F.col("n")
    slots = repeated(rows.select(*by, "i", "n"), reps).select(*by, "rep", ((start + F.col("i") % block) % F.col("n")).alias("i"))
    return slots.join(rows.select(*by, "i", "x", "y"), [*by, "i"]).drop("i")


def bootstrap(rows: DataFrame, full: DataFrame, keys: list[str], order: str, reps: int = 500, block: int = 24) -> DataFrame:
    """Interval of each relation's strength and whether it stays on the full sign's side."""
    by = [*keys, "source", "target"]
    drawn = spearman(block_draws(placed(rows, full, keys, order), keys, reps, block), [*keys, "rep"], least=3)
    found = drawn.groupBy(*by).agg(F.count("strength").alias("valid"), *[F.percentile("strength", q).alias(c) for c, q in (("ci_low", 0.025), ("ci_median", 0.5), ("ci_high", 0.975))])
    side = F.when(F.col("sign") > 0, F.col("ci_low") >= 0).when(F.col("sign") < 0, F.col("ci_high") <= 0).otherwise(False)
    return found.join(full.select(*by, "sign"), by).select(*by, "valid", "ci_low", "ci_median", "ci_high", (F.col("ci_high") - F.col("ci_low")).alias("ci_width"), F.coalesce(side, F.lit(False)).alias("interval_keeps_sign"))


def missingness(rows: DataFrame, full: DataFrame, keys: list[str], order: str, reps: int = 100, share: float = 0.10, least: int = 20) -> DataFrame:
    """Strength once a share of rows is dropped; robust if always estimable and mostly of the full sign."""
    by = [*keys, "source", "target"]
    here = Window.partitionBy(*by, "rep").orderBy(mixed(F.col("rep"), F.col("i"), 977), "i")
    kept = repeated(placed(rows, full, keys, order), reps).withColumn("_k", F.row_number().over(here)).where(F.col("_k") > F.floor(F.lit(share) * F.col("n")))
    drawn = spearman(kept, [*keys, "rep"], least).select(*by, F.col("strength").alias("_r"), F.col("sign").alias("_s"))
    found = drawn.join(full.select(*by, "strength", "sign"), by).groupBy(*by).agg(
        F.count("_r").alias("valid"), F.avg((F.col("_s") == F.col("sign")).cast("double")).alias("sign_fraction"), F.percentile(F.abs(F.col("_r") - F.col("strength")), 0.5).alias("median_change")
    )
    return found.withColumn("missingness_robust", (F.col("valid") == reps) & F.coalesce(F.col("sign_fraction") >= 0.75, F.lit(False)))


def shift_null(rows: DataFrame, full: DataFrame, keys: list[str], order: str, reps: int = 300) -> DataFrame:
    """Plus-one p-value and effect of each relation against circular shifts of one side by
    a tenth to nine tenths of its length.  Each shift is correlated once, however often drawn."""
    by = [*keys, "source", "target"]
    at = placed(rows, full, keys, order)
    ranked = at.select(*by, "i", "n", average_rank("x", by).alias("rx"), average_rank("y", by).alias("ry"))
    low, high = F.ceil(F.col("n") / 10), F.floor(F.col("n") * 0.9)
    drawn = repeated(at.where("i = 0").select(*by, "n"), reps).select(*by, "rep", (low + mixed(F.col("rep"), F.lit(1)) % (F.greatest(high, low) - low + 1)).alias("shift"))
    each = drawn.select(*by, "shift").distinct().join(ranked.select(*by, "i", "n", "rx"), by).withColumn("i", F.pmod(F.col("i") - F.col("shift"), F.col("n")))
    turned = each.join(ranked.select(*by, "i", "ry"), [*by, "i"]).groupBy(*by, "shift").agg(F.abs(safe_corr(F.col("rx"), F.col("ry"))).alias("v"))
    size = F.abs("strength")
    return drawn.join(turned, [*by, "shift"]).join(full.select(*by, "strength"), by).groupBy(*by).agg(
        F.count("v").alias("repetitions"), ((F.count_if(F.col("v") >= size - 1e-12) + 1) / (F.count("v") + 1)).alias("p_value"), (F.max(size) - F.percentile("v", 0.5)).alias("effect")
    )


def topological_continuity(snapshots: DataFrame, scale: str = "scale_id", least: int = 3) -> DataFrame:
    """Rank correlation of node strengths between consecutive snapshots (scale, snapshot,
    source, target, strength), over nodes that both have, if there are ``least``."""
    ends = snapshots.where("strength is not null").select(scale, "snapshot", F.explode(F.array("source", "target")).alias("node"), F.abs("strength").alias("_w"))
    # Rounded, so that equal strengths tie whatever the order of the sum.
    nodes = ends.groupBy(scale, "snapshot", "node").agg(F.round(F.sum("_w"), 9).alias("s"))
    both = nodes.withColumnRenamed("s", "x").join(nodes.select(scale, (F.col("snapshot") - 1).alias("snapshot"), "node", F.col("s").alias("y")), [scale, "snapshot", "node"])
    by = [scale, "snapshot"]
    ranked = both.select(*by, average_rank("x", by).alias("rx"), average_rank("y", by).alias("ry"))
    found = ranked.groupBy(*by).agg(F.count("*").alias("common_nodes"), safe_corr(F.col("rx"), F.col("ry")).alias("_r"))
    value = F.when(F.col("common_nodes") >= least, F.col("_r"))
    reason = F.when(F.col("common_nodes") < least, "insufficient_common_nodes").when(F.col("_r").isNull(), "non_identifiable_node_role_ranking")
    return found.select(*by, "common_nodes", value.alias("topological_continuity"), reason.alias("reason"))


def leave_one_out_robust(blocks: DataFrame, full: DataFrame, keys: list[str], least_sign: float = 0.75, most_change: float = 0.20) -> DataFrame:
    """Whether the mean block strength keeps the full sign and moves little without any one block."""
    by = [*keys, "source", "target"]
    here = Window.partitionBy(*by)
    n, total = F.count("*").over(here), F.sum("strength").over(here)
    some = blocks.where("strength is not null").select(*by, F.when(n > 1, (total - F.col("strength")) / (n - 1)).alias("_w"))
    joined = some.join(full.select(*by, "strength", "sign"), by)
    found = joined.groupBy(*by).agg(F.avg((sign_of(F.col("_w")) == F.col("sign")).cast("double")).alias("_s"), F.percentile(F.abs(F.abs("_w") - F.abs("strength")), 0.5).alias("_c"))
    return found.select(*by, F.coalesce((F.col("_s") >= least_sign) & (F.col("_c") <= most_change), F.lit(False)).alias("loo_robust"))
