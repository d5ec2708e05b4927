"""Audits of rank relations: overlap, null outcomes, redundancy, snapshot nulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from .relations import average_rank
from .resample import correlation, seed_of, sign_of


def overlap_class(change: Column) -> Column:
    """How far a strength moves once overlapping windows are thinned out."""
    return F.when(change.isNull(), "non_estimable").when(change <= 0.15, "robust").when(change <= 0.30, "moderate").otherwise("strong")


def overlap(full: DataFrame, thinned: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, "source", "target"]
    both = full.select(*by, "strength").join(thinned.select(*by, F.col("strength").alias("thinned_strength")), by, "left")
    change = F.abs(F.col("strength") - F.col("thinned_strength"))
    return both.select(*by, "strength", "thinned_strength", change.alias("change"), overlap_class(change).alias("overlap_class"))


def null_outcome(nulls: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome of a relation over its nulls, with the largest p-value and least effect."""
    grouped = nulls.groupBy(*keys).agg(
        F.count("p_value").alias("_n"), F.count_if(F.col("p_value") <= 0.05).alias("_five"), F.count_if(F.col("p_value") <= 0.10).alias("_ten"), F.max("p_value").alias("maximum_p"), F.min("effect").alias("minimum_effect")
    )
    kind = F.when(F.col("_n") == 0, "not_admissible").when(F.col("_five") >= 2, "exceeds_null").when(F.col("_ten") >= 1, "partially_exceeds_null").when(F.col("minimum_effect") <= 0, "equivalent_to_null").otherwise("inconclusive")
    return grouped.select(*keys, "maximum_p", "minimum_effect", kind.alias("null_outcome"))


def partial_spearman(table: DataFrame, keys: list[str], x: str, y: str, control: str) -> DataFrame:
    """Rank correlation of x and y with the ranks of one control taken out, over
    complete rows, and whether the control explains most of it."""
    some = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in (x, y, control)]).dropna()
    ranked = some.select(*keys, *[average_rank(c, keys).alias(c) for c in (x, y, control)])
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), *[safe_corr(F.col(a), F.col(b)).alias(name) for name, a, b in (("rxy", x, y), ("rxz", x, control), ("ryz", y, control))])
    r, a, b = F.col("rxy"), F.col("rxz"), F.col("ryz")
    partial = F.try_divide(r - a * b, F.sqrt((1 - a * a) * (1 - b * b)))
    kind = F.when(partial.isNull(), "non_estimable").when(F.abs(partial) < 0.15, "redundant").otherwise("informative")
    return got.select(*keys, "n", r.alias("strength"), partial.alias("partial_strength"), kind.alias("redundancy"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return total * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def spearman_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation by Student's t."""
    if r is None or n < 3 or math.isnan(r):
        return None
    return 0.0 if abs(r) >= 1 else _beta_fraction((n - 2) / 2, 0.5, 1 - r * r)


def with_p_values(relations: DataFrame) -> DataFrame:
    kinds = ", ".join(f"{c} {t}" for c, t in relations.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(p_value=[spearman_p(r, int(n)) for r, n in zip(pdf["strength"], pdf["n"])])

    return relations.mapInPandas(run, f"{kinds}, p_value double")


def continuity_of(before: np.ndarray, after: np.ndarray) -> float | None:
    """Mean of sign agreement and scaled weight correlation over common relations."""
    some = ~np.isnan(before) & ~np.isnan(after)
    if not some.any():
        return None
    parts = [float(np.mean(sign_of(before[some]) == sign_of(after[some]))), float(some.sum() / max((~np.isnan(before) | ~np.isnan(after)).sum(), 1))]
    weight = correlation(np.abs(before[some]), np.abs(after[some]))
    return float(np.mean([*parts, (weight + 1) / 2] if weight is not None else parts))


def surrogate(row: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights and signs of the relations that are estimable, each shuffled among them."""
    out, some = row.copy(), ~np.isnan(row)
    out[some] = rng.permutation(np.abs(row[some])) * rng.permutation(np.sign(row[some]))
    return out


def snapshot_nulls(snapshots: DataFrame, scale: str = "scale_id", reps: int = 200) -> DataFrame:
    """Observed mean continuity of each scale against three nulls: snapshots in random
    order, relation labels permuted in each snapshot, and weights and signs shuffled."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="snapshot", columns="pair_id", values="strength", dropna=False).sort_index().to_numpy()

        def mean(m: np.ndarray) -> float | None:
            got = [c for c in (continuity_of(a, b) for a, b in zip(m, m[1:])) if c is not None]
            return float(np.mean(got)) if got else None

        observed, rows = mean(x), []
        for name in ("temporal_permutation", "label_permutation", "weight_sign_surrogate"):
            rng, draws = np.random.default_rng(seed_of(name, *key)), []
            for _ in range(reps if observed is not None else 0):
                if name == "temporal_permutation":
                    m = x[rng.permutation(len(x))]
                elif name == "label_permutation":
                    m = np.array([r[rng.permutation(len(r))] for r in x])
                else:
                    m = np.array([surrogate(r, rng) for r in x])
                if (value := mean(m)) is not None:
                    draws.append(value)
            p = (1 + sum(d >= observed for d in draws)) / (1 + len(draws)) if draws else None
            rows.append([key[0], name, observed, float(np.median(draws)) if draws else None, p, observed - float(np.median(draws)) if draws else None])
        return pd.DataFrame(rows, columns=[scale, "null_model", "observed", "null_median", "p_value", "effect"])

    return snapshots.groupBy(scale).applyInPandas(run, f"{scale} string, null_model string, observed double, null_median double, p_value double, effect double")


def continuity_outcome(nulls: DataFrame, transitions: DataFrame, scale: str = "scale_id", least: int = 5) -> DataFrame:
    """Supported if every null is exceeded, partial if some are; a scale with fewer than
    ``least`` estimable transitions is not identifiable."""
    known = transitions.groupBy(scale).agg(F.count("rcs").alias("estimable_transitions"))
    grouped = nulls.groupBy(scale).agg(F.count("*").alias("_n"), F.count_if(F.col("p_value") <= 0.05).alias("_hit"), F.max("p_value").alias("maximum_p"))
    kind = F.when(F.col("estimable_transitions") < least, "NON_IDENTIFIABLE").when(F.col("_hit") == F.col("_n"), "CONTINUITY_SUPPORTED").when(F.col("_hit") > 0, "PARTIAL_CONTINUITY").otherwise("NOT_SUPPORTED")
    return known.join(grouped, scale, "left").select(scale, "estimable_transitions", "maximum_p", kind.alias("outcome"))
