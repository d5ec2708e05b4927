"""Seeded resampling of relations in grouped pandas functions: one group a relation."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def seed_of(*parts: object) -> int:
    """A seed from the first eight digest bytes of the joined token."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big") % ((1 << 32) - 1)


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 with ties averaged."""
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[back]


def correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    if len(a) < 3 or a.std() == 0 or b.std() == 0:
        return None
    return float(np.clip(np.corrcoef(a, b)[0, 1], -1, 1))


def spearman_of(x: np.ndarray, y: np.ndarray) -> float | None:
    return correlation(ranks(x), ranks(y)) if len(x) else None


def sign_of(x: np.ndarray) -> np.ndarray:
    """-1, 0 or 1; values that are zero but for rounding have the sign 0."""
    return np.where(np.abs(x) <= 1e-12, 0.0, np.sign(x))


def block_indices(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Circular moving blocks that cover n rows."""
    starts = rng.integers(0, n, -(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).ravel()[:n]


def _interval(values: list[float | None]) -> tuple:
    good = [v for v in values if v is not None]
    return (len(good), *(np.quantile(good, [0.025, 0.5, 0.975]) if good else (None, None, None)))


def bootstrap(rows: DataFrame, keys: list[str], order: str, reps: int = 500, block: int = 24) -> DataFrame:
    """Moving-block bootstrap of each pair's strength: interval and sign support."""
    by = [*keys, "source", "target"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        rng, full = np.random.default_rng(seed_of(*key)), spearman_of(x, y)
        draws = [spearman_of(x[i], y[i]) for i in (block_indices(len(x), block, rng) for _ in range(reps))]
        n, low, mid, high = _interval(draws)
        support = np.mean([sign_of(d) == sign_of(full) for d in draws if d is not None]) if n and full is not None else None
        return pd.DataFrame([[*key, full, n, low, mid, high, support]], columns=[*by, "strength", "valid", "ci_low", "median", "ci_high", "sign_support"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", strength double, valid int, ci_low double, median double, ci_high double, sign_support double")


def missingness(rows: DataFrame, keys: list[str], order: str, reps: int = 100, share: float = 0.10, least: int = 20) -> DataFrame:
    """Strength after dropping a share of rows without replacement."""
    by = [*keys, "source", "target"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        rng, n = np.random.default_rng(seed_of("missing", *key)), len(pdf)
        keep = n - int(share * n)
        draws = [spearman_of(x[i], y[i]) if keep >= least else None for i in (np.sort(rng.permutation(n)[:keep]) for _ in range(reps))]
        valid, low, mid, high = _interval(draws)
        full = spearman_of(x, y)
        change = float(np.median([abs(d - full) for d in draws if d is not None])) if valid and full is not None else None
        return pd.DataFrame([[*key, valid, low, mid, high, change]], columns=[*by, "valid", "ci_low", "median", "ci_high", "median_change"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", valid int, ci_low double, median double, ci_high double, median_change double")


def nulls(rows: DataFrame, keys: list[str], order: str, block_col: str, reps: int = 300) -> DataFrame:
    """Circular-shift, calendar-block and value permutation nulls of each pair, with
    plus-one p-values and effects.  Ranks are computed once: ranking commutes with
    permutation."""
    by = [*keys, "source", "target"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = ranks(pdf["x"].to_numpy()), ranks(pdf["y"].to_numpy())
        n, observed, out = len(pdf), correlation(a, b), []
        groups = [g for _, g in pd.Series(np.arange(n)).groupby(pdf[block_col].to_numpy())]
        for name in ("circular_shift", "block_permutation", "value_permutation"):
            rng, draws = np.random.default_rng(seed_of(name, *key)), []
            for _ in range(reps if observed is not None else 0):
                if name == "circular_shift":
                    low, high = -(-n // 10), int(0.9 * n)
                    other = np.roll(b, int(rng.integers(low, max(high, low) + 1)))
                elif name == "block_permutation":
                    other = b[np.concatenate([groups[i].to_numpy() for i in rng.permutation(len(groups))])]
                else:
                    other = b[rng.permutation(n)]
                draws.append(abs(correlation(a, other)))
            p = (1 + sum(d >= abs(observed) for d in draws)) / (1 + len(draws)) if draws else None
            out.append([*key, name, observed, len(draws), p, abs(observed) - float(np.median(draws)) if draws else None])
        return pd.DataFrame(out, columns=[*by, "null_model", "strength", "repetitions", "p_value", "effect"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", null_model string, strength double, repetitions int, p_value double, effect double")


def correlation_distance(table: DataFrame, features: list[str], rows: int = 120, least: int = 56) -> DataFrame:
    """Distance of the rolling rank correlation matrix of each window to that of its
    first ``rows`` rows; NULL until there are ``least`` rows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("endpoint").reset_index(drop=True)
        upper = np.triu_indices(len(features), 1)

        def vector(part: pd.DataFrame) -> np.ndarray:
            return np.nan_to_num(part[features].rank().corr().to_numpy()[upper])

        base = vector(pdf.iloc[:rows])
        out = [float(np.linalg.norm(vector(pdf.iloc[max(0, i + 1 - rows) : i + 1]) - base) / np.sqrt(len(base))) if i + 1 >= least else None for i in range(len(pdf))]
        return pd.DataFrame({"window_id": key[0], "endpoint": pdf["endpoint"], "crm": out})

    wide = table.select("window_id", "endpoint", *[table[f].cast("double") for f in features])
    return wide.groupBy("window_id").applyInPandas(run, "window_id string, endpoint timestamp, crm double")
