"""Communities of small relation graphs, one group a graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def greedy_modularity(edges: list[tuple[str, str, float]]) -> list[list[str]]:
    """Agglomeration by the largest gain of weighted modularity; ties go to the first
    pair in name order."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    total = w.sum()
    groups = {i: [n] for i, n in enumerate(nodes)}
    if total <= 0:
        return sorted(groups.values())
    share, degree = w / total, w.sum(1) / total
    while len(groups) > 1:
        ids = sorted(groups, key=lambda i: groups[i])
        gain, i, j = max(((2 * (share[i, j] - degree[i] * degree[j]), -a, -b) for a, i in enumerate(ids) for b, j in enumerate(ids) if a < b and share[i, j] > 0), default=(0.0, 0, 0))
        if gain <= 1e-12:
            break
        i, j = ids[-i], ids[-j]
        groups[i] = sorted(groups[i] + groups.pop(j))
        share[i] += share[j]
        share[:, i] += share[:, j]
        degree[i] += degree[j]
        share[j], share[:, j], degree[j] = 0, 0, 0
    return sorted(groups.values())


def label_propagation(edges: list[tuple[str, str, float]], seed: int = 0, rounds: int = 50) -> list[list[str]]:
    """Asynchronous weighted label propagation in a seeded node order; ties go to the
    smaller label."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    near: dict[str, list[tuple[str, float]]] = {n: [] for n in nodes}
    for a, b, x in edges:
        near[a].append((b, x))
        near[b].append((a, x))
    label, rng = {n: n for n in nodes}, np.random.default_rng(seed)
    for _ in range(rounds):
        moved = False
        for n in rng.permutation(nodes):
            votes: dict[str, float] = {}
            for m, x in near[n]:
                votes[label[m]] = votes.get(label[m], 0.0) + x
            best = min(votes, key=lambda v: (-votes[v], v)) if votes else label[n]
            moved |= best != label[n]
            label[n] = best
        if not moved:
            break
    return sorted([sorted(n for n in nodes if label[n] == v) for v in set(label.values())])


def families(relations: DataFrame, keys: list[str], reps: int = 100) -> DataFrame:
    """Families of each key's graph (source, target, strength) with their stability:
    how often, in edge bootstraps, two members of a family fall together."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = sorted((a, b, abs(x)) for a, b, x in zip(pdf["source"], pdf["target"], pdf["strength"]))
        found, rng, together = greedy_modularity(edges), np.random.default_rng(len(edges)), {}
        for _ in range(reps):
            counts = np.bincount(rng.integers(0, len(edges), len(edges)), minlength=len(edges))
            for g in greedy_modularity([(a, b, x * c) for (a, b, x), c in zip(edges, counts) if c]):
                for i, a in enumerate(g):
                    for b in g[i + 1 :]:
                        together[a, b] = together.get((a, b), 0) + 1
        rows = []
        for i, g in enumerate(found, 1):
            inner = [together.get((a, b), 0) / reps for k, a in enumerate(g) for b in g[k + 1 :]]
            n = sum(a in g and b in g for a, b, _ in edges)
            stability = float(np.mean(inner)) if inner else None
            rows.append([*key, i, ",".join(g), len(g), n, stability, len(g) >= 2 and n >= 1 and stability >= 0.65])
        return pd.DataFrame(rows, columns=[*keys, "family_id", "members", "nodes", "relations", "stability", "reproducible"])

    kinds = dict(relations.dtypes)
    return relations.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", family_id int, members string, nodes int, relations int, stability double, reproducible boolean")
