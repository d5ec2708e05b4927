"""Resampling by joins and the classes of relations, against plain Python."""

import numpy as np
import pandas as pd
import pytest

from stratafold.operators import draws, relations, resample, selection
from stratafold.sources import frozen


def mixed(a, b, salt=0):
    return (a * 2654435761 + b * 40503 + salt) % 4294967296 * 69069 % 1000003


def series(n=50):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n).round(1)
    return pd.DataFrame({"k": "w", "t": range(n), "source": "a", "target": "b", "x": x, "y": (x + rng.normal(size=n)).round(1)})


def test_bootstrap_missingness_and_shifts_against_loops(spark):
    pdf = series()
    rows, n, x, y = spark.createDataFrame(pdf), len(pdf), pdf["x"].to_numpy(), pdf["y"].to_numpy()
    full = relations.spearman(rows, ["k"])
    observed = resample.spearman_of(x, y)

    def draw(rep, block=7):
        i = np.array([(mixed(rep, j // block) % n + j % block) % n for j in range(n)])
        return resample.spearman_of(x[i], y[i])

    got = draws.bootstrap(rows, full, ["k"], "t", reps=30, block=7).first()
    low, mid, high = np.quantile([draw(r) for r in range(30)], [0.025, 0.5, 0.975])
    assert (got["ci_low"], got["ci_median"], got["ci_high"]) == pytest.approx((low, mid, high)) and got["valid"] == 30 and got["interval_keeps_sign"] == (low >= 0)

    def dropped(rep):
        i = np.sort(sorted(range(n), key=lambda j: (mixed(rep, j, 977), j))[n // 10 :])
        return resample.spearman_of(x[i], y[i])

    got = draws.missingness(rows, full, ["k"], "t", reps=20).first()
    assert got["median_change"] == pytest.approx(np.median([abs(dropped(r) - observed) for r in range(20)])) and got["missingness_robust"]

    a, b = resample.ranks(x), resample.ranks(y)
    null = [abs(np.corrcoef(a, np.roll(b, 5 + mixed(r, 1) % 41))[0, 1]) for r in range(40)]
    got = draws.shift_null(rows, full, ["k"], "t", reps=40).first()
    assert got["p_value"] == pytest.approx((1 + sum(v >= abs(observed) - 1e-12 for v in null)) / 41) and got["effect"] == pytest.approx(abs(observed) - np.median(null))


def test_draws_of_nothing(spark):
    rows = spark.createDataFrame(series(5))
    full = relations.spearman(rows, ["k"])
    assert draws.bootstrap(rows, full, ["k"], "t", reps=3).count() == 0 and draws.shift_null(rows, full, ["k"], "t", reps=3).count() == 0


def test_redundancy_against_least_squares(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=["a", "p", "q"]).assign(k="w")
    pdf["b"] = pdf["p"] + pdf["q"] + 0.1 * rng.normal(size=80)
    pdf["d"], pdf["one"] = pdf["b"] * 2 + 1, 1.0
    table = spark.createDataFrame(pdf)
    flat = relations.affine(relations.pairs(table, ["a", "b", "d", "p"], ["k"]), ["k"])
    rows = selection.controlled_pairs(table, ["a", "b", "d", "p"], ["p", "one", "q"], ["k"])
    got = {(r["source"], r["target"]): r for r in selection.redundancy(rows, ["k"], flat).collect()}
    rank = {c: resample.ranks(pdf[c].to_numpy()) for c in "abpq"}

    def left(y, *controls):
        m = np.column_stack([np.ones(80), *[rank[c] for c in controls]])
        return rank[y] - m @ np.linalg.lstsq(m, rank[y], rcond=None)[0]

    assert got["a", "b"]["partial_strength"] == pytest.approx(np.corrcoef(left("a", "p", "q"), left("b", "p", "q"))[0, 1])
    assert got["b", "p"]["partial_strength"] == pytest.approx(np.corrcoef(left("b", "q"), left("p", "q"))[0, 1])
    assert got["b", "d"]["redundancy"] == "fully_redundant" and got["b", "p"]["redundancy"] == "retains_residual_information"


GOOD = {"estimability": "estimable", "strength": -0.4, "blocks": 6, "estimable_blocks": 5, "sign_preservation": 0.8, "persistence": 0.7, "ci_width": 0.5, "interval_keeps_sign": True, "loo_robust": True, "missingness_robust": True}


@pytest.mark.parametrize(("change", "status", "failed"), [
    ({}, "eligible", ""), ({"strength": 0.25}, "candidate", "strength"), ({"ci_width": 0.6, "loo_robust": None}, "candidate", "ci_width|leave_one_out"), ({"strength": 0.1}, "rejected", "strength"),
    ({"persistence": None}, "rejected", "persistence"), ({"strength": None, "estimability": "constant_component"}, "non_estimable", "estimable|strength"), ({"estimable_blocks": 3}, "candidate", "valid_blocks|block_fraction"),
])
def test_status(spark, change, status, failed):
    kinds = "estimability string, strength double, blocks long, estimable_blocks long, sign_preservation double, persistence double, ci_width double, interval_keeps_sign boolean, loo_robust boolean, missingness_robust boolean"
    r = selection.full_status(spark.createDataFrame([tuple((GOOD | change).values())], kinds)).first()
    assert (r["status"], r["failed_eligible"]) == (status, failed)


def test_representatives_and_outcome(spark):
    base = {"window_id": "w", "pair_id": "p", "status": "eligible", "family_id": "f", "family_reproducible": True, "dependency": "independent", "overlap_class": "robust", "sign_preserved": True, "supported_scales": 2,
            "multiscale_class": "all_scales", "nulls_passed": 1, "null_margin": 0.2, "redundancy": "retains_residual_information", "persistence": 0.8, "ci_width": 0.3}
    changes = [{"pair_id": "a"}, {"pair_id": "b", "ci_width": 0.2}, {"pair_id": "c", "overlap_class": "strong"}, {"pair_id": "d", "multiscale_class": "scale_inconsistent", "overlap_class": "strong"}, {"pair_id": "e", "dependency": "directly_derived"},
               {"pair_id": "g", "redundancy": "fully_redundant"}, {"pair_id": "h", "family_id": None, "family_reproducible": None}, {"pair_id": "i", "sign_preserved": None}]
    kinds = "window_id string, pair_id string, status string, family_id string, family_reproducible boolean, dependency string, overlap_class string, sign_preserved boolean, supported_scales int, multiscale_class string, nulls_passed int, null_margin double, redundancy string, persistence double, ci_width double"
    states = selection.representatives(spark.createDataFrame([tuple((base | c).values()) for c in changes], kinds))
    got = {r["pair_id"]: (r["state"], r["family_rank"], r["conditions_met"]) for r in states.collect()}
    assert got == {
        "a": ("supporting_relation", 2, 10), "b": ("family_representative_candidate", 1, 10), "c": ("overlap_sensitive", None, 9), "d": ("scale_inconsistent", None, 9), "e": ("definitionally_constrained", None, 9),
        "g": ("redundant_relation", None, 8), "h": ("insufficient_evidence", None, 8), "i": ("supporting_relation", None, 9),
    }
    assert selection.selection_outcome(states).first()["outcome"] == "families_and_representatives_identified"
    assert selection.selection_outcome(states.where("pair_id = 'c'").withColumn("family_reproducible", states["family_id"] != "f")).first()["outcome"] == "all_relations_overlap_sensitive"


def test_frozen_table_is_built_once_until_its_input_changes(spark, tmp_path):
    source, built = str(tmp_path / "in.txt"), []

    def build():
        built.append(1)
        return spark.range(len(built))

    for text, count in (("a", 1), ("a", 1), ("bcd", 2)):
        (tmp_path / "in.txt").write_text(text)
        import os

        os.utime(source, (1, 1))
        assert frozen.frozen(spark, "t", source, build).count() == count
