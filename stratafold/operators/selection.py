"""From evidence to classes: relation status, redundancy, representatives, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from .relations import average_rank


def failed(tests: dict[str, Column]) -> Column:
    """Names of the tests that are not true, joined by ``|``."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()])), "|")


def full_status(evidence: DataFrame, least_blocks: int = 4) -> DataFrame:
    """non_estimable > eligible > candidate > rejected by all conditions, with those that failed.

    Fixed values: strength .30 and .20, persistence .70 and .50, interval width .50 and
    .70 (eligible, candidate); estimable blocks .75; sign preservation .75.
    """
    size, width = F.abs("strength"), F.col("ci_width")
    known = (F.col("estimability") == "estimable") & F.col("strength").isNotNull()
    eligible = {
        "estimable": known, "strength": size >= 0.30, "valid_blocks": F.col("estimable_blocks") >= least_blocks, "block_fraction": F.col("estimable_blocks") / F.col("blocks") >= 0.75,
        "sign_preservation": F.col("sign_preservation") >= 0.75, "persistence": F.col("persistence") >= 0.70, "ci_width": width <= 0.50, "interval_sign": F.col("interval_keeps_sign"),
        "leave_one_out": F.col("loo_robust"), "missingness": F.col("missingness_robust"),
    }
    candidate = {"estimable": known, "strength": size >= 0.20, "persistence": F.col("persistence") >= 0.50, "ci_width": width <= 0.70}
    named = F.when(~F.coalesce(known, F.lit(False)), "non_estimable").when(failed(eligible) == "", "eligible").when(failed(candidate) == "", "candidate").otherwise("rejected")
    return evidence.withColumns({"status": named, "failed_eligible": failed(eligible), "failed_candidate": failed(candidate)})


def discovery_outcome(statuses: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Relations of each status and what they amount to."""
    found = statuses.groupBy(*keys).agg(F.count("*").alias("relations"), *[F.count_if(F.col("status") == s).alias(s) for s in ("eligible", "candidate", "rejected", "non_estimable")])
    kind = F.when(F.col("eligible") > 0, "eligible_relations_identified").when(F.col("candidate") > 0, "only_candidate_relations").when(F.col("non_estimable") == F.col("relations"), "all_relations_non_estimable").otherwise("no_eligible_relations")
    return found.withColumn("outcome", kind)


def controlled_pairs(table: DataFrame, features: list[str], controls: list[str], keys: list[str]) -> DataFrame:
    """(keys, source, target, x, y, c0, c1, ...) of all pairs; a control that is of the pair
    is a constant, and rows are complete."""
    names = sorted(features)
    value = {c: F.col(c).cast("double") for c in {*names, *controls}}
    each = [
        F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), value[a].alias("x"), value[b].alias("y"), *[(F.lit(0.0) if c in (a, b) else value[c]).alias(f"c{k}") for k, c in enumerate(controls)])
        for i, a in enumerate(names) for b in names[i + 1 :]
    ]
    return table.select(*keys, F.inline(F.array(*each))).dropna(subset=["x", "y", *[f"c{k}" for k in range(len(controls))]])


def redundancy(rows: DataFrame, keys: list[str], affine: DataFrame, least: int = 20, bar: float = 0.15) -> DataFrame:
    """What is left of each rank relation once its controls' ranks are taken out, one after
    the other.  Constant controls and those that others explain take nothing out; an affine
    pair is redundant whatever is left."""
    by = [*keys, "source", "target"]
    controls = sorted(c for c in rows.columns if c[0] == "c" and c[1:].isdigit())
    names = ["x", "y", *controls]
    ranked = rows.select(*by, *[average_rank(c, by).alias(c) for c in names])
    couples = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = ranked.groupBy(*by).agg(F.count("*").alias("n"), *[safe_corr(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in couples])
    found = found.withColumns({f"{a}_{b}": F.coalesce(f"{a}_{b}", F.lit(0.0)) for a, b in couples if (a, b) != ("x", "y")}).withColumn("strength", F.col("x_y"))
    for k, c in enumerate(controls):
        left = ["x", "y", *controls[k + 1 :]]
        some = [(a, b) for i, a in enumerate(left) for b in left[i + 1 :]]

        def rest(a: str, b: str, c: str = c) -> Column:
            p, q = (F.col(f"{d}_{c}" if d in "xy" else f"{c}_{d}") for d in (a, b))
            free = (1 - p * p) * (1 - q * q)
            got = F.when(free > 1e-12, (F.col(f"{a}_{b}") - p * q) / F.sqrt(free))
            return got if (a, b) == ("x", "y") else F.coalesce(got, F.lit(0.0))

        found = found.withColumns({f"{a}_{b}": rest(a, b) for a, b in some})
    partial = F.when(F.col("n") >= least, F.col("x_y"))
    flags = affine.select(*by, F.col("affine").alias("_affine"))
    kind = F.when(F.coalesce("_affine", F.lit(False)) | (F.abs(partial) < bar), "fully_redundant").when(partial.isNull(), "conditional_test_inconclusive").otherwise("retains_residual_information")
    return found.join(flags, by, "left").select(*by, "n", "strength", partial.alias("partial_strength"), kind.alias("redundancy"))


def with_singletons(relations: DataFrame, membership: DataFrame, key: list[str]) -> DataFrame:
    """Every relation with a family: those of ``membership`` (key, family_id), and each other
    one as a family of its own, named by its key."""
    lone = relations.join(membership, key, "left_anti").select(*key, F.concat(F.lit("single:"), F.concat_ws("/", *key)).alias("family_id"), F.lit(True).alias("singleton"))
    return relations.select(*key).join(membership, key).select(*key, "family_id", F.lit(False).alias("singleton")).unionByName(lone)


def representatives(evidence: DataFrame, least_scales: int = 2, least_nulls: int = 1, most: int = 1) -> DataFrame:
    """Ten conditions, the rank within a family among relations that meet them all, and
    the state of each relation.

    Needs window_id, pair_id, status, family_id, family_reproducible, dependency,
    overlap_class, sign_preserved, supported_scales, multiscale_class, nulls_passed,
    null_margin, redundancy, persistence and ci_width.
    """
    tests = {
        "status_allowed": F.col("status").isin("eligible", "candidate"), "family_membership": F.col("family_id").isNotNull(), "family_reproducible": F.col("family_reproducible"),
        "not_directly_derived": ~F.coalesce(F.col("dependency") == "directly_derived", F.lit(False)), "not_overlap_sensitive": ~F.coalesce(F.col("overlap_class") == "strong", F.lit(False)),
        "sign_preserved": F.col("sign_preserved"), "supported_scales": F.col("supported_scales") >= least_scales, "nulls_exceeded": F.col("nulls_passed") >= least_nulls,
        "residual_information": F.col("redundancy") == "retains_residual_information", "not_fully_redundant": ~F.coalesce(F.col("redundancy") == "fully_redundant", F.lit(False)),
    }
    judged = evidence.withColumn("failed_conditions", failed(tests)).withColumn("conditions_met", sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests.values()), F.lit(0)))
    sturdy = F.when(F.col("overlap_class") == "robust", 2).when(F.col("overlap_class") == "moderate", 1).otherwise(0)
    informed = F.when(F.col("redundancy") == "retains_residual_information", 2).when(F.col("redundancy") == "partially_redundant", 1).otherwise(0)
    # Rounded, so that values equal but for the order of a sum tie.
    order = [F.col("supported_scales").desc_nulls_last(), sturdy.desc(), F.round("null_margin", 9).desc_nulls_last(), informed.desc(), F.round("persistence", 9).desc_nulls_last(), F.round("ci_width", 9).asc_nulls_last(), F.col("pair_id"), F.col("window_id")]
    whole = F.col("failed_conditions") == ""
    rank = F.when(whole, F.row_number().over(Window.partitionBy("family_id", whole).orderBy(*order)))
    chosen = judged.withColumn("family_rank", rank)
    state = (
        F.when(F.col("multiscale_class") == "scale_inconsistent", "scale_inconsistent").when(F.col("overlap_class") == "strong", "overlap_sensitive")
        .when(F.col("dependency") == "directly_derived", "definitionally_constrained").when(F.col("redundancy") == "fully_redundant", "redundant_relation")
        .when(F.col("family_rank") <= most, "family_representative_candidate").when(F.col("family_id").isNotNull() & F.coalesce("family_reproducible", F.lit(False)), "supporting_relation").otherwise("insufficient_evidence")
    )
    return chosen.withColumn("state", state)


def selection_outcome(states: DataFrame) -> DataFrame:
    """How many families and representatives there are and what that amounts to."""
    found = states.agg(
        F.count("*").alias("relations"), F.count_distinct(F.when(F.col("family_reproducible"), F.col("family_id"))).alias("reproducible_families"),
        *[F.count_if(F.col("state") == s).alias(n) for s, n in (("family_representative_candidate", "representatives"), ("definitionally_constrained", "constrained"), ("overlap_sensitive", "sensitive"))],
    )
    families, chosen, rows = F.col("reproducible_families") > 0, F.col("representatives") > 0, F.col("relations")
    kind = (
        F.when(families & chosen, "families_and_representatives_identified").when(families, "families_identified_without_representatives").when(F.col("constrained") == rows, "all_relations_definitionally_constrained")
        .when(F.col("sensitive") == rows, "all_relations_overlap_sensitive").otherwise("no_reproducible_families")
    )
    return found.withColumn("outcome", kind)
