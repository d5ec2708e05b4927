"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import boosting, classlm, fixity, media, mixing, packing, rules, simhash, substrings, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_audit": fixity.query,
        "op2_simhash_ball": simhash.query,
        "op3_pareto_mixing": mixing.query,
        "op4_netpbm_bmp": media.query,
        "op5_boosted_trees": boosting.query,
        "op6_url_logistic": urls.query,
        "op7_decision_lists": rules.query,
        "op8_brown_classes": classlm.query,
        "op9_bin_completion": packing.query,
        "op10_seed_extend": substrings.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_audit": fixity.ORACLE,
        "op3_pareto_mixing": mixing.ORACLE,
        "op10_seed_extend": substrings.ORACLE,
    }
