"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm.decontaminate import SQL9, op9_suffix_array
from pairwright.llm.embeddings import SQL4, op4_sorted_projection
from pairwright.llm.mixing import SQL1, op1_pfair_mix
from pairwright.llm.pii import op6_boosted_candidates
from pairwright.llm.ppm import op5_ppm_scores
from pairwright.llm.sharding import SQL7, op7_histogram_sort
from pairwright.llm.simhash import op2_simhash_dedup
from pairwright.llm.tokens import op3_token_counts
from pairwright.llm.toxicity import op8_counterfactual
from pairwright.llm.warc import SQL10, op10_warc_splits


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pfair_mix, op2_simhash_dedup, op3_token_counts, op4_sorted_projection, op5_ppm_scores, op6_boosted_candidates, op7_histogram_sort, op8_counterfactual, op9_suffix_array, op10_warc_splits)}


def oracle_sql() -> dict[str, str]:
    return {"op1_pfair_mix": SQL1, "op4_sorted_projection": SQL4, "op7_histogram_sort": SQL7, "op9_suffix_array": SQL9, "op10_warc_splits": SQL10}
