"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import (
    bpe, exact_dedup, fill_middle, jaccard_join, line_blocks, mixing, pairwise_quality, perplexity, personal_data, phrases, secrets_forest,
    suffix_dedup, toxicity,
)
from ledgerline.session import ship_package


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in {
    "op1_pairwise_quality": pairwise_quality.op1_pairwise_quality,
    "op2_perplexity": perplexity.op2_perplexity,
    "op3_line_blocks": line_blocks.op3_line_blocks,
    "op4_personal_data": personal_data.op4_personal_data,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_repeats": suffix_dedup.op6_repeats,
    "op7_bpe": bpe.op7_bpe,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_secrets": secrets_forest.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_phrases": phrases.op13_phrases,
}.items()}

ORACLES = {
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
