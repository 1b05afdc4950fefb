"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op3_kmeans_tree_search
from .bpe import op1_token_counts, op10_byte_bpe
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .line_dedup import OP7_SQL, op7_line_dedup
from .ngram_join import OP9_SQL, op9_ngram_jaccard_join
from .packing import op6_best_fit_packing
from .pii import op5_pii_surrogates
from .quality import op8_quality_classifier
from .substring_dedup import op4_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_token_counts": op1_token_counts,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_kmeans_tree_search": op3_kmeans_tree_search,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_pii_surrogates": op5_pii_surrogates,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_byte_bpe": op10_byte_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op2_exact_dedup": OP2_SQL, "op7_line_dedup": OP7_SQL, "op9_ngram_jaccard_join": OP9_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
