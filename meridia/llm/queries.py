"""The queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import oracles
from meridia.llm.collocations import op13_hashed_collocations
from meridia.llm.dominance import op11_dominance_packing
from meridia.llm.embeddings import op5_spherical_cap_dedup
from meridia.llm.licenses import op8_license_scans
from meridia.llm.media import op7_media_columns
from meridia.llm.mixing import op9_raked_mixing
from meridia.llm.ngrams import op1_ngram_jaccard_join
from meridia.llm.packing import op2_best_fit_packing
from meridia.llm.quality import op6_quality_classifier
from meridia.llm.secrets import op10_secret_ownership
from meridia.llm.sharding import op4_hash_tree_sharding
from meridia.llm.substrings import op3_substring_dedup
from meridia.llm.trie import op12_heavy_path_trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_hash_tree_sharding": op4_hash_tree_sharding,
        "op5_spherical_cap_dedup": op5_spherical_cap_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_media_columns": op7_media_columns,
        "op8_license_scans": op8_license_scans,
        "op9_raked_mixing": op9_raked_mixing,
        "op10_secret_ownership": op10_secret_ownership,
        "op11_dominance_packing": op11_dominance_packing,
        "op12_heavy_path_trie": op12_heavy_path_trie,
        "op13_hashed_collocations": op13_hashed_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
