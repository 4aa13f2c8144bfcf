"""Queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from . import byte_bpe, collocations, decontamination, fingerprints, jaccard_join, languages, pages, prefix_counts, ranked_search, sharding, substring_dedup, surrogates, toxicity
from .common import Query


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": byte_bpe.op1_byte_bpe,
        "op2_surrogates": surrogates.op2_surrogates,
        "op3_prefix_counts": prefix_counts.op3_prefix_counts,
        "op4_wu_manber": decontamination.op4_wu_manber,
        "op5_minimax_shards": sharding.op5_minimax_shards,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language_spans": languages.op7_language_spans,
        "op8_main_text": pages.op8_main_text,
        "op9_bottom_k": fingerprints.op9_bottom_k,
        "op10_count_vector_rtree": jaccard_join.op10_count_vector_rtree,
        "op11_pair_maxscore": ranked_search.op11_pair_maxscore,
        "op12_collocations": collocations.op12_collocations,
        "op13_relative_lz": substring_dedup.op13_relative_lz,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_pair_maxscore": ranked_search.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
