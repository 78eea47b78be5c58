"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from labelaudit.llm import exact_dedup, language, merkle, mixing, neighbours, packing, quality, resampling, sharding, simhash, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_sharding": sharding.op2_sharding,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_id": language.op4_language_id,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_token_files": token_files.op10_token_files,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle": merkle.op12_merkle,
    "op13_resampling": resampling.op13_resampling,
}
SQL = {"op2_sharding": sharding.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL, "op12_merkle": merkle.SQL, "op13_resampling": resampling.SQL}
