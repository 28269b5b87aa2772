"""Queries of the operators, by name.

Only operator 12 has an SQL equivalent: operators 1, 3 and 5 hold a trained model, 4,
6 and 10 a tokenizer, 7 a codec and 2 CRC-32; SQL is too slow over whole tables
for 8, 9 and 13; 11 solves for eigenvectors.  The tests compare them with brute force,
exact round trips and held-out labels.
"""

from __future__ import annotations

from shiftscope.llm import flac, jaccard_join, language_id, packing, periodic_runs, quality_crf, sentencepiece_scan, sharding, substring_dedup, token_counts, toxicity, warc, whitening

QUERIES = {
    "op1_line_crf_quality": quality_crf.query,
    "op2_stratified_interleave": sharding.query,
    "op3_toxicity_cnn": toxicity.query,
    "op4_token_attribution": token_counts.query,
    "op5_byte_gru_language": language_id.query,
    "op6_best_fit_packing": packing.query,
    "op7_flac_columns": flac.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_fm_substring_dedup": substring_dedup.query,
    "op10_sentencepiece_scan": sentencepiece_scan.query,
    "op11_welford_whitening": whitening.query,
    "op12_warc_source": warc.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE_SQL: dict[str, str] = {"op12_warc_source": warc.ORACLE_SQL}
