"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from reelspan.llm import ann, centroids, decontaminate, hard_negatives, jaccard_join, language_id, licenses, line_dedup, packing, pieces, suffix_array, suffix_trees, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_warc": warc.op3_warc,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_suffix_array_dedup": suffix_array.op6_suffix_array_dedup,
    "op7_ann": ann.op7_ann,
    "op8_substring_dedup": suffix_trees.op8_substring_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op2_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op4_license_scan": licenses.ORACLE_SQL,
    "op5_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op6_suffix_array_dedup": suffix_array.ORACLE_SQL,
    "op8_substring_dedup": suffix_trees.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_centroid_clustering": centroids.ORACLE_SQL,
}
