"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from docloom.llm import byte_bpe, collocations, fm_index, hard_negatives, language_id, line_dedup, mixing, ngram_lm, shards, simhash, suffix_dedup, toxicity, va_file

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_benchmark_decontamination": fm_index.op4,
    "op5_toxicity": toxicity.op5,
    "op6_language_id": language_id.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_va_file_top_k": va_file.op8,
    "op9_external_shuffle": shards.op9,
    "op10_ngram_lm": ngram_lm.op10,
    "op11_collocations": collocations.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_byte_bpe": byte_bpe.op13,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op4_benchmark_decontamination": fm_index.ORACLE, "op8_va_file_top_k": va_file.ORACLE,
    "op11_collocations": collocations.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE,
}
