"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from corpusflow.llm import bit_sliced, compact_windows, context_mixing, mix_tree, ngram_join, odd_sketch, packing, periodic_runs, prefix_trie, quality_model, quality_rules, secrets, toxicity

QUERIES = {
    "op1_compact_windows": compact_windows.op1_compact_windows,
    "op2_bit_sliced": bit_sliced.op2_bit_sliced,
    "op3_odd_sketch": odd_sketch.op3_odd_sketch,
    "op4_packing": packing.op4_packing,
    "op5_context_mixing": context_mixing.op5_context_mixing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_source_mix": mix_tree.op8_source_mix,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op2_bit_sliced": bit_sliced.ORACLE,
    "op3_odd_sketch": odd_sketch.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op8_source_mix": mix_tree.ORACLE,
    "op11_ngram_join": ngram_join.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
