"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline

from . import curriculum, decontaminate, hard_negatives, langid, matroska, prefix_trie, quality, simhash, sitetree, token_counts, tokens, toxicity, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op4_language_id": langid.op4_language_id,
    "op7_simhash_golay": simhash.op7_simhash_golay,
    "op1_arc_to_warc": warc.op1_arc_to_warc,
    "op3_matroska": matroska.op3_matroska,
    "op5_site_style_tree": sitetree.op5_site_style_tree,
    "op6_quality_lsa": quality.op6_quality_lsa,
    "op9_toxicity_zstd": toxicity.op9_toxicity_zstd,
    "op10_repair_tokens": tokens.op10_repair_tokens,
    "op8_curriculum_mix": curriculum.op8_curriculum_mix,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES = {"op1_arc_to_warc": warc.OP1_SQL, "op2_decontaminate": decontaminate.OP2_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
