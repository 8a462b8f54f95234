"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from brindle.llm import chat, collocations, decontamination, gated_lm, html_text, packing, pii, quality, record_files, sharding, simhash, spelling, toxicity

QUERIES = {
    "op1_gated_lm": gated_lm.op1_gated_lm,
    "op2_page_text": html_text.op2_page_text,
    "op3_simhash_components": simhash.op3_simhash_components,
    "op4_pack_sequences": packing.op4_pack_sequences,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_kd_shards": sharding.op6_kd_shards,
    "op7_record_files": record_files.op7_record_files,
    "op8_skip_chain_pii": pii.op8_skip_chain_pii,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_chat_format": chat.op10_chat_format,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op5_quality_rules": quality.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
