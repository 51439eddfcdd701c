"""The operators' queries and the SQL that checks them."""

from __future__ import annotations

from evispan.llm import classifier, decontaminate, mixing, passages, pii, rules, secrets, simhash, urlfilter, warc

QUERIES = {
    "op1_path_templates": urlfilter.op1_path_templates,
    "op2_warc_normaliser": warc.op2_warc,
    "op3_sainte_lague": mixing.op3_sainte_lague,
    "op4_weak_supervision": pii.op4_weak_supervision,
    "op5_trigram_secrets": secrets.op5_trigram_secrets,
    "op6_decision_list": rules.op6_decision_list,
    "op7_byte_cnn": classifier.op7_byte_cnn,
    "op8_suffix_array": decontaminate.op8_decontaminate,
    "op9_simhash_anchors": simhash.op9_simhash,
    "op10_collinear_chains": passages.op10_collinear_chains,
}

ORACLES = {
    "op2_warc_normaliser": warc.OP2_SQL,
    "op3_sainte_lague": mixing.OP3_SQL,
    "op8_suffix_array": decontaminate.OP8_SQL,
}
