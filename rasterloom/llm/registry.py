"""The queries of this subpackage and their SQL."""

from . import byte_bpe, embedding_dedup, filter_audit, fingerprint, html_extract, line_dedup, minhash, packing, quality_classifier, quality_rules, source_divergence, suffix_dedup, url_filter

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_packing": packing.op9_packing,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

ORACLES = {
    "op1_minhash_dedup": minhash.SQL,
    "op3_url_filters": url_filter.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_embedding_dedup": embedding_dedup.SQL,
}
