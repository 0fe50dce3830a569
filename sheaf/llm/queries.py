"""Queries of this package, and the SQL of those that SQL can express."""

from sheaf.llm import bpe, decontaminate, embedding_dedup, html_main_text, lm_score, pii, simhash_dedup, toxicity, url_filter, warc_fixity

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_warc_fixity": warc_fixity.op2_warc_fixity,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op9_html_extraction": html_main_text.op9_html_extraction,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_warc_fixity": warc_fixity.OP2_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
}
