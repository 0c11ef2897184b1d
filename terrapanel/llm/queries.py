"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, fingerprints, jaccard, langid, packing, pii, quality, suffix_dedup, topk, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_pii": pii.op2_pii,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_langid": langid.op5_langid,
    "op6_packing": packing.op6_packing,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality": quality.op8_quality,
    "op9_topk": topk.op9_topk,
    "op10_fingerprints": fingerprints.op10_fingerprints,
}

ORACLE_SQL = {"op1_url_filters": url_filters.ORACLE, "op9_topk": topk.ORACLE}
