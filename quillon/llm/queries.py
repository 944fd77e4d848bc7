"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, extract, interplay, jaccard, langid, mixing, pii, quality, sptokens, topk, toxicity, warc, yinyang

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pii": pii.op2_pii,
    "op3_chat_format": chat.op3_chat_format,
    "op4_sentencepiece": sptokens.op4_sentencepiece,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_html_extract": extract.op6_html_extract,
    "op7_top_k": topk.op7_top_k,
    "op8_quality": quality.op8_quality,
    "op9_langid": langid.op9_langid,
    "op10_mixing": mixing.op10_mixing,
    "op11_centroid_clustering": yinyang.op11_centroid_clustering,
    "op12_filter_interaction": interplay.op12_filter_interaction,
    "op13_warc": warc.op13_warc,
}
ORACLES = {
    "op3_chat_format": chat.ORACLE,
    "op5_jaccard_join": jaccard.ORACLE,
    "op7_top_k": topk.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_centroid_clustering": yinyang.ORACLE,
    "op12_filter_interaction": interplay.ORACLE,
    "op13_warc": warc.ORACLE,
}
