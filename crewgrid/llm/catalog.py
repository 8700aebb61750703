"""Queries of this folder and the SQL each must equal, where SQL can express it."""

from __future__ import annotations

from crewgrid.llm import alignment, chat, contamination, langid, mincut, mixing, neardup, pieces, quality, ranked, secrets, suffixes, toxicity

QUERIES = {
    "op1_scoring": mixing.op1_scoring,
    "op2_neardup": neardup.op2_neardup,
    "op3_extraction": mincut.op3_extraction,
    "op4_secrets": secrets.op4_secrets,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": contamination.op7_decontamination,
    "op8_chat": chat.op8_chat,
    "op9_quality": quality.op9_quality,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_language": langid.op11_language,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op7_decontamination": contamination.SQL,
    "op8_chat": chat.SQL,
    "op12_ranked_search": ranked.SQL,
}
