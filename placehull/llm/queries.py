"""The registered queries of this package and their SQL."""

from __future__ import annotations

from placehull.llm import (
    alignment,
    chat,
    decontaminate,
    fillmiddle,
    linededup,
    mergetable,
    mixing,
    neardup,
    ngrams,
    quality,
    sitestyle,
    tokencount,
    warc,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_ngram_scores": ngrams.op2_ngram_scores,
    "op3_warc_derivatives": warc.op3_warc_derivatives,
    "op4_reply_trees": chat.op4_reply_trees,
    "op5_site_style_text": sitestyle.op5_site_style_text,
    "op6_latent_decontamination": decontaminate.op6_latent_decontamination,
    "op7_unigram_counts": tokencount.op7_unigram_counts,
    "op8_odd_sketch_neardup": neardup.op8_odd_sketch_neardup,
    "op9_weak_supervision": quality.op9_weak_supervision,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_prefix_table_ids": mergetable.op11_prefix_table_ids,
    "op12_fill_in_middle": fillmiddle.op12_fill_in_middle,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLES = {
    "op4_reply_trees": chat.ORACLE,
    "op1_mix_sources": mixing.ORACLE,
    "op8_odd_sketch_neardup": neardup.ORACLE,
    "op9_weak_supervision": quality.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
    "op12_fill_in_middle": fillmiddle.ORACLE,
}
