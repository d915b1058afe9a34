"""The queries of the training-data operators and their SQL."""

from . import boilerplate, bpe, convtrie, decontaminate, hardneg, kdshard, media, nearjoin, ordinal, pii, recompress, simhash, wordpiece

QUERIES = {
    "op1_pii_spans": pii.op1,
    "op2_media_columns": media.op2,
    "op3_substring_dedup": recompress.op3,
    "op4_near_dedup": nearjoin.op4,
    "op5_toxicity": ordinal.op5,
    "op6_line_dedup": boilerplate.op6,
    "op7_kd_shards": kdshard.op7,
    "op8_token_counts": wordpiece.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_bpe_roundtrip": bpe.op10,
    "op11_simhash_bktree": simhash.op11,
    "op12_hard_negatives": hardneg.op12,
    "op13_prefix_trie": convtrie.op13,
}

ORACLE = {
    "op3_substring_dedup": recompress.ORACLE,
    "op4_near_dedup": nearjoin.ORACLE,
    "op6_line_dedup": boilerplate.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op12_hard_negatives": hardneg.ORACLE,
    "op13_prefix_trie": convtrie.ORACLE,
}
