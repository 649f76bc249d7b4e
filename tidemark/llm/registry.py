"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, infill, isolation, jaccard, nbsvm, pieces, pii, ppm, prefix_trie, textcnn, tiling, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pii": pii.op1_feistel_pii,
    "op2_ppm_score": ppm.op2_ppm_score,
    "op3_toxicity_cnn": textcnn.op3_toxicity_cnn,
    "op4_warc_transactions": warc.op4_warc_transactions,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_quality_nbsvm": nbsvm.op6_quality_nbsvm,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_greedy_tiling": tiling.op9_greedy_tiling,
    "op10_chat_format": chat.op10_chat_format,
    "op11_infill_frames": infill.op11_infill_frames,
    "op12_isolation_rules": isolation.op12_isolation_rules,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op4_warc_transactions": warc.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_infill_frames": infill.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
