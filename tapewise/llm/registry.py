"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewise.llm.bpe import op12_merge_replay_bpe
from tapewise.llm.concurrency import OP13_SQL, op13_peak_concurrency
from tapewise.llm.decontaminate import OP5_SQL, op5_winnow_decontamination
from tapewise.llm.fingerprint import op3_scaled_fingerprints
from tapewise.llm.html_extract import op2_wrapper_extraction
from tapewise.llm.licences import op7_template_licences
from tapewise.llm.line_dedup import OP4_SQL, op4_line_dedup
from tapewise.llm.materialise import op1_training_order
from tapewise.llm.ngram_join import op8_parity_jaccard_join
from tapewise.llm.packing import op10_min_slack_packing
from tapewise.llm.sharding import op6_jump_sharding
from tapewise.llm.spelling import op11_spelling_variants
from tapewise.llm.toxicity import op9_compression_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_training_order": op1_training_order,
    "op2_wrapper_extraction": op2_wrapper_extraction,
    "op3_scaled_fingerprints": op3_scaled_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_winnow_decontamination": op5_winnow_decontamination,
    "op6_jump_sharding": op6_jump_sharding,
    "op7_template_licences": op7_template_licences,
    "op8_parity_jaccard_join": op8_parity_jaccard_join,
    "op9_compression_toxicity": op9_compression_toxicity,
    "op10_min_slack_packing": op10_min_slack_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merge_replay_bpe": op12_merge_replay_bpe,
    "op13_peak_concurrency": op13_peak_concurrency,
}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op5_winnow_decontamination": OP5_SQL, "op13_peak_concurrency": OP13_SQL}
