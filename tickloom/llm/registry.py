"""Registered queries of the corpus operators and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tickloom.llm import (
    bpe,
    dataset_manifest,
    decontaminate,
    fixity,
    language_id,
    licenses,
    line_dedup,
    simhash,
    suffix_dedup,
    token_alignment,
    tool_calls,
    topk,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fixity": fixity.query,
    "op2_line_dedup": line_dedup.query,
    "op3_tool_calls": tool_calls.query,
    "op4_bpe_codec": bpe.query,
    "op5_decontaminate": decontaminate.query,
    "op6_topk": topk.query,
    "op7_toxicity": toxicity.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_simhash": simhash.query,
    "op10_language_id": language_id.query,
    "op11_alignment": token_alignment.query,
    "op12_manifest": dataset_manifest.query,
    "op13_licenses": licenses.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_fixity": fixity.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op6_topk": topk.SQL,
    "op12_manifest": dataset_manifest.SQL,
}
