"""Registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from propval.llm import collocations, decontamination, importance, mixing, multi_index, oracle, secret_scan, sentencepiece_viterbi
from propval.llm import sharding, simhash, token_counts, topk, toxicity, warc

QUERIES = {
    "op1_token_counts": token_counts.q_op1,
    "op2_toxicity": toxicity.q_op2,
    "op3_topk": topk.q_op3,
    "op4_secret_scan": secret_scan.q_op4,
    "op5_multi_index": multi_index.q_op5,
    "op6_warc": warc.q_op6,
    "op7_simhash": simhash.q_op7,
    "op8_mixing": mixing.q_op8,
    "op9_sharding": sharding.q_op9,
    "op10_sentencepiece": sentencepiece_viterbi.q_op10,
    "op11_decontamination": decontamination.q_op11,
    "op12_importance": importance.q_op12,
    "op13_collocations": collocations.q_op13,
    "pipeline": corpus_pipeline.run,
}

ORACLE = oracle.ORACLE
