"""Registered queries of the training-data operators and the DuckDB SQL of those that have one."""

from __future__ import annotations

import corpus_pipeline
from sightings.llm import (
    alignment,
    compression,
    decontamination,
    embedding_dedup,
    html_extract,
    language_id,
    lexical,
    mixing,
    quality,
    simhash_dedup,
    suffix_dedup,
    toxicity,
    warc,
)
from sightings.llm.common import table


def op1_fm_index_decontamination(spark, sf_dir):
    return decontamination.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_run_length_dedup(spark, sf_dir):
    return suffix_dedup.op2(table(spark, sf_dir, "documents"))


def op3_warc_normaliser(spark, sf_dir):
    return warc.op3(table(spark, sf_dir, "pages"))


def op4_centroid_language_id(spark, sf_dir):
    return language_id.op4(table(spark, sf_dir, "documents"))


def op5_template_extraction(spark, sf_dir):
    return html_extract.op5(table(spark, sf_dir, "pages"))


def op6_co_trained_quality(spark, sf_dir):
    return quality.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pivotal_mixing(spark, sf_dir):
    return mixing.op7(table(spark, sf_dir, "documents"))


def op8_int8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.op8(table(spark, sf_dir, "embeddings"))


def op9_kneser_ney_toxicity(spark, sf_dir):
    return toxicity.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_trie(spark, sf_dir):
    return simhash_dedup.op10(table(spark, sf_dir, "documents"))


def op11_term_pipeline(spark, sf_dir):
    return lexical.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_compression_bands(spark, sf_dir):
    return compression.op12(table(spark, sf_dir, "documents"))


def op13_distinct_text_alignment(spark, sf_dir):
    return alignment.op13(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    pipeline, op1_fm_index_decontamination, op2_run_length_dedup, op3_warc_normaliser, op4_centroid_language_id,
    op5_template_extraction, op6_co_trained_quality, op7_pivotal_mixing, op8_int8_embedding_dedup,
    op9_kneser_ney_toxicity, op10_simhash_trie, op11_term_pipeline,
    op12_compression_bands, op13_distinct_text_alignment)}

ORACLES: dict[str, str] = {
    "op1_fm_index_decontamination": decontamination.OP1_SQL,
    "op3_warc_normaliser": warc.OP3_SQL,
    "op8_int8_embedding_dedup": embedding_dedup.OP8_SQL,
    "op11_term_pipeline": lexical.OP11_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
