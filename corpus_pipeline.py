"""The corpus pipeline: five stages from ``documents`` to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes a stage's rows as
Parquet to the shared folder of the session and reads them back as the next one's docs. The first
four return the columns of ``documents``; the last returns the mix: one row per document that
reached it, with how often the mix takes it.

Null, empty or repeated rows follow the rules of each operator's docstring; an empty table passes
through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightings.llm import decontamination, mixing, simhash_dedup, suffix_dedup, toxicity
from sightings.llm.common import stage, table
from sightings.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the class-conditional models score as toxic go."""
    configure(spark)
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each SimHash component stays."""
    configure(spark)
    return simhash_dedup.keep_one(docs)


def strip_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: byte strings that also start in an earlier document are cut from the texts."""
    configure(spark)
    return suffix_dedup.strip_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents contaminated by the benchmark go."""
    configure(spark)
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: how often the mix takes each document."""
    configure(spark)
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", strip_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Toxicity and the rounding of the mix are no SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
