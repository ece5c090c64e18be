"""Corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, source mixing, SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weighbridge.llm.common import table, written
from weighbridge.llm.exact_dedup import dedup_stage
from weighbridge.llm.jaccard_join import jaccard_stage
from weighbridge.llm.mixing import mixing_stage
from weighbridge.llm.quality_rules import quality_stage
from weighbridge.llm.sentencepiece_codec import sentencepiece_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", dedup_stage),
    ("ngram_jaccard", jaccard_stage),
    ("source_mix", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]
#: SQL can state neither the learned rules nor the balanced sample; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
