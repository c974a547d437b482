"""A training corpus from documents: five operators one after the other.

Every stage takes and gives the columns of ``documents``; the last one gives packed pieces of token
ids (see ``ledgerloom.llm.packing``).  Each stage works on all rows that the one before has kept.  Stages
that follow one another in ``run`` without being written in between read their input several times, so
``run`` writes each stage's result to the shared scratch folder, as a caller of ``STAGES`` does.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, packing, quality, suffix_dedup
from ledgerloom.llm.common import table
from ledgerloom.session import materialize

#: Fewest words of a passage that is cut: every passage of over 50 words.
PASSAGE_WORDS = 51

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or are depleted without their host's common lines, go; the others lose these lines."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 stays."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes and more, that occur elsewhere too are cut out of the texts."""
    return suffix_dedup.rewrite(docs, words=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast("bigint"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination), ("pack", pack)]

#: Packing reads a tokenizer's vocabulary, which SQL can't; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
