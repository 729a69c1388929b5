"""A training corpus from raw documents: quality, toxicity, near duplicates, benchmark passages, packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it returns is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents`` and keep or drop whole rows;
the last returns the packed pieces.  Rows with a null id, or with an id that others have, are judged by their text.

The stages are operators of ``ordinaut.llm``: without that subpackage this module cannot be imported, and
``__spark_entry__`` leaves the query out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinaut.llm import decontaminate, neardup, packing, quality, toxicity
from ordinaut.llm.common import id_text, read_table, written

_SCORE = "_ordinaut_score"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the cut."""
    ranker = quality.learn(id_text(docs), read_table(spark, sf_dir, "labels"))
    return quality.with_score(docs, ranker, _SCORE).where(F.col(_SCORE) >= 0.5).drop(_SCORE)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    scorer = toxicity.learn(id_text(docs), read_table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, scorer, _SCORE).where(F.col(_SCORE) < 0.5).drop(_SCORE)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest id (a null one last), then the smallest digest of
    its text.  Texts that share an id but no words are different documents."""
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences."""
    return packing.pack(id_text(docs), public_tokenizers.path(packing.TOKENIZER), packing.SEQUENCE)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Neither the classifiers nor signatures nor the tokenizer are SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
