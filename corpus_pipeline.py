"""The corpus pipeline, from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; the stages before the last return the columns of ``documents``. They may
be written and reread between stages, and ``run`` does so in the shared folder,
so that a lost executor repeats one stage only.

1. quality: documents that the ordinal classifier does not select go;
2. near_duplicates: one document of each near-duplicate group stays;
3. decontaminate: documents that hold a benchmark window go;
4. pii: personal data and words that disclose it are replaced in the texts;
5. packing: the texts become training sequences, one row per piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.llm import decontaminate, minhash, packing, pii, quality
from ordersight.llm.common import read
from ordersight.llm.queries import quality_model
from ordersight.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of the best grade is under one half."""
    return quality.select(docs, quality_model(docs, read(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group."""
    return minhash.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontaminate", decontaminate_stage),
          ("pii", pii_stage), ("packing", packing_stage)]

#: The classifier's fit, the signatures and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per piece of a packed sequence."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
