"""A corpus pipeline of five operators: documents in, token ids out.

Each stage works on all rows that the stage before it kept.  ``run`` writes
each stage's result to shared storage and reads it again as the next one's
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import mixing, pii_sanitise, quality_fm, queries, simhash, sp_viterbi
from barloom.llm.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts get the score of an empty text; very long ones are
    scored whole; equal texts, and so repeated rows, are decided alike; without
    labels all stay.  Null ids, languages and sources do not matter, nor do
    further columns, which stay.  An empty table stays empty.
    """
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Wordless texts (null, empty, blank) are one group.  Repeated rows of an id
    stay or go together; rows without an id stay.  Very long texts are compared
    whole.  Further columns stay, whatever their names.  An empty table stays
    empty.
    """
    return simhash.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that reveal it; all rows stay.

    Texts without any, null and empty ones too, are left as they are.  Very long
    texts are cleaned whole; equal texts, and so repeated rows, alike.  Null ids
    do not matter.  Other columns stay, but n_chars follows the text.  An empty
    table stays empty.
    """
    return pii_sanitise.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities calibrated to source, language and topic.

    Null categories are categories of their own; null and empty texts have no
    tokens and are sampled by their cell like others; very long ones count
    whole.  Rows of one id (null too) in one cell are decided alike.  Further
    columns stay, whatever their names.  An empty table stays empty.
    """
    return mixing.sample(docs, queries.TARGETS, queries.BUDGET, queries.ITERATIONS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; texts can be decoded from them.

    Null and empty texts have no ids; very long ones are encoded whole; each
    repeated row gets a row, null ids too.  Other columns are not read.  An
    empty table gives no rows.
    """
    return sp_viterbi.encode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mix), ("sentencepiece", encode)]

#: Learned scores, fingerprints and segmentations are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
