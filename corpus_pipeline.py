"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but the
last return the columns of ``documents``; the last returns one row per piece of a packed sequence.

Defined results: null and empty texts, and texts without letters, go in the first stage; very long texts
are read whole by every stage; rows with a null or repeated id are rows of their own, told apart by id and
text, and of equal rows one stays; ties go to the smaller id; an empty table gives no rows; other columns
are carried along, whatever their names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, language_id, minhash_join, mixing, packing
from tesserae.llm.common import materialise, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no learned language fits."""
    return language_id.keep_known(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return minhash_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of documents that the mix of sources draws, one row a draw; ``n_chars`` is the block's."""
    return mixing.apply_mix(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mix_sources", mixed),
    ("best_fit_packing", packed),
]

#: Tokenization, language ID and the forest's signatures have no SQL form; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
