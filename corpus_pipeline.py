"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.

Every stage decides on rows, not ids: ids may be null or repeated, and a decision
on one row leaves others of its id alone. An empty table gives an empty result;
further columns stay as they are, whatever their names, up to the last stage.
Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraudlens.llm.exact_dedup import drop_exact_copies
from fraudlens.llm.langid import keep_identified
from fraudlens.llm.mixing import training_order
from fraudlens.llm.near_dedup import keep_one_of_each
from fraudlens.llm.sentencepiece_ids import round_trip
from fraudlens.llm.storage import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter (null and blank
    texts too) and those with a near-uniform prediction go, and all if no row has
    a language to learn from. Rows with equal texts are kept or go together."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each content, white space aside: the longest text, then the
    least id, null ids last; of rows that agree in all columns any one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 on five-word shingles:
    the least id, null ids last. Texts without a word are linked with nothing and stay."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, a row for each reading, up to three; a
    document that the mix takes less than half of is not read. A null source is a
    source of its own; ties are in the order of ids, then of a hash of the row."""
    return training_order(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each reading; a null text
    has no ids. Equal rows give equal rows."""
    return round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_ids", sentencepiece_ids),
]
#: The first and third stage cannot be expressed in SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
