"""A training corpus from documents: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of their documents as they came, further columns and
columns with names that a stage uses itself included. An empty table passes through all of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriledge.llm.common import stored, table
from veriledge.llm.decontam import without_benchmark
from veriledge.llm.lang_id import fit, identified, training_rows
from veriledge.llm.mixing import mix, repeated
from veriledge.llm.ngram_join import one_of_each
from veriledge.llm.token_ids import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letter, or a score under the threshold.

    Null and empty texts have no letter and go. Rows without language are judged like all others,
    by their text alone; repeated rows and rows with equal texts share one decision. Where no row
    has a language, nothing can be learned and all rows go. An empty table gives none.
    """
    return identified(docs, fit(training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares four fifths of its word 5-grams.

    The smallest doc_id of a group stays; of rows that repeat it, one. A row without doc_id stays
    unless an equal text has one. Texts without words are groups of their own.
    """
    return one_of_each(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null or wordless texts and items match nothing; without items all rows stay. Repeated rows go
    or stay together.
    """
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come to their target shares of words.

    A null source is one source, after all others. Repeated rows are drawn one by one; texts
    without words are drawn on their own. Reruns take the same copies.
    """
    return repeated(docs, stored(mix(docs), "pipeline-mix"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards; one row per document in them, by ascending doc_id, null ids first.

    A null text has the end id alone. Copies and repeated rows are documents of their own.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", decontamination), ("mix_sources", mixing),
          ("token_ids", token_ids)]

# Learned models, walks and draws: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
