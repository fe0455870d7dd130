"""A corpus pipeline: toxic documents, near copies, repeated spans and benchmark passages go; the rest is packed.

Each stage takes the session, the documents that its predecessor kept and the
folder of the tables, and returns a DataFrame; all but the last return the
columns of documents.  ``run`` writes each stage's result to the shared folder
and reads it again, so a lost executor costs no more than a stage's tasks.
Empty tables of documents, labels or items give empty results or take nothing;
columns other than doc_id, text and n_chars pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontamination, packing, simhash, substring_dedup, toxicity
from strata.llm.common import Scratch, cleared, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, whole; repeated rows are scored alike.

    A null or empty text has no marked word and stays; without labels of both
    kinds nothing goes.
    """
    return docs.where(toxicity.with_score(docs, table(spark, sf_dir, "labels")) < F.lit(toxicity.THRESHOLD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link: the smallest id, null last, then the smallest hash of the text.

    Null and empty texts and texts without words have fingerprint zero and are
    one group; of repeated rows one stays.
    """
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; words of spans that occur earlier (smaller id, null first, then smaller start) are gone from their texts.

    Null and empty texts stay as they are; rows that share an id are one
    document.
    """
    return substring_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, whole; null and empty texts and items match nothing, repeated rows are judged alike."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096; a null or empty text is its end alone, and repeated rows are packed as often as they stand."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_spans", drop_repeats),
    ("benchmark_leaks", drop_leaks),
    ("packing", pack),
]

#: The first stage is a trained model, which SQL can't express; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with cleared():  # a stage's own tables go once its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
