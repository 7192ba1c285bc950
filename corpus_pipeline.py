"""The corpus pipeline: five stages, each on all that the one before kept.

Language ID rejects documents of no language; of each group of near-duplicates (five words, similarity 0.8) the smallest
doc_id stays; documents that hold a benchmark item go; secrets in the texts become a mark; the last stage mixes the sources
to target weights and emits each document as often as the mix holds it, with the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import langid, latent_decontam, mixing, parity_join, secrets
from tallywright.llm.shared import stored, table

LEAST_SCORE = 0.1  # share of a text's n-grams that its language must know


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with a score of LEAST_SCORE or more. Null, empty and letterless texts go; ties take the
    language that sorts first; repeated rows are judged alike; without labelled rows all go; other columns are kept as they are."""
    predicted = langid.predict(docs, langid.learn(docs))
    return predicted.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id. Of repeated rows and of rows that share an id one stays; null and
    empty texts link with nothing and stay; texts of any length are compared whole; an empty table stays empty."""
    return parity_join.keep_first(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay; repeated rows go or stay together; an empty benchmark or table
    takes nothing away; other columns, `answer` included, are kept as they are."""
    return latent_decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew where it did. Null and empty texts are kept; repeated rows
    are redacted alike; a value found at one place of a document is replaced at all its places."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it, with the number of the copy. A null source is a source of its own, a null or empty
    text has size 0; rows equal in id and text share a draw; an empty table stays empty; columns named like the mix's own are replaced."""
    return mixing.emitted(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
