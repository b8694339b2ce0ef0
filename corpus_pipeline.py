"""The document pipeline: language, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what is left of `docs` in its columns; the
last returns the packed pieces. A stage works on all that the one before kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow.llm import language, neardup, packing, pii, toxicity
from claimflow.llm.store import stored
from claimflow.llm.text import table, unused


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no learned language; a null lang is filled. Learned from the rows with lang.

    Null and empty texts, and texts without a letter, are in no language and go. Long texts are read
    whole; repeated rows fare alike; an empty table stays empty; extra columns are kept.
    """
    return language.accepted(docs, language.fit(language.learnable(docs)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic, learned from `labels`.

    Null and empty texts are not toxic. Long texts are read whole; repeated rows fare alike; an empty
    table stays empty; extra columns are kept.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at five words a shingle and a similarity of 0.8.

    Texts without words, null ones among them, are like no other and stay, as do rows without id; of
    repeated rows one stays. Long texts are read whole; an empty table stays empty; extra columns are kept.
    """
    return neardup.representatives(docs, words_per_shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms under the session's key; n_chars follows.

    Null texts stay null. Long texts are read whole; repeated rows change alike; an empty table stays
    empty; extra columns are kept, whatever their names.
    """
    count = unused(docs, "found")
    replaced = pii.pseudonymise(docs, pii.session_key(spark), found=count)
    n_chars = F.when(F.col(count) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", n_chars).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048.

    A null or empty text is its end alone; long ones are cut into pieces; repeated rows are packed each
    on its own; an empty table gives no rows; extra columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

# SQL cannot express the stages: models, hashes and tokenizers decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
