"""Deterministic repairs: the replacement follows from a hash of the claim id alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.functions import scalars as fn
from claimflow.operators import quality


def repair_claim_types(claims: DataFrame) -> DataFrame:
    """Give each mismatched claim a type its policy covers; an unknown policy keeps its type."""
    covered = fn.list_lookup(vocab.COVERED_CLAIM_TYPES, F.col("policy_type"))
    bucket = fn.hash_bucket(F.col("claim_id"), F.size(covered))
    repaired = F.element_at(covered, (bucket + 1).cast("int"))
    broken = F.coalesce(~quality.is_covered(), F.lit(False)) & covered.isNotNull()
    return claims.withColumn("claim_type", F.when(broken, repaired).otherwise(F.col("claim_type")))


def repair_descriptions(claims: DataFrame) -> DataFrame:
    """Replace each description by one of three texts for its policy and claim type."""
    events = fn.list_lookup(vocab.DESCRIPTION_EVENTS, F.col("claim_type"))
    bucket = fn.hash_bucket(F.col("claim_id"), F.size(events))
    text = F.concat(
        fn.lookup(vocab.DESCRIPTION_PLACES, F.col("policy_type")),
        F.lit(": "),
        F.element_at(events, (bucket + 1).cast("int")),
    )
    known = events.isNotNull() & quality.is_covered()
    return claims.withColumn("description", F.when(known, text).otherwise(F.col("description")))


def names_by_country(claims: DataFrame) -> DataFrame:
    """Claims with a surname from their country's pool; NULL outside the eight markets."""
    pool = F.broadcast(quality.surname_pool(claims.sparkSession))
    size = len(next(iter(vocab.SURNAMES.values())))
    return (
        claims.withColumn("idx", fn.hash_bucket(F.col("claim_id"), size))
        .join(pool, ["country", "idx"], "left")
        .drop("idx")
    )


def repair_names(claims: DataFrame) -> DataFrame:
    named = names_by_country(claims)
    return named.withColumn("last_name", F.coalesce("surname", "last_name")).select(*claims.columns)


def reset_evaluations(claims: DataFrame) -> DataFrame:
    """Clear decisions and reopen decided claims."""
    reopened = fn.pick(vocab.OPEN_STATUSES, F.concat("claim_id", F.lit("status")))
    decided = F.col("ai_decision").isNotNull()
    return claims.withColumns(
        {
            "ai_decision": F.lit(None).cast("string"),
            "ai_reasoning": F.when(~decided, F.col("ai_reasoning")),
            "status": F.when(F.col("status").isin(vocab.CLOSED_STATUSES), reopened).otherwise(F.col("status")),
        }
    )


def hash_buckets(claims: DataFrame, buckets: int) -> DataFrame:
    return claims.select("claim_id", fn.hash_bucket(F.col("claim_id"), buckets).alias("bucket"))
