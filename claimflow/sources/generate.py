"""Synthetic customers, policies and claims, each row a function of its seed id alone.

The seeds are any column of distinct ids, so the work spreads as the seeds are spread and a
lost partition is rebuilt identically.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.functions import scalars as fn

# Our own choice of given names and of city labels per market.
GIVEN_NAMES = ["Alex", "Kim", "Sam", "Robin", "Jamie", "Lee", "Noor", "Dana"]
CITIES_PER_MARKET = 5


def _salted(seed: Column, salt: str) -> Column:
    return F.concat(seed.cast("string"), F.lit(f"/{salt}"))


def _country(seed: Column) -> Column:
    return fn.pick(list(vocab.MARKETS.values()), _salted(seed, "country"))


def _policy_type(seed: Column) -> Column:
    return fn.pick(list(vocab.COVERED_CLAIM_TYPES), _salted(seed, "policy"))


def _pick_listed(options: Column, key: Column) -> Column:
    return F.element_at(options, (fn.hash_bucket(key, F.size(options)) + 1).cast("int"))


def _limit(seed: Column) -> Column:
    return (50_000 + 1_000 * fn.hash_bucket(_salted(seed, "limit"), 450)).cast("decimal(18,2)")


def generate_customers(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    s = F.col(seed)
    surnames = fn.list_lookup(vocab.SURNAMES, F.col("country"))
    return seeds.withColumn("country", _country(s)).select(
        F.concat(F.lit("CUS-"), s.cast("string")).alias("customer_id"),
        fn.pick(GIVEN_NAMES, _salted(s, "first")).alias("first_name"),
        _pick_listed(surnames, _salted(s, "last")).alias("last_name"),
        "country",
        F.concat_ws(
            " City ", F.col("country"), (fn.hash_bucket(_salted(s, "city"), CITIES_PER_MARKET) + 1).cast("string")
        ).alias("city"),
    )


def generate_policies(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    s = F.col(seed)
    return seeds.select(
        F.concat(F.lit("POL-"), s.cast("string")).alias("policy_number"),
        F.concat(F.lit("CUS-"), s.cast("string")).alias("customer_id"),
        _policy_type(s).alias("policy_type"),
        _limit(s).alias("coverage_limit"),
        (500 * (1 + fn.hash_bucket(_salted(s, "deductible"), 6))).cast("decimal(18,2)").alias("deductible"),
        (400 + 10 * fn.hash_bucket(_salted(s, "premium"), 300)).cast("decimal(18,2)").alias("premium"),
    )


def generate_claims(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """One claim per seed, against the policy of the same seed, of a type that policy covers."""
    s = F.col(seed)
    covered = fn.list_lookup(vocab.COVERED_CLAIM_TYPES, F.col("policy_type"))
    events = fn.list_lookup(vocab.DESCRIPTION_EVENTS, F.col("claim_type"))
    filed = F.date_add(F.lit("2025-01-01").cast("date"), fn.hash_bucket(_salted(s, "filed"), 365).cast("int"))
    return (
        seeds.withColumn("policy_type", _policy_type(s))
        .withColumn("claim_type", _pick_listed(covered, _salted(s, "type")))
        .select(
            F.concat(F.lit("CLM-"), s.cast("string")).alias("claim_id"),
            F.concat(F.lit("POL-"), s.cast("string")).alias("policy_number"),
            "claim_type",
            fn.pick(vocab.OPEN_STATUSES, _salted(s, "status")).alias("status"),
            filed.cast("timestamp_ntz").alias("filing_date"),
            (500 + 25 * fn.hash_bucket(_salted(s, "amount"), 20_000)).cast("decimal(18,2)").alias("claim_amount"),
            F.concat(
                fn.lookup(vocab.DESCRIPTION_PLACES, F.col("policy_type")),
                F.lit(": "),
                _pick_listed(events, _salted(s, "event")),
            ).alias("description"),
        )
    )
