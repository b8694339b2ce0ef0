"""Joins that build the wide claims table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow import schemas


def with_country_risk(claims: DataFrame, risk: DataFrame, markets_only: bool = False) -> DataFrame:
    """Claims with their country's population and displaced persons; every claim is kept.

    With `markets_only` the caller states that the risk side has a row per market of the fixed list,
    which is then broadcast; otherwise the join strategy follows from measured sizes.
    """
    extra = risk.select("country", "population", "disaster_displaced_persons")
    return claims.join(F.broadcast(extra) if markets_only else extra, "country", "left")


def build_curated_claims(
    claims: DataFrame,
    customers: DataFrame,
    policies: DataFrame,
    risk: DataFrame,
    markets_only: bool = False,
) -> DataFrame:
    """One wide row per claim: policy, policy holder and country risk joined on.

    Policies and holders are joined first, so that the claims, the large side, are shuffled
    once on the policy number at most. Keys on the right-hand sides must be unique; the row
    count gate tells when they are not.
    """
    holders = policies.join(customers, "customer_id", "left")
    indicators = risk.select(
        "country",
        F.col("gdp_per_capita").alias("country_gdp_per_capita"),
        F.col("insurance_penetration").alias("country_insurance_penetration"),
        F.col("natural_disaster_exposure").alias("country_disaster_exposure"),
    )
    wide = (
        claims.join(holders, "policy_number", "left")
        .join(F.broadcast(indicators) if markets_only else indicators, "country", "left")
        .withColumn("ai_decision", F.lit(None).cast("string"))
        .withColumn("ai_reasoning", F.lit(None).cast("string"))
    )
    return wide.select(*schemas.names(schemas.CLAIMS))


def build_policy_text(policies: DataFrame) -> DataFrame:
    """Search-ready text per policy."""
    def part(value) -> Column:
        return F.coalesce(value, F.lit("None"))

    text = F.concat(
        F.lit("Policy "), part(F.col("policy_number")),
        F.lit(" is a "), part(F.col("policy_type")),
        F.lit(" policy. Coverage limit $"), part(F.format_number("coverage_limit", 0)),
        F.lit(", deductible $"), part(F.format_number("deductible", 0)),
        F.lit(", annual premium $"), part(F.format_number("premium", 0)), F.lit("."),
    )
    return policies.select("policy_number", "policy_type", text.alias("search_text"))
