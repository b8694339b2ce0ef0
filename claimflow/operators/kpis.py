"""Aggregates behind the dashboards. Every grouping combines partial results before it shuffles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.functions import scalars as fn


def kpi_rollup(claims: DataFrame) -> DataFrame:
    """Eight figures in one pass over the claims."""
    decision = F.col("ai_decision")
    return claims.agg(
        F.count("*").alias("total_claims"),
        F.round(F.sum("claim_amount"), 0).alias("total_amount"),
        F.round(F.avg("claim_amount"), 0).alias("avg_amount"),
        F.countDistinct("country").alias("countries"),
        F.count(decision).alias("evaluated"),
        F.count_if(decision == "APPROVE").alias("approved"),
        F.count_if(decision == "DENY").alias("denied"),
        F.count_if(decision == "REFER").alias("referred"),
    )


def evaluation_progress(kpis: DataFrame) -> DataFrame:
    """Evaluated share and its whole percent, rounded down; no row when there are no claims."""
    return kpis.filter("total_claims > 0").select(
        "evaluated",
        "total_claims",
        (F.col("evaluated") / F.col("total_claims")).alias("progress"),
        F.expr("evaluated * 100 div total_claims").alias("percent"),
    )


def count_by(claims: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return claims.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), column)


def count_ids_by(claims: DataFrame, column: str) -> DataFrame:
    """Rows that hold a claim id, per value: the dashboard form of a count over a text column."""
    return claims.groupBy(column).agg(F.count("claim_id").alias("claims"))


def total_by(rows: DataFrame, column: str, measure: str, alias: str) -> DataFrame:
    return rows.groupBy(column).agg(F.sum(measure).alias(alias))


def average_by(rows: DataFrame, column: str, measure: str, alias: str) -> DataFrame:
    return rows.groupBy(column).agg(F.avg(measure).alias(alias))


def bi_kpis(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.countDistinct("claim_id").alias("distinct_claims"),
        F.sum("claim_amount").alias("total_claimed"),
        F.avg("claim_amount").alias("average_claim"),
    )


def claims_by_amount(claims: DataFrame) -> DataFrame:
    """Amount per claim id, type, country and status, largest first, without a limit."""
    return (
        claims.groupBy("claim_id", "claim_type", "country", "status")
        .agg(F.sum("claim_amount").alias("claim_amount"))
        .orderBy(F.col("claim_amount").desc_nulls_first(), "claim_id")
    )


def country_risk_detail(risk: DataFrame) -> DataFrame:
    return risk.groupBy("country", "country_code").agg(
        F.avg("gdp_per_capita").alias("gdp_per_capita"),
        F.avg("insurance_penetration").alias("insurance_penetration"),
        F.avg("natural_disaster_exposure").alias("natural_disaster_exposure"),
        F.sum("population").alias("population"),
    )


def average_amount_of_type(claims: DataFrame, claim_type: str) -> DataFrame:
    of_type = claims.filter(F.col("claim_type") == claim_type)
    return average_by(of_type, "country", "claim_amount", "avg_amount")


def busiest_city(claims: DataFrame, claim_type: str) -> DataFrame:
    """The city with the most claims of a type; the name settles a tie."""
    return count_by(claims.filter(F.col("claim_type") == claim_type), "city").limit(1)


def pending_count(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count_if(F.col("status") == "Pending").alias("pending"))


def country_highest_total(claims: DataFrame) -> DataFrame:
    totals = total_by(claims, "country", "claim_amount", "total_amount")
    return totals.orderBy(F.col("total_amount").desc_nulls_last(), "country").limit(1)


def type_share(claims: DataFrame, claim_type: str) -> DataFrame:
    """Percent of each country's claims that are of one type."""
    hits = F.count_if(F.col("claim_type") == claim_type)
    return claims.groupBy("country").agg((hits * 100 / F.count("*")).alias("share_pct"))


def type_share_in_country(claims: DataFrame, claim_type: str, country: str) -> DataFrame:
    return type_share(claims.filter(F.col("country") == country), claim_type)


def premium_vs_claim(claims: DataFrame) -> DataFrame:
    return claims.groupBy("country").agg(
        F.avg("premium").alias("avg_premium"), F.avg("claim_amount").alias("avg_claim")
    )


def kpi_display(kpis: DataFrame) -> DataFrame:
    """The rollup as report text."""
    count: Column = fn.whole_number(F.col("total_claims"))
    return kpis.select(
        count.alias("Total Claims"),
        fn.dollars(F.col("total_amount")).alias("Total Claimed"),
        fn.dollars(F.col("avg_amount")).alias("Avg Claim"),
        F.col("countries").cast("string").alias("Markets"),
        F.concat_ws(" / ", "evaluated", "total_claims").alias("Evaluated"),
        *(fn.whole_number(F.col(name.lower())).alias(name) for name in ("Approved", "Denied", "Referred")),
    )
