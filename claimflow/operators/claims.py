"""Views of the wide claims table: lookups, labels, detail rows, market context, request text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.functions import scalars as fn

# The columns of the claim list. The headings and labels of the reports below are fixed too.
SCAN_COLUMNS = [
    "claim_id", "claim_type", "country", "city", "claim_amount", "coverage_limit", "deductible",
    "policy_number", "policy_type", "first_name", "last_name", "status", "filing_date",
    "description", "country_gdp_per_capita", "country_insurance_penetration",
    "country_disaster_exposure", "ai_decision", "ai_reasoning",
]


def scan_claims(claims: DataFrame) -> DataFrame:
    return claims.select(*SCAN_COLUMNS)


def by_id(claims: DataFrame, claim_id: str) -> DataFrame:
    """Point lookup; the id is a bound value, never part of a SQL text."""
    return claims.filter(F.col("claim_id") == F.lit(claim_id))


def pending(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("status") == "Pending")


def unevaluated(claims: DataFrame) -> DataFrame:
    return claims.filter(fn.is_blank(F.col("ai_decision")))


def ordered(claims: DataFrame) -> DataFrame:
    return claims.orderBy("claim_id")


def load_claims(claims_with_risk: DataFrame) -> DataFrame:
    """The full claim list with the country figures, ordered by id and not limited."""
    return ordered(claims_with_risk.select(*SCAN_COLUMNS, "population", "disaster_displaced_persons"))


def largest(claims: DataFrame, limit: int = 10) -> DataFrame:
    """The largest claims; equal amounts are told apart by id."""
    return (
        claims.select("claim_id", "claim_type", "country", "city", "claim_amount")
        .orderBy(F.col("claim_amount").desc_nulls_first(), "claim_id")
        .limit(limit)
    )


def largest_display(top: DataFrame) -> DataFrame:
    return top.withColumn("claim_amount", fn.dollars(F.col("claim_amount"))).withColumnsRenamed(
        {"claim_id": "Claim", "claim_type": "Type", "country": "Country", "city": "City", "claim_amount": "Amount"}
    )


def headline(claims: DataFrame) -> DataFrame:
    """The four headline figures of each claim as report text; N/A where one is missing."""

    def shown(value: Column) -> Column:
        return F.coalesce(value, F.lit("N/A"))

    return claims.select(
        "claim_id",
        shown(fn.dollars(F.col("claim_amount"))).alias("Claim Amount"),
        shown(fn.dollars(F.col("coverage_limit"))).alias("Coverage Limit"),
        shown(fn.dollars(F.col("deductible"))).alias("Deductible"),
        shown(F.col("status")).alias("Status"),
    )


def labels(claims: DataFrame) -> DataFrame:
    label = F.concat(
        _text("claim_id"), F.lit(" — "), _text("claim_type"),
        F.lit(" | "), _text("country"), F.lit(" | "), _text("status"),
    )
    return claims.select("claim_id", label.alias("label"))


def detail_rows(claims: DataFrame) -> DataFrame:
    """Five (field, value) rows per claim."""
    facts = claims.select(
        "claim_id",
        F.col("policy_number").alias("Policy"),
        F.col("claim_type").alias("Claim Type"),
        F.col("policy_type").alias("Policy Type"),
        F.concat(_text("city"), F.lit(", "), _text("country")).alias("Location"),
        F.col("filing_date").cast("string").alias("Filing Date"),
    )
    return facts.unpivot(
        "claim_id", ["Policy", "Claim Type", "Policy Type", "Location", "Filing Date"], "field", "value"
    )


def market_context(claims: DataFrame) -> DataFrame:
    """Report text of five country indicators; N/A where the value is missing or zero."""
    gdp, population, displaced = map(F.col, ["country_gdp_per_capita", "population", "disaster_displaced_persons"])
    penetration, exposure = F.col("country_insurance_penetration"), F.col("country_disaster_exposure")

    def present(value: Column) -> Column:
        return F.coalesce(value != 0, F.lit(False))

    return claims.select(
        "claim_id",
        "country",
        fn.or_not_available(gdp, fn.dollars(gdp)).alias("gdp_per_capita"),
        fn.or_not_available(penetration, fn.percent_text(fn.to_percent(penetration))).alias("penetration"),
        fn.or_not_available(exposure, fn.percent_text(fn.to_percent(exposure))).alias("exposure"),
        fn.or_not_available(population, fn.whole_number(population)).alias("population_text"),
        fn.or_not_available(displaced, fn.whole_number(displaced)).alias("displaced_text"),
        (present(population) | present(displaced)).alias("shows_population"),
    )


def procedure_context(claims: DataFrame) -> DataFrame:
    """The evaluation's own inputs, where a missing indicator counts as zero."""
    zero = F.lit(0.0)
    return claims.select(
        "*",
        F.coalesce("country_gdp_per_capita", zero).alias("gdp"),
        fn.to_percent(F.coalesce("country_insurance_penetration", zero)).alias("penetration_pct"),
        fn.to_percent(F.coalesce("country_disaster_exposure", zero)).alias("exposure_pct"),
    )


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def render_prompts(claims: DataFrame) -> DataFrame:
    """One request text per claim, from fifteen columns, for a scorer further down the line."""
    amount, limit, deductible = (F.coalesce(fn.dollars(F.col(c)), F.lit("None")) for c in ["claim_amount", "coverage_limit", "deductible"])
    lines = [
        F.lit("Assess this insurance claim and answer with one JSON object."),
        F.concat(F.lit("Claim: "), _text("claim_id"), F.lit(", status "), _text("status")),
        F.concat(F.lit("Type: "), _text("claim_type"), F.lit(", policy "), _text("policy_type")),
        F.concat(F.lit("Amount: "), amount, F.lit(", coverage "), limit, F.lit(", deductible "), deductible),
        F.concat(F.lit("Place: "), _text("city"), F.lit(", "), _text("country")),
        F.concat(F.lit("Claimant: "), _text("first_name"), F.lit(" "), _text("last_name")),
        F.concat(F.lit("Incident: "), _text("description")),
        F.concat(F.lit("GDP per capita: "), fn.dollars(F.col("gdp"))),
        F.concat(F.lit("Insurance penetration: "), fn.percent_text(F.col("penetration_pct"), 2)),
        F.concat(F.lit("Disaster exposure: "), fn.percent_text(F.col("exposure_pct"), 2)),
        F.lit("Deny above the coverage limit or when the policy does not cover the claim type."),
        F.lit("Approve a reasonable claim within limits; refer one that needs investigation."),
        F.lit("Weigh the country figures in the risk score."),
        F.lit('Answer keys: decision (APPROVE, DENY or REFER), risk_score (1-10), recommended_payout, reasoning.'),
    ]
    return procedure_context(claims).select("claim_id", F.concat_ws("\n", *lines).alias("prompt"))
