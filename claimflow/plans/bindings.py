"""Stand-ins: the claims tables derived from the given tables, whole and without row filters.

The mapping is described in FIXTURES.md; `oracles.py` states the same mapping in SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.functions import scalars as fn
from claimflow.operators import curate, risk

MONEY = "decimal(18,2)"
# Codes by index 0..8: the eight markets, then a country outside them.
GEO_CODES = [*vocab.MARKETS, "USA"]

CLAIM_TYPES = {
    "1-URGENT": "Medical",
    "2-HIGH": "Fire",
    "3-MEDIUM": "Theft",
    "4-NOT SPECIFIED": "Property Damage",
    "5-LOW": "Auto Collision",
}
POLICY_TYPES = {
    "AUTOMOBILE": "Auto",
    "HOUSEHOLD": "Home",
    "FURNITURE": "Health",
    "BUILDING": "Commercial",
    "MACHINERY": "Travel",
}
STATUSES = {"P": "Pending", "O": "Submitted", "F": "Under Review"}
DESCRIPTIONS = [
    "vehicle damaged in car park",
    "hotel burglary",
    "commercial signage fell",
    "typhoon damage to residence",
]
VARIABLE_NAMES = {
    "purchase": "GDP per capita, PPP (current international $)",
    "view": "Insurance and financial services (% of commercial service exports)",
    "click": "Internally displaced persons, new displacement associated with disasters",
    "signup": "Population, total",
    "error": "Other indicator",
}


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _nth(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (index + 1).cast("int"))


def _prefixed(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("n_nationkey") % 9
    country = F.when(place < 8, F.get(F.array(*map(F.lit, vocab.MARKETS.values())), place)).otherwise(F.col("n_name"))
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.withColumn("country", country).select(
        _prefixed("CUS-", "c_custkey").alias("customer_id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        "country",
        F.concat("country", F.lit("-"), (F.col("c_custkey") % 5).cast("string")).alias("city"),
    )


def raw_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _prefixed("POL-", "c_custkey").alias("policy_number"),
        _prefixed("CUS-", "c_custkey").alias("customer_id"),
        fn.lookup(POLICY_TYPES, F.col("c_mktsegment")).alias("policy_type"),
        (300_000 + 10 * F.col("c_acctbal")).cast(MONEY).alias("coverage_limit"),
        (500 * (1 + key % 5)).cast(MONEY).alias("deductible"),
        (1000 + key % 1000).cast(MONEY).alias("premium"),
    )


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        _prefixed("CLM-", "o_orderkey").alias("claim_id"),
        _prefixed("POL-", "o_custkey").alias("policy_number"),
        fn.lookup(CLAIM_TYPES, F.col("o_orderpriority")).alias("claim_type"),
        fn.lookup(STATUSES, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("filing_date"),
        F.col("o_totalprice").cast(MONEY).alias("claim_amount"),
        _nth(DESCRIPTIONS, F.col("o_orderkey") % 4).alias("description"),
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of which each is about to become a long text, dealt into partitions of the advisory size.

    The given tables are one row group, which one task reads, however the scan is split.
    """
    return rows.hint("rebalance")


def timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("user_id") % 9
    kind = F.col("event_type")
    value = (
        F.when(F.col("event_id") % 10 == 0, F.lit(None))
        .when((kind == "signup") & (place == 7), F.lit(0.0))
        .otherwise(F.col("value"))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit(vocab.GEO_PREFIX), _nth(GEO_CODES, place)).alias("geo_id"),
        kind.alias("variable"),
        fn.lookup(VARIABLE_NAMES, kind).alias("variable_name"),
        F.col("ts").cast("timestamp_ntz").alias("date"),
        value.alias("value"),
        F.lit("unit").alias("unit"),
    )


def country_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.country_risk(timeseries(spark, sf_dir))


def _no_risk(spark: SparkSession) -> DataFrame:
    """An empty risk table; Catalyst then drops the join and leaves the columns NULL."""
    missing = F.lit(None).cast("double")
    return spark.range(1).filter(F.lit(False)).select(
        F.lit("").alias("country"),
        missing.alias("gdp_per_capita"),
        missing.alias("insurance_penetration"),
        missing.alias("natural_disaster_exposure"),
    )


def claims(spark: SparkSession, sf_dir: str, with_risk: bool = False) -> DataFrame:
    """The wide claims table; the country indicators are joined on only where they are read."""
    indicators = country_risk(spark, sf_dir) if with_risk else _no_risk(spark)
    return curate.build_curated_claims(
        raw_claims(spark, sf_dir),
        raw_customers(spark, sf_dir),
        raw_policies(spark, sf_dir),
        indicators,
        markets_only=True,
    )


# Columns that lack a value in some rows, by what the row's key leaves over when divided by GAPS_PER.
GAPS_PER = 17
CLAIM_GAPS = {"claim_type": 3, "city": 4, "coverage_limit": 5, "deductible": 6, "status": 8, "claim_amount": 9, "policy_type": 10, "last_name": 11, "description": 12}
POLICY_GAPS = {"policy_type": 2, "coverage_limit": 3, "deductible": 5, "premium": 7}


def _with_gaps(rows: DataFrame, key: Column, gaps: dict[str, int]) -> DataFrame:
    return rows.withColumns({c: F.when(key % GAPS_PER != n, F.col(c)) for c, n in gaps.items()})


def gapped_claims(spark: SparkSession, sf_dir: str, with_risk: bool = False) -> DataFrame:
    """The wide claims with NULLs in nine columns, for what has to show a missing value."""
    return _with_gaps(claims(spark, sf_dir, with_risk), claim_key(), CLAIM_GAPS)


def gapped_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_gaps(raw_policies(spark, sf_dir), F.substring("policy_number", 5, 20).cast("bigint"), POLICY_GAPS)


def claim_key() -> Column:
    return F.substring("claim_id", 5, 20).cast("bigint")


def evaluated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with stored evaluations of five kinds: none, JSON, plain text, JSON with gaps, blank."""
    kind = claim_key() % 5
    decision = F.when(kind == 1, "APPROVE").when(kind == 2, "DENY").when(kind == 3, "REFER").when(kind == 4, "  ")
    reasoning = (
        F.when(kind == 1, F.concat(
            F.lit('{"decision": "APPROVE", "risk_score": 3, "recommended_payout": 120, "reasoning": "fine '),
            F.col("claim_id"), F.lit('"}')))
        .when(kind == 2, F.concat(F.lit("over the limit: "), F.col("claim_id")))
        .when(kind == 3, F.lit('{"risk_score": "7"}'))
    )
    return claims(spark, sf_dir).withColumn("ai_decision", decision).withColumn("ai_reasoning", reasoning)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation response per claim, in six shapes, and a second, later one for each fifth."""
    key = claim_key()
    word = F.when(key % 3 == 0, "APPROVE").when(key % 3 == 1, "DENY").otherwise("REFER")
    body = F.concat(
        F.lit('{"decision": "'), word, F.lit('", "risk_score": '), (key % 10 + 1).cast("string"),
        F.lit(', "recommended_payout": '), (key % 1000).cast("string"),
        F.lit(', "flags": ["manual"], "reasoning": "case '), F.col("claim_id"), F.lit('"}'),
    )
    shape = key % 6
    text = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(shape == 3, F.concat(F.lit("Here is my answer: "), body, F.lit(" Regards")))
        .when(shape == 4, F.concat(F.lit("  "), F.regexp_replace(body, "}$", "")))
        .otherwise(F.concat(F.lit("I cannot decide on "), F.col("claim_id")))
    )
    first = _dealt(raw_claims(spark, sf_dir)).select(
        "claim_id", F.col("filing_date").alias("decided_at"), text.alias("response")
    )
    repeats = F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    later = F.lit('{"decision": "REFER", "risk_score": 5, "recommended_payout": 0, "reasoning": "second look"}')
    return first.withColumn("again", F.explode(repeats)).select(
        "claim_id",
        F.when(F.col("again") == 1, F.date_add("decided_at", 30).cast("timestamp_ntz"))
        .otherwise(F.col("decided_at")).alias("decided_at"),
        F.when(F.col("again") == 1, later).otherwise(F.col("response")).alias("response"),
    )


def note_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inspection note per claim, with the label, date, currency and heading variants."""
    key = claim_key()
    amount = F.format_number("claim_amount", 2)
    total = (
        F.when(key % 3 == 0, F.concat(F.lit("Total Loss Amount: $"), amount))
        .when(key % 3 == 1, F.concat(F.lit("Total Claim Amount: USD "), amount))
        .otherwise(F.concat(F.lit("Total: SGD 999,999 (USD "), amount, F.lit(")")))
    )
    date = F.when(key % 2 == 0, F.date_format("filing_date", "yyyy-MM-dd")).otherwise(
        F.date_format("filing_date", "MMMM d, yyyy")
    )
    text = F.concat(
        F.lit("FIELD INSPECTION REPORT\nClaim Number: "), F.col("claim_id"),
        F.when(key % 4 < 2, "\nDate of Inspection: ").otherwise("\nDate of Report: "), date,
        F.when(key % 5 == 0, "\nField Adjuster: ").otherwise("\nAdjuster: "),
        F.lit("Robin "), F.col("policy_number"), F.lit(" (License #"), key.cast("string"), F.lit(")\n\n"),
        F.when(key % 4 == 0, F.lit("DAMAGE ASSESSMENT:\n"))
        .when(key % 4 == 1, F.lit("OBSERVED DAMAGES:\n"))
        .otherwise(F.lit("INCIDENT DETAILS:\n")),
        F.col("description"), F.lit("\n\nCOST BREAKDOWN:\n1. Parts: USD 1,000.50\n   - Bolts: USD 5\n- Labor: $"),
        (key % 100).cast("string"), F.lit("\n"), total, F.lit("\n\n"),
        F.when(key % 3 == 0, F.lit("RECOMMENDATION:\n"))
        .when(key % 3 == 1, F.lit("RECOMMENDATIONS:\n"))
        .otherwise(F.lit("FINDINGS:\n")),
        F.lit("Handle "), F.col("claim_id"), F.lit(" as "), F.col("claim_type"), F.lit(".\n"),
    )
    return _dealt(raw_claims(spark, sf_dir)).select(
        F.concat(F.lit("note_"), key.cast("string"), F.lit(".txt")).alias("file_name"), text.alias("text")
    )


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents where they lie, for what deals them out itself."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(stored_documents(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
