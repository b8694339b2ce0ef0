"""Declared schemas: no reader in this package infers one."""

CLAIMS = """
    claim_id string, claim_type string, policy_type string, policy_number string, status string,
    country string, city string, first_name string, last_name string, filing_date timestamp_ntz,
    claim_amount decimal(18,2), coverage_limit decimal(18,2), deductible decimal(18,2),
    premium decimal(18,2), ai_decision string, ai_reasoning string,
    country_gdp_per_capita double, country_insurance_penetration double,
    country_disaster_exposure double, description string
"""
RAW_CLAIMS = """
    claim_id string, policy_number string, claim_type string, status string,
    filing_date timestamp_ntz, claim_amount decimal(18,2), description string
"""
RAW_POLICIES = """
    policy_number string, customer_id string, policy_type string, coverage_limit decimal(18,2),
    deductible decimal(18,2), premium decimal(18,2)
"""
RAW_CUSTOMERS = "customer_id string, first_name string, last_name string, country string, city string"
TIMESERIES = """
    geo_id string, variable string, variable_name string, date timestamp_ntz, value double, unit string
"""
COUNTRY_RISK = """
    country string, country_code string, gdp_per_capita double, insurance_penetration double,
    natural_disaster_exposure double, population double, disaster_displaced_persons double
"""
NOTES = """
    file_name string, claim_id string, adjuster_name string, inspection_date string,
    damage_assessment string, estimated_amount decimal(18,2), recommendation string
"""
RAW_DECISIONS = "claim_id string, decided_at timestamp_ntz, response string"
DECISIONS = """
    claim_id string, decided_at timestamp_ntz, decision string, risk_score string,
    recommended_payout decimal(18,2), reasoning string
"""


def names(ddl: str) -> list[str]:
    """Column names of a DDL string, in order."""
    flat = ddl.replace("decimal(18,2)", "decimal")
    return [part.split()[0] for part in flat.split(",")]
