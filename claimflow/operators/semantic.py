"""A small semantic layer: business names over the claims table, with default aggregations."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGGREGATES = {"SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "DISTINCT_COUNT": F.countDistinct}


@dataclass(frozen=True)
class Field:
    column: str
    name: str
    synonyms: list[str] = field(default_factory=list)
    aggregation: str | None = None
    hidden: bool = False


# Friendly names, synonyms, default aggregations and the one hidden column.
FIELDS = [
    Field("claim_id", "Claim ID", ["claim number", "claim ref"]),
    Field("claim_type", "Claim Type", ["type", "category", "claim category"]),
    Field("policy_type", "Policy Type", ["policy", "insurance type", "product"]),
    Field("status", "Claim Status", ["state", "progress", "stage"]),
    Field("country", "Country", ["market", "region", "location", "nation"]),
    Field("city", "City", ["town", "location"]),
    Field("claim_amount", "Claim Amount", ["amount", "value", "cost", "claim value", "claim cost"], "SUM"),
    Field("coverage_limit", "Coverage Limit", ["coverage", "limit", "max coverage"], "AVERAGE"),
    Field("deductible", "Deductible", ["excess"], "AVERAGE"),
    Field("premium", "Premium", ["price", "annual premium"], "SUM"),
    Field("ai_decision", "AI Decision", ["decision", "ai result", "evaluation", "recommendation"]),
    Field("filing_date", "Filing Date", ["date", "filed", "submission date"]),
    Field("first_name", "First Name"),
    Field("last_name", "Last Name"),
    Field("policy_number", "Policy Number"),
    Field("country_gdp_per_capita", "GDP per Capita", ["gdp", "income"], "AVERAGE"),
    Field("country_insurance_penetration", "Insurance Penetration", ["penetration", "insurance rate"], "AVERAGE"),
    Field("country_disaster_exposure", "Disaster Exposure", ["disaster risk", "exposure", "catastrophe"], "AVERAGE"),
    Field("ai_reasoning", "AI Reasoning", hidden=True),
]


def resolve(term: str) -> Field:
    """Field behind a column name, friendly name or synonym, in that order of preference.

    Two fields share the synonym "location"; the one listed first, the country, wins.
    """
    wanted = term.strip().lower()
    visible = [f for f in FIELDS if not f.hidden]
    for matches in (
        lambda f: wanted in (f.column, f.name.lower()),
        lambda f: wanted in f.synonyms,
    ):
        for candidate in visible:
            if matches(candidate):
                return candidate
    raise KeyError(f"no field is called {term!r}")


def _measure(spec: str | tuple[str, str]) -> Column:
    term, aggregation = spec if isinstance(spec, tuple) else (spec, None)
    found = resolve(term)
    chosen = aggregation or found.aggregation or "COUNT"
    return _AGGREGATES[chosen](found.column).alias(f"{chosen.lower()}_{found.column}")


def semantic_query(
    claims: DataFrame,
    dimensions: list[str],
    measures: list[str | tuple[str, str]],
    filters: dict[str, object] | None = None,
) -> DataFrame:
    """Aggregate claims by business terms.

    A measure is a term, aggregated its default way, or a (term, aggregation) pair. A filter
    maps a term to one value or a list of values.
    """
    rows = claims
    for term, wanted in (filters or {}).items():
        values = wanted if isinstance(wanted, list) else [wanted]
        rows = rows.filter(F.col(resolve(term).column).isin(values))
    return rows.groupBy(*[resolve(d).column for d in dimensions]).agg(*map(_measure, measures))
