"""The full build: from raw tables to the stored tables that the reports read."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from claimflow.operators import curate, notes, quality, repair, risk
from claimflow.sources import tables


@dataclass(frozen=True)
class RawTables:
    customers: DataFrame
    policies: DataFrame
    claims: DataFrame
    timeseries: DataFrame
    notes: DataFrame


def build_tables(raw: RawTables, root: str) -> dict[str, DataFrame]:
    """Write country risk, indicators, claims, extracted notes and policy texts below `root`.

    The risk table is stored before the claims join it: the long series is read once, and the
    stored table has one row per market at most, which bounds the broadcast. Repairs and the
    reset of stale evaluations ride on the same narrow pass that writes the claims, and so do the
    gates over them, whose figures come back as table "gate_figures".
    """
    country_risk = tables.write_snapshot(risk.country_risk(raw.timeseries), f"{root}/country_risk")
    indicators = tables.write_snapshot(risk.indicators(country_risk), f"{root}/indicators")
    wide = curate.build_curated_claims(raw.claims, raw.customers, raw.policies, country_risk, markets_only=True)
    repaired = repair.repair_names(repair.repair_descriptions(repair.repair_claim_types(wide)))
    checked, seen = quality.observed(repair.reset_evaluations(repaired))
    claims = tables.write_snapshot(checked, f"{root}/claims")
    extracted = tables.write_snapshot(notes.dataset_notes(notes.extract_notes(raw.notes)), f"{root}/notes")
    texts = tables.write_snapshot(curate.build_policy_text(raw.policies), f"{root}/policy_texts")
    return {
        "raw_customers": raw.customers,
        "raw_policies": raw.policies,
        "raw_claims": raw.claims,
        "country_risk": country_risk,
        "indicators": indicators,
        "claims": claims,
        "notes": extracted,
        "policy_texts": texts,
        "gate_figures": quality.gate_figures(claims.sparkSession, seen),
    }


def gates(built: dict[str, DataFrame], expected: dict[str, int]) -> dict[str, DataFrame]:
    """The checks that must pass before the tables are served, as small result tables."""
    counted = {name: built[name] for name in expected}
    return {
        "row_counts": quality.row_count_gate(counted, expected),
        "violations": quality.violation_counts(built["claims"]),
        "early_statuses": quality.status_gate(built["claims"]),
        "names": quality.name_country_gate(built["claims"]),
        "markets": quality.market_coverage_gate(built["claims"]),
    }
