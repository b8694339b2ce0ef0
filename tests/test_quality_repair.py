"""Rule checks, gates and repairs on hand-made rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.operators import kpis, quality, repair, semantic
from claimflow.plans import bindings


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def grid(spark):
    policies = [*vocab.COVERED_CLAIM_TYPES, "Boat", None]
    types = ["Auto Collision", "Theft", "Liability", "Fire", "Property Damage", "Natural Disaster", "Medical",
             "Travel Disruption", "Piracy", None]
    rows = [(f"CLM-{i}", t, p) for i, (p, t) in enumerate(itertools.product(policies, types))]
    return spark.createDataFrame(rows, "claim_id string, claim_type string, policy_type string")


def test_mismatch_on_the_full_grid(grid):
    flagged = rows_of(quality.claim_type_mismatch(grid), "claim_id")
    assert len(flagged) == 49
    assert flagged == rows_of(quality.mismatch_anti_join(grid), "claim_id")


def test_repair_leaves_unknown_policies_only(grid):
    fixed = repair.repair_claim_types(grid)
    left = quality.claim_type_mismatch(fixed)
    assert {r.policy_type for r in left.collect()} == {"Boat", None}
    assert rows_of(repair.repair_claim_types(fixed), "claim_id", "claim_type") == rows_of(fixed, "claim_id", "claim_type")
    ok = grid.exceptAll(quality.claim_type_mismatch(grid).select(grid.columns))
    assert ok.join(fixed, ["claim_id", "claim_type"], "left_anti").filter("claim_type IS NOT NULL").count() == 0


def test_whole_repair_passes_every_check(spark, sf_dir):
    claims = bindings.claims(spark, sf_dir)
    fixed = repair.repair_names(repair.repair_descriptions(repair.repair_claim_types(claims)))
    assert fixed.columns == claims.columns and fixed.count() == claims.count()
    assert {r.violations for r in quality.violation_counts(fixed).collect()} == {0}
    assert quality.description_violations_by_rule(fixed).count() == 0
    assert quality.name_country_gate(fixed).count() == 0
    assert quality.name_country_gate(claims).count() > 0


def test_own_descriptions_break_no_rule(spark):
    rows = [
        (f"CLM-{n}", t, p, None)
        for p, types in vocab.COVERED_CLAIM_TYPES.items() for t in types for n in range(30)
    ]
    df = spark.createDataFrame(rows, "claim_id string, claim_type string, policy_type string, description string")
    fixed = repair.repair_descriptions(df)
    assert fixed.filter("description IS NULL").count() == 0
    assert quality.description_violations_by_rule(fixed).count() == 0


def test_description_rules_differ(spark):
    df = spark.createDataFrame(
        [("1", "Theft", "Home", "taken at the Shopping Mall"), ("2", "Fire", "Home", "WAREHOUSE fire"),
         ("3", "Theft", "Home", "Car Park"), ("4", "Theft", "Home", None), ("5", None, "Home", "retail")],
        "claim_id string, claim_type string, policy_type string, description string",
    )
    assert rows_of(quality.description_violations(df), "claim_id") == [("3",)]
    assert rows_of(quality.description_violations_by_rule(df), "claim_id", "rule") == [
        ("1", "home_theft"), ("2", "home_any"), ("3", "home_theft"), ("5", "home_any"),
    ]


def test_reset(spark):
    states = [*vocab.OPEN_STATUSES, *vocab.CLOSED_STATUSES]
    rows = [(f"{s}/{d}", s, d, "{}" if d else None) for s in states for d in ("APPROVE", None)]
    rows.append(("kept", "Pending", None, "a reasoning without a decision"))
    df = spark.createDataFrame(rows, "claim_id string, status string, ai_decision string, ai_reasoning string")
    once = repair.reset_evaluations(df)
    got = {r.claim_id: r for r in once.collect()}
    assert all(r.ai_decision is None for r in got.values())
    assert {k for k, r in got.items() if r.ai_reasoning} == {"kept"}
    assert all(r.status in vocab.OPEN_STATUSES for r in got.values())
    assert all(got[f"{s}/{d}"].status == s for s in vocab.OPEN_STATUSES for d in ("APPROVE", None))
    assert rows_of(repair.reset_evaluations(once), *df.columns) == rows_of(once, *df.columns)


def test_gates(spark):
    df = spark.createDataFrame(
        [("a", "Approved", None, "Japan"), ("b", "Denied", " ", "Japan"), ("c", "Denied", "DENY", "Peru")],
        "claim_id string, status string, ai_decision string, country string",
    )
    assert rows_of(quality.status_gate(df), "status", "violations") == [("Approved", 1), ("Denied", 1)]
    gate = quality.market_coverage_gate(df, bounds=(2, 3))
    assert gate.count() == 8
    assert rows_of(gate.filter("passed"), "country", "cnt") == [("Japan", 2)]
    counts = quality.row_count_gate({"raw_claims": df, "other": df}, {"raw_claims": 3})
    assert rows_of(counts, "tbl", "cnt", "expected", "passed") == [("other", 3, None, False), ("raw_claims", 3, 3, True)]


def test_progress_and_empty_table(spark):
    df = spark.createDataFrame(
        [("x", "1.50", "a", "APPROVE" if i < 7 else None) for i in range(9)],
        "claim_id string, claim_amount string, country string, ai_decision string",
    ).withColumn("claim_amount", F.col("claim_amount").cast("decimal(18,2)"))
    assert kpis.evaluation_progress(kpis.kpi_rollup(df)).collect()[0].percent == 77
    all_done = df.filter("ai_decision IS NOT NULL")
    assert kpis.evaluation_progress(kpis.kpi_rollup(all_done)).collect()[0].percent == 100
    empty = kpis.kpi_rollup(df.filter("false"))
    row = empty.collect()[0]
    assert (row.total_claims, row.evaluated, row.approved, row.total_amount) == (0, 0, 0, None)
    assert kpis.evaluation_progress(empty).count() == 0


def test_semantic_names():
    assert semantic.resolve("Market").column == "country"
    assert semantic.resolve("location").column == "country"
    assert semantic.resolve("Annual Premium").aggregation == "SUM"
    for hidden in ("ai_reasoning", "AI Reasoning", "no such thing"):
        with pytest.raises(KeyError):
            semantic.resolve(hidden)
    visible = [f for f in semantic.FIELDS if not f.hidden]
    assert len(semantic.FIELDS) == 19 and len(visible) == 18
    for f in visible:
        assert semantic.resolve(f.name) == f and semantic.resolve(f.column) == f
