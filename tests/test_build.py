"""The full build on generated tables, and what follows from it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimflow import schemas, vocab
from claimflow.operators import decisions, kpis, quality
from claimflow.plans.bindings import note_texts
from claimflow.plans.build import RawTables, build_tables, gates
from claimflow.sources import generate


@pytest.fixture(scope="module")
def built(spark, sf_dir, tmp_path_factory):
    seeds = spark.range(200).withColumnRenamed("id", "seed")
    names = ["GDP per capita, PPP (current international $)", "Population, total",
             "Internally displaced persons by disasters", "Insurance and financial services (% of commercial service exports)"]
    rows = [(vocab.GEO_PREFIX + code, "v", name, dt.datetime(2000 + y, 1, 1), float(100 * (i + 1) + y), "u")
            for code in [*vocab.MARKETS, "USA"] for i, name in enumerate(names) for y in range(3)]
    raw = RawTables(
        customers=generate.generate_customers(seeds.filter("seed < 50")),
        policies=generate.generate_policies(seeds.filter("seed < 100")).withColumn(
            "customer_id", F.concat(F.lit("CUS-"), (F.split_part("policy_number", F.lit("-"), F.lit(2)).cast("int") % 50).cast("string"))
        ),
        claims=generate.generate_claims(seeds).withColumn(
            "policy_number", F.concat(F.lit("POL-"), (F.split_part("claim_id", F.lit("-"), F.lit(2)).cast("int") % 100).cast("string"))
        ),
        timeseries=spark.createDataFrame(rows, schemas.TIMESERIES),
        notes=note_texts(spark, sf_dir),
    )
    return build_tables(raw, str(tmp_path_factory.mktemp("built")))


def test_schemas(spark, built):
    for name, ddl in {"claims": schemas.CLAIMS, "country_risk": schemas.COUNTRY_RISK, "notes": schemas.NOTES}.items():
        assert built[name].dtypes == spark.createDataFrame([], ddl).dtypes


def test_gates_pass(built):
    checks = gates(built, vocab.EXPECTED_ROWS)
    assert checks["row_counts"].filter("NOT passed").count() == 0
    assert checks["violations"].filter("violations <> 0").count() == 0
    assert checks["early_statuses"].count() == 0 and checks["names"].count() == 0
    assert checks["markets"].count() == 8


def test_gates_ride_on_the_write(spark, built, tmp_path):
    """The observed counts are those of the gates that scan, and the write reads its input once."""
    figures = {(r.gate, r.item): r.found for r in built["gate_figures"].collect()}
    claims = built["claims"]
    assert figures["rows", "claims"] == claims.count()
    assert {r.check_name: r.violations for r in quality.violation_counts(claims).collect()} == {i: n for (g, i), n in figures.items() if g == "violations"}
    assert {r.country: r.cnt for r in quality.market_coverage_gate(claims).collect()} == {i: n for (g, i), n in figures.items() if g == "market"}
    broken = claims.withColumns({"last_name": F.lit("Nobody"), "status": F.lit("Denied")})
    checked, seen = quality.observed(broken)
    plan = checked._jdf.queryExecution().toString()
    assert plan.count("FileScan parquet") == 1 and "CollectMetrics" in plan
    checked.write.parquet(str(tmp_path / "out"))
    rows = {(r.gate, r.item): (r.found, r.passed) for r in quality.gate_figures(spark, seen, expected_rows=1).collect()}
    assert rows["names", "outside the pool"] == (quality.name_country_gate(broken).count(), False) and rows["names", "outside the pool"][0] > 0
    assert rows["early status", "Denied"] == (quality.status_gate(broken).first().violations, False)
    assert rows["rows", "claims"][1] is False


def test_evaluation_and_reports(built):
    claims = built["claims"]
    done = decisions.batch_evaluate_pending(claims)
    row = kpis.kpi_rollup(done).collect()[0]
    pending = claims.filter("status = 'Pending'").count()
    assert row.total_claims == 200 and row.evaluated == pending > 0
    assert row.approved + row.denied + row.referred == pending
    assert quality.status_gate(done).count() == 0
    one = decisions.evaluate_claim(claims, "CLM-3").collect()
    assert len(one) == 1 and one[0].decision in vocab.STATUS_AFTER
    untouched = done.join(claims.filter("status <> 'Pending'").select("claim_id"), "claim_id", "left_semi")
    assert untouched.select(claims.columns).exceptAll(claims).count() == 0
    again = decisions.evaluate_where(done, F.col("claim_id") == "CLM-3")
    assert again.filter("ai_decision IS NOT NULL").count() >= pending
