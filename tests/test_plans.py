"""The physical plans that scale depends on."""

import pytest

from claimflow import vocab
from claimflow.operators import claims as views
from claimflow.operators import curate, decisions, kpis, quality, repair, risk, search
from claimflow.plans import bindings
from claimflow.session import fixed_rows
from claimflow.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Claims and series as stored tables, as they are in use."""
    root = tmp_path_factory.mktemp("tables")
    wide = tables.write_snapshot(bindings.claims(spark, sf_dir, with_risk=True), str(root / "claims"))
    series = tables.write_snapshot(bindings.timeseries(spark, sf_dir), str(root / "series"))
    return wide, series


def test_series_conditions_reach_the_scan(stored):
    text = plan(risk.latest_value(risk.scan_timeseries(stored[1])))
    pushed = text[text.index("PushedFilters") :].split("ReadSchema")[0]
    assert "In(geo_id" in pushed and "IsNotNull(value)" in pushed
    assert "unit" not in text[text.index("ReadSchema") :].split("\n")[0]
    # One row per group leaves each task, and no group is sorted by date.
    assert "partial_max" in text and "Window" not in text
    assert text.index("partial_max") > text.index("Exchange hashpartitioning(geo_id")
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_newest_decision_is_cut_before_the_shuffle(spark, sf_dir):
    text = plan(decisions.latest_decisions(decisions.parse_decisions(bindings.responses(spark, sf_dir))))
    assert text.index("partial_max") > text.index("Exchange hashpartitioning(claim_id")


def test_rollup_reads_three_columns_in_one_pass(stored):
    text = plan(kpis.kpi_rollup(stored[0]))
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<country:string,claim_amount:decimal(18,2),ai_decision:string>" in text


def test_country_risk_is_broadcast_and_claims_stay(stored):
    wide, series = stored
    text = plan(curate.with_country_risk(wide, risk.country_risk(series), markets_only=True))
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text
    assert "hashpartitioning(country" not in text


def test_no_hint_without_the_callers_word(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide, series = stored
        text = plan(curate.with_country_risk(wide, risk.country_risk(series)))
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_claims_without_a_full_sort(stored):
    assert "TakeOrderedAndProject" in plan(views.largest(stored[0]))


@pytest.mark.parametrize(
    "operator",
    [decisions.batch_evaluate_pending, repair.repair_claim_types, repair.repair_descriptions,
     repair.repair_names, repair.reset_evaluations, views.render_prompts, quality.claim_type_mismatch,
     quality.mismatch_anti_join, quality.description_violations_by_rule, decisions.previous_evaluation],
)
def test_narrow_operators_do_not_shuffle(stored, operator):
    text = plan(operator(stored[0]))
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_point_lookup_is_pushed(stored):
    assert "EqualTo(claim_id,CLM-7)" in plan(views.by_id(stored[0], "CLM-7"))


def test_search_shuffles_ranks_only(spark, sf_dir):
    docs = bindings.documents(spark, sf_dir)
    text = plan(search.search_text(docs, [(0, "the home")]))
    assert "NestedLoop" not in text and "Cartesian" not in text
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in text.splitlines() if "Exchange hash" in line]
    # Counts per asked term, and k rows per question and task; no text is shuffled by either.
    assert sorted(keys) == ["query_id", "term"]


def test_fixed_rows_have_a_known_size(spark):
    df = fixed_rows(spark, "a string, b bigint", [("x", 1), (None, 2)])
    assert "LocalTableScan" in plan(df) and df.count() == 2


def test_write_back_leaves_bucketed_claims_in_place(spark, stored, sf_dir, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = tables.write_bucketed(stored[0], "bucketed_claims", "claim_id", 8, str(tmp_path / "claims"))
        made = decisions.parse_decisions(bindings.responses(spark, sf_dir))
        done = decisions.apply_decisions(claims, made)
        text = plan(done)
        assert text.count("Exchange hashpartitioning(claim_id") == 2 and "Bucketed: true" in text  # the decisions, twice
        assert "SortAggregate" not in text
        assert done.count() == stored[0].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_claims")


def test_a_hot_policy_is_split(spark):
    """A third of the claims on one policy: the join must not end up in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        claims = spark.range(0, 120_000, 1, 8).selectExpr(
            "concat('CLM-', id) AS claim_id", "if(id % 3 = 0, 'POL-0', concat('POL-', id)) AS policy_number",
            "'Fire' AS claim_type", "'Pending' AS status", "TIMESTAMP_NTZ '2025-01-01 00:00:00' AS filing_date",
            "CAST(id AS DECIMAL(18,2)) AS claim_amount", "md5(CAST(id AS STRING)) AS description")
        policies = spark.range(0, 120_000, 1, 8).selectExpr(
            "concat('POL-', id) AS policy_number", "concat('CUS-', id) AS customer_id", "'Home' AS policy_type",
            "CAST(1 AS DECIMAL(18,2)) AS coverage_limit", "CAST(1 AS DECIMAL(18,2)) AS deductible",
            "CAST(1 AS DECIMAL(18,2)) AS premium")
        customers = spark.range(0, 120_000, 1, 8).selectExpr(
            "concat('CUS-', id) AS customer_id", "'A' AS first_name", "'B' AS last_name", "'Japan' AS country", "'T' AS city")
        empty = bindings._no_risk(spark)
        wide = curate.build_curated_claims(claims, customers, policies, empty, markets_only=True)
        assert wide.filter("policy_type IS NULL").count() == 0
        rows = wide.groupBy("policy_type").count().collect()
        assert rows[0]["count"] == 120_000
        wide.write.format("noop").mode("overwrite").save()
        collected = wide.select("claim_id", "country", "policy_number")
        collected.collect()
        assert "skew=true" in plan(collected)
    finally:
        for name in settings:
            spark.conf.unset(name)
