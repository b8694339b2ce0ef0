"""What a write-back does no more often than it has to."""

from claimflow.functions import responses
from claimflow.operators import decisions
from claimflow.sources import buckets


def test_touched_buckets_are_told_by_the_claim_ids_alone(spark, tmp_path, monkeypatch):
    claims = spark.createDataFrame(
        [(f"CLM-{i}", "Pending", None, None) for i in range(50)], "claim_id string, status string, ai_decision string, ai_reasoning string"
    )
    root = str(tmp_path / "claims")
    buckets.create(claims, root, 8)
    made = spark.createDataFrame([(None, None, "x"), (None, None, "y")], "claim_id string, decided_at timestamp_ntz, response string")

    def joined(_):
        raise AssertionError("newest decisions were made to tell the touched buckets")

    monkeypatch.setattr(decisions, "newest_numbered", joined)
    assert buckets.apply(spark, root, decisions.parse_decisions(made)) == []


def test_the_span_of_a_wrapped_answer_is_made_once(spark):
    rows = spark.createDataFrame([("CLM-1", "Well: {} or so")], "claim_id string, response string")
    parsed = decisions.parse_decisions(rows)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("instr(") <= 4


def test_widest_braces(spark):
    texts = ["", "{", "}", "}{", "{}", "a{b}c", "{{x}", "{x}}", "é{ü}ß", "}a{b}c{", "a } b", None, "x{\n}\ny}z", "{a"]
    want = [None, None, None, None, "{}", "{b}", "{{x}", "{x}}", "{ü}", "{b}", None, None, "{\n}\ny}", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = found.select("i", responses.widest_braces(found["t"]).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == want
