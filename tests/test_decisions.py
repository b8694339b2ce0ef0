"""Responses, stored evaluations, rule decisions and write-back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimflow import schemas
from claimflow.functions import responses
from claimflow.operators import decisions
from claimflow.plans import bindings

OBJECT = '{"decision": "DENY", "risk_score": "7", "recommended_payout": 12.5, "reasoning": "a {b} c"}'
SHAPES = {
    "clean": OBJECT,
    "fenced": f"```json\n{OBJECT}\n```",
    "bare fence": f"  ```\n{OBJECT}\n```  \n",
    "upper-case tag": f"```JSON\n{OBJECT}\n```",
    "prose": f"My answer is {OBJECT} - regards",
    "trailing": f"{OBJECT} trailing",
    "single quotes": "{'decision': 'DENY'}",
    "array": f"[{OBJECT}]",
    "two objects": f"{OBJECT} and {OBJECT}",
    "two in a list": f"{OBJECT}, {OBJECT}",
    "empty": "",
    "missing": None,
    "missing keys": '{"risk_score": 4}',
    "unknown decision": '{"decision": "MAYBE"}',
    "broken": '{"decision": "DENY"',
    "broken in prose": 'so {"decision": } there',
    "plain": "no idea",
    "number": "5",
    "newline in text": '{"decision": "REFER", "reasoning": "line\\nnext \\"q\\""}',
}


# What is read of each shape: decision, score, reasoning; None where there is no object to read.
READ = {
    "clean": ("DENY", "7", "a {b} c"),
    "fenced": ("DENY", "7", "a {b} c"),
    "bare fence": ("DENY", "7", "a {b} c"),
    "upper-case tag": ("DENY", "7", "a {b} c"),
    "prose": ("DENY", "7", "a {b} c"),
    "trailing": ("DENY", "7", "a {b} c"),
    "single quotes": None,
    "array": None,
    "two objects": None,
    "two in a list": None,
    "empty": None,
    "missing": None,
    "missing keys": ("", "4", None),
    "unknown decision": ("MAYBE", None, None),
    "broken": None,
    "broken in prose": None,
    "plain": None,
    "number": None,
    "newline in text": ("REFER", None, 'line\nnext "q"'),
}


@pytest.mark.parametrize("mode", ["REFER", "ERROR"])
def test_every_shape(spark, mode):
    df = spark.createDataFrame([(k, v) for k, v in SHAPES.items()], "claim_id string, response string")
    rows = {r.claim_id: r for r in decisions.parse_decisions(df, on_error=mode).collect()}
    assert set(rows) == set(READ)
    for name, read in READ.items():
        row = rows[name]
        if read is None:
            assert (row.decision, row.risk_score) == (mode, "5" if mode == "REFER" else None), name
        else:
            unstated = "REFER" if mode == "REFER" else "UNKNOWN"
            assert (row.decision, row.risk_score, row.reasoning) == (read[0] or unstated, *read[1:]), name
    assert rows["plain"].reasoning == "no idea"


def test_mode_is_checked(spark):
    with pytest.raises(ValueError):
        decisions.parse_decisions(spark.range(1), on_error="IGNORE")


def test_clean_completion(spark):
    texts = ['"costs $5\\nnext\\tend"', "plain", '"', '""', '  "a"  ']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i")
    got = [r[0] for r in df.select(responses.clean_completion(F.col("x"))).collect()]
    assert got == ["costs \\$5\nnext end", "plain", "", "", "a"]


def test_previous_evaluation_fills_gaps(spark):
    stored = [
        ("full", "APPROVE", '{"decision": "APPROVE", "risk_score": 2, "recommended_payout": 9, "reasoning": "ok"}'),
        ("gaps", "DENY", '{"risk_score": 8}'),
        ("text", "REFER", "see file"),
        ("none", "DENY", None),
        ("empty", "DENY", ""),
        ("blank", " \t", "{}"),
        ("open", None, None),
    ]
    df = spark.createDataFrame(stored, "claim_id string, ai_decision string, ai_reasoning string")
    rows = {r.claim_id: tuple(r)[1:] for r in decisions.previous_evaluation(df).collect()}
    assert rows == {
        "full": ("APPROVE", "2", "9", "ok"),
        "gaps": ("DENY", "8", "0", '{"risk_score": 8}'),
        "text": ("REFER", "N/A", "0", "see file"),
        "none": ("DENY", "N/A", "0", "No reasoning provided"),
        "empty": ("DENY", "N/A", "0", "No reasoning provided"),
    }


def claims(spark, rows):
    """Claims from (id, claim type, policy type, status, amount, limit, deductible, exposure)."""
    base = spark.createDataFrame(
        rows,
        "claim_id string, claim_type string, policy_type string, status string, claim_amount string,"
        "coverage_limit string, deductible string, country_disaster_exposure double",
    )
    have = set(base.columns)
    other = [c for c in schemas.names(schemas.CLAIMS) if c not in have]
    types = dict(zip(schemas.names(schemas.CLAIMS), spark.createDataFrame([], schemas.CLAIMS).dtypes))
    for name in other:
        base = base.withColumn(name, F.lit(None))
    return base.select(*[F.col(n).cast(types[n][1]).alias(n) for n in schemas.names(schemas.CLAIMS)])


def test_rules_payout_and_score(spark):
    df = claims(spark, [
        ("over", "Medical", "Health", "Pending", "101", "100", "10", 0.0),
        ("wrong", "Fire", "Health", "Pending", "50", "100", "10", 0.0),
        ("fine", "Medical", "Health", "Pending", "50", "100", "10", 0.025),
        ("small", "Medical", "Health", "Pending", "5", "100", "10", None),
        ("gap", "Medical", "Health", "Pending", None, "100", "10", 9.0),
        ("zero limit", "Medical", "Health", "Pending", "0", "0", "0", 9.0),
    ])
    rows = {r.claim_id: r for r in decisions.evaluate(df).collect()}
    assert {k: r.decision for k, r in rows.items()} == {
        "over": "DENY", "wrong": "DENY", "fine": "APPROVE", "small": "APPROVE", "gap": "REFER", "zero limit": "APPROVE",
    }
    assert float(rows["fine"].recommended_payout) == 40 and float(rows["small"].recommended_payout) == 0
    assert float(rows["over"].recommended_payout) == 0
    assert {k: r.risk_score for k, r in rows.items()} == {
        "over": 7, "wrong": 4, "fine": 6, "small": 1, "gap": 10, "zero limit": 10,
    }


def test_write_back(spark):
    df = claims(spark, [(i, "Medical", "Health", "Pending", "50", "100", "10", 0.0) for i in ("a", "b", "c")])
    made = spark.sql("""
        SELECT * FROM VALUES
          ('a', TIMESTAMP_NTZ '2025-01-01 00:00:00', 'DENY', '9', CAST(0 AS DECIMAL(18,2)), 'old'),
          ('a', TIMESTAMP_NTZ '2025-01-02 00:00:00', 'APPROVE', '2', CAST(40 AS DECIMAL(18,2)), 'it''s "new" \\\\ fine'),
          ('x', TIMESTAMP_NTZ '2025-01-01 00:00:00', 'DENY', '9', CAST(0 AS DECIMAL(18,2)), 'no such claim'),
          (NULL, TIMESTAMP_NTZ '2025-01-01 00:00:00', 'DENY', '9', CAST(0 AS DECIMAL(18,2)), 'no id'),
          ('c', NULL, 'ODD', NULL, NULL, NULL)
        AS t(claim_id, decided_at, decision, risk_score, recommended_payout, reasoning)""")
    new = decisions.apply_decisions(df, made)
    assert new.columns == df.columns
    rows = {r.claim_id: r for r in new.collect()}
    assert len(rows) == 3 and new.count() == 3
    assert (rows["a"].ai_decision, rows["a"].status) == ("APPROVE", "Approved")
    assert json.loads(rows["a"].ai_reasoning)["reasoning"] == "it's \"new\" \\ fine"
    assert (rows["c"].ai_decision, rows["c"].status) == ("ODD", "Under Review")
    assert rows["b"] == df.filter("claim_id = 'b'").collect()[0]
    unchanged = decisions.apply_decisions(df, made.filter("false"))
    assert sorted(map(tuple, unchanged.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert {r.claim_id for r in decisions.version_changes(df, new).collect()} == {"a", "c"}


def test_batch_equals_write_back_of_its_own_decisions(spark, sf_dir):
    df = bindings.claims(spark, sf_dir, with_risk=True)
    judged = decisions.evaluate(df.filter("status = 'Pending'")).select(
        "claim_id", F.lit(None).cast("timestamp_ntz").alias("decided_at"),
        "decision", "risk_score", "recommended_payout", "reasoning",
    )
    joined, narrow = decisions.apply_decisions(df, judged), decisions.batch_evaluate_pending(df)
    assert joined.exceptAll(narrow).count() == 0 and narrow.count() == joined.count()


def test_evaluation_display(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          ('a', 'Pending', 'APPROVE', '7.9', CAST(1234.5 AS DECIMAL(18,2)), 'pays $5'),
          ('b', 'Submitted', NULL, 'high', NULL, NULL)
        AS t(claim_id, status, decision, risk_score, recommended_payout, reasoning)""")
    assert sorted(tuple(r) for r in decisions.evaluation_display(df).collect()) == [
        ("a", "APPROVE", "Claim status updated: Pending → Approved", "7/10 — High Risk", "$1,234", "pays \\$5"),
        ("b", "UNKNOWN", "Claim status updated: Submitted → Under Review", None, "$0", "No reasoning provided"),
    ]


def test_random_wrappings_of_an_object(spark):
    """An object is read out of any prose without braces around it, fenced or not; without an object nothing is."""
    rnd = random.Random(5)
    prose = ["[", "]", '"decision"', ":", ",", "7", " ", "\n", "json", "'", "null", "//c", "-", "text", "NaN", "01", "```"]
    objects = {
        '{"decision": "DENY"}': "DENY", '{"decision": "APPROVE", "reasoning": "x {y}"}': "APPROVE", '{"decision": null}': "UNKNOWN",
        '{"a": {"b": [1, 2]}}': "UNKNOWN", '{"decision": "A\\"B"}': 'A"B',
    }
    texts, want = [], []
    for _ in range(3000):
        before, after = ("".join(rnd.choices(prose, k=rnd.randint(0, 5))) for _ in range(2))
        body = rnd.choice(list(objects))
        kind = rnd.randrange(5)
        if kind == 0:
            texts.append(f"{before} so {body} and {after}")
            want.append(objects[body])
        elif kind == 1:
            texts.append(f"  ```json\n{body}\n```\n")
            want.append(objects[body])
        elif kind == 2:
            texts.append(f"said {before}{after}")
            want.append("ERROR")
        elif kind == 3:
            texts.append(f"said {body} or {body}")
            want.append("ERROR")
        else:
            texts.append(f"said {body[:-1]} {after}")
            want.append("ERROR" if body.count("}") == 1 else None)
    df = spark.createDataFrame(list(enumerate(texts)), "claim_id bigint, response string")
    got = {r.claim_id: r.decision for r in decisions.parse_decisions(df, on_error="ERROR").collect()}
    for i, text in enumerate(texts):
        assert want[i] is None or got[i] == want[i], (text, got[i])


def test_the_whole_accepted_object_is_stored(spark):
    text = '{"decision": "DENY", "risk_score": 7, "recommended_payout": 10.5, "flags": ["a"], "reasoning": "r"}'
    claims = spark.createDataFrame([("C1", "Pending", None, None), ("C2", "Pending", None, None)],
                                   "claim_id string, status string, ai_decision string, ai_reasoning string")
    said = spark.createDataFrame([("C1", f"Well: {text} .", None), ("C2", "no idea", None)],
                                 "claim_id string, response string, decided_at timestamp_ntz")
    done = decisions.apply_decisions(claims, decisions.parse_decisions(said))
    rows = {r.claim_id: r for r in done.collect()}
    assert rows["C1"].ai_reasoning == text and rows["C1"].status == "Denied"
    assert rows["C2"].ai_decision == "REFER" and '"reasoning":"no idea"' in rows["C2"].ai_reasoning
    read = {r.claim_id: r for r in decisions.previous_evaluation(done).collect()}
    assert (read["C1"].risk_score, read["C1"].recommended_payout, read["C1"].reasoning) == ("7", "10.5", "r")
