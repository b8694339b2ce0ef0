"""File-arrival streams: each file once, a restart adds nothing."""

import json
import os

from claimflow import schemas
from claimflow.operators import kpis
from claimflow.plans import bindings
from claimflow.streaming import jobs


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))


def claim(i, **more):
    return {"claim_id": f"CLM-{i}", "policy_number": "P", "claim_type": "Fire", "status": "Pending",
            "filing_date": "2025-01-01T10:00:00.000", "claim_amount": 12.5, **more}


def test_ingest(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "raw", "check"))

    def run():
        return jobs.ingest_claims(spark, folder, out, check, files_per_batch=1)

    put(folder, "one.json", claim(1))
    put(folder, "two.json", claim(2), claim(3, extra="ignored"))
    assert run().count() == 3
    assert run().count() == 3
    put(folder, "three.json", claim(4), '{"claim_id": "CLM-5", ')
    table = run()
    good = {r.claim_id: r for r in jobs.raw_claims(table).collect()}
    assert set(good) == {"CLM-1", "CLM-2", "CLM-3", "CLM-4"}
    assert float(good["CLM-1"].claim_amount) == 12.5 and good["CLM-1"].filing_date.hour == 10
    assert jobs.raw_claims(table).columns == schemas.names(schemas.RAW_CLAIMS)
    bad = jobs.malformed_claims(table).collect()
    assert len(bad) == 1 and bad[0].source_file == "three.json"


def test_one_claim_over_many_lines(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "raw", "check"))
    put(folder, "one.json", json.dumps(claim(1), indent=2))
    put(folder, "two.json", "{ not json")
    table = jobs.ingest_claims(spark, folder, out, check, whole_files=True)
    assert [r.claim_id for r in jobs.raw_claims(table).collect()] == ["CLM-1"]
    assert [r.source_file for r in jobs.malformed_claims(table).collect()] == ["two.json"]


def test_decisions_follow_the_stream(spark, sf_dir, tmp_path):
    folder, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    claims = bindings.claims(spark, sf_dir)
    before = {r.status: r.cnt for r in kpis.count_by(claims, "status").collect()}
    pending = [r.claim_id for r in claims.filter("status = 'Pending'").limit(2).collect()]

    def answer(claim_id, day, text):
        return {"claim_id": claim_id, "decided_at": f"2025-01-0{day}T00:00:00.000", "response": text}

    put(folder, "a.json", answer(pending[0], 1, '{"decision": "DENY"}'), answer("CLM-none", 1, '{"decision": "DENY"}'))
    jobs.log_decisions(spark, folder, log, check)
    put(folder, "b.json", answer(pending[0], 2, '```json\n{"decision": "APPROVE"}\n```'), answer(pending[1], 1, "??"))
    table = jobs.log_decisions(spark, folder, log, check)
    assert table.count() == 4 and jobs.log_decisions(spark, folder, log, check).count() == 4
    after = {r.status: r.cnt for r in jobs.stream_status_counts(claims, table).collect()}
    assert after["Approved"] == 1 and "Denied" not in after
    assert jobs.malformed_decisions(table).count() == 0
    assert after["Pending"] == before["Pending"] - 2
    assert after["Under Review"] == before["Under Review"] + 1
    assert jobs.current_claims(claims, table).count() == claims.count()


def test_unreadable_decision_records_are_kept_and_not_applied(spark, sf_dir, tmp_path):
    folder, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    claims = bindings.claims(spark, sf_dir)
    lines = [
        '{"claim_id": "CLM-1", "decided_at": "not a time", "response": "{\\"decision\\": \\"DENY\\"}"}',
        '{"claim_id": "CLM-1", "decided_at"',
        '{"claim_id": "CLM-1", "response": "{\\"decision\\": \\"APPROVE\\"}"}',
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    table = jobs.log_decisions(spark, folder, log, check)
    assert {r[0] for r in jobs.malformed_decisions(table).collect()} == set(lines[:2])
    good = jobs.good_decisions(table).collect()
    assert [(r.claim_id, r.decided_at, r.decision) for r in good] == [("CLM-1", None, "APPROVE")]
    done = jobs.current_claims(claims, table).filter("claim_id = 'CLM-1'").first()
    assert done.status == "Approved"
