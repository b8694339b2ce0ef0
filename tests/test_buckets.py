"""Write-back into touched buckets alone, compaction of the log, notes as a stream."""

import json
import os

import pytest

from claimflow.operators import decisions, kpis
from claimflow.plans import bindings
from claimflow.sources import buckets
from claimflow.streaming import jobs
from test_streaming import put


def files(root):
    out = {}
    for folder, _, names in os.walk(f"{root}/rows"):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(folder, name)
                out.setdefault(os.path.basename(folder), set()).add((name, os.stat(path).st_mtime_ns))
    return out


def made(spark, *rows):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"('{i}', TIMESTAMP_NTZ '{day} 00:00:00', '{d}', '5', CAST(0 AS DECIMAL(18,2)), 'r')" for i, day, d in rows
    ) + " AS t(claim_id, decided_at, decision, risk_score, recommended_payout, reasoning)")


@pytest.fixture
def table(spark, sf_dir, tmp_path):
    root = str(tmp_path / "claims")
    claims = bindings.claims(spark, sf_dir)
    buckets.create(claims, root, buckets=16)
    return claims, root


def test_one_decision_replaces_one_bucket(spark, table):
    claims, root = table
    one = claims.select("claim_id").first()[0]
    before = files(root)
    assert len(before) == 16
    touched = buckets.apply(spark, root, made(spark, (one, "2025-01-02", "DENY")))
    after = files(root)
    assert len(touched) == 1 and set(after) == set(before)
    changed = [b for b in before if before[b] != after[b]]
    assert changed == [f"bucket={touched[0]}"]
    want = decisions.apply_decisions(claims, made(spark, (one, "2025-01-02", "DENY")))
    got = buckets.read(spark, root)
    assert sorted(got.columns) == sorted(want.columns)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    assert [r.status for r in buckets.by_id(spark, root, one).collect()] == ["Denied"]


def test_order_and_repeats_change_nothing(spark, table):
    claims, root = table
    a, b, c = (r[0] for r in claims.select("claim_id").limit(3).collect())
    new, old = made(spark, (a, "2025-01-02", "APPROVE"), (b, "2025-01-02", "DENY")), made(spark, (a, "2025-01-01", "DENY"), (c, "2025-01-01", "REFER"))
    for batch in (new, old, new, old):
        buckets.apply(spark, root, batch)
    got = {r.claim_id: r.ai_decision for r in buckets.read(spark, root).filter("ai_decision IS NOT NULL").collect()}
    assert got == {a: "APPROVE", b: "DENY", c: "REFER"}
    assert buckets.apply(spark, root, made(spark, ("none such", "2025-01-02", "DENY")).limit(0)) == []


def test_compaction_after_a_failed_commit(spark, table, tmp_path, monkeypatch):
    claims, root = table
    folder, log, read, applied = (str(tmp_path / n) for n in ("in", "log", "read", "applied"))
    a, b = (r[0] for r in claims.select("claim_id").limit(2).collect())
    say = lambda i, day, d: {"claim_id": i, "decided_at": f"2025-01-0{day}T00:00:00.000", "response": json.dumps({"decision": d})}
    put(folder, "one.json", say(a, 2, "APPROVE"), '{"claim_id": "x", ')
    jobs.log_decisions(spark, folder, log, read)
    real = jobs.buckets.apply

    def fails_after_writing(*args):
        real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs.buckets, "apply", fails_after_writing)
    with pytest.raises(Exception, match="lost"):
        jobs.compact_decisions(spark, log, root, applied)
    monkeypatch.setattr(jobs.buckets, "apply", real)
    jobs.compact_decisions(spark, log, root, applied)
    assert jobs.applied_batch(spark, root, applied) == 0
    put(folder, "two.json", say(a, 1, "DENY"), say(b, 1, "DENY"))
    whole = jobs.log_decisions(spark, folder, log, read)
    seen = []
    monkeypatch.setattr(jobs.buckets, "apply", lambda s, r, rows: (seen.append(rows.count()), real(s, r, rows)))
    jobs.compact_decisions(spark, log, root, applied)
    jobs.compact_decisions(spark, log, root, applied)
    assert seen == [2] and jobs.applied_batch(spark, root, applied) == 1
    counts = lambda df: {r.status: r.cnt for r in df.collect()}
    assert counts(kpis.count_by(buckets.read(spark, root), "status")) == counts(jobs.stream_status_counts(claims, whole))


NOTE = "FIELD INSPECTION REPORT\nClaim Number: {}\nDate of Report: 2025-01-02\nAdjuster: Kim (License #1)\n\nFINDINGS:\nPay.\n"


def test_notes_arrive_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "notes", "check"))

    def run(**more):
        return jobs.ingest_notes(spark, folder, out, check, **more)

    put(folder, "one.txt", NOTE.format("CLM-1"))
    put(folder, "two.txt", "no claim here")
    assert run().count() == 2 and run().count() == 2
    put(folder, "late.txt", NOTE.format("CLM-2"))
    table = run()
    assert {(r.claim_id, r.adjuster_name, r.recommendation) for r in jobs.noted(table).collect()} == {("CLM-1", "Kim", "Pay."), ("CLM-2", "Kim", "Pay.")}
    assert [tuple(r) for r in jobs.malformed_notes(table).collect()] == [("two.txt", "no claim here")]


def test_many_notes_in_a_file(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "all.txt", NOTE.format("CLM-1") + NOTE.format("CLM-2").replace("\n", "\r\n"))
    table = jobs.ingest_notes(spark, folder, f"{tmp_path}/o", f"{tmp_path}/c", opening="FIELD INSPECTION REPORT")
    assert sorted(r.claim_id for r in jobs.noted(table).collect()) == ["CLM-1", "CLM-2"]
