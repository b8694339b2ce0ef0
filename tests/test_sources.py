"""Whole-text reading, snapshots, CSV export, note extraction, scratch space."""

import os
import pytest
from pyspark.sql import functions as F

from claimflow import schemas
from claimflow.operators import notes
from claimflow.plans import bindings
from claimflow.session import discard, scratch
from claimflow.sources import tables, texts

NOTE_A = """FIELD INSPECTION REPORT
Date of Inspection: March 5, 2025
Claim Number: CLM-901
Field Adjuster: Ana Perez (License #X1)

OBSERVED DAMAGES:
- roof
- wall

COST BREAKDOWN:
1. Parts: USD 1,200.25
   - Bolts: USD 200
2. Work: USD 300

Total Claim Amount: USD 1,500.25
Less Deductible: USD 100

RECOMMENDATIONS:
Pay it.
"""
NOTE_B = """FIELD INSPECTION REPORT
Claim Number: CLM-902
Date of Report: 2025-04-01
Adjuster: Bo Li-Ng (#Y2)

TREATMENT PLAN COSTS:
Tests: SGD 10
Ward (2 days): SGD 20
Total: SGD 31 (USD 23.40)

FINDINGS:
Approve after deductible.

Additional Notes:
none"""
NOTE_C = "nothing of use here"


@pytest.fixture()
def folder(tmp_path):
    for name, text in {"a.txt": NOTE_A, "b.txt": NOTE_B, "c.txt": NOTE_C}.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_one_row_per_file(spark, folder):
    rows = {r.file_name: r.text for r in texts.read_notes(spark, folder).collect()}
    assert rows == {"a.txt": NOTE_A, "b.txt": NOTE_B, "c.txt": NOTE_C}


def test_extraction(spark, folder):
    df = notes.dataset_notes(notes.extract_notes(texts.read_notes(spark, folder)))
    assert df.columns == schemas.names(schemas.NOTES) and dict(df.dtypes)["estimated_amount"] == "decimal(18,2)"
    rows = {r.file_name: r for r in df.collect()}
    a, b, c = (rows[n] for n in ("a.txt", "b.txt", "c.txt"))
    assert (a.claim_id, a.adjuster_name, a.inspection_date) == ("CLM-901", "Ana Perez", "2025-03-05")
    assert (float(a.estimated_amount), a.damage_assessment, a.recommendation) == (1500.25, "- roof\n- wall", "Pay it.")
    assert (b.claim_id, b.adjuster_name, b.inspection_date) == ("CLM-902", "Bo Li-Ng", "2025-04-01")
    assert (float(b.estimated_amount), b.damage_assessment) == (23.40, None)
    assert b.recommendation == "Approve after deductible."
    assert set(tuple(c)[1:]) == {None}


def test_windows_line_ends_change_nothing(spark, folder):
    plain = texts.read_notes(spark, folder)
    windows = plain.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    for operator in (notes.extract_notes, notes.itemized_totals):
        assert sorted(map(tuple, operator(windows).collect())) == sorted(map(tuple, operator(plain).collect()))


def test_itemized_totals(spark, folder):
    rows = {r.file_name: r for r in notes.itemized_totals(texts.read_notes(spark, folder)).collect()}
    assert [float(x) for x in tuple(rows["a.txt"])[1:]] == [1500.25, 1500.25]
    assert [float(x) for x in tuple(rows["b.txt"])[1:]] == [31, 30]
    assert tuple(rows["c.txt"])[1:] == (None, None)


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [(1, 'say "hi", now', 5.0), (2, "two\nlines", 6.0), (3, None, 7.0), (4, "left out", 1.0)]
    df = spark.createDataFrame(rows, "id int, text string, amount double")
    tables.export_csv(df, "amount > 4", str(tmp_path / "csv"))
    back = tables.read_csv(spark, df.schema, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == rows[:3]


def test_datasets_answer_sql(spark, sf_dir):
    claims = bindings.claims(spark, sf_dir, with_risk=True)
    tables.register_views({"claims_report": tables.dataset_claims(claims)})
    assert spark.table("claims_report").columns == [c for c in schemas.names(schemas.CLAIMS) if c != "description"]
    total = spark.sql("SELECT count(*) AS n FROM claims_report WHERE status = :s", args={"s": "Pending"}).collect()[0].n
    assert total == claims.filter("status = 'Pending'").count()


def test_snapshot_is_a_new_version(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS part")
    back = tables.write_snapshot(df, str(tmp_path / "v1"), ["part"])
    assert sorted(map(tuple, back.select("id", "part").collect())) == sorted(map(tuple, df.collect()))


def test_scratch_follows_the_cluster_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch(spark, "x"), scratch(spark, "x")
    assert first != second and first.startswith(f"{base}/x-")


def test_versions_are_committed_one_after_the_other(spark, tmp_path):
    root = str(tmp_path / "table")
    first = tables.write_version(spark.range(3).selectExpr("id", "0 AS v"), root, first=True)
    old = tables.read_version(spark, root, first.schema)
    tables.write_version(old.selectExpr("id", "v + 1 AS v"), root)
    assert {r.v for r in tables.read_version(spark, root, first.schema).collect()} == {1}
    assert {r.v for r in first.collect()} == {0}
    # A folder that no record names is never read, and a table starts once.
    spark.range(9).selectExpr("id", "5 AS v").write.parquet(f"{root}/v9-unfinished")
    assert tables.read_version(spark, root, first.schema).count() == 3
    with pytest.raises(Exception):
        tables.write_version(first, root, first=True)


def test_only_scratch_is_discarded(spark, tmp_path):
    own, other = scratch(spark, "gone"), str(tmp_path / "kept")
    for path in (own, other):
        spark.range(3).write.parquet(path)
        discard(spark, path)
    assert not os.path.exists(own) and os.path.exists(other)
