"""Note files of the registered stream: as many as the notes need, none of them long."""

import glob

from claimflow.plans import registry
from claimflow.streaming import jobs


def test_note_files_grow_in_number(spark, sf_dir, tmp_path, monkeypatch):
    seen = []

    def ingest(session, folder, *args, **kwargs):
        seen.append(folder)
        return ingest_notes(session, folder, *args, **kwargs)

    ingest_notes = jobs.ingest_notes
    monkeypatch.setattr(registry.jobs, "ingest_notes", ingest)
    monkeypatch.setattr(registry, "KEYS_PER_FILE", 200)
    rows = registry.QUERIES["ingest_notes_stream"](spark, sf_dir)
    notes = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert rows.count() == notes and rows.select("claim_id").distinct().count() == notes
    files = glob.glob(f"{seen[0]}/*.txt")
    assert len(files) >= notes / 200
    assert max(open(f).read().count("FIELD INSPECTION REPORT") for f in files) <= 200
