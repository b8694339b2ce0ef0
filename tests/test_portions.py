"""Searches take texts apart in bounded portions, whatever a batch holds."""

import pyarrow as pa
import pytest

from claimflow.operators import postings, search

ROWS = [(i, "hail on the roof " * (1 + i % 7) + "storm glass water fire " * (i % 3)) for i in range(60)] + [(60, None), (61, "")]
QUESTIONS = [(0, "hail on the roof of glass and water, fire, storm"), (1, "water")]


def test_portions_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(search, "PORTION_BYTES", 1_000)
    monkeypatch.setattr(search, "PORTION_ROWS", 5)
    texts = ["x" * 300] * 10 + ["y" * 5_000, None] + ["z"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(search.portions([batch, batch.slice(0, 0)]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 5 for p in parts)
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1_000 for p in parts)


@pytest.mark.parametrize("rows", [1, 7])
def test_results_do_not_depend_on_portions(spark, monkeypatch, rows, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    hits = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))
    best = lambda: sorted(map(tuple, search.best_question(docs, QUESTIONS).collect()))
    asked = spark.createDataFrame(QUESTIONS, "query_id long, question string")

    def indexed(name):
        postings.write_index(docs, f"{tmp_path}/{name}")
        return hits(postings.search_index(spark, f"{tmp_path}/{name}", asked, k=9))

    want, each, same = hits(search.search_text(docs, QUESTIONS, k=9)), best(), indexed("before")
    monkeypatch.setattr(search, "PORTION_ROWS", rows)
    assert hits(search.search_text(docs, QUESTIONS, k=9)) == want and best() == each
    assert indexed("after") == same
