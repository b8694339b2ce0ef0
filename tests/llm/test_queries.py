"""Every registered operator query: its columns and types, its rows, and what they must agree with."""

import os
import zlib

import pytest

from claimflow.llm.registry import QUERIES
from claimflow.llm.text import table

# The leading columns of each result.
COLUMNS = {
    "op1": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3": "doc_id bigint, text string, found int",
    "op4": "query_id bigint, rank int, vec_id bigint, distance int",
    "op5": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6": "doc_id bigint",
    "op7": "query_id bigint, rank int, vec_id bigint, score double",
    "op8": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op11": (
        "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    ),
    "op12": "page_id bigint, url string, text string, n_chars bigint",
    "op13": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
}
SOURCE = {"op4": None, "op7": None, "op10": None, "op11": None, "op12": "pages", "op13": "embeddings"}


@pytest.fixture(scope="module")
def sf_dir(sf_dir):
    return os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(name, spark, sf_dir):
    op = name.split("_")[0]
    found = QUERIES[name](spark, sf_dir)
    want = [tuple(c.split()) for c in COLUMNS[op].split(", ")]
    types = dict(found.dtypes)
    assert [c for c, _ in want] == [c for c in found.columns if c in dict(want)]
    assert {c: types[c] for c, _ in want} == dict(want)
    rows = found.collect()
    source = SOURCE.get(op, "documents")
    if source:
        assert len(rows) == table(spark, sf_dir, source).count()
    if "held_out" in types:
        parts = 10 if op == "op8" else 5
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == 0) for r in rows)
    if op in ("op1", "op2", "op9"):
        assert all(0 <= r["score"] <= 1 for r in rows)
    if op in ("op2", "op9"):
        mark = 0.3 if op == "op2" else 0.5
        assert all(r["predicted"] == (r["score"] >= mark) for r in rows)
    if op in ("op4", "op7"):
        queries = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").count()
        assert len(rows) == 20 * queries and all(r["query_id"] % 20 == 0 != r["query_id"] - r["vec_id"] for r in rows)


def test_languages_and_toxicity_of_held_out_rows(spark, sf_dir):
    """Accuracy on rows that nothing was learned from."""
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    found = [r for r in QUERIES["op1_language_id"](spark, sf_dir).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.98 * len(found)
    labels = {r["doc_id"]: r for r in table(spark, sf_dir, "labels").collect()}
    for name, label, least in (("op2_quality", "quality", 0.9), ("op9_toxicity", "toxic", 0.9)):
        held = [r for r in QUERIES[name](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels and labels[r["doc_id"]][label] is not None]
        assert sum(r["predicted"] == labels[r["doc_id"]][label] for r in held) >= least * len(held)
