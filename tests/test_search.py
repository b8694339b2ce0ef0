"""Search against brute force on small fixtures."""

import json
import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from claimflow.operators import search

TEXTS = {
    1: "Typhoon damage to the home. Home, sweet home!",
    2: "auto auto auto deductible",
    3: "AUTO deductible; the deductible",
    4: "",
    5: None,
    6: "1234 éà !!",
    7: "auto auto auto deductible",
    8: "the the the the",
}
QUESTIONS = [(10, "Home typhoon?"), (11, "the auto deductible deductible"), (12, "unheard-of words"), (13, "!!")]


def counts(text):
    letters = "".join(c if "a" <= c <= "z" else " " for c in (text or "").lower())
    return Counter(letters.split())


def brute_force(question):
    docs = {i: counts(t) for i, t in TEXTS.items()}
    frequency = Counter(t for c in docs.values() for t in c)
    asked = {t: (1 + math.log(n)) * math.log(1 + len(docs) / frequency[t]) for t, n in counts(question).items() if t in frequency}
    own = math.sqrt(sum(w * w for w in asked.values()))
    out = []
    for i, c in docs.items():
        norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in c.values()))
        dot = sum(w * (1 + math.log(c[t])) for t, w in asked.items() if t in c)
        score = round(dot / own / norm, 6) if own and norm else 0.0
        if score > 0:
            out.append((-score, i))
    return [(i, -s) for s, i in sorted(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kind") for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, doc_type string").repartition(3)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_text_hits(docs, k):
    hits = search.search_text(docs, QUESTIONS, k).orderBy("query_id", "rank").collect()
    for query_id, text in QUESTIONS:
        got = [(h.doc_id, h.score) for h in hits if h.query_id == query_id]
        assert got == [(i, pytest.approx(s, abs=1e-6)) for i, s in brute_force(text)[:k]]


def test_long_question_lists_go_in_blocks(docs, monkeypatch):
    whole = search.search_text(docs, QUESTIONS, 3)
    expected = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(search, "BLOCK", 1)
    # Corpus figures do not depend on the block, so neither do the scores.
    assert sorted(map(tuple, search.search_text(docs, QUESTIONS[:3], 3).collect())) == expected
    with pytest.raises(ValueError):
        search.search_text(docs, [])


def test_best_question_keeps_every_document(docs):
    rows = {r.doc_id: r for r in search.best_question(docs, QUESTIONS).collect()}
    assert set(rows) == set(TEXTS)
    assert rows[1].query_id == 10 and rows[2].query_id == 11 and rows[8].query_id == 11
    assert rows[4].score == 0 and rows[5].score == 0


def test_vector_hits(spark):
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=6).tolist() for i in range(200)}
    vectors[50] = vectors[3]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0] * 5), (903, [float("nan")] + [1.0] * 5), (904, [])]
    df = spark.createDataFrame([*vectors.items(), *odd], "doc_id bigint, embedding array<float>").repartition(5)
    probes = [(0, vectors[3]), (1, rng.normal(size=6).tolist())]
    hits = search.search_vectors(df, probes, 7).orderBy("query_id", "rank").collect()
    for query_id, probe in probes:
        def cosine(v):
            a, b = np.array(v, np.float32).astype(float), np.array(probe)
            return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)

        ranked = sorted((-cosine(v), i) for i, v in vectors.items())[:7]
        got = [(h.doc_id, h.score, h.rank) for h in hits if h.query_id == query_id]
        assert got == [(i, pytest.approx(-s, abs=2e-6), n + 1) for n, (s, i) in enumerate(ranked)]
    assert [h.doc_id for h in hits if h.query_id == 0][:2] == [3, 50]


def test_context_is_in_rank_order(spark):
    hits = spark.createDataFrame(
        [(1, r, 100 + r, "Home", f"text {r}", 0.5) for r in (10, 2, 1)],
        "query_id bigint, rank int, doc_id bigint, doc_type string, text string, score double",
    )
    row = search.assemble_context(hits).collect()[0]
    assert row.context.split("\n\n") == [f"[Document {100 + r} — Home]\ntext {r}" for r in (1, 2, 10)]
    gate = {g.query_id: (g.best_score, g.passed) for g in search.search_quality_gate(hits, [1, 2]).collect()}
    assert gate == {1: (0.5, True), 2: (0.0, False)}


def test_context_keeps_every_hit(spark):
    hits = spark.createDataFrame(
        [(1, 1, 5, None, "text", 0.5), (1, 2, 6, "Home", None, 0.4)],
        "query_id bigint, rank int, doc_id bigint, doc_type string, text string, score double",
    )
    row = search.assemble_context(hits).collect()[0]
    assert (row.context, row.documents) == ("[Document 5 — Unknown]\ntext\n\n[Document 6 — Home]\n", 2)
    assert all(r.heading for r in search.hit_display(hits).collect())


def test_near_ties_rank_unrounded(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0005]), (2, [1.0, 0.0])], "doc_id bigint, embedding array<double>")
    assert [h.doc_id for h in search.search_vectors(df, [(0, [1.0, 0.0])], 1).collect()] == [2]


def test_many_questions_in_two_scans(docs):
    many = [(i, f"{w} home auto") for i, w in enumerate(["the", "damage", "typhoon", "deductible"] * 50)]
    whole = search.search_text(docs, many, 2)
    parts = [r for i in range(0, 200, 50) for r in search.search_text(docs, many[i : i + 50], 2).collect()]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts))
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + whole._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 2


def test_text_ids(spark):
    rows = [(f"POL-{i}", t, "kind") for i, t in TEXTS.items()]
    named = spark.createDataFrame(rows, "doc_id string, text string, doc_type string")
    hits = search.search_text(named, QUESTIONS, 3).orderBy("query_id", "rank").collect()
    assert [h.doc_id for h in hits if h.query_id == 11] == [f"POL-{i}" for i, _ in brute_force(QUESTIONS[1][1])[:3]]


def test_responses_fill_what_is_missing(spark):
    full = {"POLICY_NUMBER": "P1", "POLICY_TYPE": "Home", "SEARCH_TEXT": "t", "@scores": {"cosine_similarity": 0.7}}
    rows = [(1, json.dumps({"results": [full, {}]})), (2, json.dumps({"results": []})), (3, "{}"), (4, "not json"), (5, None)]
    got = search.read_search_response(spark.createDataFrame(rows, "query_id bigint, response string"))
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == [
        (1, 1, "P1", "Home", "t", 0.7), (1, 2, "Unknown", "Unknown", "", 0.0),
    ]


def test_task_code_needs_no_package_on_the_executors(tmp_path):
    (tmp_path / "code").write_bytes(cloudpickle.dumps((search._TextScorer, search._Best, search.terms_of)))
    check = "import pickle; s, b, t = pickle.load(open('code', 'rb')); print(t('a B a')['a'], b([1], 2).k, s([(0, 'x')], ['x']).own[0][1])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert out.stdout.split() == ["2", "2", "[1.]"], out.stderr
