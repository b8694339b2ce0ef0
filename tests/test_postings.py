"""Search over the stored lists against the scan of all texts; what is read, and what is skipped."""

import random

import pytest
from pyspark.sql import functions as F

from claimflow.operators import postings, search

WORDS = "storm flood roof claim paid hail water car theft fire glass wall door the of and".split()


def texts(n: int) -> list[tuple[int, str | None]]:
    """Documents of very unlike lengths; some alike, some empty."""
    rnd = random.Random(4)
    shares = [1 / (1 + k) for k in range(len(WORDS))]
    rows = [(i, " ".join(rnd.choices(WORDS, shares, k=rnd.randint(3, 12) * (1 if i % 9 else 40)))) for i in range(n)]
    rows += [(n, None), (n + 1, " 12 "), (n + 2, rows[0][1]), (n + 3, rows[0][1])]
    return rows


QUESTIONS = [(0, "hail on the roof"), (1, "the of and"), (2, "zzz"), (3, ""), (4, "Fire, fire! glass"), (5, "water " * 30 + "door")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index") / "i")
    docs = spark.createDataFrame(texts(600), "doc_id long, text string").repartition(5)
    postings.write_index(docs, root, part_documents=50)
    return docs, root


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_same_as_the_scan(spark, index):
    docs, root = index
    asked = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    want = rows(search.search_text(docs, QUESTIONS, k=7))
    assert rows(postings.search_index(spark, root, asked, k=7)) == want
    assert rows(postings.search_index(spark, root, asked, k=7, terms=postings.terms_in(QUESTIONS))) == want
    assert rows(postings.search_index(spark, root, asked.limit(0), k=7)) == []


def test_parts_below_the_kth_score_are_skipped(spark, index):
    docs, root = index
    lists = postings.read_postings(spark, root)
    asked = spark.createDataFrame([(0, "hail")], "query_id long, question string")
    weighted = postings._weighted_terms(asked, lists, docs.count())
    _, first, rest = postings.looked_into(weighted, lists, 3)
    parts = lists.select("part").distinct().count()
    assert parts > 10 and first.count() == postings.FIRST_PARTS
    assert first.count() + rest.count() < parts / 2


def test_only_the_asked_terms_are_read(spark, index):
    _, root = index
    asked = spark.createDataFrame([(0, "hail roof")], "query_id long, question string")
    plan = postings.search_index(spark, root, asked, terms=["hail", "roof"])._jdf.queryExecution().toString()
    assert "In(term, [hail,roof])" in plan and "PartitionFilters: [bucket" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "(text" not in plan.replace("(text#", "(")
    opened = postings.read_postings(spark, root, ["hail", "roof"])
    assert opened.select(F.input_file_name()).distinct().count() <= 2 and opened.select("term").distinct().count() == 2


def test_a_hot_term_is_many_rows(spark, index):
    docs, root = index
    the = postings.read_postings(spark, root, ["the"])
    assert the.agg(F.max("n")).first()[0] <= 120 and the.count() > 5
    assert the.agg(F.sum("n")).first()[0] == docs.filter("text rlike '(^| )the( |$)'").count()


def test_a_list_asked_for_often_is_salted(spark, index, monkeypatch):
    docs, root = index
    monkeypatch.setattr(postings, "SALT_ROWS", 3)
    many = [(i, QUESTIONS[i % 2][1]) for i in range(20)]
    asked = spark.createDataFrame(many, "query_id long, question string")
    assert rows(postings.search_index(spark, root, asked, k=3)) == rows(search.search_text(docs, many, k=3))


def test_the_plan_does_not_grow_with_the_questions(spark, index):
    _, root = index
    size = lambda n: len(postings.search_index(spark, root, spark.range(n).select(F.col("id").alias("query_id"), F.lit("hail").alias("question")))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(1_000_000) - size(10)) < 2_000


def test_ids_of_another_type_and_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([("b", "hail"), ("a", "hail")], "doc_id string, text string")
    postings.write_index(docs, f"{tmp_path}/s")
    asked = spark.createDataFrame([(1, "Hail?")], "query_id long, question string")
    assert [r["doc_id"] for r in postings.search_index(spark, f"{tmp_path}/s", asked).orderBy("rank").collect()] == ["a", "b"]
    postings.write_index(docs.limit(0), f"{tmp_path}/e")
    assert postings.search_index(spark, f"{tmp_path}/e", asked).count() == 0
