"""What the index and a table of questions move through shuffles stays in proportion to the texts."""

import random

from pyspark.sql import functions as F

from claimflow.operators import postings, search


def corpus(n: int) -> list[tuple[int, str]]:
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(400)]
    return [(i, " ".join(rnd.choices(words, [1 / (1 + j) for j in range(400)], k=rnd.randint(40, 400)))) for i in range(n)]


def test_bytes_moved_follow_the_texts(spark, tmp_path):
    rows = corpus(4_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    asked = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 120).alias("question")).cache()
    assert docs.count() == 4_000 and asked.count() == 400
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, root = written(), f"{tmp_path}/i"
    postings.write_index(docs, root)
    hits = postings.search_index(spark, root, asked, k=3).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    moved = written() - before
    assert len(hits) == 1_200
    assert moved < 4 * sum(len(t) for _, t in rows)


def test_counts_and_gaps_of_any_size_come_back(spark, tmp_path):
    rows = [(i, "glass") for i in range(70_000)] + [(70_000, "hail " * 70_000 + "glass"), (70_001, "hail " * 300), (5, "glass")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    postings.write_index(docs, f"{tmp_path}/i", part_documents=100_000)
    questions = [(0, "hail"), (1, "hail glass")]
    found = postings.search_index(spark, f"{tmp_path}/i", spark.createDataFrame(questions, "query_id long, question string"), k=6)
    shown = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    scanned = [r for r in shown(search.search_text(docs.dropDuplicates(["doc_id"]), questions, k=6))]
    assert [r[:3] for r in shown(found)] == [r[:3] for r in scanned]
    assert shown(found)[:2] == scanned[:2]
