"""A table of questions meets the lists without a row for each question and document."""

from pyspark.sql import functions as F

from claimflow.operators import postings


def test_no_row_for_a_question_and_a_document(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("hail on the roof "), F.repeat(F.lit("glass "), F.col("id").cast("int") % 9)).alias("text"))
    postings.write_index(docs, f"{tmp_path}/i", part_documents=40)
    lists = postings.read_postings(spark, f"{tmp_path}/i")
    asked = spark.range(30).select(F.col("id").alias("query_id"), F.lit("hail on the roof of glass").alias("question"))
    weighted = postings._weighted_terms(asked, lists, 400)
    pairs = postings.bounds(weighted, lists)
    found = postings._scored(pairs, weighted, lists, 3)
    assert found.count() <= 3 * pairs.count() and "explode(docs" not in found._jdf.queryExecution().toString()
    hits = postings.search_index(spark, f"{tmp_path}/i", asked, k=3)
    assert hits.count() == 90 and hits.select("doc_id", "rank").distinct().count() == 3
