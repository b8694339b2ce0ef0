"""What the toxicity fit brings to the driver."""

from pyspark.sql import functions as F

from claimflow.llm import toxicity


def test_units_of_a_word_reach_the_driver_once(spark):
    n, k = 40, 400
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ")
    sample = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"), words.alias("text"))
    label, group, doc, word, count, hashed = toxicity._unit_counts(sample)
    assert hashed.shape == (k, len(toxicity.STEMS) + 1)  # not one row for each word of each document
    assert len(doc) == len(word) == len(count) == n * k and (count == 1).all()
    assert label.tolist() == [0, 1] * (n // 2) and len(set(group.tolist())) == 1
    # The words of every document are those of the text.
    own = toxicity._tokens(sample.select("text").limit(1).toArrow().column("text").combine_chunks())[2][:, -1]
    assert set(hashed[word[doc == 7], -1].tolist()) == set(own.tolist())


def test_a_sample_without_words(spark):
    sample = spark.createDataFrame([(1, 0, ""), (2, 1, " ")], "doc_id bigint, label bigint, text string")
    label, _, doc, word, count, hashed = toxicity._unit_counts(sample)
    assert label.tolist() == [0, 1] and not len(doc) and not len(word) and not len(count) and not len(hashed)
    none = toxicity._unit_counts(sample.filter("doc_id = 9"))
    assert [len(x) for x in none] == [0] * 6
