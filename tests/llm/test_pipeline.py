"""The pipeline: every stage takes the documents' columns, and its decisions take effect."""

import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from claimflow.llm.text import table


@pytest.fixture(scope="module")
def sf_dir(sf_dir):
    """The smallest table holds too few toxic labels to learn from."""
    return os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stages(steps, sf_dir, spark):
    for before, after in steps[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    before, after = (x.join(toxic, "doc_id").count() for x in steps[1])
    assert after < 0.5 * before
    clean = table(spark, sf_dir, "labels").filter("toxic = 0")
    before, after = (x.join(clean, "doc_id").count() for x in steps[1])
    assert after >= 0.97 * before
    before, after = steps[3]
    assert before.count() == after.count()
    mails = F.expr(r"regexp_count(text, '[a-z]+[.][0-9]+@mail[0-9][.]example[.]com')")
    assert before.agg(F.sum(mails)).first()[0] > 0 and after.agg(F.sum(mails)).first()[0] == 0
    before, after = steps[4]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run_is_the_stages(steps, spark, sf_dir):
    columns = ["doc_id", "piece", "start", "length", "ids"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*columns).collect())) == sorted(map(tuple, steps[-1][1].select(*columns).collect()))
