"""Search over stored clusters against the scan of all vectors, and how much of them is read."""

import numpy as np
import pytest

from claimflow.operators import clusters, search


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Vectors around twenty directions, copies, vectors without a cosine, and a few of another length."""
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(20, 16))
    rows = [(i, (middles[i % 20] + 0.15 * rng.normal(size=16)).tolist()) for i in range(2000)]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, 2.0]), (3004, [None] * 16), (3005, [])]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(4)
    root = str(tmp_path_factory.mktemp("clusters") / "c")
    clusters.write_clusters(docs, root)
    return docs, root, middles


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 12)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 60])
def test_same_as_the_scan(spark, stored, k):
    docs, root, middles = stored
    questions = [(0, middles[3].tolist()), (1, (middles[4] + middles[5]).tolist()), (2, np.ones(16).tolist())]
    assert rows(clusters.search_clusters(spark, root, questions, k)) == rows(search.search_vectors(docs, questions, k))


def test_few_clusters_are_read(spark, stored):
    _, root, middles = stored
    first, rest = clusters.clusters_to_read(spark, root, [(0, middles[3].tolist())], 5)
    all_of_them = spark.read.parquet(f"{root}/clusters").count()
    assert all_of_them > 40 and len(first) + len(rest) < all_of_them / 2
    plan = clusters.search_clusters(spark, root, [(0, middles[3].tolist())], 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan or "PartitionFilters: [cluster" in plan


def test_other_lengths_and_nothing(spark, stored, tmp_path):
    docs, root, _ = stored
    assert [r[1:3] for r in rows(clusters.search_clusters(spark, root, [(0, [1.0, 2.0])], 3))] == [(1, 3003)]
    clusters.write_clusters(docs.limit(0), str(tmp_path / "none"))
    assert clusters.search_clusters(spark, str(tmp_path / "none"), [(0, [1.0])]).count() == 0
