"""Exact vector search over stored clusters, of which only those that can hold a hit are read.

A cluster is the vectors nearest to one centre by angle, in a folder of its own; beside them stands the
widest angle between a vector and its centre. By the triangle inequality of angles no vector of a cluster is
nearer to a question than the question's angle to the centre less that width. The centres are a
number of stored vectors that grows with the square root of all, so they fit every task.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.operators.search import ranked_hits, search_vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Clusters that a question looks into before its k-th cosine is known.
FIRST_CLUSTERS = 2
# Angles are told apart no further than this, so that no rounding drops a hit.
SLACK = 1e-7


def _units(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True), rows


def _usable(docs: DataFrame) -> DataFrame:
    """Vectors that have a cosine: no component missing or infinite, not all zero."""
    x = F.col("embedding").cast("array<double>")
    rows = docs.select("doc_id", x.alias("embedding")).filter("embedding IS NOT NULL AND size(embedding) > 0")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.filter(finite & F.exists("embedding", lambda v: v != 0))


def write_clusters(docs: DataFrame, root: str, per_root: float = 2.0) -> None:
    """Store the vectors of `docs` (doc_id, of any type; embedding) by cluster below `root`.

    Of each width per_root * sqrt(n) vectors, those smallest by hash, are the centres. Each task
    puts its vectors to the nearest of their width; a centre's vectors are split over files by size.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = _usable(docs)
    sizes = {r["width"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("width")).count().collect()}
    centres: dict[int, np.ndarray] = {}
    for width, n in sizes.items():
        own = rows.filter(F.size("embedding") == width).select("embedding").distinct()
        chosen = own.orderBy(F.xxhash64("embedding"), "embedding").limit(int(np.ceil(per_root * np.sqrt(n))))
        held = np.array([r[0] for r in chosen.collect()])
        centres[width] = held / np.linalg.norm(held, axis=1, keepdims=True)
    numbers = np.cumsum([0, *(len(c) for c in centres.values())])
    first = dict(zip(centres, numbers))

    def dealt(batches):
        for batch in batches:
            column = batch.column("embedding")
            widths = np.asarray(pc.list_value_length(column))
            for width in np.unique(widths):
                at = pa.array(np.flatnonzero(widths == width))
                units, _ = _units(column.take(at))
                cosines = units @ centres[int(width)].T
                nearest = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(nearest)), nearest], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), column.take(at), pa.array(angle), pa.array((nearest + first[int(width)]).astype(np.int32))],
                    ["doc_id", "embedding", "angle", "cluster"],
                )

    put = rows.mapInArrow(dealt, f"doc_id {kind}, embedding array<double>, angle double, cluster int")
    put.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{root}/vectors")
    listed = [(int(first[w]) + i, c.tolist()) for w, held in centres.items() for i, c in enumerate(held)]
    of = spark.createDataFrame(listed, "cluster int, centre array<double>")
    vectors = spark.read.schema(f"doc_id {kind}, embedding array<double>, angle double, cluster int").parquet(f"{root}/vectors")
    widest = vectors.groupBy("cluster").agg(F.max("angle").alias("width"), F.count("*").alias("n"))
    of.join(widest, "cluster").withColumn("kind", F.lit(kind)).coalesce(1).write.parquet(f"{root}/clusters")


def _bounds(held: list, questions: list[tuple[int, list[float]]]) -> np.ndarray:
    """The largest cosine that a vector of each cluster can have with each question; -2 where the lengths differ."""
    out = np.full((len(questions), len(held)), -2.0)
    for j, cluster in enumerate(held):
        centre = np.array(cluster["centre"])
        for i, (_, vector) in enumerate(questions):
            if len(vector) == len(centre):
                angle = np.arccos(np.clip(centre @ np.array(vector) / np.linalg.norm(vector), -1, 1))
                out[i, j] = np.cos(max(angle - cluster["width"] - SLACK, 0.0))
    return out


def clusters_to_read(spark: SparkSession, root: str, questions: list[tuple[int, list[float]]], k: int) -> tuple[list[int], list[int]]:
    """The clusters looked into at first and then, for all the questions together."""
    held = sorted(spark.read.parquet(f"{root}/clusters").collect(), key=lambda r: r["cluster"])
    if not held:
        return [], []
    bounds = _bounds(held, questions)
    order = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_CLUSTERS]
    first = np.unique(order[np.take_along_axis(bounds, order, axis=1) > -2])
    hits = search_vectors(_read(spark, root, held, [held[j]["cluster"] for j in first]), questions, k)
    kth = {r["query_id"]: r["score"] for r in hits.filter(F.col("rank") == k).collect()}
    least = np.array([kth.get(q, -1.0) for q, _ in questions])
    rest = np.flatnonzero((bounds >= least[:, None] - SLACK).any(axis=0))
    return [held[j]["cluster"] for j in first], [held[j]["cluster"] for j in np.setdiff1d(rest, first)]


def _read(spark: SparkSession, root: str, held: list, clusters: list[int]) -> DataFrame:
    schema = f"doc_id {held[0]['kind']}, embedding array<double>, angle double, cluster int"
    return spark.read.schema(schema).parquet(f"{root}/vectors").filter(F.col("cluster").isin(clusters)).select("doc_id", "embedding")


def search_clusters(spark: SparkSession, root: str, questions: list[tuple[int, list[float]]], k: int = vocab.SEARCH_HITS) -> DataFrame:
    """The k nearest stored vectors per question by cosine, exactly: query_id, doc_id, score, rank.

    The questions are a list that the caller holds. After the nearest clusters the k-th cosine of each is
    known, and only folders whose bound reaches one of them are opened, in a second pass.
    """
    first, rest = clusters_to_read(spark, root, questions, k)
    held = spark.read.parquet(f"{root}/clusters").limit(1).collect()
    if not held:
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int")
    found = [search_vectors(_read(spark, root, held, c), questions, k).drop("rank") for c in (first, rest) if c]
    return ranked_hits(found[0] if len(found) == 1 else found[0].unionByName(found[1]), k)
