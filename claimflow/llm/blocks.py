"""Queries against all rows of a table, block by block, for the searches over vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, of rows that can take part.

    Left out are rows without id and vectors that are null, empty, all zeros or hold a null or
    non-finite component.
    """
    numbers = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint"), numbers.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distinct(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, of repeated rows one: a hot row is reduced in the tasks that read it."""
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").dropDuplicates()


def search(rows: DataFrame, queries: DataFrame, block_rows: int, index, code: Column | None = None) -> DataFrame:
    """What `index` finds for every query in every block of rows of its width.

    Vectors of one width are searched among themselves. The rows, distinct ones, are dealt into blocks by
    a hash of id and vector, about `block_rows` in each however many rows there are or share an id;
    every query visits every block of its width. `code`, an array made of the column `embedding`,
    travels in its place. A task reads a block's rows first, builds `index(ids, matrix, width)` and then streams
    the queries past it in batches, so it holds one block and one batch. `index(..).find(query_ids,
    matrix)` returns arrays of query, row and score. Only `usable` vectors take part.
    """
    rows, queries = (usable(distinct(x)).withColumn("width", F.size("embedding")) for x in (rows, queries))
    # A row for each width there is.
    sizes = rows.groupBy("width").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    held = {r["width"]: r["blocks"] for r in sizes.collect()}
    blocks = F.coalesce(*[F.when(F.col("width") == w, F.lit(n)) for w, n in held.items()], F.lit(0)) if held else F.lit(0)
    code = F.col("embedding") if code is None else code
    own = rows.select("width", F.pmod(F.xxhash64("vec_id", "embedding"), F.greatest(blocks, F.lit(1))).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", code.alias("code"))
    numbers = F.when(blocks > 0, F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1))
    asked = queries.select("width", F.explode(numbers).alias("block"), F.lit(1).alias("kind"), "vec_id", code.alias("code"))

    def found(batches):
        at, ids, parts, built = None, [], [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "block", "kind")]
            turns = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            for start, stop in zip([0, *turns], [*turns, batch.num_rows]):
                if start == stop:
                    continue
                width, block, kind = (k[start] for k in keys)
                if (width, block) != at:
                    at, ids, parts, built = (width, block), [], [], None
                piece = batch.slice(start, stop - start)
                vectors, own_ids = matrix(piece.column("code")), piece.column("vec_id").to_numpy(zero_copy_only=False)
                if kind == 0:
                    ids.append(own_ids)
                    parts.append(vectors)
                elif parts:
                    if built is None:
                        built = index(np.concatenate(ids), np.concatenate(parts), int(width))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in built.find(own_ids, vectors)], ["query_id", "vec_id", "score"])

    dealt = own.unionByName(asked).repartition(max(1, sum(held.values())), "width", "block").sortWithinPartitions("width", "block", "kind")
    return dealt.mapInArrow(found, HITS)
