"""Exact top-k search over binary codes by incremental multi-index hashing (operator 4)."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.blocks import search
from claimflow.llm.text import spans, table

# A block's codes are 8 bytes a row for 64 components.
BLOCK_ROWS, NEAREST = 262_144, 20
SEGMENT = 16  # bits
QUERY_PORTION = 128
# Cells of a table of queries and ids.
CELLS = 1 << 24


def segments(embedding: Column) -> Column:
    """The code of a vector as numbers of SEGMENT bits: bit 1 where a component is above 0, padded with zeros."""
    starts = F.sequence(F.lit(0), F.floor((F.size(embedding) - 1) / SEGMENT).cast("int"))

    def one(at: Column) -> Column:
        bits = F.transform(F.slice(embedding, at * SEGMENT + 1, SEGMENT), lambda x, i: F.when(x > 0, F.power(F.lit(2), i).cast("int")).otherwise(0))
        return F.aggregate(bits, F.lit(0), lambda a, x: a + x)

    return F.transform(starts, one)


class MultiIndex:
    """One table per segment over a block, addressed directly by the segment's value."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int):
        self.ids, self.k = ids, k
        distinct, self.id_of = np.unique(ids, return_inverse=True)
        self.n_ids = len(distinct)
        self.codes = codes.astype(np.uint16)
        self.orders, self.starts = [], []
        values = np.arange(1 << SEGMENT, dtype=np.uint16)
        self.masks = [values[np.bitwise_count(values) == radius] for radius in range(SEGMENT + 1)]
        for segment in self.codes.T:
            self.orders.append(np.argsort(segment, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=1 << SEGMENT))]))

    def _probed(self, codes: np.ndarray, active: np.ndarray, j: int, radius: int):
        """Pairs (query, row) first met when segment j is searched at exactly this radius, and their distance."""
        keys = (codes[active, j][:, None] ^ self.masks[radius]).astype(np.int64)
        begin, n = self.starts[j][keys], self.starts[j][keys + 1] - self.starts[j][keys]
        per_query = n.sum(axis=1)
        flat = n.ravel()
        rows = self.orders[j][np.repeat(begin.ravel(), flat) + spans(flat)]
        asked = np.repeat(active, per_query)
        apart = np.bitwise_count(codes[asked] ^ self.codes[rows])
        # Met before: another segment within a smaller radius, or an earlier one within this one.
        new = (apart[:, :j] > radius).all(axis=1) & (apart[:, j + 1 :] >= radius).all(axis=1)
        return asked[new], rows[new], apart[new].sum(axis=1, dtype=np.int64)

    def _search(self, query_ids: np.ndarray, codes: np.ndarray):
        segments = codes.shape[1]
        width = segments * SEGMENT
        counts = np.zeros((len(codes), width + 1), np.int64)
        repeated = self.n_ids < len(self.ids)
        least = np.full(len(codes) * self.n_ids if repeated else 0, width + 1, np.int32)  # distance of each id so far
        wanted = self.k
        active = np.arange(len(codes))
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for radius in range(SEGMENT + 1):
            for j in range(segments):
                asked, rows, apart = self._probed(codes, active, j, radius)
                other = self.ids[rows] != query_ids[asked]
                asked, rows, apart = asked[other], rows[other], apart[other]
                if repeated:  # an id counts once, at its smallest distance
                    pair = asked * self.n_ids + self.id_of[rows]
                    met = np.unique(pair)
                    before = least[met]
                    np.minimum.at(least, pair, apart.astype(np.int32))
                    known = before <= width
                    np.add.at(counts, (met[known] // self.n_ids, before[known]), -1)
                    np.add.at(counts, (met // self.n_ids, least[met]), 1)
                else:
                    np.add.at(counts, (asked, apart), 1)
                reached = np.cumsum(counts, axis=1) >= wanted
                kth = np.where(reached.any(axis=1), reached.argmax(axis=1), width + 1)
                near = apart <= kth[asked]
                kept.append((asked[near], rows[near], apart[near]))
                # Every code within segments * radius + j bits has been met by now.
                active = active[kth[active] > segments * radius + j]
                if not len(active):
                    return kept, kth
        return kept, kth

    def find(self, query_ids: np.ndarray, codes: np.ndarray):
        out = [[], [], []]
        portion = QUERY_PORTION if self.n_ids == len(self.ids) else max(1, min(QUERY_PORTION, CELLS // self.n_ids))
        for begin in range(0, len(query_ids), portion):
            own = query_ids[begin : begin + portion]
            kept, kth = self._search(own, codes[begin : begin + portion].astype(np.uint16))
            asked, rows, apart = (np.concatenate(x) for x in zip(*kept))
            near = apart <= kth[asked]
            asked, ids, apart = asked[near], self.ids[rows[near]], apart[near]
            order = np.lexsort((ids, apart, asked))
            asked, ids, apart = asked[order], ids[order], apart[order]
            if self.n_ids < len(self.ids):  # of rows that share an id the nearest
                first = np.sort(np.unique(np.stack([asked, ids]), axis=1, return_index=True)[1])
                asked, ids, apart = asked[first], ids[first], apart[first]
            each = np.bincount(asked, minlength=len(own))
            best = spans(each) < self.k
            for column, values in zip(out, (own[asked[best]], ids[best], apart[best].astype(np.float64))):
                column.append(values)
        return tuple(np.concatenate(x) for x in out)


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = NEAREST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k rows at the smallest Hamming distance for each query, exactly: query_id, rank, vec_id, distance.

    A vector's code has a bit for each component: 1 where it is above 0. In each block the search
    takes segment after segment and radius after radius until the k-th distance found is provably
    covered, ties included; the blocks' hits are then merged. A query's own id is no candidate;
    ties go to the smaller id.

    Codes of one length are searched among themselves. Vectors that are null, zero or hold a null or
    non-finite component have no code; an empty table gives no rows. Rows that repeat an id
    count once, by their smallest distance. Other columns are not read.
    """
    found = search(rows, queries, block_rows, lambda ids, codes, _: MultiIndex(ids, codes, k), segments(F.col("embedding")))
    hits = found.groupBy("query_id", "vec_id").agg(F.min("score").cast("int").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance")


def op4_hamming_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_codes(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH held AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), apart AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    CAST(len(list_filter(range(1, len(q.code) + 1), lambda i: q.code[i] <> r.code[i])) AS INTEGER) AS distance
  FROM held q JOIN held r ON q.vec_id <> r.vec_id AND len(q.code) = len(r.code) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
FROM apart QUALIFY rank <= 20
"""
