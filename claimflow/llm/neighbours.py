"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 7)."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.blocks import search
from claimflow.llm.text import spans, table

# Rows of a block; tables, projections of each, width of a slot in standard deviations of a unit
# vector's projection, and the rows of a block that the probes of one table gather.
BLOCK_ROWS, TABLES, PROJECTIONS, SLOT, GATHERED = 8_192, 8, 8, 1.5, 700
NEIGHBOURS = 20
QUERY_PORTION = 256


class StableIndex:
    """Hash tables over one block: slots of Gaussian projections, buckets in order of their key.

    Inner products become distances by one more component that gives every row the block's
    largest norm; a query's is 0. So the nearest in distance has the largest inner product.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, tables: int, projections: int, slot: float, gathered: int, seed: int):
        self.ids, self.rows, self.k, self.slot, self.budget = ids, rows, k, slot, max(k, gathered)
        _, self.id_of, times = np.unique(ids, return_inverse=True, return_counts=True)
        self.repeated = len(times) < len(ids)
        self.share = 1 / times[self.id_of]  # rows that share an id are gathered as one
        norms = np.linalg.norm(rows, axis=1)
        top = norms.max()
        lifted = np.hstack([rows / top, np.sqrt(np.maximum(1 - (norms / top) ** 2, 0))[:, None]])
        rng = np.random.default_rng(seed)  # alike in every block
        self.directions = rng.normal(size=(tables, lifted.shape[1], projections))
        self.offsets = rng.uniform(0, slot, size=(tables, projections))
        self.tables = []
        for direction, offset in zip(self.directions, self.offsets):
            slots = np.floor((lifted @ direction + offset) / slot).astype(np.int64)
            buckets, which, sizes = np.unique(slots, axis=0, return_inverse=True, return_counts=True)
            order = np.argsort(which, kind="stable")
            # Per projection the slots in use and which of them each bucket has.
            used = [np.unique(column, return_inverse=True) for column in buckets.T]
            self.tables.append((used, order, sizes, np.concatenate([[0], np.cumsum(sizes)]), np.bincount(which, self.share)))
        self.single = rows.astype(np.float32)
        # Twice the most that single precision can be off by, for a query of length 1.
        self.slack = 2.0 * rows.shape[1] * 2.0**-23 * top

    def _candidates(self, units: np.ndarray) -> list[np.ndarray]:
        """Rows of the visited buckets of all tables, for each query.

        A query visits a table's buckets in order of the squared distance from its projections
        to the bucket's slots, which is the order of estimated success, until `budget` rows are
        gathered, rows of one id counting as one; its own bucket has distance 0 and comes first.
        """
        visited = np.zeros((len(units), len(self.ids)), bool)
        for (used, order, sizes, starts, shares), direction, offset in zip(self.tables, self.directions, self.offsets):
            at = (units @ direction + offset) / self.slot
            far = np.zeros((len(units), len(sizes)), np.float32)
            for (slots, which), place in zip(used, at.T):
                low = slots[None, :] - place[:, None]  # above 0: the slot lies higher
                far += (np.maximum(np.maximum(low, -low - 1), 0) ** 2).astype(np.float32)[:, which]
            ranked = self._nearest_buckets(far)
            gathered = np.cumsum(shares[ranked], axis=1)
            taken = np.concatenate([np.ones((len(units), 1), bool), gathered[:, :-1] < self.budget], axis=1)
            query, place = np.nonzero(taken)
            bucket = ranked[query, place]
            rows = order[np.repeat(starts[bucket], sizes[bucket]) + spans(sizes[bucket])]
            visited[np.repeat(query, sizes[bucket]), rows] = True
        return [np.flatnonzero(v) for v in visited]

    def _nearest_buckets(self, far: np.ndarray) -> np.ndarray:
        """The nearest buckets in order; every bucket holds a row, so `budget` of them suffice unless ids repeat."""
        if far.shape[1] <= self.budget or self.repeated:
            return np.argsort(far, axis=1, kind="stable")
        near = np.sort(np.argpartition(far, self.budget - 1, axis=1)[:, : self.budget], axis=1)
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)

    def _best_of_id(self, near: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best score of each distinct id among these rows."""
        distinct, which = np.unique(self.id_of[near], return_inverse=True)
        best = np.full(len(distinct), -np.inf, scores.dtype)
        np.maximum.at(best, which, scores)
        return best

    def find(self, query_ids: np.ndarray, queries: np.ndarray):
        out_q, out_id, out_score = [], [], []
        for begin in range(0, len(query_ids), QUERY_PORTION):
            some = queries[begin : begin + QUERY_PORTION]
            units = np.hstack([some / np.linalg.norm(some, axis=1, keepdims=True), np.zeros((len(some), 1))])
            for own, query, near in zip(query_ids[begin:], some, self._candidates(units)):
                near = near[self.ids[near] != own]
                if len(near) > self.k:  # what single precision shows to lie behind the k best need not be ranked
                    rough = self.single[near] @ query.astype(np.float32)
                    top = self._best_of_id(near, rough) if self.repeated else rough
                    last = np.partition(top, len(top) - self.k)[len(top) - self.k] if len(top) > self.k else -np.inf
                    near = near[rough >= last - self.slack * np.linalg.norm(query)]
                scores = self.rows[near] @ query
                best = np.lexsort((self.ids[near], -scores))
                if self.repeated:
                    best = best[np.sort(np.unique(self.ids[near[best]], return_index=True)[1])]
                best = best[: self.k]
                out_q.append(np.full(len(best), own))
                out_id.append(self.ids[near[best]])
                out_score.append(scores[best])
        return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS,
    tables: int = TABLES, projections: int = PROJECTIONS, slot: float = SLOT, gathered: int = GATHERED, seed: int = 5,
) -> DataFrame:
    """The k rows of largest inner product found for each query: query_id, rank, vec_id, score.

    `rows` and `queries` have vec_id and embedding. Candidates come from the buckets that the
    probes of all tables visit; their inner products are exact, in double precision. A query's
    own id is no candidate. Ties go to the smaller id; fewer candidates than k give fewer rows.

    Vectors of one width are searched among themselves. Those that are null, zero or hold a null or
    non-finite component take no part; an empty table gives no rows. Rows that repeat an id
    count once, by their best score. Other columns are not read.
    """
    index = lambda ids, vectors, _: StableIndex(ids, vectors, k, tables, projections, slot, gathered, seed)
    hits = search(rows, queries, block_rows, index).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
