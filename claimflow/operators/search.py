"""Ranked search over text and over vectors.

The questions are arguments of a call: a list the user gives, small by nature, and taken in
blocks inside a task where it is long. The documents are the large side and never move: each
task scores its documents against all questions and hands on its k best per question. No join
of questions with documents takes place, the shuffle carries k rows per question and task, and
the documents are read once, or twice where corpus figures are needed, for any number of
questions. Scores rank unrounded, and documents that are alike score alike to the last bit.
"""

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.functions import scalars as fn
from claimflow.session import fixed_rows

# What runs in tasks travels with the job: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Questions that a task scores at once.
BLOCK = 64
# Bytes of text and rows that a task takes apart at once; a longer single text is taken alone.
PORTION_BYTES, PORTION_ROWS = 2 << 20, 2_048


def portions(batches, column: int = 1):
    """The batches in slices of bounded text, so that a task's memory does not follow the length of a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, done + PORTION_BYTES, side="right"))
            stop = min(max(start + 1, stop), start + PORTION_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def _hits(docs: DataFrame) -> str:
    """The schema of hits; ids keep the type they have."""
    return f"query_id bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"


def ranked_hits(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents per question with their rank, ties by document id."""
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def _asked(questions: list[tuple]) -> list[int]:
    if not questions:
        raise ValueError("no questions given")
    return [q for q, _ in questions]


class _Best:
    """The k best (document, score) pairs per question seen by one task."""

    def __init__(self, query_ids: list[int], k: int):
        self.query_ids, self.k, self.type = query_ids, k, None
        self.kept = [None] * len(query_ids)

    def add(self, j: int, doc_ids: pa.Array, scores: np.ndarray) -> None:
        """Rows of one batch for question number j."""
        self.type = doc_ids.type
        ids = doc_ids.to_numpy(zero_copy_only=False)
        if self.kept[j] is not None:
            ids = np.concatenate([self.kept[j][0], ids])
            scores = np.concatenate([self.kept[j][1], scores])
        if len(scores) > self.k:  # only rows that reach the k-th best score can stay
            last = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= last], scores[scores >= last]
        # Best score first, then smallest id: the order of the final ranking.
        by_id = np.argsort(ids, kind="stable")
        best = by_id[np.argsort(-scores[by_id], kind="stable")][: self.k]
        self.kept[j] = ids[best], scores[best]

    def batches(self):
        for query_id, kept in zip(self.query_ids, self.kept):
            if kept is not None and len(kept[0]):
                columns = [pa.array(np.full(len(kept[0]), query_id, np.int64)), pa.array(kept[0], self.type), pa.array(kept[1])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "score"])


# --- vectors -------------------------------------------------------------------------------------


def search_vectors(docs: DataFrame, questions: list[tuple[int, list[float]]], k: int = vocab.SEARCH_HITS) -> DataFrame:
    """The k nearest documents per question vector by cosine, exactly.

    `docs` has doc_id, of any type, and embedding. A document whose vector is missing, of another
    length or all zeros has no cosine and is no hit.
    """
    query_ids = _asked(questions)
    matrix = np.array([v for _, v in questions], dtype=np.float64)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    width = matrix.shape[1]

    def best_of_task(batches):
        best = _Best(query_ids, k)
        for batch in batches:
            doc_ids, vectors = batch.column(0), batch.column(1)
            usable = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
            flat = vectors.filter(usable).flatten().to_numpy(zero_copy_only=False)
            rows = flat.astype(np.float64).reshape(-1, width)
            norms = np.sqrt((rows * rows).sum(axis=1))
            good = np.isfinite(norms) & (norms > 0)
            rows = rows[good] / norms[good, None]
            doc_ids = doc_ids.filter(usable).filter(pa.array(good))
            for j, question in enumerate(matrix):
                best.add(j, doc_ids, (rows * question).sum(axis=1))  # a sum per row: equal rows, equal scores
        yield from best.batches()

    return ranked_hits(docs.select("doc_id", "embedding").mapInArrow(best_of_task, _hits(docs)), k)


# --- text ----------------------------------------------------------------------------------------

_WORD = re.compile("[a-z]+")


def terms_of(text: str | None) -> Counter:
    """Lower-case runs of the letters a to z, counted."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _weights(counts) -> np.ndarray:
    return 1 + np.log(np.fromiter(counts, dtype=np.float64))


def _vocabulary(questions: list[tuple[int, str]]) -> list[str]:
    return sorted({t for _, text in questions for t in terms_of(text)})


def _term_stats(docs: DataFrame, terms: list[str]) -> DataFrame:
    """One row, a map: documents per term, and under the empty term the number of documents.

    Each document counts once under every asked term it holds; partial counts leave a task with
    one row per term.
    """
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    held = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")
    marks = F.concat(F.array(F.lit("")), F.array_intersect(held, wanted))
    counts = docs.select(F.explode(marks).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("stats"))


def _with_stats(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with the corpus figures, a scalar subquery, in the first row of each partition."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return docs.select("doc_id", "text", F.when(first, _term_stats(docs, terms).scalar()).alias("stats"))


class _TextScorer:
    """Cosine of documents with questions.

    A document weighs a term 1 + ln(tf); a question does the same, times ln(1 + N / df). The
    norm of a document then needs nothing but its own text.
    """

    def __init__(self, questions: list[tuple[int, str]], terms: list[str]):
        index = {t: i for i, t in enumerate(terms)}
        self.terms = pa.array(terms, pa.string())
        self.own = []
        for _, text in questions:
            counts = terms_of(text)
            at = np.array(sorted(index[t] for t in counts), np.int64)
            self.own.append((at, _weights(counts[terms[i]] for i in at)))
        self.weighted = None

    def _learn(self, stats: dict) -> None:
        held = np.array([stats.get(t, 0) for t in self.terms.to_pylist()], np.float64)
        idf = np.log1p(np.divide(stats[""], held, out=np.zeros_like(held), where=held > 0))
        self.weighted = []
        for at, own in self.own:
            values = own * idf[at]
            length = np.sqrt((values * values).sum())
            self.weighted.append((at, values / length if length > 0 else values))

    def scores(self, batch: pa.RecordBatch):
        """For blocks of questions: the first one's number, and a row of scores per document."""
        if self.weighted is None:
            self._learn(dict(batch.column(2)[0].as_py()))
        texts = pc.utf8_lower(pc.fill_null(batch.column(1), ""))
        parts = pc.split_pattern_regex(texts, "[^a-z]+")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        flat = parts.flatten()
        full = pc.not_equal(flat, "")
        coded = flat.filter(full).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(len(coded.dictionary), 1)
        pair, tf = np.unique(row[full.to_numpy(zero_copy_only=False)] * n + codes, return_counts=True)
        # In order of the count, so that alike documents add up the same numbers in the same order.
        order = np.lexsort((tf, pair // n))
        row, code, weight = (pair // n)[order], (pair % n)[order], 1 + np.log(tf[order])
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))
        term = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        term = term[code] if len(code) else np.zeros(0, np.int64)
        asked = term >= 0
        row, term, weight = row[asked], term[asked], weight[asked]
        for start in range(0, len(self.weighted), BLOCK):
            block = self.weighted[start : start + BLOCK]
            used = np.unique(np.concatenate([at for at, _ in block]))
            place = np.full(len(self.terms), -1)
            place[used] = np.arange(len(used))
            own = place[term] >= 0
            rows = np.zeros((batch.num_rows, len(used)))
            rows[row[own], place[term[own]]] = weight[own]
            total = np.zeros((batch.num_rows, len(block)))
            for j, (at, values) in enumerate(block):
                for i, value in zip(place[at], values):  # one order of the sums, however many rows there are
                    total[:, j] += rows[:, i] * value
            yield start, np.divide(total, norm[:, None], out=np.zeros_like(total), where=norm[:, None] > 0)


def search_text(docs: DataFrame, questions: list[tuple[int, str]], k: int = vocab.SEARCH_HITS) -> DataFrame:
    """The k best documents per question by term cosine over whole texts; a hit scores above zero.

    `docs` has doc_id, of any type, and text. Two narrow passes over the texts, whatever the
    number of questions: one for the corpus figures, one that scores.
    """
    query_ids, terms = _asked(questions), _vocabulary(questions)

    def best_of_task(batches):
        scorer, best = _TextScorer(questions, terms), _Best(query_ids, k)
        for part in portions(batches):
            for start, scores in scorer.scores(part):
                for j, own in enumerate(scores.T, start):
                    best.add(j, part.column(0).filter(pa.array(own > 0)), own[own > 0])
        yield from best.batches()

    return ranked_hits(_with_stats(docs, terms).mapInArrow(best_of_task, _hits(docs)), k)


def best_question(docs: DataFrame, questions: list[tuple[int, str]]) -> DataFrame:
    """Each document beside the question it answers best, the first listed on a tie; no shuffle."""
    query_ids, terms = np.array(_asked(questions), np.int64), _vocabulary(questions)

    def best_per_document(batches):
        scorer = _TextScorer(questions, terms)
        for part in portions(batches):
            top, high = np.zeros(part.num_rows, np.int64), np.full(part.num_rows, -1.0)
            for start, scores in scorer.scores(part):
                at = scores.argmax(axis=1)
                own = scores[np.arange(len(at)), at]
                top, high = np.where(own > high, at + start, top), np.maximum(own, high)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(query_ids[top]), pa.array(high)], ["doc_id", "query_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_stats(docs, terms).mapInArrow(best_per_document, f"doc_id {kind}, query_id bigint, score double")


# --- after the search ----------------------------------------------------------------------------


def with_relevance(hits: DataFrame) -> DataFrame:
    return hits.withColumn("relevance", fn.relevance_band(F.col("score")))


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their document columns, fetched after the ranking so that no text is sorted.

    The hits are k for each question of a list that the caller holds, and travel to the documents.
    """
    return docs.join(F.broadcast(hits), "doc_id")


def _kind():
    """The document's type, or the word for a missing one."""
    return F.coalesce("doc_type", F.lit("Unknown"))


def hit_display(found: DataFrame) -> DataFrame:
    """A heading and a relevance line per hit."""
    heading = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("doc_id").cast("string"), F.lit(" — "), _kind()
    )
    line = F.concat(fn.relevance_band(F.col("score")), F.lit(" ("), F.format_number("score", 2), F.lit(")"))
    return found.select("query_id", "rank", heading.alias("heading"), line.alias("relevance"))


# The shape of a search response.
_RESPONSE = (
    "struct<results: array<struct<POLICY_NUMBER: string, POLICY_TYPE: string, SEARCH_TEXT: string,"
    " `@scores`: struct<cosine_similarity: double>>>>"
)


def search_response(found: DataFrame) -> DataFrame:
    """One JSON response per question, its hits in rank order; a group holds k rows at most."""
    hit = F.struct(
        F.col("doc_id").cast("string").alias("POLICY_NUMBER"),
        F.col("doc_type").alias("POLICY_TYPE"),
        F.col("text").alias("SEARCH_TEXT"),
        F.struct(F.col("score").alias("cosine_similarity")).alias("@scores"),
    )
    hits = F.transform(F.array_sort(F.collect_list(F.struct("rank", hit.alias("hit")))), lambda x: x["hit"])
    return found.groupBy("query_id").agg(F.to_json(F.struct(hits.alias("results"))).alias("response"))


def read_search_response(responses: DataFrame) -> DataFrame:
    """Hits of JSON responses, ranked as listed; what a hit lacks is filled with defaults."""
    listed = F.from_json("response", _RESPONSE)["results"]
    rows = responses.select("query_id", F.posexplode(listed).alias("pos", "hit"))
    return rows.select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.coalesce("hit.POLICY_NUMBER", F.lit("Unknown")).alias("policy_number"),
        F.coalesce("hit.POLICY_TYPE", F.lit("Unknown")).alias("policy_type"),
        F.coalesce("hit.SEARCH_TEXT", F.lit("")).alias("search_text"),
        F.coalesce("hit.@scores.cosine_similarity", F.lit(0.0)).alias("score"),
    )


def assemble_context(hits: DataFrame) -> DataFrame:
    """All hits of a question as one labelled text in rank order; a group holds k rows at most."""
    part = F.concat(
        F.lit("[Document "), F.col("doc_id").cast("string"), F.lit(" — "), _kind(),
        F.lit("]\n"), F.coalesce("text", F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("context"),
        F.count("*").alias("documents"),
    )


def search_quality_gate(hits: DataFrame, query_ids: list[int], pass_mark: float = vocab.SEARCH_PASS_MARK) -> DataFrame:
    """Best score per asked question, and whether it reaches the pass mark; one without hits scores 0."""
    asked = fixed_rows(hits.sparkSession, "query_id bigint", [(q,) for q in query_ids])
    best = hits.groupBy("query_id").agg(F.max("score").alias("best_score"))
    found = asked.join(best, "query_id", "left").withColumn("best_score", F.coalesce("best_score", F.lit(0.0)))
    return found.withColumn("passed", F.col("best_score") >= pass_mark)
