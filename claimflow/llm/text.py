"""Helpers that the operators share: batches, words, hashes, splits of the documents."""

import sys
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow.llm.store import stored

# Bytes of text that a task works on at once; a longer single text is a portion of its own.
PORTION_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one, that no column of `df` has."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text, remainder 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def task_state(name: str, make):
    """An object kept in the worker process from task to task; only caches of pure functions go here."""
    home = sys.modules.setdefault("_claimflow_task_state", ModuleType("_claimflow_task_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def remembered(name: str, key, make, most: int = 1 << 16):
    """`make()`, a pure function of the key, kept in the worker process; the memory is emptied when it is full."""
    held = task_state(name, dict)
    if key not in held:
        if len(held) >= most:
            held.clear()
        held[key] = make()
    return held[key]


def portions(batch: pa.RecordBatch, column: str = "text", limit: int = PORTION_BYTES):
    """The batch in slices of at most `limit` bytes of `column`, of one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased on request: codes, words per row, the distinct words.

    A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), counts, coded.dictionary


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each run begins when runs of these lengths follow each other."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run; an empty run sums to 0."""
    total = np.zeros((len(counts), *values.shape[1:]), np.float64)
    held = counts > 0
    if held.any():
        total[held] = np.add.reduceat(values, starts_of(counts)[held], axis=0, dtype=np.float64)
    return total


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash per string, equal in every process."""
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)  # a copy
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. of each run, runs one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(starts_of(lengths), lengths)


def sampled_ids(rows: DataFrame, n: int, seed: int) -> list[int]:
    """The n ids smallest by a hash: a bounded sample, alike however the rows are dealt."""
    key = F.col("doc_id").cast("bigint")
    held = rows.filter(key.isNotNull()).select(key.alias("doc_id"))
    return [r[0] for r in held.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n).collect()]


def sampled_texts(docs: DataFrame, chosen: list[tuple[int, object]], kind: str) -> DataFrame:
    """The whole texts of chosen (doc_id, label) rows, for fitting only: doc_id, label, text.

    Ids are chosen before any text is read. The sample is bounded by its rows alone; its texts
    stay in the cluster, in the shared folder, and the driver gets what tasks make of them. An id
    that stands for several texts enters with the smallest of them.
    """
    labels = dict(chosen)
    frame = pd.DataFrame({"doc_id": list(labels), "label": list(labels.values())})
    ids = docs.sparkSession.createDataFrame(frame if labels else [], f"doc_id bigint, label {kind}")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return stored(found, "sample")
