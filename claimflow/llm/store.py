"""Intermediate tables in the cluster's shared folder."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimflow.session import discard, scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the shared folder and read again: its lineage ends, its files survive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Deletes the files of a `stored` table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        discard(df.sparkSession, folder)


def runs(batches, column: str):
    """Successive rows of one value of `column` as one table each; the input is ordered by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(np.diff(key)) + 1
        for start, stop in zip([0, *turns], [*turns, len(key)]):
            if held and held[0].column(column)[0].as_py() != key[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)
