"""Best-fit packing of token ids into sequences of one length (operator 10)."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.store import stored
from claimflow.llm.text import portions, starts_of, table
from claimflow.llm.tokens import encoder

SEQUENCE = 2048
# Bins a task holds open at once; its memory for packing is bounded by this, not by its documents.
OPEN_BINS = 512
# Ids of open bins that one task of the second step packs anew, and the bins it holds open.
LEFT_IDS, LEFT_BINS = 1 << 22, 8_192
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


class BestFit:
    """Online best-fit with a bounded number of open bins.

    Open bins lie in lists by free space; bit s of `spaces` says whether any bin has s left. The
    fitting bin with least space is the lowest set bit from the asked length on; when the bins
    run out, the fullest one closes, which is the lowest set bit of all.
    """

    def __init__(self, size: int, open_bins: int):
        self.size, self.limit, self.n_open, self.made = size, open_bins, 0, 0
        self.spaces = 0
        self.closed: list[int] = []
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        one = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        self.n_open -= 1
        return one

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset for a piece of this length, 1 to size."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            one = self._take(space)
        else:
            if self.n_open >= self.limit:
                self.closed.append(self._take((self.spaces & -self.spaces).bit_length() - 1))
            space, one = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins[left].append(one)
            self.spaces |= 1 << left
            self.n_open += 1
        else:
            self.closed.append(one)
        return one, self.size - space


def cut(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these lengths: document, piece number, start, length.

    Only a longer document is cut; its first piece takes the remainder, the others are full.
    """
    n = np.maximum(-(-lengths // size), 1)
    doc = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(doc)) - np.repeat(starts_of(n), n)
    first = lengths - (n - 1) * size
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
    return doc, piece, start, np.where(piece == 0, first[doc], size)


class _Packer:
    """Bins and the pieces in them; pieces come out when their bin closes, so no more than the open bins are held."""

    def __init__(self, size: int, open_bins: int, base: int):
        self.fit, self.base, self.held = BestFit(size, open_bins), base, {}

    def put(self, piece: tuple) -> None:
        """A piece is doc_id, piece, start, length and ids."""
        one, offset = self.fit.put(piece[3])
        self.held.setdefault(one, []).append((*piece, self.base + one, offset))

    def done(self, all_bins: bool = False) -> list[tuple]:
        bins = list(self.held) if all_bins else self.fit.closed
        out = [row for one in bins for row in self.held.pop(one)]
        self.fit.closed = []
        return out


KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
NAMES = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]


def _batch(rows: list[tuple], is_open: bool | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(KINDS), KINDS)]
    if is_open is None:
        return pa.RecordBatch.from_arrays(columns, NAMES)
    return pa.RecordBatch.from_arrays([*columns, pa.array([is_open] * len(rows), pa.bool_())], [*NAMES, "open"])


def pack(docs: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Every document's ids, ended by `end_id`, placed into sequences of at most `size` ids.

    Returns a row per piece: doc_id, piece, start (ids of the document before it), length, ids
    (little-endian unsigned 32-bit), sequence_id and offset. Each task packs its own partition as it
    reads, by best fit into `open_bins` bins. What lies in the bins that are still open at its end, a
    bounded number however large the partition, is packed once more, longest pieces first, in a second
    step over as few tasks as their ids fill, so that many small partitions leave no more gaps than one.
    Sequence ids hold the step and the partition, and the first step is stored, so a task that runs again
    numbers alike.

    A null or empty text is the end id alone; a very long one is cut and held as one text. Repeated rows and
    rows without id are packed each on its own; an empty table gives no rows; other columns are not read.
    """

    def packed(batches):
        encode, packer = encoder(tokenizer), _Packer(size, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in portions(batch):
                ids, counts = encode.texts(part.column("text"))
                lengths = counts + 1
                whole = np.full(int(lengths.sum()), end_id, np.dtype("<u4"))
                held = np.ones(len(whole), bool)
                held[np.cumsum(lengths) - 1] = False
                whole[held] = ids
                doc, piece, start, length = cut(lengths, size)
                ends, owners = np.concatenate([[0], np.cumsum(length)]).tolist(), part.column("doc_id").to_pylist()
                for k, (d, p, s, n) in enumerate(zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist())):
                    packer.put((owners[d], p, s, n, whole[ends[k] : ends[k + 1]].tobytes()))
                yield _batch(packer.done(), False)
        yield _batch(packer.done(all_bins=True), True)

    def packed_again(batches):
        packer = _Packer(size, LEFT_BINS, (1 << 62) + (TaskContext.get().partitionId() << 40))
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in NAMES[:5])):
                packer.put(row)
            yield _batch(packer.done())
        yield _batch(packer.done(all_bins=True))

    first = stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(packed, PIECES + ", open boolean"), "pieces")
    left = first.filter("open").select(*NAMES[:5])
    ids = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = left.repartition(max(1, -(-ids // LEFT_IDS)), F.xxhash64("doc_id", "piece", "start", F.crc32("ids")))
    again = dealt.sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids").mapInArrow(packed_again, PIECES)
    return first.filter("NOT open").drop("open").unionByName(again)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places; the ids as a checksum."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
