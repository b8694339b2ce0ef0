"""Vector codes by ball k-means on integer parts (operator 13)."""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.store import released, stored
from claimflow.llm.text import table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
# Components beyond this stand at it, so that squared distances stay whole numbers of 64 bits.
WIDEST = 1 << 26
# Up to here sums of products are exact in doubles, and matrix products may be used.
EXACT = float(1 << 53)
BATCH = 8_192
KEPT = "vec_id bigint, label string, parts array<int>, codes binary, error bigint"
TOTALS = "width int, part int, entry int, at int, total bigint, n bigint"


def cuts(width: int) -> list[int]:
    """Where the parts of a vector begin and end; equal ones where the width allows."""
    return [width * i // PARTS for i in range(PARTS + 1)]


def apart(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows and entries, exact whole numbers."""
    if not rows.shape[1]:
        return np.zeros((len(rows), len(entries)), np.int64)
    most = max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * float(most) ** 2 * rows.shape[1] < EXACT:
        x, c = rows.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(1) for c in entries], axis=1)


@dataclass
class Balls:
    """The entries of one part: what lies around each of them, and which moved in the last round.

    An entry and the parts it codes are a ball. `near[i]` lists the entries by their squared
    distance `gaps[i]` from entry i. An entry can only be as near to a part as entry i, at
    squared distance d, if it is within twice the distance of i: gaps <= 4d. Parts for which
    no other entry is form the stable core of the ball; the others lie in rings, one for each
    further neighbour.
    """

    entries: np.ndarray
    near: np.ndarray
    gaps: np.ndarray
    moved: np.ndarray

    @classmethod
    def around(cls, entries: np.ndarray, moved: np.ndarray) -> "Balls":
        gaps = apart(entries, entries)
        near = np.argsort(gaps, axis=1, kind="stable")
        return cls(entries, near, np.take_along_axis(gaps, near, axis=1), moved)

    def assign(self, rows: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower one, and the squared distance.

        `codes` are the entries of the round before; without them every entry is compared.
        """
        if codes is None:
            codes, best = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
            for at in range(0, len(rows), BATCH):
                found = apart(rows[at : at + BATCH], self.entries)
                codes[at : at + BATCH] = found.argmin(1)
                best[at : at + BATCH] = found.min(1)
            return codes, best
        own = rows - self.entries[codes]
        best = (own * own).sum(1)
        codes = codes.copy()
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(self.entries) + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            members = order[bounds[i] : bounds[i + 1]]
            reach = np.searchsorted(self.gaps[i], 4 * best[members], side="right")
            if not self.moved[i]:
                # A ball that stayed has to look at its rings only as far as a neighbour moved.
                shifted = np.cumsum(self.moved[self.near[i]])
                reach = np.where(shifted[reach - 1] > 0, reach, 1)
            ring = reach > 1
            if not ring.any():
                continue
            members = members[ring]
            neighbours = np.sort(self.near[i, : reach.max()])
            found = apart(rows[members], self.entries[neighbours])
            codes[members] = neighbours[found.argmin(1)]
            best[members] = found.min(1)
        return codes, best


class Codebooks:
    """The entries of all parts of one width of vectors."""

    def __init__(self, books: list[np.ndarray], moved: list[np.ndarray] | None = None):
        moved = moved or [np.ones(len(b), bool) for b in books]
        self.parts = [Balls.around(b, m) for b, m in zip(books, moved)]

    def assign(self, rows: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        at = cuts(rows.shape[1])
        new, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
        for p, balls in enumerate(self.parts):
            new[:, p], best = balls.assign(rows[:, at[p] : at[p + 1]], None if codes is None else codes[:, p].astype(np.int64))
            error += best
        return new, error

    def sha256(self) -> str:
        """Over all entries' components as decimals, by part, entry and position."""
        text = ",".join(str(x) for balls in self.parts for x in balls.entries.reshape(-1).tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the components as whole numbers floor(1024 x), of vectors that are kept.

    Left out are vectors that are null or hold a null or non-finite component.
    """
    x = F.col("embedding").cast("array<double>")
    held = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    held = held.filter(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    bound = lambda v: F.greatest(F.lit(float(-WIDEST)), F.least(F.lit(float(WIDEST)), v * SCALE))
    return held.select("vec_id", "label", F.transform("x", lambda v: F.floor(bound(v)).cast("int")).alias("parts"))


def first_entries(rows: DataFrame) -> dict[int, Codebooks]:
    """Of each width the parts of the ENTRIES smallest ids; of an id that is repeated the smallest vector."""
    ids = rows.filter("vec_id is not null").select(F.size("parts").alias("width"), "vec_id").distinct()
    place = F.row_number().over(Window.partitionBy("width").orderBy("vec_id"))
    least = F.broadcast(ids.withColumn("place", place).filter(F.col("place") <= ENTRIES).drop("place"))
    chosen = rows.withColumn("width", F.size("parts")).join(least, ["width", "vec_id"]).groupBy("width", "vec_id").agg(F.min("parts").alias("parts"))
    found: dict[int, list] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["width"], r["vec_id"])):
        found.setdefault(r["width"], []).append(r["parts"])
    books = {}
    for width, held in found.items():
        whole, at = np.array(held, np.int64).reshape(len(held), width), cuts(width)
        books[width] = Codebooks([whole[:, at[p] : at[p + 1]] for p in range(PARTS)])
    return books


def _by_width(batch: pa.RecordBatch):
    """Row positions, width and matrix of the vectors of each width in the batch."""
    column = batch.column("parts")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, int(width), flat.astype(np.int64).reshape(len(at), int(width))


def assigned(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """`rows` with the codes and the error under `books`; codes that are there narrow the search."""
    coded = "codes" in rows.columns

    def coding(batches):
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            old = None
            if coded and batch.num_rows:
                old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            for at, width, matrix in _by_width(batch):
                if width in books:
                    codes[at], error[at] = books[width].assign(matrix, None if old is None else old[at])
            binary = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("parts"), binary, pa.array(error)],
                ["vec_id", "label", "parts", "codes", "error"],
            )

    return rows.mapInArrow(coding, KEPT)


def _summed(rows: DataFrame) -> DataFrame:
    """Sum and number of the parts of each entry, component by component; a task hands on one row for each."""

    def summing(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            for at, width, matrix in _by_width(batch):
                ends = cuts(width)
                if width not in held:
                    held[width] = [(np.zeros((ENTRIES, ends[p + 1] - ends[p]), np.int64), np.zeros(ENTRIES, np.int64)) for p in range(PARTS)]
                for p, (total, n) in enumerate(held[width]):
                    np.add.at(total, codes[at, p], matrix[:, ends[p] : ends[p + 1]])
                    n += np.bincount(codes[at, p], minlength=ENTRIES)
        for width, parts in held.items():
            for p, (total, n) in enumerate(parts):
                used = np.flatnonzero(n)
                size = total.shape[1]
                rows = len(used) * size
                columns = [np.full(rows, width), np.full(rows, p), np.repeat(used, size), np.tile(np.arange(size), len(used))]
                arrays = [pa.array(c.astype(np.int32)) for c in columns] + [pa.array(total[used].reshape(-1)), pa.array(np.repeat(n[used], size))]
                yield pa.RecordBatch.from_arrays(arrays, ["width", "part", "entry", "at", "total", "n"])

    each = rows.select("parts", "codes").mapInArrow(summing, TOTALS)
    wide = F.col("total").cast("decimal(38,0)")
    return each.groupBy("width", "part", "entry", "at").agg(F.sum(wide).alias("total"), F.sum("n").alias("n"))


def moved_on(rows: DataFrame, books: dict[int, Codebooks]) -> dict[int, Codebooks]:
    """The next entries: the floored mean of their parts; an unused entry stays."""
    new = {width: [b.entries.copy() for b in book.parts] for width, book in books.items()}
    for r in _summed(rows).toLocalIterator():
        new[r["width"]][r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return {width: Codebooks(parts, [(b.entries != x).any(axis=1) for b, x in zip(books[width].parts, parts)]) for width, parts in new.items()}


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every kept vector's code under codebooks learned from all of them.

    Returns vec_id, label, code (an entry for each of four parts, two hex digits each), error
    (squared distance to the entries), label_error (summed over equal labels, nulls together)
    and codebooks_sha256. Each round reads and writes the table of whole numbers once in the
    shared folder, codes included, so that only parts outside the stable cores are compared, and
    adds up a row for each entry and component in each task. The driver holds the entries alone.

    Vectors of another width have codebooks of their own; a width that four does not divide has
    parts that differ by one; an empty vector has code 00000000 and error 0. Rows without id are
    coded but start no entry; repeated rows all count. Components beyond 65,536 count as that, a
    label's error beyond a long as its largest. An empty table gives no rows; other columns are not read.
    """
    table_now = stored(whole_numbers(vectors), "vectors")
    books = first_entries(table_now)
    for _ in range(rounds):
        before, table_now = table_now, stored(assigned(table_now, books), "vectors")
        released(before)
        books = moved_on(table_now, books)
    last = stored(assigned(table_now, books).select("vec_id", "label", F.size("parts").alias("width"), "codes", "error"), "codes")
    released(table_now)
    most = F.lit((1 << 63) - 1)
    label_error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most.cast("decimal(38,0)")).cast("bigint")
    by_label = last.groupBy(F.col("label").alias("of")).agg(label_error.alias("label_error"))
    hashed = F.create_map(*[F.lit(x) for width, book in books.items() for x in (width, book.sha256())]) if books else F.lit(None)
    sha = hashed[F.col("width")] if books else F.lit(None).cast("string")
    # An entryless width, of rows without id alone, has empty codebooks.
    sha = F.coalesce(sha, F.lit(hashlib.sha256(b"").hexdigest()))
    return last.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256")
    )


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    """The rounds one after the other, every part compared with every entry."""
    rounds = []
    for t in range(ROUNDS + 1):
        rounds.append(f"""near{t} AS (
  SELECT p.row, p.part, arg_min(b.entry, struct_pack(d := list_sum(list_transform(range(1, 1 + len(p.x)), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))), e := b.entry)) AS entry,
    min(list_sum(list_transform(range(1, 1 + len(p.x)), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))) AS d
  FROM pieces p JOIN book{t} b ON b.part = p.part GROUP BY p.row, p.part
)""")
        if t < ROUNDS:
            rounds.append(f"""mean{t} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT q.part, q.entry, i, sum(p.x[i]) AS s, count(*) AS n
    FROM near{t} q JOIN pieces p ON p.row = q.row AND p.part = q.part, LATERAL (SELECT unnest(range(1, 1 + len(p.x))) AS i) GROUP BY q.part, q.entry, i
  ) GROUP BY part, entry
), book{t + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{t} b LEFT JOIN mean{t} m ON m.part = b.part AND m.entry = b.entry
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS (
  SELECT row, vec_id, part, x[1 + len(x) * part // {PARTS} : len(x) * (part + 1) // {PARTS}] AS x FROM kept, range({PARTS}) r(part)
), book0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM pieces QUALIFY entry < {ENTRIES}
), {", ".join(rounds)}, coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


ORACLE = _oracle()
