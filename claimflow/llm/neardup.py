"""Near-duplicate documents by min-max hashing (operator 5)."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.components import components
from claimflow.llm.store import runs, stored
from claimflow.llm.text import hashes, mixed, portions, starts_of, table, unused, words

# Links need 100 * common >= PERCENT * united shingles.
PERCENT = 80
# Each permutation gives its minimum and its maximum: 160 values in 32 bands of 5. A pair at a
# similarity of 0.8 shares no band with a probability of 3e-6.
PERMUTATIONS, BAND = 80, 5
BANDS = 2 * PERMUTATIONS // BAND
# Share of equal values below which a pair is taken to lie under 0.8: 4.5 standard deviations.
ESTIMATE = 0.66
# Members of a cell, the unit that a task holds at once: with whole sets, and with signatures
# alone. More members become several cells.
CELL, SIGNATURE_CELL = 512, 4_096
# Bits of the filter that tells which documents are candidates; fixed, whatever the input.
FILTER_BITS = 1 << 24

SKETCH = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>, signature binary"
SETS = "node bigint, shingles binary"


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text in order, and how many each has.

    A text of fewer than `size` words has its whole sequence as its one shingle; one without
    words has none.
    """
    codes, counts, distinct = words(texts)
    word = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    full = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for i in range(size):
        full = mixed(full ^ word[i : i + len(full)])
    begins = starts_of(counts)
    out, lengths = [], np.zeros(len(counts), np.int64)
    for row, (begin, n) in enumerate(zip(begins.tolist(), counts.tolist())):
        if n >= size:
            own = np.unique(full[begin : begin + n - size + 1])
        elif n:
            key = np.full(1, n, np.uint64)
            for w in word[begin : begin + n]:
                key = mixed(key ^ w)
            own = mixed(key + np.uint64(1))
        else:
            continue
        lengths[row] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), lengths


def signatures(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Min-max signatures of non-empty sets: a row of minima, then maxima, of each permutation."""
    multipliers = mixed(np.arange(1, PERMUTATIONS + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    starts = starts_of(lengths)
    out = np.empty((len(lengths), 2 * PERMUTATIONS), np.uint64)
    for i, a in enumerate(multipliers):
        permuted = keys * a
        out[:, i] = np.minimum.reduceat(permuted, starts)
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(permuted, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A hash of each band's values and its number."""
    grouped = values.reshape(len(values), BANDS, BAND)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(values), 1))
    for i in range(BAND):
        key = mixed(key ^ grouped[:, :, i])
    return key


def _binary(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of each run that ends at these positions of a flat array."""
    offsets = (np.concatenate([[0], ends]) * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Per row with an id: the size of its shingle set, a 128-bit hash of the set, bands and signature.

    The signature keeps the low 16 of each value's high bits, for estimates; a row without
    shingles has no bands.
    """

    def sketched(batches):
        for batch in batches:
            for part in portions(batch):
                keys, lengths = shingles(part.column("text"), size)
                held = lengths > 0
                own = lengths[held]
                values = signatures(keys, own) if len(own) else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
                prints = np.zeros((2, len(lengths)), np.uint64)
                if len(own):
                    for i, salt in enumerate((1, 2)):
                        prints[i, held] = np.add.reduceat(mixed(mixed(keys) ^ np.uint64(salt)), starts_of(own))
                offsets = np.concatenate([[0], np.cumsum(np.where(held, BANDS, 0))]).astype(np.int32)
                short = ((values >> np.uint64(40)) & np.uint64(0xFFFF)).astype("<u2").ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(lengths),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(values).ravel().view(np.int64))),
                        _binary(short, np.cumsum(np.where(held, 2 * PERMUTATIONS, 0))),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "bands", "signature"],
                )

    known = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id IS NOT NULL")
    return known.mapInArrow(sketched, SKETCH)


def _filter_places(ids: np.ndarray) -> np.ndarray:
    return np.stack([mixed(ids.astype(np.uint64) ^ np.uint64(salt)) % np.uint64(FILTER_BITS) for salt in (7, 8)]).astype(np.int64)


def candidate_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids in `node`, FILTER_BITS long whatever their number.

    It only saves work: a document let through by chance meets no candidate later.
    """

    def bits(batches):
        own = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            own[_filter_places(batch.column("node").to_numpy(zero_copy_only=False)).ravel()] = True
        rows = np.packbits(own).view(np.int64)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at])], ["at", "bits"])

    parts = ids.select("node").mapInArrow(bits, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    rows = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in parts.toArrow().to_batches():
        rows[batch.column("at").to_numpy()] = batch.column("bits").to_numpy()
    return rows.view(np.uint8)


def shingle_sets(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """The whole shingle sets of the documents that the filter lets through."""

    def made(batches):
        for batch in batches:
            places = _filter_places(batch.column("node").to_numpy(zero_copy_only=False))
            let = ((wanted[places >> 3] >> (7 - (places & 7))) & 1).all(axis=0)
            for part in portions(batch.filter(pa.array(let))):
                keys, lengths = shingles(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("node"), _binary(keys.astype("<u8"), np.cumsum(lengths))], ["node", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").filter("node IS NOT NULL").mapInArrow(made, SETS)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ordered sets reach the similarity."""
    if len(a) < len(b):
        a, b = b, a
    if 100 * len(b) < percent * len(a):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sets_of(group: pa.Table) -> dict[int, list[np.ndarray]]:
    """The sets of each node; an id that stands for several texts has several."""
    out: dict[int, list[np.ndarray]] = {}
    for node, data in zip(group.column("node").to_pylist(), group.column("shingles").to_pylist()):
        out.setdefault(node, []).append(np.frombuffer(data, "<u8"))
    return out


def _any_similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> bool:
    return any(similar(x, y, percent) for x in a for y in b)


def _blocks(count, of, size):
    """How many blocks of about `size` hold `count` members, and the block of a member."""
    n = F.ceil(count / size).cast("bigint")
    return n, F.pmod(F.xxhash64(of, F.lit(3)), n)


def _star_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """One confirmed link per document, where there is one, to the centre it shares most bands with.

    Each bucket names a centre, by an order of its own; cells hold a centre with some of those
    that chose it, so a centre of many documents is spread over tasks.
    """
    centres = stored(buckets.groupBy("key").agg((F.min(F.col("node").bitwiseXOR(F.col("key")))).alias("x"), F.count("*").alias("n")).filter("n > 1"), "centres")
    named = centres.select("key", F.col("x").bitwiseXOR(F.col("key")).alias("centre"))
    shared = buckets.join(named, "key").filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("shared"))
    order = F.col("shared") + F.pmod(F.xxhash64("node", "centre"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = stored(shared.groupBy("node").agg(F.max_by("centre", order).alias("centre")), "chosen")
    sizes = stored(chosen.groupBy("centre").agg(F.count("*").alias("n")), "sizes")
    n, block = _blocks(F.col("n"), F.col("node"), CELL)
    members = chosen.join(sizes, "centre").select(F.xxhash64("centre", block).alias("cell"), "node", "centre")
    middle = sizes.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("block"))
    cells = members.unionByName(middle.select(F.xxhash64("centre", "block").alias("cell"), "node", "centre"))

    def confirmed(batches):
        for group in runs(batches, "cell"):
            centre = group.column("centre")[0].as_py()
            sets_ = _sets_of(group)
            own = sets_.pop(centre, None)
            linked = [node for node, s in sets_.items() if own and _any_similar(own, s, percent)]
            yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array([centre] * len(linked), pa.int64())], ["a", "b"])

    dealt = cells.join(sets, "node").repartition("cell").sortWithinPartitions("cell", "centre")
    return dealt.mapInArrow(confirmed, "a bigint, b bigint")


def _open_cells(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component so far, dealt into cells.

    A bucket of several blocks has a cell for each pair of them; `side` tells a member's block.
    """
    known = buckets.join(labels, buckets["node"] == labels["member"], "left").select("key", "band", "node", F.coalesce("root", "node").alias("component"))
    known = stored(known, "labelled")
    several = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    several = stored(several.filter("low <> high").select("key", "n"), "several")
    n, block = _blocks(F.col("n"), F.col("node"), SIGNATURE_CELL)
    rows = known.join(several, "key").withColumn("blocks", n).withColumn("side", block)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    cell = F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other"))
    return rows.select(cell.alias("cell"), "band", "node", "component", (F.col("side") - F.col("other")).alias("half"))


def _partners(cells: DataFrame, signatures_: DataFrame, percent: int) -> DataFrame:
    """Per cell the documents whose signatures come near to another component's, with whom.

    A pair is listed in the cell of the first band it shares, under one of the two.
    """
    schema = "cell bigint, node bigint, component bigint, partners array<bigint>"

    def near(batches):
        for group in runs(batches, "cell"):
            node = group.column("node").to_numpy()
            component = group.column("component").to_numpy()
            half = group.column("half").to_numpy()
            sizes = group.column("n_shingles").to_numpy()
            band = group.column("band")[0].as_py()
            values = np.stack([np.frombuffer(s, "<u2") for s in group.column("signature").to_pylist()])
            keys = group.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            across = (half != 0).any()
            found: dict[int, list[int]] = {}
            for i in range(len(node)):
                after = slice(i + 1, None)
                fits = (component[after] != component[i]) & (node[after] != node[i])
                if across:  # the blocks meet their own members elsewhere
                    fits &= np.sign(half[after]) == -np.sign(half[i])
                fits &= 100 * np.minimum(sizes[after], sizes[i]) >= percent * np.maximum(sizes[after], sizes[i])
                rows = np.flatnonzero(fits) + i + 1
                if not len(rows):
                    continue
                equal = values[rows] == values[i]
                rows = rows[equal.mean(axis=1) >= ESTIMATE]
                # By the keys of the buckets: the signature's few bits can agree where no bucket is shared.
                rows = rows[~(keys[rows, :band] == keys[i, :band]).any(axis=1)]
                if len(rows):
                    found.setdefault(i, []).extend(node[rows].tolist())
                    for j in rows.tolist():
                        found.setdefault(j, [])
            kept = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [
                    group.column("cell").combine_chunks().take(pa.array(kept, pa.int64())),
                    pa.array(node[kept]),
                    pa.array(component[kept]),
                    pa.array([found[i] for i in kept], pa.list_(pa.int64())),
                ],
                ["cell", "node", "component", "partners"],
            )

    dealt = cells.join(signatures_, "node").repartition("cell").sortWithinPartitions("cell", "half", "node")
    return dealt.mapInArrow(near, schema)


def _cell_links(partners: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between components: of each cell a forest, which joins what its pairs join."""

    def confirmed(batches):
        for group in runs(batches, "cell"):
            sets_ = _sets_of(group)
            component = dict(zip(group.column("node").to_pylist(), group.column("component").to_pylist()))
            parent = {c: c for c in component.values()}

            def top(c):
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            links = []
            for node, others in zip(group.column("node").to_pylist(), group.column("partners").to_pylist()):
                for other in others:
                    if other not in component:
                        continue
                    a, b = top(component[node]), top(component[other])
                    if a != b and _any_similar(sets_[node], sets_[other], percent):
                        parent[a] = b
                        links.append((component[node], component[other]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    dealt = partners.join(sets, "node").repartition("cell").sortWithinPartitions("cell", "node")
    return dealt.mapInArrow(confirmed, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept, a row per row of `docs`.

    Two documents are linked when 100 times their common shingles are at least `percent` times
    their united ones; `component_id` is the smallest id that links reach, `kept` tells the
    document that stands for its component. Equal sets are one class from the start and count
    through their smallest id. Classes that share a band are candidates; links are confirmed on
    the whole sets. First every class is compared with one centre. Then, in every bucket that
    still holds several components, all pairs between components are compared by signature and
    those that may reach the similarity on their sets, so that no pair of candidates is left out
    but those already joined.

    A text without words, or null, has no shingles, is linked with nothing and kept. A row
    without id takes no part: its component is null and it is kept. Repeated rows get equal rows;
    rows that share an id but not their text are judged each by its text. An empty table gives
    no rows; other columns are not read.
    """
    found = stored(sketch(docs, words_per_shingle), "sketch")
    classes = found.filter("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "classes")
    own = found.join(classes.withColumnRenamed("node", "doc_id"), ["fp1", "fp2", "doc_id"], "left_semi")
    own = own.select(F.col("doc_id").alias("node"), "n_shingles", "signature", "bands")
    banded = own.select("node", F.posexplode("bands").alias("band", "key"))
    several = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = stored(banded.join(several, "key", "left_semi").distinct(), "buckets")
    sets = shingle_sets(docs, words_per_shingle, candidate_filter(buckets.select("node").distinct()))

    first = components(_star_links(buckets, sets, percent)).select(F.col("node").alias("member"), "root")
    partners = stored(_partners(_open_cells(buckets, first), own.select("node", "n_shingles", "signature", "bands"), percent), "partners")
    second = components(_cell_links(partners, sets, percent)).select(F.col("node").alias("first_root"), F.col("root").alias("last_root"))

    roots = classes.join(first, classes["node"] == first["member"], "left").select("fp1", "fp2", F.coalesce("root", "node").alias("root"))
    roots = roots.join(second, roots["root"] == second["first_root"], "left").select("fp1", "fp2", F.coalesce("last_root", "root").alias("root"))
    roots = stored(roots, "roots")
    listed = found.select("doc_id", "n_shingles", "fp1", "fp2").join(roots, ["fp1", "fp2"], "left")
    # A text without shingles hashes to 0, 0 and finds no class.
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    listed = listed.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    nameless = docs.filter(F.col("doc_id").cast("bigint").isNull()).select("doc_id", "text")
    rest = sketch(nameless.withColumn("doc_id", F.lit(0).cast("bigint")), words_per_shingle)
    null = F.lit(None).cast("bigint")
    return listed.unionByName(rest.select(null.alias("doc_id"), "n_shingles", null.alias("component_id"), F.lit(True).alias("kept")))


def representatives(docs: DataFrame, words_per_shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, in all their columns; of repeated rows one.

    Rows without id all stay. Columns may have any names beside doc_id and text.
    """
    name = unused(docs, "kept_id")
    kept = near_duplicates(docs, words_per_shingle, percent).filter("kept AND doc_id IS NOT NULL")
    kept = kept.select(F.col("doc_id").alias(name)).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col(name), "left_semi")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id IS NULL"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2)


ORACLE = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM split
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b
    ON a.item = b.item AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN smallest m USING (doc_id)
"""
