"""Ranked text search over a stored inverted index, for questions that come as a table.

The index holds, for every term and part of the corpus, the documents with the term and its count
in them. A part is a bounded number of documents of like length, so a frequent term is many rows,
none of them large. Asking reads the rows of the asked terms alone, and scores only the
parts that can still hold one of the k best: the figures beside the lists (the best weight of a
term in a part) bound what a document of the part may score.

A list keeps the gaps between its documents' places in the part, and the counts, in as few bytes as
its largest one takes. The empty term has a row for each document of a part: its id and, as its
weight, its norm; documents have their places in the order of their ids. What a shuffle moves is
packed first: the rows of a batch with one key are one compressed block.

Scores are those of `search.search_text`: a document weighs a term 1 + ln(tf) over its own norm,
a question the same times ln(1 + N / df). They are summed as whole numbers of 10^-15, so that no order
of rows shows in a sum and documents that are alike stay tied; ties go to the smaller id.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimflow import vocab
from claimflow.operators.search import portions, ranked_hits
from claimflow.session import scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 1e15
# Documents of a part and bytes of their text, and folders that the terms are dealt into.
PART_DOCUMENTS, PART_BYTES, BUCKETS = 4_096, 16 << 20, 64
# Lengths within a factor of 2^(1/BANDS) are alike.
BANDS = 4
# Bytes of text of which the lists of a folder are sorted by one task.
FOLDER_BYTES = 1 << 30
LISTS = "term string, part bigint, n bigint, best double, gaps binary, counts binary, doc_id {kind}"
# Parts that a question looks into before its bound is known.
FIRST_PARTS = 2
# Neighbouring parts that one task holds the lists of, and questions that meet them there.
SHARD_PARTS, SALT_ROWS = 16, 65_536
# Documents of questions, and entries of lists, that a task adds up at once.
CELLS = 1 << 19
# Documents of a part for one of a list that is kept as a row over all of them.
DENSE = 8


# --- blocks --------------------------------------------------------------------------------------


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, whole numbers, and a compressed block of the other columns for each of them in a batch."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in keys])
            batch = batch.take(order)
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            rest = batch.drop_columns(keys)
            new = np.flatnonzero(np.any([a[1:] != a[:-1] for a in own], axis=0)) + 1
            starts, blocks = np.concatenate([[0], new]), []
            for start, stop in zip(starts, [*new, batch.num_rows]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rest.slice(start, stop - start))
                blocks.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(a[starts], pa.int64()) for a in own), pa.array(blocks, pa.binary())], [*keys, "block"])

    return rows.mapInArrow(pack, ", ".join(f"{c} bigint" for c in keys) + ", block binary")


def _tables(blocks: pa.Table):
    for block in blocks.column("block"):
        yield pa.ipc.open_stream(block.as_buffer()).read_all()


def _binary(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Whole numbers below 2^32 as one value for each list, in 1, 2 or 4 bytes a number."""
    top = np.maximum.reduceat(values, starts) if len(starts) else values
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))
    used = np.arange(4) < np.repeat(width, sizes)[:, None]
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[used]
    ends = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _numbers(lists: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all lists one after the other."""
    width = pc.binary_length(lists).to_numpy(zero_copy_only=False) // sizes
    found = np.zeros(int(sizes.sum()), np.int64)
    for w in (1, 2, 4):
        own = np.flatnonzero(width == w)
        if len(own):
            data = b"".join(lists.take(pa.array(own)).to_pylist())
            found[np.repeat(width == w, sizes)] = np.frombuffer(data, f"<u{w}")
    return found


# --- the index -----------------------------------------------------------------------------------


def _counted(batches):
    """For portions of documents (doc_id, text): the row, term and count of each pair, the terms, and the documents' norms."""
    for batch in portions(batches):
        parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(batch.column(1), "")), "[^a-z]+")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        flat = parts.flatten()
        full = pc.not_equal(flat, "")
        coded = flat.filter(full).dictionary_encode()
        n = max(len(coded.dictionary), 1)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique(row[full.to_numpy(zero_copy_only=False)] * n + codes, return_counts=True)
        # By count, so that the norms of documents that are alike are the same to the last bit.
        order = np.lexsort((tf, pair // n))
        row, code, tf = (pair // n)[order], (pair % n)[order], tf[order]
        weight = 1 + np.log(tf)
        yield row, code, tf, coded.dictionary, np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))


def _lists(kind: pa.DataType):
    """The lists of a part, from its documents."""

    def lists(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        docs = pa.concat_tables(_tables(blocks)).combine_chunks()
        ids = docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], kind)
        place = pc.rank(ids, "ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64) - 1
        found, names, norms, done, known = ([], [], []), [], [], 0, 0
        for row, code, tf, terms, norm in _counted(docs.to_batches()):
            found[0].append((row + done).astype(np.int32)), found[1].append((code + known).astype(np.int32)), found[2].append(tf.astype(np.int32))
            names.append(terms), norms.append(norm)
            done, known = done + len(norm), known + len(terms)
        row, code, tf = map(np.concatenate, found)
        norm = np.concatenate(norms)
        terms = pa.concat_arrays(names).dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False)[code]
        order = np.argsort(code.astype(np.int64) * len(ids) + place[row], kind="stable")
        row, code, tf = row[order], code[order], tf[order]
        sizes = np.bincount(code, minlength=len(terms.dictionary))
        starts = np.cumsum(sizes) - sizes
        gaps = np.diff(place[row], prepend=0)
        gaps[starts] = place[row[starts]]
        alone = np.unique(place, return_index=True)[1]  # rows of one id are one document
        n, none = len(sizes), len(alone)
        joined = lambda a, b: pa.concat_arrays([a, b])
        return pa.table(
            {
                "term": joined(terms.dictionary.cast(pa.string()), pa.array([""] * none, pa.string())),
                "part": np.full(n + none, key[0].as_py(), np.int64),
                "n": np.concatenate([sizes, np.ones(none)]).astype(np.int64),
                "best": np.concatenate([np.maximum.reduceat((1 + np.log(tf)) / norm[row], starts) if n else np.zeros(0), norm[alone]]),
                "gaps": joined(_binary(gaps, starts, sizes), pa.nulls(none, pa.binary())),
                "counts": joined(_binary(tf, starts, sizes), pa.nulls(none, pa.binary())),
                "doc_id": joined(pa.nulls(n, kind), ids.take(pa.array(alone))),
            }
        )

    return lists


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, root: str, part_documents: int = PART_DOCUMENTS) -> None:
    """Store the index of `docs` (doc_id, of any type and distinct; text) below `root`.

    The texts are counted by band of lengths (some hundred numbers, all that the driver sees), then
    move to their part once, compressed, and are taken apart there: no row is made for a term of a document.
    A group is a part's documents at most. Documents without a word, or without text, count in N only.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    length = F.octet_length("text")
    sized = docs.select("doc_id", "text", F.floor(F.log2(length) * BANDS).alias("band"))
    sizes = sized.groupBy("band").agg(F.count("*").alias("n"), F.sum(length).alias("bytes")).orderBy("band").collect()
    counted = spark.range(1, numPartitions=1).select(F.lit(sum(r["n"] for r in sizes)).cast("bigint").alias("documents"), F.lit(kind).alias("kind"))
    counted.write.parquet(f"{root}/corpus")
    # Parts are numbered through the bands, so that neighbours hold documents of like length.
    slots, offsets, total = {}, {}, 0
    for r in sizes:
        if r["bytes"]:
            slots[r["band"]], offsets[r["band"]] = max(-(-r["n"] // part_documents), -(-r["bytes"] // PART_BYTES)), total
            total += slots[r["band"]]
    numbers = lambda of: F.create_map(*[F.lit(x).cast("bigint") for pair in (of or {0: 1}).items() for x in pair])[F.col("band")]
    part = numbers(offsets) + F.pmod(F.xxhash64("doc_id"), numbers(slots))
    dealt = _packed(sized.filter(length > 0).select("doc_id", "text", part.cast("bigint").alias("part")), ["part"])
    lists = dealt.groupBy("part").applyInArrow(_lists(to_arrow_type(docs.schema["doc_id"].dataType)), LISTS.format(kind=kind))
    # A term's lists are in one file, of its folder or of a slice of it.
    slices = -(-sum(r["bytes"] or 0 for r in sizes) // (FOLDER_BYTES * BUCKETS)) or 1
    placed = lists.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket", F.pmod(F.crc32("term"), F.lit(slices)))
    ordered = placed.sortWithinPartitions("bucket", "term", "part")
    ordered.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings")


def read_postings(spark: SparkSession, root: str, terms: list[str] | None = None) -> DataFrame:
    """The lists of the index; of known terms only where they are given, whose folders and rows alone are read."""
    kind = spark.read.parquet(f"{root}/corpus").first()["kind"]
    lists = spark.read.schema(f"{LISTS.format(kind=kind)}, bucket int").parquet(f"{root}/postings")
    if terms is None:
        return lists
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"))).distinct().collect()] if terms else []
    return lists.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


# --- asking --------------------------------------------------------------------------------------


def _weighted_terms(questions: DataFrame, lists: DataFrame, documents: int) -> DataFrame:
    """query_id, term and the question's weight of it, of terms that the corpus knows."""
    words = F.explode(F.split(F.lower(F.coalesce("question", F.lit(""))), "[^a-z]+"))
    asked = questions.select("query_id", words.alias("term")).filter("term <> ''").groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    known = lists.groupBy("term").agg(F.sum("n").alias("df"))
    value = (1 + F.log("tf")) * F.log1p(F.lit(float(documents)) / F.col("df"))
    valued = asked.join(known, "term").select("query_id", "term", value.alias("value"))
    # In the order of the terms: a question's norm is the same on every run. A group is one question's terms.
    terms = F.array_sort(F.collect_list(F.struct("term", "value")))
    whole = valued.groupBy("query_id").agg(terms.alias("terms"))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["value"] * t["value"]))
    each = whole.select("query_id", norm.alias("norm"), F.explode("terms").alias("t")).filter("norm > 0")
    return each.select("query_id", F.col("t.term").alias("term"), (F.col("t.value") / F.col("norm")).alias("value"))


def _asked_schema(questions: DataFrame) -> str:
    return f"query_id {questions.schema['query_id'].dataType.simpleString()}, term string, value double"


def _shard() -> Column:
    return F.floor(F.col("part") / SHARD_PARTS).cast("bigint")


def _salts(weighted: DataFrame) -> Column:
    return weighted.agg(F.greatest(F.ceil(F.count_distinct("query_id") / SALT_ROWS), F.lit(1)).cast("bigint").alias("salts")).scalar()


def _questions(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("value").alias("values"))


def _meet(asked: DataFrame, weighted: DataFrame, lists: DataFrame, found, schema: str) -> DataFrame:
    """What `found` makes of the lists of a shard and the questions that look into it: query_id, shard, terms, values.

    No row is made for a question and a document. The lists of a shard are copied for each SALT_ROWS
    questions there are; their blocks do not depend on the pairs, so that one shuffle of them serves all.
    """
    blocks = _packed(lists.drop("bucket").withColumn("shard", _shard()), ["shard"])
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), _salts(weighted) - 1)))
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), _salts(weighted)).cast("bigint"))
    return copies.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(found, schema)


class _Asked:
    """The questions of a shard, term by term, and the lists of its parts that they ask for."""

    def __init__(self, blocks: pa.Table, questions: pa.Table):
        terms = questions.column("terms").combine_chunks()
        self.row = np.repeat(np.arange(questions.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        self.value = questions.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False) * UNIT
        coded = terms.flatten().dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        wanted, held = pa.concat_arrays([coded.dictionary, pa.array([""], coded.dictionary.type)]), []
        for table in _tables(blocks):
            own = pc.index_in(table.column("term"), value_set=wanted)
            held.append(table.append_column("code", own).filter(pc.is_valid(own)).drop_columns(["term"]))
        self.lists = pa.concat_tables(held).combine_chunks()
        self.terms = len(coded.dictionary)

    def parts(self):
        """For each part its number, its lists, the rows of its documents and the list of each entry, -1 where it has none."""
        order = pc.sort_indices(self.lists, sort_keys=[("part", "ascending"), ("code", "ascending")])
        lists, self.lists = self.lists.take(order), None
        part, code = lists.column("part").to_numpy(), lists.column("code").to_numpy()
        ends = np.flatnonzero(np.diff(part, append=part[-1:] - 1)) + 1
        for start, stop in zip([0, *ends[:-1]], ends):
            held = start + int(np.searchsorted(code[start:stop], self.terms))
            at = np.full(self.terms, -1)
            at[code[start:held]] = np.arange(held - start)
            yield int(part[start]), lists.slice(start, held - start), lists.slice(held, stop - held), at[self.code]


def _bounds_of_shard(blocks: pa.Table, questions: pa.Table) -> pa.Table:
    """The most that a document of each part can score for each question, in units."""
    found = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    if blocks.num_rows and questions.num_rows:
        asked = _Asked(blocks, questions)
        for part, lists, _, at in asked.parts():
            own = np.flatnonzero(at >= 0)
            if not len(own):
                continue
            most = np.floor(asked.value[own] * lists.column("best").to_numpy()[at[own]]).astype(np.int64)
            starts = np.flatnonzero(np.diff(asked.row[own], prepend=-1))
            most = np.add.reduceat(most, starts)
            found[0].append(asked.row[own][starts]), found[1].append(np.full(len(starts), part)), found[2].append(most)
    row, part, bound = map(np.concatenate, found)
    return pa.table({"query_id": questions.column("query_id").take(pa.array(row)), "part": pa.array(part), "bound": pa.array(bound)})


def bounds(weighted: DataFrame, lists: DataFrame) -> DataFrame:
    """The most that a document of a part can score for a question, and the parts' order by it."""
    last = lists.agg(F.max(_shard()).alias("last")).scalar()
    asked = _questions(weighted).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    query = weighted.schema["query_id"].dataType.simpleString()
    found = _meet(asked, weighted, lists, _bounds_of_shard, f"query_id {query}, part bigint, bound bigint").filter("bound > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "part")
    return found.withColumn("place", F.row_number().over(order))


class _Part:
    """The asked lists of a part, entry by entry."""

    def __init__(self, lists: pa.Table, documents: pa.Table):
        documents = documents.take(pc.sort_indices(documents, sort_keys=[("doc_id", "ascending")]))
        self.ids, norms = documents.column("doc_id").combine_chunks(), documents.column("best").to_numpy()
        sizes = lists.column("n").to_numpy()
        gaps = _numbers(lists.column("gaps").combine_chunks(), sizes)
        starts = np.cumsum(sizes) - sizes
        along = np.cumsum(gaps)
        place = along - np.repeat(along[starts] - gaps[starts], sizes)
        weight = 1 + np.log(_numbers(lists.column("counts").combine_chunks(), sizes))
        again = gaps == 0  # a document whose id came twice
        again[starts] = False
        listed = np.repeat(np.arange(len(sizes)), sizes)[~again]
        self.n, self.place, self.weight = len(self.ids), place[~again], (weight / norms[place])[~again]
        self.size = np.bincount(listed, minlength=len(sizes))
        self.start = np.cumsum(self.size) - self.size
        # Frequent lists also as a row over all documents.
        common = self.size * DENSE >= self.n
        self.dense = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((np.count_nonzero(common), self.n))
        own = common[listed]
        self.rows[self.dense[listed[own]], self.place[own]] = self.weight[own]

    def added(self, row, at, value, rows: int) -> np.ndarray:
        """The sums of all entries of lists `at`, for each row and document: whole numbers below 2^53, so that they are exact."""
        dense = self.dense[at]
        few = np.flatnonzero(dense < 0)
        n = self.size[at[few]]
        entry = np.repeat(self.start[at[few]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        amount = np.floor(np.repeat(value[few], n) * self.weight[entry])
        total = np.bincount(np.repeat(row[few] * self.n, n) + self.place[entry], amount, minlength=rows * self.n)
        total, amount, often = total.reshape(rows, self.n).astype(float, copy=False), np.empty(self.n), np.flatnonzero(dense >= 0)
        for r, d, v in zip(row[often].tolist(), dense[often].tolist(), value[often].tolist()):
            np.multiply(self.rows[d], v, out=amount)
            np.floor(amount, out=amount)
            own = total[r]
            own += amount
        return total


def _stretches(cost: np.ndarray):
    """Neighbours whose costs sum up to CELLS at most; one alone may cost more."""
    ends, start = np.cumsum(cost), 0
    while start < len(cost):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, side="right")))
        yield start, stop
        start = stop


def _best_of_block(part: _Part, row, at, value, least, k: int):
    """Row, place and score of the k best documents of each row that reach its least score; entries come by row."""
    rows, found = len(least), ([], [], [])
    cost = part.n + np.bincount(row, np.where(part.dense[at] < 0, part.size[at], 0), minlength=rows).astype(np.int64)
    for first, last in _stretches(cost):
        own = slice(*np.searchsorted(row, [first, last]))
        total = part.added(row[own] - first, at[own], value[own], last - first)
        need = np.maximum(least[first:last], 1)
        held = total >= need[:, None]
        if np.count_nonzero(held) > 8 * k * (last - first) and part.n > k:
            held = total >= np.maximum(need, np.partition(total, part.n - k, axis=1)[:, part.n - k])[:, None]
        own, place = np.nonzero(held)
        score = total[own, place]
        order = np.lexsort((place, -score, own))
        per = np.bincount(own, minlength=last - first)
        order = order[np.arange(len(order)) - (np.cumsum(per) - per)[own[order]] < k]
        found[0].append(own[order] + first), found[1].append(place[order]), found[2].append(score[order])
    return map(np.concatenate, found)


def _best_of_shard(k: int, kind: pa.DataType):
    """For the lists of a shard and the questions that meet them: the k best documents of each question in each part, in units."""

    def best(blocks: pa.Table, questions: pa.Table) -> pa.Table:
        found = ([np.zeros(0, np.int64)], [pa.array([], kind)], [np.zeros(0)])
        if blocks.num_rows and questions.num_rows:
            asked = _Asked(blocks, questions)
            least = questions.column("least").to_numpy().astype(float)
            top = np.zeros((len(least), k))
            looks = questions.column("parts").combine_chunks()
            looking = np.repeat(np.arange(len(least)), pc.list_value_length(looks).to_numpy(zero_copy_only=False))
            looks = looks.flatten().to_numpy(zero_copy_only=False)
            for number, lists, documents, at in asked.parts():
                wants = np.zeros(len(least), bool)
                wants[looking[looks == number]] = True
                own = np.flatnonzero((at >= 0) & wants[asked.row])
                if not len(own):
                    continue
                part = _Part(lists, documents)
                pa.default_memory_pool().release_unused()
                used, row = np.unique(asked.row[own], return_inverse=True)
                row, place, score = _best_of_block(part, row, at[own], asked.value[own], least[used], k)
                # The k-th score of a question so far is the least that counts in the next part.
                per = np.bincount(row, minlength=len(used))
                new = np.zeros((len(used), k))
                new[row, np.arange(len(row)) - (np.cumsum(per) - per)[row]] = score
                top[used] = np.sort(np.concatenate([top[used], new], axis=1), axis=1)[:, -k:]
                least[used] = np.maximum(least[used], top[used, 0])
                found[0].append(used[row]), found[1].append(part.ids.take(pa.array(place))), found[2].append(score)
        query = questions.column("query_id").take(pa.array(np.concatenate(found[0])))
        return pa.table({"query_id": query, "doc_id": pa.concat_arrays(found[1]), "score": pa.array(np.concatenate(found[2]).astype(np.int64))})

    return best


def _scored(pairs: DataFrame, weighted: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """The k best documents of each (question, part) pair, in units, but for those that cannot be a hit of the question.

    The questions that look into a shard of parts meet its lists in one task; where the pairs
    have a `least` score, lower ones are left out.
    """
    least = F.col("least") if "least" in pairs.columns else F.lit(1).cast("bigint")
    wanted = pairs.select("query_id", "part", least.alias("least"), _shard().alias("shard"))
    wanted = wanted.groupBy("query_id", "shard").agg(F.collect_list("part").alias("parts"), F.min("least").alias("least"))
    asked = wanted.join(_questions(weighted), "query_id")
    kind = lists.schema["doc_id"].dataType
    query = pairs.schema["query_id"].dataType.simpleString()
    return _meet(asked, weighted, lists, _best_of_shard(k, to_arrow_type(kind)), f"query_id {query}, doc_id {kind.simpleString()}, score bigint")


def looked_into(weighted: DataFrame, lists: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First hits, and the (question, part) pairs looked into at first and then.

    After the first parts of a question its k-th score is known; a part whose bound is
    below it holds no hit and is not read. A part that may tie is.
    """
    placed = bounds(weighted, lists)
    first = placed.filter(F.col("place").isin(*range(1, FIRST_PARTS + 1)))  # of the rows that the others come from: a limit would rank them anew
    hits = ranked_hits(_scored(first, weighted, lists, k), k)
    kth = hits.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("hits")).filter(F.col("hits") == k).drop("hits")
    left = placed.filter(F.col("place") > FIRST_PARTS).join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    return hits, first, left.filter(F.col("bound") >= F.col("least"))


def search_index(spark: SparkSession, root: str, questions: DataFrame, k: int = vocab.SEARCH_HITS, terms: list[str] | None = None) -> DataFrame:
    """The k best documents per question: query_id, doc_id, score, rank.

    `questions` (query_id, question) is a table of any size; `terms`, if given, are all its terms,
    for a few questions: they reach the scan as a filter. No list of questions is held anywhere, and
    no question meets a document it shares no term with. Each question's k best of a part leave it.
    The weighted terms of the questions are found and stored by the call, since every step reads them.
    A question with no known term has no hit; a null question has none.
    """
    lists = read_postings(spark, root, terms)
    if terms is not None:  # and the documents of the parts
        lists = lists.unionByName(read_postings(spark, root, [""]))
    documents = spark.read.parquet(f"{root}/corpus").first()["documents"]
    path = scratch(spark, "asked")
    _weighted_terms(questions, lists, documents).write.parquet(path)
    weighted = spark.read.schema(_asked_schema(questions)).parquet(path)
    hits, _, rest = looked_into(weighted, lists, k)
    more = _scored(rest, weighted, lists, k)
    both = ranked_hits(hits.select("query_id", "doc_id", "score").unionByName(more), k)
    return both.withColumn("score", F.col("score") / UNIT)


def terms_in(questions: list[tuple[int, str]]) -> list[str]:
    """The distinct terms of a short list of questions."""
    words = pc.split_pattern_regex(pc.utf8_lower(pa.array([q or "" for _, q in questions], pa.string())), "[^a-z]+")
    return sorted({t for t in words.flatten().to_pylist() if t})
