"""Language identification with character language models (operator 1)."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.text import mixed, portions, remainder, sampled_ids, sampled_texts, spans, starts_of, sums, table, words

ORDER = 4
# Bound of the sample that the models are fitted on: documents per language, whole.
FIT_DOCS = 400
# Share of the fitting documents that the calibrated limit may reject, room beyond it in bits a
# letter, and more of it for a short text of n letters: REJECT_SHORT / sqrt(n).
REJECT_SHARE, REJECT_ROOM, REJECT_SHORT = 0.002, 1.0, 8.0
NONE = "und"
PREDICTIONS = "doc_id bigint, lang_pred string, score double, bits double, rejected boolean"


def _letters(words_: pa.Array) -> pa.Array:
    """Lower-cased words without anything but letters."""
    return pc.replace_substring_regex(pc.utf8_lower(words_), r"[^\p{L}]+", "")


def _grams(cleaned: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ORDER characters ending at each letter and at the end of each word.

    Returns a (n, ORDER) matrix of code points, 32 standing before and after a word, and the
    windows per word; an empty word has none. No context reaches beyond its word.
    """
    lengths = pc.utf8_length(cleaned).to_numpy(zero_copy_only=False).astype(np.int64)
    held = lengths > 0
    counts = np.where(held, lengths + 1, 0)
    joined = "".join(cleaned.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    pad = ORDER - 1
    sizes = np.where(held, lengths + ORDER, 0)  # pad before, one end after
    line = np.full(int(sizes.sum()), 32, np.uint32)
    line[np.repeat(starts_of(sizes) + pad, lengths) + spans(lengths)] = points
    ends = np.repeat(starts_of(sizes) + pad, counts) + spans(counts)
    return line[ends[:, None] + np.arange(-pad, 1)], counts


def _hash(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    key = np.full(len(grams), grams.shape[1], np.uint64)
    for column in grams.T:
        key = mixed(key ^ column.astype(np.uint64)) if grams.shape[1] > 2 else (key << np.uint64(21)) | column.astype(np.uint64)
    return key


class KneserNey:
    """An interpolated Kneser-Ney model of one language in sorted hash arrays.

    Level n holds the hashes of its n-grams in order and, beside them, the discounted share of
    each in its context; contexts lie likewise with the weight they leave to the level below.
    The top level counts occurrences, those below count the distinct characters before a gram.
    """

    def __init__(self, grams: np.ndarray, weights: np.ndarray, alphabet: int):
        self.alphabet = alphabet
        self.levels = []
        keys = pd.DataFrame(grams).assign(w=weights).groupby(list(range(ORDER)), as_index=False)["w"].sum()
        rows, counts = keys[list(range(ORDER))].to_numpy(np.uint32), keys["w"].to_numpy(np.float64)
        for n in range(ORDER, 0, -1):
            self.levels.append(self._level(rows, counts))
            if n > 1:  # continuation counts: one for each distinct longer gram
                shorter = pd.DataFrame(rows[:, 1:]).groupby(list(range(n - 1)), as_index=False).size()
                rows, counts = shorter[list(range(n - 1))].to_numpy(np.uint32), shorter["size"].to_numpy(np.float64)
        self.levels.reverse()

    @staticmethod
    def _level(rows: np.ndarray, counts: np.ndarray):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, inverse = np.unique(_hash(rows[:, :-1]), return_inverse=True)
        total = np.bincount(inverse, counts)
        kinds = np.bincount(inverse)
        hashed = _hash(rows)
        order = np.argsort(hashed)
        share = np.maximum(counts - discount, 0) / total[inverse]
        return hashed[order], share[order], contexts, discount * kinds / total

    def bits(self, hashed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Bits of the last character of each gram; `hashed` has gram and context hashes per level."""
        p = np.full(len(hashed[0][0]), 1.0 / self.alphabet)
        for (grams, contexts), (known, share, known_contexts, left) in zip(hashed, self.levels):
            p = _found(known, share, grams, 0.0) + _found(known_contexts, left, contexts, 1.0) * p
        return -np.log2(p)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


class Languages:
    """The models of all languages with the calibrated limits."""

    def __init__(self, models: dict[str, KneserNey], limits: dict[str, float]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.limits = np.array([limits.get(n, np.inf) for n in self.names])

    def cross_entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text under each model, and the characters (letters and word ends)."""
        codes, counts, distinct = words(texts, lower=False)
        grams, sizes = _grams(_letters(distinct))
        if not len(grams):
            return np.zeros((len(counts), len(self.names))), np.zeros(len(counts))
        packed = grams[:, 0].astype(np.uint64)
        for column in grams.T[1:]:
            packed = mixed(packed) ^ column.astype(np.uint64)
        which, first = pd.factorize(packed)  # each distinct window is looked up once
        seen = np.zeros(len(first), np.int64)
        seen[which[::-1]] = np.arange(len(packed))[::-1]
        unique = grams[seen]
        hashed = [(_hash(unique[:, -n:]), _hash(unique[:, -n:-1])) for n in range(1, ORDER + 1)]
        per_gram = np.stack([m.bits(hashed) for m in self.models], axis=1)
        per_word = sums(per_gram[which], sizes)
        total = sums(per_word[codes], counts)
        n = sums(sizes[codes].astype(np.float64), counts)
        return total / np.maximum(n, 1)[:, None], n

    def judge(self, texts: pa.Array):
        """Language, score, bits a character and rejection of each text."""
        bits, n = self.cross_entropy(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        # A posterior from the summed bits; characters are not independent, so at most 40 count.
        gap = np.exp2(-(bits - least[:, None]) * np.minimum(n, 40)[:, None])
        held = n > 0
        names = np.where(held, np.array(self.names, object)[best], NONE)
        return names, np.where(held, 1 / gap.sum(axis=1), 0.0), least, ~held | (least > self.limits[best] + REJECT_SHORT / np.sqrt(np.maximum(n, 1)))


def fit(labelled: DataFrame, per_language: int = FIT_DOCS, seed: int = 11) -> Languages:
    """Models from the non-null lang and the text of `labelled`, on a bounded sample.

    Of each language the `per_language` documents smallest by hash enter with their whole texts;
    tasks count their windows and measure them, and the driver gets the sums. The limit of a language lets pass all but REJECT_SHARE of its own sample, and
    REJECT_ROOM bits more.
    """
    known = labelled.filter(F.col("lang").isNotNull())
    names = sorted(r[0] for r in known.select("lang").distinct().collect())
    chosen = [(i, n) for n in names for i in sampled_ids(known.filter(F.col("lang") == n), per_language, seed)]
    sample = sampled_texts(labelled, chosen, "string")
    found = _counted(sample)
    if not found:
        return Languages({}, {})
    alphabet = max(2, len(np.unique(np.concatenate([g[:, -1] for g, _ in found.values()]))) + 1)
    models = {n: KneserNey(g, w, alphabet) for n, (g, w) in found.items()}
    free = Languages(models, {})

    def measured(batches):
        for batch in batches:
            for part in portions(batch):
                bits, held = free.cross_entropy(part.column("text"))
                own = np.array([free.names.index(n) if n in models else -1 for n in part.column("label").to_pylist()])
                known_ = (held > 0) & (own >= 0)
                yield pa.RecordBatch.from_arrays([part.column("label").filter(pa.array(known_)), pa.array(bits[known_, own[known_]])], ["label", "bits"])

    bits = sample.mapInArrow(measured, "label string, bits double").toPandas()
    limits = {n: float(np.quantile(own, 1 - REJECT_SHARE)) + REJECT_ROOM for n, own in bits.groupby("label")["bits"]}
    pa.default_memory_pool().release_unused()
    return Languages(models, limits)


def _counted(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The distinct windows of each label's texts, and how often each occurs."""

    def counted(batches):
        for batch in batches:
            for part in portions(batch):
                for label in part.column("label").unique().to_pylist():
                    codes, _, distinct = words(part.filter(pc.equal(part.column("label"), label)).column("text"), lower=False)
                    grams, sizes = _grams(_letters(distinct))
                    n = np.repeat(np.bincount(codes, minlength=len(distinct)), sizes).astype(np.int64)
                    wide = grams.astype(np.int64)
                    halves = [(wide[:, i] << 32) | wide[:, i + 1] for i in (0, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(n), pa.string()), *map(pa.array, halves), pa.array(n)], ["label", "first", "last", "n"])

    rows = sample.mapInArrow(counted, "label string, first bigint, last bigint, n bigint").groupBy("label", "first", "last").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for label, own in rows.groupby("label"):
        halves = own[["first", "last"]].to_numpy()
        grams = np.stack([halves[:, 0] >> 32, halves[:, 0], halves[:, 1] >> 32, halves[:, 1]], axis=1) & 0xFFFFFFFF
        out[label] = grams.astype(np.uint32), own["n"].to_numpy(np.float64)
    return out


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score, bits, rejected.

    Chosen is the model with the lowest bits a character; `rejected` marks a text whose bits lie
    above that language's limit or that has no letter. A null, empty or letterless text is `und`
    with score 0 and is rejected; so is every text where no language was learned. Ties go to the
    first language by name. Repeated rows are judged alike; other columns are not read.
    """
    models = languages

    def judged(batches):
        for batch in batches:
            for part in portions(batch):
                n = part.num_rows
                if models.names:
                    names, score, bits, rejected = models.judge(part.column("text"))
                else:
                    names, score, bits, rejected = [NONE] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "bits", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(judged, PREDICTIONS)


def accepted(docs: DataFrame, languages: Languages) -> DataFrame:
    """The rows of `docs` that `identify` does not reject, in all their columns; a null lang becomes the language found."""

    def kept(batches):
        for batch in batches:
            for part in portions(batch):
                if not languages.names:
                    continue
                names, _, _, rejected = languages.judge(part.column("text"))
                lang = pc.coalesce(part.column("lang"), pa.array(names, pa.string()))
                part = part.set_column(part.schema.get_field_index("lang"), "lang", lang)
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(kept, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder(F.col("doc_id"), 5) != 0)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(learnable(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "bits", "rejected")
