"""Toxicity by maximum-scoring segments of token log-odds (operator 9)."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.store import stored
from claimflow.llm.text import hashes, mixed, portions, remainder, sampled_ids, sampled_texts, starts_of, sums, table, words

# Bounds of the fitting sample: documents of each label, whole.
FIT_TOXIC, FIT_CLEAN = 1_500, 2_000
# Strength of the Dirichlet prior in documents.
PRIOR = 50.0
# A token stands for itself and for its beginnings of these lengths, so that inflected forms share evidence.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.5
SCORES = (
    "doc_id bigint, score double, predicted int, "
    "passages array<struct<first: int, last: int, score: double, e_value: double>>"
)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words, words per text, and per code the hashes of its units.

    Units are the letters and digits of the word, lower-cased, and their beginnings. A word
    without a letter or digit keeps its place; its units are the empty string.
    """
    codes, counts, distinct = words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\p{L}\p{N}]+", "")
    units = [hashes(pc.utf8_slice_codeunits(plain, 0, n)) for n in STEMS] + [hashes(plain)]
    return codes, counts, np.stack(units, axis=1)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of one sequence, as (first, last, score), in linear time.

    The scan keeps candidate segments with the running total before and after each. A new
    segment joins back to the nearest candidate that began lower, as long as its own total ends
    higher than that one's. Only positive scores start a candidate, so the loop visits those.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, last, total before, total after
    for at in np.flatnonzero(scores > 0).tolist():
        first, low, high = at, total[at], total[at + 1]
        while True:
            back = len(found) - 1
            while back >= 0 and found[back][2] >= low:
                back = found[back][4]
            if back < 0 or found[back][3] >= high:
                found.append([first, at, low, high, back])
                break
            first, low = found[back][0], found[back][2]
            del found[back:]
    return [(f, l, float(h - w)) for f, l, w, h, _ in found]


@dataclass
class ToxicModel:
    """Unit scores as sorted hashes, the extreme-value figures and the final calibration."""

    keys: np.ndarray
    z: np.ndarray
    scores: np.ndarray
    drift: float  # log-odds of all other tokens
    rate: float  # lambda
    size: float  # K
    weights: np.ndarray

    def units_of(self, hashed: np.ndarray) -> np.ndarray:
        """The surest listed unit of each row of hashes, -1 where none is listed."""
        best, z = np.full(len(hashed), -1), np.zeros(len(hashed))
        if len(self.keys):
            for column in hashed.T:
                at = np.minimum(np.searchsorted(self.keys, column), len(self.keys) - 1)
                better = (self.keys[at] == column) & (self.z[at] >= np.maximum(z, 1e-9))
                best[better], z[better] = at[better], self.z[at][better]
        return best

    def token_scores(self, hashed: np.ndarray) -> np.ndarray:
        unit = self.units_of(hashed)
        return np.where(unit < 0, self.drift, np.append(self.scores, 0.0)[unit])

    def passages(self, texts: pa.Array) -> tuple[list[list[tuple]], np.ndarray]:
        """Segments of each text, and its words."""
        codes, counts, hashed = _tokens(texts)
        scores = self.token_scores(hashed)[codes]
        out: list[list[tuple]] = [[] for _ in counts]
        positive = sums((scores > 0).astype(np.float64), counts) > 0
        begins = starts_of(counts)
        for i in np.flatnonzero(positive).tolist():
            out[i] = maximal_segments(scores[begins[i] : begins[i] + counts[i]])
        return out, counts

    def features(self, found: list[list[tuple]], counts: np.ndarray) -> np.ndarray:
        """Per text: the best normalised score, the sum of those of significant passages, their number."""
        rows = np.zeros((len(found), 3))
        for i, segments in enumerate(found):
            if segments:
                own = self.rate * np.array([s[2] for s in segments]) - np.log(self.size * max(counts[i], 1))
                rows[i] = max(own.max(), 0), np.maximum(own, 0).sum(), (own > 0).sum()
        return np.log1p(rows)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[1:] + self.weights[0], -30, 30)))


def _groups(ids: np.ndarray, hashed: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash per document that copies share: those with the same two minima over word pairs."""
    group = mixed(ids.astype(np.uint64))
    held = counts > 0
    if held.any():
        token = hashed[codes, -1]
        pair = mixed(token ^ mixed(np.roll(token, -1)))
        low = [np.minimum.reduceat(mixed(pair ^ np.uint64(s)), starts_of(counts)[held]) for s in (1, 2)]
        group[held] = mixed(low[0]) ^ low[1]
    return group


def _unit_counts(sample: DataFrame) -> tuple[np.ndarray, ...]:
    """Of each sampled document its label and group, and its distinct words with how often they occur.

    Tasks read the whole texts. Returned are labels and groups by document, then document, word and number
    of each of its distinct words, and of every distinct word its units. A word's units reach the
    driver once, not with every document that holds it.
    """
    width = len(STEMS) + 1

    def counted(batches):
        for batch in batches:
            for part in portions(batch):
                codes, counts, hashed = _tokens(part.column("text"))
                group = _groups(part.column("doc_id").to_numpy(), hashed, codes, counts)
                # The last unit is the word itself, of which the others follow.
                own, first, code = np.unique(hashed[:, -1], return_index=True, return_inverse=True)
                types = max(len(own), 1)
                doc = np.repeat(np.arange(len(counts)), counts)
                pairs, n = np.unique(doc * types + code[codes] if len(codes) else doc, return_counts=True)
                ends = np.searchsorted(pairs // types, np.arange(len(counts) + 1))
                each = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
                held = [own[pairs[some] % types].astype("<u8").tobytes() for some in each]
                names = ["doc_id", "label", "group", "words", "n", "units"]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("label"), pa.array(group.view(np.int64)), pa.array(held, pa.binary()),
                        pa.array([n[some].astype("<u4").tobytes() for some in each], pa.binary()), pa.nulls(len(each), pa.binary()),
                    ],
                    names,
                )
                none = [pa.nulls(len(own), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([x.tobytes() for x in hashed[first].astype("<u8")], pa.binary())], names)

    rows = stored(sample.mapInArrow(counted, "doc_id bigint, label bigint, group bigint, words binary, n binary, units binary"), "units")
    units = rows.filter("units IS NOT NULL").select("units").distinct().toArrow().column("units")
    hashed = _flat(units, "<u8").reshape(-1, width)
    hashed = hashed[np.unique(hashed[:, -1], return_index=True)[1]]
    found = rows.filter("units IS NULL").drop("units").toArrow().sort_by("doc_id")
    group = np.unique(found.column("group").to_numpy(), return_inverse=True)[1]
    doc = np.repeat(np.arange(found.num_rows), pc.binary_length(found.column("words")).to_numpy() // 8)
    word = np.searchsorted(hashed[:, -1], _flat(found.column("words"), "<u8"))
    return found.column("label").to_numpy(), group, doc, word, _flat(found.column("n"), "<u4"), hashed


def _flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers in all bytes of a binary column, without an object for each row."""
    whole = pa.concat_arrays([pa.array([], pa.binary()), *(c.cast(pa.binary()) for c in column.chunks)])
    ends = np.frombuffer(whole.buffers()[1], "<i4")[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, "<i4")
    data = whole.buffers()[2]
    return np.frombuffer(data, "u1")[ends[0] : ends[-1]].view(kind) if data and ends[-1] > ends[0] else np.zeros(0, kind)


def _surprise(y1: np.ndarray, y0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Signed root of the likelihood ratio that a unit is held by toxic documents as often as by clean ones."""
    share = (y1 + y0) / (n1 + n0)

    def part(y, expected):
        return np.where(y > 0, y * np.log(np.maximum(y, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    ratio = part(y1, n1 * share) + part(n1 - y1, n1 * (1 - share)) + part(y0, n0 * share) + part(n0 - y0, n0 * (1 - share))
    return np.sign(y1 * n0 - y0 * n1) * np.sqrt(np.maximum(2 * ratio, 0))


def _learned(labels: np.ndarray, group: np.ndarray, doc: np.ndarray, word: np.ndarray, n: np.ndarray, hashed: np.ndarray) -> ToxicModel:
    """The units sure to speak for the toxic label, with their log-odds under Dirichlet priors.

    Whether a unit is listed is decided by the documents that hold it, copies counting as one;
    its score and that of all other tokens come from the tokens, each document's copies sharing
    the weight of one.
    """
    toxic_group = np.zeros(group.max() + 1)
    np.maximum.at(toxic_group, group, labels.astype(float))
    n1, n0 = float(toxic_group.sum()), float((1 - toxic_group).sum())
    listed = {}
    for column in hashed.T:
        distinct, unit = np.unique(column, return_inverse=True)
        pairs = np.unique(unit.astype(np.int64)[word] * len(toxic_group) + group[doc])
        toxic = toxic_group[pairs % len(toxic_group)]
        y1 = np.bincount(pairs // len(toxic_group), toxic, minlength=len(distinct))
        y0 = np.bincount(pairs // len(toxic_group), 1 - toxic, minlength=len(distinct))
        z = _surprise(y1, y0, n1, n0)
        # As high as the best of so many units without a tie to the label would come by chance.
        sure = np.sqrt(2 * np.log(hashed.shape[1] * max(len(distinct), 2)))
        listed |= {int(distinct[i]): float(z[i]) for i in np.flatnonzero(z >= sure)}
    keys = np.array(sorted(listed), np.uint64)
    model = ToxicModel(keys, np.array([listed[int(k)] for k in keys]), np.zeros(len(keys)), 0.0, 1.0, 1.0, np.zeros(4))
    unit = model.units_of(hashed)[word]
    weight = n * (1 / np.bincount(group))[group][doc]
    c1 = np.bincount(unit + 1, weight * labels[doc], minlength=len(keys) + 1)
    c0 = np.bincount(unit + 1, weight * (1 - labels[doc]), minlength=len(keys) + 1)
    prior = PRIOR * (c0 + c1 + 0.01) / (c0 + c1 + 0.01).sum()
    share1, share0 = (c1 + prior) / (c1 + prior).sum(), (c0 + prior) / (c0 + prior).sum()
    scores = np.log(share1 / share0)
    model.drift, model.scores = float(min(scores[0], -1e-3)), np.maximum(scores[1:], 1e-3)
    model.rate = _rate(np.append(model.scores, model.drift), np.append(share0[1:], share0[0]))
    return model


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of the scores' generating function over clean tokens."""
    grown = lambda x: share @ np.exp(x * scores) - 1
    low, high = 1e-3, 1.0
    while grown(high) < 0 and high < 16:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if grown(middle) < 0 else (low, middle)
    return high


def _calibrated(rows: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge; rows weigh as their label is common."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (importance * (labels - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, seed: int = 17) -> ToxicModel:
    """A model from the non-null `toxic` of `labels`, on a bounded sample of documents.

    The FIT_TOXIC toxic and FIT_CLEAN clean documents smallest by hash enter with their whole
    texts, of which the driver gets counts of units and, for the calibration, figures of the
    passages; the calibration weighs them back to the labels' true shares. Without
    both labels every text scores 0 for clean or, with toxic ones alone, 1.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    share = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = [(i, y) for y, n in ((0, FIT_CLEAN), (1, FIT_TOXIC)) for i in sampled_ids(known.filter(F.col("toxic") == y), n, seed)]
    sample = sampled_texts(docs, chosen, "bigint")
    y, *counted = _unit_counts(sample)
    if len(set(y.tolist())) < 2:
        constant = 30.0 if len(y) and y[0] else -30.0
        none = np.zeros(0)
        return ToxicModel(none.astype(np.uint64), none, none, -1.0, 1.0, 1.0, np.array([constant, 0, 0, 0]))
    model = _learned(y, *counted)
    del counted
    found, counts = _passage_scores(sample, model)
    best = np.array([max((s[2] for s in f), default=0.0) for f in found])
    quiet = y == 0  # the likeliest K when clean documents follow the extreme-value law
    model.size = float(quiet.sum() / np.sum(np.maximum(counts[quiet], 1) * np.exp(-model.rate * best[quiet])))
    importance = np.where(y == 1, share[1] / max((y == 1).sum(), 1), share[0] / max((y == 0).sum(), 1))
    model.weights = _calibrated(model.features(found, counts), y, importance / importance.mean())
    pa.default_memory_pool().release_unused()
    return model


def _passage_scores(sample: DataFrame, model: ToxicModel) -> tuple[list[list[tuple]], np.ndarray]:
    """The segments of each sampled whole text, by their scores alone, and its words, in order of doc_id."""

    def found(batches):
        for batch in batches:
            for part in portions(batch):
                segments, counts = model.passages(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), pa.array([[s[2] for s in own] for own in segments], pa.list_(pa.float64()))], ["doc_id", "words", "scores"]
                )

    rows = sample.mapInArrow(found, "doc_id bigint, words bigint, scores array<double>").toArrow().sort_by("doc_id")
    return [[(0, 0, s) for s in own] for own in rows.column("scores").to_pylist()], rows.column("words").to_numpy()


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Toxicity of every whole text: doc_id, score, predicted, passages.

    A passage is a maximal scoring run of words with its E-value, the number of such passages
    expected by chance in a clean text of that length; listed are those with an E-value below 1.
    Null and empty texts have none and score as a text without passages. Repeated rows score
    alike; an empty table gives no rows; other columns are not read.
    """

    def scored(batches):
        for batch in batches:
            for part in portions(batch):
                found, counts = model.passages(part.column("text"))
                p = model.probability(model.features(found, counts))
                listed = []
                for segments, n in zip(found, counts.tolist()):
                    chance = [(f, l, s, model.size * max(n, 1) * float(np.exp(-model.rate * s))) for f, l, s in segments]
                    listed.append([{"first": f, "last": l, "score": s, "e_value": e} for f, l, s, e in chance if e < 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(p),
                        pa.array((p >= THRESHOLD).astype(np.int32)),
                        pa.array(listed, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))),
                    ],
                    ["doc_id", "score", "predicted", "passages"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, SCORES)


def accepted(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of `docs` that `score` does not predict toxic, in all their columns."""

    def kept(batches):
        for batch in batches:
            for part in portions(batch):
                found, counts = model.passages(part.column("text"))
                yield part.filter(pa.array(model.probability(model.features(found, counts)) < THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(remainder(F.col("doc_id"), 5) != 0)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, learnable(labels)))
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages")
    )
