"""Document quality by attention-based multiple-instance learning (operator 2)."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.text import mixed, portions, remainder, sampled_ids, sampled_texts, starts_of, sums, table, words

PASSAGE = 64  # words of an instance
HIDDEN, GATE = 24, 12
# Bound of the fitting sample: documents of each label, whole.
FIT_DOCS = 2_000
EPOCHS, RATE, RIDGE = 150, 0.01, 1e-4
THRESHOLD = 0.3
# Character classes counted in each word, as byte ranges: capitals, small letters, vowels, digits,
# full stops and commas, exclamation and question marks, bars, other marks, bytes beyond ASCII.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"aeiou",
    b"0123456789",
    b".,;:",
    b"!?",
    b"|\\/_=+-",
    b"%$#*&@~^<>",
    b"\"'()[]{}",
    bytes(range(128, 256)),
)
SCORES = "doc_id bigint, score double, predicted int, attention array<double>"


def _word_features(distinct: pa.Array) -> np.ndarray:
    """A row per distinct word: class shares, length, and flags of form."""
    sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(distinct.to_pylist()).encode(), np.uint8)
    n = np.maximum(sizes, 1)
    columns = []
    for members in CLASSES:
        flag = np.zeros(256, np.uint8)
        flag[list(members)] = 1
        columns.append(sums(flag[data].astype(np.float64), sizes) / n)
    first = data[np.minimum(starts_of(sizes), max(len(data) - 1, 0))] if len(data) else np.zeros(len(sizes), np.uint8)
    upper, lower = columns[0], columns[1]
    columns += [
        np.log1p(sizes),
        (sizes == 1).astype(float),
        (sizes > 20).astype(float),
        ((upper > 0.4) & (lower == 0)).astype(float),
        ((first >= 65) & (first <= 90)).astype(float),
        ((upper == 0) & (lower == 0) & (columns[-1] == 0)).astype(float),
    ]
    return np.stack(columns, axis=1)


def instances(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the passages of all texts, and passages per text; an empty text has one of zeros.

    Beside the mean form of its words a passage knows how many repeat the word before, were
    seen earlier in the document, or follow the same word as earlier.
    """
    codes, counts, distinct = words(texts, lower=False)
    n = np.maximum(-(-counts // PASSAGE), 1)
    length = np.full(int(n.sum()), PASSAGE, np.int64)
    length[np.cumsum(n) - 1] = counts - (n - 1) * PASSAGE
    forms = _word_features(distinct) if len(distinct) else np.zeros((0, len(CLASSES) + 6))
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    code = codes.astype(np.uint64)
    before = np.concatenate([[np.uint64(1 << 40)], code[:-1]]) if len(code) else code
    opens = np.zeros(len(code), bool)
    opens[starts_of(counts)[counts > 0]] = True
    seen = _seen(mixed(doc) ^ code)
    pair_seen = _seen(mixed(mixed(doc) ^ code) ^ before) & ~opens
    again = (code == before) & ~opens
    rows = np.hstack([forms[codes], np.stack([again, seen, pair_seen], axis=1)]) if len(code) else np.zeros((0, forms.shape[1] + 3))
    mean = sums(rows, length) / np.maximum(length, 1)[:, None]
    spread = np.sqrt(np.maximum(sums(rows[:, :11] ** 2, length) / np.maximum(length, 1)[:, None] - mean[:, :11] ** 2, 0))
    return np.hstack([mean, spread, np.log1p(length)[:, None], np.repeat(np.log1p(counts), n)[:, None]]), n


def _seen(keys: np.ndarray) -> np.ndarray:
    """Whether the same key stands anywhere before."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


@dataclass
class GatedAttention:
    """Encoder, gated attention and classifier of the bag.

    A passage x is encoded as h = tanh(Ax + a); its weight is the softmax over the document of
    w . (tanh(Vh) * sigmoid(Uh)); the document is the weighted mean of h, classified linearly.
    """

    centre: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, rows: np.ndarray, seed: int) -> "GatedAttention":
        rng = np.random.default_rng(seed)
        d = rows.shape[1]
        make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"A": make(d, HIDDEN), "a": np.zeros(HIDDEN), "V": make(HIDDEN, GATE), "U": make(HIDDEN, GATE), "w": make(GATE), "c": make(HIDDEN), "b": np.zeros(1)}
        return cls(rows.mean(axis=0), rows.std(axis=0) + 1e-3, p)

    def forward(self, rows: np.ndarray, n: np.ndarray):
        p = self.p
        x = np.clip((rows - self.centre) / self.scale, -8, 8)
        h = np.tanh(x @ p["A"] + p["a"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        top = np.maximum.reduceat(e, starts_of(n))
        weight = np.exp(e - np.repeat(top, n))
        weight = weight / np.repeat(np.add.reduceat(weight, starts_of(n)), n)
        bag = np.add.reduceat(h * weight[:, None], starts_of(n))
        logit = bag @ p["c"] + p["b"][0]
        return logit, (x, h, v, u, weight, bag)

    def step(self, rows: np.ndarray, n: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross-entropy."""
        p = self.p
        logit, (x, h, v, u, weight, bag) = self.forward(rows, n)
        d = importance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        g = {"c": bag.T @ d, "b": np.array([d.sum()])}
        each = np.repeat(np.arange(len(n)), n)
        dbag = d[:, None] * p["c"]
        dh = dbag[each] * weight[:, None]
        de = weight * np.einsum("ij,ij->i", dbag[each], h - bag[each])
        g["w"] = (v * u).T @ de
        dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        g["A"], g["a"] = x.T @ dh, dh.sum(axis=0)
        return g


def _trained(rows: np.ndarray, n: np.ndarray, y: np.ndarray, importance: np.ndarray, seed: int) -> GatedAttention:
    model = GatedAttention.new(rows, seed)
    rng = np.random.default_rng(seed)
    begins = starts_of(n)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(n))
        for chunk in np.array_split(order, max(1, len(n) // 512)):
            picked = np.concatenate([np.arange(begins[i], begins[i] + n[i]) for i in chunk])
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for k, g in model.step(rows[picked], n[chunk], y[chunk], importance[chunk]).items():
                g = g + RIDGE * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, seed: int = 13) -> GatedAttention | float:
    """A model from the non-null `quality` of `labels`, on a bounded sample of documents.

    Of each label the FIT_DOCS documents smallest by hash enter with the passages of their whole
    texts, which tasks turn into feature rows, weighed back to the labels' true shares. With one label only, or none, the share
    of label 1 is returned and stands for every text.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    chosen = [(i, y) for y in (0, 1) for i in sampled_ids(known.filter(F.col("quality") == y), FIT_DOCS, seed)]
    sample = sampled_texts(docs, chosen, "bigint")

    def featured(batches):
        for batch in batches:
            for part in portions(batch, limit=1 << 20):
                rows, n = instances(part.column("text"))
                data = [x.astype("<f8").tobytes() for x in np.split(rows, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(n), pa.array(data, pa.binary())], ["doc_id", "label", "n", "rows"])

    found = sample.mapInArrow(featured, "doc_id bigint, label bigint, n bigint, rows binary").toArrow().sort_by("doc_id")
    y, n = found.column("label").to_numpy().astype(np.float64), found.column("n").to_numpy()
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    rows = np.frombuffer(b"".join(found.column("rows").to_pylist()), "<f8").reshape(int(n.sum()), -1)
    del found
    pa.default_memory_pool().release_unused()
    importance = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    return _trained(rows, n, y, importance / importance.mean(), seed)


def score(docs: DataFrame, model: GatedAttention | float) -> DataFrame:
    """Quality of every whole text: doc_id, score, predicted, attention (one weight per passage).

    Null and empty texts are one passage without words and are scored as such. Repeated rows
    score alike; an empty table gives no rows; other columns are not read.
    """

    def scored(batches):
        for batch in batches:
            for part in portions(batch, limit=1 << 20):
                rows, n = instances(part.column("text"))
                if isinstance(model, float):
                    p, weight = np.full(len(n), model), np.repeat(1.0 / n, n)
                else:
                    logit, held = model.forward(rows, n)
                    p, weight = 1 / (1 + np.exp(-np.clip(logit, -30, 30))), held[4]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(weight))],
                    ["doc_id", "score", "predicted", "attention"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, SCORES)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(remainder(F.col("doc_id"), 5) != 0)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, learnable(labels)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("attention").alias("n_passages"))
