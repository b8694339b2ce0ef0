"""Language-model scoring with a small causal self-attention model (operator 8)."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.store import stored
from claimflow.llm.text import hashes, mixed, portions, remainder, spans, starts_of, sums, table, words
from claimflow.llm.tokens import encoder

TOKENIZER, END = "byte_bpe_50k.json", 50256
IDS = 50257
# A word counted at least once in so many tokens is broadcast; no more than that many words can be.
FREQUENT = 1_000_000
# Context and step of the windows: each scores STEP ids and sees at least WINDOW - STEP before them.
WINDOW, STEP = 16, 8
# How far each slot lies before each place that a window scores; below 0: behind it.
BACK = np.arange(WINDOW - STEP, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
# Width; ids with an embedding of their own. Predicted are CLASSES classes of LEAVES leaves: the
# commonest ids have a leaf each, the rest share GROUPS leaves.
WIDTH, OWN, CLASSES, LEAVES, GROUPS = 32, 2_000, 32, 32, 16
TOP = CLASSES * LEAVES - GROUPS
# Steps of the attention weights and windows a step; as many windows are drawn from all training texts.
STEPS, BATCH = 1_000, 256
# After that a pass over all training texts: one step in so many (1: every one), windows a step.
PASS_SHARE, PASS_BATCH, PASS_RATE = 1, 1_024, 2e-3
# Windows whose attention is held at once: what does not fit the processor's cache costs more to move than to work out.
PART = 128
# Rows of a step that name the same embedding, from which on they are summed in one product.
OFTEN = 8
# Bytes of text whose words are encoded together: most words come again in the next portion.
ENCODED = 32 << 20
# Places that are scored at once.
BLOCK = 1 << 13
# Numbers of the parameters that travel in one row when tasks' models are averaged.
SLICE = 1 << 12
# One drawn window in so many is kept from the weights, to tell how far they and the transitions are to be trusted.
HELD = 10


def _pairs(texts: pa.Array):
    """Distinct words of a portion with the number of each."""
    codes, counts, distinct = words(texts)
    return distinct, np.bincount(codes, minlength=len(distinct)).astype(np.int64), counts


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in all texts: word, n."""

    def counted(batches):
        for batch in batches:
            for part in portions(batch):
                distinct, n, _ = _pairs(part.column("text"))
                yield pa.RecordBatch.from_arrays([distinct, pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


ROWS = ["row", "word", "n", "doc", "score"]
TOKENS = "row bigint, learned boolean, scored boolean, ids binary"


def tokenised(rows: DataFrame, tokenizer: str) -> DataFrame:
    """The ids of the words of each text with an end, 16 bits each, stored: every text is tokenised once.

    `rows` has doc_id, text, learned and scored. An id of this vocabulary has 16 bits.
    """

    def cut(batches):
        for batch in batches:
            for part, ids, per_text in _streams(batch, tokenizer):
                ends = np.concatenate([[0], np.cumsum(per_text * 2)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(per_text), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([pa.array(_row_ids(part)), part.column("learned"), part.column("scored"), binary], ["row", "learned", "scored", "ids"])

    return stored(rows.mapInArrow(cut, TOKENS), "ids")


def _runs(batches):
    """Row numbers, ids of all runs one after the other, and ids per run, in portions."""
    for batch in batches:
        for part in portions(batch, "ids", limit=2 << 20):
            binary = part.column("ids")
            counts = pc.binary_length(binary).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            ids = np.frombuffer(b"".join(binary.to_pylist()), "<u2").astype(np.int64)
            yield part.column("row").to_numpy(zero_copy_only=False), ids, counts


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each subword id occurs in the learned texts; bounded by the vocabulary."""

    def counted(batches):
        total = np.zeros(IDS, np.int64)
        for _, ids, _ in _runs(batches):
            total += np.bincount(ids, minlength=IDS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["id", "n"])

    each = tokens.filter("learned").select("row", "ids").mapInArrow(counted, "id bigint, n bigint")
    found = each.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(IDS)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


@dataclass
class Attention:
    """One layer of causal self-attention over subword ids.

    Ids without an embedding of their own share one per group. With h = relu(own part + attended
    values + bias), the next id's class comes from one softmax over h, its leaf from another one
    of that class, and an id within a shared leaf from its share of the training counts. The leaf's
    probability is mixed with its share among all that followed the id before in training.
    """

    input_of: np.ndarray  # id -> embedding
    leaf_of: np.ndarray  # id -> leaf; its class is leaf // LEAVES
    log_share: np.ndarray  # id -> log of its share of its leaf
    p: dict[str, np.ndarray]
    follows: np.ndarray | None = None  # embedding of the id before -> probability of each leaf
    trust: float = 0.0  # weight of `follows`

    @classmethod
    def new(cls, counts: np.ndarray, seed: int) -> "Attention":
        rank = np.argsort(-counts, kind="stable")
        place = np.empty(IDS, np.int64)
        place[rank] = np.arange(IDS)
        smooth = counts + 0.1
        # The rest in groups of about equal weight, in order of frequency.
        rest = np.cumsum(smooth[rank][TOP:])
        group = np.minimum((rest / rest[-1] * GROUPS).astype(np.int64), GROUPS - 1)
        leaf_of = place.copy()
        leaf_of[rank[TOP:]] = TOP + group
        input_of = np.where(place < OWN, place, OWN + np.maximum(leaf_of - TOP, 0))
        mass = np.bincount(leaf_of, smooth, minlength=TOP + GROUPS)
        share = np.log(smooth) - np.log(mass)[leaf_of]
        by_class = mass.reshape(CLASSES, LEAVES)
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        p = {
            "E": rng.normal(0, 0.5, (OWN + GROUPS, WIDTH)).astype(np.float32),
            "Q": make(WIDTH, WIDTH), "K": make(WIDTH, WIDTH), "V": make(WIDTH, WIDTH), "R": make(WIDTH, WIDTH),
            "W": make(WIDTH, CLASSES), "b": np.log(by_class.sum(axis=1) / mass.sum()).astype(np.float32),
            "L": np.stack([make(WIDTH, LEAVES) for _ in range(CLASSES)]),
            "l": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32),
            "d": np.zeros(WINDOW, np.float32), "h": np.zeros(WIDTH, np.float32),
        }
        return cls(input_of.astype(np.int32), leaf_of.astype(np.int32), share.astype(np.float32), p)

    def weights(self, scores: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """Masked softmax over the slots of a window, in place; `unseen` marks slots before the text's begin."""
        scores += np.where(BACK < 0, np.float32(-1e9), self.p["d"][np.maximum(BACK, 0)])
        begins = np.flatnonzero(unseen[:, 0])  # slots before the begin are the first ones
        if len(begins):
            scores[begins] = np.where(unseen[begins, None, :], np.float32(-1e9), scores[begins])
        each, ones = np.exp(scores), np.ones(WINDOW, np.float32)
        total = each @ ones
        if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < np.inf):  # too large or small for single precision: shifted first
            each = np.exp(scores - scores.max(axis=2, keepdims=True))
            total = each @ ones
        each /= total[:, :, None]
        return each

    def tables(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, ...]:
        """Key, value, query and own part of these embeddings; one layer needs no more. Queries are scaled as scores are."""
        made = self.p["E"][some] @ np.hstack([self.p["K"], self.p["V"], self.p["Q"] * np.float32(1 / np.sqrt(WIDTH)), self.p["R"]])
        keys, values, queries, owns = (np.ascontiguousarray(made[:, i * WIDTH : (i + 1) * WIDTH]) for i in range(4))
        return keys, values, queries, owns + self.p["h"]

    def attended(self, queries: np.ndarray, keys: np.ndarray, values: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the slots of whole windows, and what they make of the values at every scored place."""
        a = self.weights(queries @ keys.transpose(0, 2, 1), unseen)
        return a, a @ values

    def step(self, inputs: np.ndarray, unseen: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the leaves and its gradients."""
        context = WINDOW - STEP
        # A window that sees nothing before it may follow any other.
        follow = unseen[1:, :context].all(axis=1) | (inputs[1:, :context] == inputs[:-1, -context:]).all(axis=1)
        if STEP == context and follow.all():
            flat = np.concatenate([inputs[:1, :context].ravel(), inputs[:, context:].ravel()])
            return self.along(flat, STEP, unseen, targets, valid)
        return self.along(inputs.ravel(), WINDOW, unseen, targets, valid)

    def along(self, flat: np.ndarray, stride: int, unseen: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Mean loss and gradients of windows that begin `stride` apart in one run of embeddings.

        At STEP apart a window's context is what the one before it scores: a slot is looked up once, and
        its gradients meet there. Keys, values, queries and own parts are made once for every embedding
        and looked up. The gradients of a place by all four go on to its embedding while they are in the
        cache, so that only one row of WIDTH a place is added up by embedding.
        """
        p, context, n = self.p, WINDOW - STEP, len(unseen)
        keys, values, queries, owns = self.tables()
        here = _windows_of(flat, stride, n)[:, context:]
        key, value = (_windows_of(x.take(flat, axis=0), stride, n) for x in (keys, values))
        query, parts = queries.take(here, axis=0), [slice(at, min(at + PART, n)) for at in range(0, n, PART)]
        a, pre = np.empty((n, STEP, WINDOW), np.float32), owns.take(here, axis=0)
        for some in parts:
            a[some], seen = self.attended(query[some], key[some], value[some], unseen[some])
            pre[some] += seen
        held = np.flatnonzero(valid)
        leaf = targets.ravel()[held]
        order = np.argsort(leaf.astype(np.int16), kind="stable")  # by class, so that a class is one run of rows
        held, leaf = held[order], leaf[order]
        loss, dhidden, g = self._outputs(_hidden(pre.reshape(-1, WIDTH), held), leaf)
        dpre = pre
        if len(held) < n * STEP:
            dpre.fill(0)
        dpre.reshape(-1, WIDTH)[held] = dhidden
        to_e = np.vstack([p["K"].T, p["V"].T, p["Q"].T * np.float32(1 / np.sqrt(WIDTH)), p["R"].T])
        by_e, by_kind = np.zeros((len(flat), WIDTH), np.float32), np.zeros((WIDTH, 4 * WIDTH), np.float32)
        by_slot, ones = np.zeros(STEP * WINDOW, np.float32), np.ones(max(WINDOW, PART), np.float32)
        for some in parts:
            dp, m = dpre[some], some.stop - some.start
            ds = dp @ value[some].transpose(0, 2, 1)
            ds -= ((ds * a[some]) @ ones[:WINDOW])[:, :, None]
            ds *= a[some]
            by_slot += ones[:m] @ ds.reshape(m, STEP * WINDOW)
            # Gradients of each slot by its key and value, and of each scored place by its query and own part.
            slots = slice(some.start * stride, (some.stop - 1) * stride + WINDOW)
            each = np.empty((slots.stop - slots.start, 4 * WIDTH), np.float32)
            seen = _windows_of(each, stride, m)
            scored, around = seen[:, context:], seen[:, :context]
            np.matmul(ds, key[some], out=scored[..., 2 * WIDTH : 3 * WIDTH])
            scored[..., 3 * WIDTH :] = dp
            np.matmul(ds[..., context:].transpose(0, 2, 1), query[some], out=scored[..., :WIDTH])
            np.matmul(a[some, :, context:].transpose(0, 2, 1), dp, out=scored[..., WIDTH : 2 * WIDTH])
            alone = around if stride == WINDOW else around[:1]
            alone.fill(0)
            around[..., :WIDTH] += ds[..., :context].transpose(0, 2, 1) @ query[some]
            around[..., WIDTH : 2 * WIDTH] += a[some, :, :context].transpose(0, 2, 1) @ dp
            by_e[slots] += each @ to_e
            by_kind += _product(p["E"].take(flat[slots], axis=0), each)
        g["E"] = np.zeros_like(p["E"])
        _added(g["E"], flat, by_e)
        g["d"] = np.bincount(np.maximum(BACK, 0).ravel(), by_slot, minlength=WINDOW).astype(np.float32)
        by_kind[:, 2 * WIDTH : 3 * WIDTH] *= np.float32(1 / np.sqrt(WIDTH))
        g["K"], g["V"], g["Q"], g["R"] = (by_kind[:, i * WIDTH : (i + 1) * WIDTH] for i in range(4))
        return loss, g

    def _outputs(self, hidden: np.ndarray, leaf: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """Mean loss of leaves in their order, its gradient by what goes into h, and those by the weights behind."""
        p, n = self.p, max(len(leaf), 1)
        g, ones = {"L": np.zeros_like(p["L"]), "l": np.zeros_like(p["l"])}, np.ones(len(leaf), np.float32)
        logits = hidden @ p["W"]
        logits += p["b"]
        loss, d = _softmax(logits, leaf // LEAVES, n)
        g["W"], g["b"], dhidden = _product(hidden, d), ones @ d, d @ p["W"].T
        logits, runs_ = self._leaves(hidden, leaf)
        own_loss, d = _softmax(logits, leaf % LEAVES, n)
        for c, rows in runs_:
            part = d[rows]
            g["L"][c], g["l"][c] = hidden[rows].T @ part, ones[rows] @ part
            dhidden[rows] += part @ p["L"][c].T
        dhidden *= hidden > 0
        g["h"] = ones @ dhidden
        return loss + own_loss, dhidden, g

    def _leaves(self, hidden: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits of each row among the leaves of its class, rows in order of their leaf; the rows of each class."""
        logits = np.empty((len(leaf), LEAVES), np.float32)
        ends = np.searchsorted(leaf, np.arange(CLASSES + 1) * LEAVES)
        runs_ = [(c, slice(ends[c], ends[c + 1])) for c in np.flatnonzero(np.diff(ends)).tolist()]
        for c, rows in runs_:
            np.matmul(hidden[rows], self.p["L"][c], out=logits[rows])
            logits[rows] += self.p["l"][c]
        return logits, runs_

    def log10(self, ids: np.ndarray, counts: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 of the probability of each run of ids, every id scored once in its window.

        Runs are laid out in whole steps behind each other, so that windows are overlapping views
        of one array of embeddings, not copies.
        """
        if not len(ids):
            return np.zeros(len(counts))
        before, number, where = laid_out(ids, counts, self.input_of)
        total = np.empty(len(ids))
        ends = np.searchsorted(where, np.arange(0, len(before) + BLOCK, BLOCK))
        for k, at in enumerate(range(0, len(before) - (WINDOW - STEP), BLOCK)):
            some = slice(ends[k], ends[k + 1])
            seen, rows, own_ids = before[at : at + BLOCK + WINDOW - STEP], where[some] - at, ids[some]
            leaf = self.leaf_of.take(own_ids)
            found = self.log_leaf(self.hidden(seen, number[at // STEP : (at + BLOCK) // STEP], tables), leaf, rows)
            if self.trust:
                follows = self.follows.ravel().take(seen.take(rows + (WINDOW - STEP)) * self.follows.shape[1] + leaf)
                found = np.log(np.float32(1 - self.trust) * np.exp(found) + np.float32(self.trust) * follows)
            total[some] = found + self.log_share.take(own_ids)
        return sums(total, counts) / np.log(10)

    def hidden(self, before: np.ndarray, number: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """What goes into h at every place of the steps laid out behind WINDOW - STEP places of context, STEP rows for each.

        `number` is each step's number in its run; what lies before the first is not seen.
        """
        unseen = (number == 0)[:, None] & (np.arange(WINDOW) < WINDOW - STEP)
        out = np.empty((len(number), STEP, WIDTH), np.float32)
        keys, values, queries, owns = tables
        for at in range(0, len(number), 4 * PART):  # scoring holds less for a window than a step does
            n = min(4 * PART, len(number) - at)
            flat = before[at * STEP : (at + n) * STEP + WINDOW - STEP]
            key, value = (_windows_of(x.take(flat, axis=0), STEP, n) for x in (keys, values))
            query, own = (x.take(flat[WINDOW - STEP :], axis=0).reshape(n, STEP, WIDTH) for x in (queries, owns))
            np.add(self.attended(query, key, value, unseen[at : at + n])[1], own, out=out[at : at + n])
        return out.reshape(-1, WIDTH)

    def in_windows(self, inputs: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """The h of every scored place of whole windows, as training sees them."""
        p, e = self.p, self.p["E"][inputs]
        own = e[:, WINDOW - STEP :]
        a = self.weights((own @ p["Q"]) @ (e @ p["K"]).transpose(0, 2, 1) * np.float32(1 / np.sqrt(WIDTH)), unseen)
        return np.maximum(own @ p["R"] + a @ (e @ p["V"]) + p["h"], 0)

    def log_leaf(self, hidden: np.ndarray, leaf: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Log of the probability that attention alone gives to each leaf; `at` names its row of `hidden`, if not the same."""
        order = np.argsort(leaf.astype(np.int16), kind="stable")
        rows, leaf = _hidden(hidden, order if at is None else at[order]), leaf[order].astype(np.int64)
        logits, out = rows @ self.p["W"], np.empty(len(rows), np.float32)
        logits += self.p["b"]
        out[order] = _log_softmax(logits, leaf // LEAVES) + _log_softmax(self._leaves(rows, leaf)[0], leaf % LEAVES)
        return out


def _windows_of(rows: np.ndarray, stride: int, n: int) -> np.ndarray:
    """n windows of WINDOW rows, `stride` rows apart, as a view."""
    return np.ndarray((n, WINDOW, *rows.shape[1:]), rows.dtype, rows, 0, (stride * rows.strides[0], *rows.strides))


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y, in parts of PART rows, which takes half the time of one long product."""
    whole = len(x) // PART
    cut = lambda z: z[: whole * PART].reshape(whole, PART, z.shape[1])
    return np.matmul(cut(x).transpose(0, 2, 1), cut(y)).sum(axis=0) + x[whole * PART :].T @ y[whole * PART :]


def _hidden(pre: np.ndarray, some: np.ndarray) -> np.ndarray:
    """h of some rows."""
    out = pre.take(some, axis=0)
    return np.maximum(out, 0, out=out)


def _added(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the row of `total` that it names; rows that many name are summed first."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    at = at[order]
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(begins, append=len(at))
    often, rows, ones = n >= OFTEN, rows.take(order, axis=0), np.ones(n.max(initial=0), np.float32)
    for k, begin, size in zip(at[begins[often]].tolist(), begins[often].tolist(), n[often].tolist()):
        total[k] += ones[:size] @ rows[begin : begin + size]
    rest = np.flatnonzero(np.repeat(~often, n))
    place = at[rest, None].astype(np.int64) * total.shape[1] + np.arange(total.shape[1])
    np.add.at(total.reshape(-1), place.ravel(), rows.take(rest, axis=0).ravel())  # one axis: many times as fast


def _log_softmax(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax at the target of each row."""
    chosen = logits.ravel()[np.arange(len(logits)) * logits.shape[1] + target]
    each = np.exp(logits)
    total = each @ np.ones(each.shape[1], each.dtype)
    if not (total.min(initial=1) > 0 and total.max(initial=1) < np.inf):  # too large or small for single precision: shifted first
        top = logits.max(axis=1)
        return chosen - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
    return chosen - np.log(total)


def _softmax(logits: np.ndarray, target: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Cross-entropy over n rows and its gradient by the logits."""
    ones, at = np.ones(logits.shape[1], np.float32), np.arange(len(logits)) * logits.shape[1] + target
    prob = np.exp(logits)
    total = prob @ ones
    if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < np.inf):  # as in `_log_softmax`
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        total = prob @ ones
    prob *= (np.float32(1 / n) / total)[:, None]
    flat = prob.ravel()
    chosen = flat[at]
    flat[at] = chosen - np.float32(1 / n)
    return -float(np.log(chosen * np.float32(n) + 1e-12).sum()) / n, prob


def laid_out(ids: np.ndarray, counts: np.ndarray, input_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ids in whole steps behind each other: embeddings before each place, numbers of the steps in their run, places.

    WINDOW - STEP places of context stand in front of all, so the place of an id's embedding before is that far on.
    """
    steps = -(-counts // STEP)
    begins, own = starts_of(counts), starts_of(steps) * STEP
    where = np.arange(len(ids)) + np.repeat(own - begins, counts)
    before = np.full(int(steps.sum()) * STEP + WINDOW - STEP, input_of[END], np.intp)
    seen = np.empty(len(ids), np.intp)
    seen[1:] = input_of.take(ids[:-1])
    seen[begins[counts > 0]] = input_of[END]
    before[where + (WINDOW - STEP)] = seen
    return before, spans(steps), where


def windows(ids: np.ndarray, counts: np.ndarray, input_of: np.ndarray, portion: int = 4_096):
    """Windows over runs of ids: embeddings seen, slots before the run's begin, ids scored, which exist.

    Slot s of the window that scores ids STEP * w .. + STEP - 1 holds the id before number
    STEP * w - (WINDOW - STEP) + s, the end of the text before standing in front of the first.
    """
    n = int((-(-counts // STEP)).sum())
    for part in range(0, n, portion):
        yield windows_at(ids, counts, input_of, slice(part, part + portion))


def windows_at(ids: np.ndarray, counts: np.ndarray, input_of: np.ndarray, some):
    """The windows of these numbers, counted through all runs."""
    per_run = -(-counts // STEP)
    run = np.repeat(np.arange(len(counts)), per_run)[some]
    begin = starts_of(counts)[run]
    first = spans(per_run)[some] * STEP
    slot = first[:, None] - (WINDOW - STEP) + np.arange(WINDOW)[None, :]
    unseen = slot < 0
    before = np.clip(begin[:, None] + slot - 1, 0, max(len(ids) - 1, 0))
    inputs = np.where(slot <= 0, input_of[END], input_of[ids[before]])
    number = first[:, None] + np.arange(STEP)[None, :]
    valid = number < counts[run, None]
    return inputs, unseen, np.minimum(begin[:, None] + number, len(ids) - 1), valid


def _streams(batch: pa.RecordBatch, tokenizer: str):
    """Portions of a batch, the subword ids of the words of each text with an end, and how many each text has.

    A word is encoded once for all portions within ENCODED bytes of text.
    """
    for group in portions(batch, limit=ENCODED):
        cut = [(part, *words(part.column("text"))) for part in portions(group, limit=2 << 20)]
        coded = pa.concat_arrays([distinct for *_, distinct in cut]).dictionary_encode()
        flat, lengths = encoder(tokenizer).words(coded.dictionary)
        begins, ends = starts_of(lengths), np.cumsum([len(distinct) for *_, distinct in cut])
        for (part, codes, counts, _), own in zip(cut, np.split(coded.indices.to_numpy(), ends[:-1])):
            codes = own[codes]
            each = lengths[codes]
            body = flat[np.repeat(begins[codes], each) + spans(each)].astype(np.int64)
            per_text = sums(each.astype(np.float64), counts).astype(np.int64)
            ids = np.full(len(body) + len(counts), END, np.int64)
            held = np.ones(len(ids), bool)
            held[np.cumsum(per_text + 1) - 1] = False
            ids[held] = body
            yield part, ids, per_text + 1


def _row_ids(part: pa.RecordBatch) -> np.ndarray:
    """A number that rows share only if id and text are equal."""
    ids = part.column("doc_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    return (mixed(mixed(number + known.astype(np.uint64) * np.uint64(3)) ^ hashes(part.column("text").fill_null("")))).view(np.int64)


def _drawn_lines(ids: np.ndarray, per_text: np.ndarray, model: Attention, some: np.ndarray) -> np.ndarray:
    """The windows of these numbers: embeddings of the slots, -1 where unseen, and leaves to predict, -1 beyond the text."""
    inputs, unseen, at, valid = windows_at(ids, per_text, model.input_of, some)
    inputs[:, WINDOW - STEP :][~valid] = model.input_of[END]  # not what the next text begins with
    return np.hstack([np.where(unseen, -1, inputs), np.where(valid, model.leaf_of[ids[at]], -1)]).astype("<i2")


def _window_keys(rows: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A hash of each window, by its row and place."""
    per_run = -(-per_text // STEP)
    return mixed(np.repeat(rows.view(np.uint64), per_run) + mixed(spans(per_run)))


def context(tokens: DataFrame, model: Attention, share: float) -> DataFrame:
    """What the learned texts say about context: rows of cell and n, and rows of key and window.

    A cell is an id's embedding and the leaf that follows, n how often in one task's texts. Of
    all windows those of the smallest hash are drawn, `share` of them wherever they stand.
    """
    leaves, limit = TOP + GROUPS, np.uint64(min(share * 2.0**64, 2.0**64 - 2**12))

    def gathered(batches):
        total = np.zeros((OWN + GROUPS) * leaves, np.int64)
        empty = lambda n, kind: pa.nulls(n, kind)
        for rows, ids, per_text in _runs(batches):
            before = model.input_of[np.concatenate([[END], ids[:-1]])].astype(np.int64)
            total += np.bincount(before * leaves + model.leaf_of[ids], minlength=len(total))
            key = _window_keys(rows, per_text)
            drawn = np.flatnonzero(key < limit) if share < 1 else np.arange(len(key))
            line = _drawn_lines(ids, per_text, model, drawn)
            line = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * (WINDOW + STEP)), len(line), [None, pa.py_buffer(np.ascontiguousarray(line))])
            none = empty(len(drawn), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(key[drawn].view(np.int64)), line.cast(pa.binary())], ["cell", "n", "key", "window"])
        held = np.flatnonzero(total)
        for cells in np.array_split(held, max(1, len(held) // 100_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(total[cells]), empty(len(cells), pa.int64()), empty(len(cells), pa.binary())], ["cell", "n", "key", "window"]
            )

    return tokens.filter("learned").select("row", "ids").mapInArrow(gathered, "cell bigint, n bigint, key bigint, window binary")


class _Adam:
    """Steps of a model's weights with the moments they need."""

    def __init__(self, model: Attention):
        self.model, self.t = model, 0
        self.m = {k: np.zeros_like(x) for k, x in model.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in model.p.items()}

    def step(self, lines: np.ndarray, rate: float) -> None:
        unseen, valid = lines[:, :WINDOW] < 0, lines[:, WINDOW:] >= 0
        inputs, targets = np.where(unseen, self.model.input_of[END], lines[:, :WINDOW]), np.where(valid, lines[:, WINDOW:], 0)
        self.move(self.model.step(inputs, unseen, targets, valid)[1], rate)

    def move(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        m, s, p = self.m, self.s, self.model.p
        for k, g in gradients.items():
            m[k] *= np.float32(0.9)
            m[k] += np.float32(0.1) * g
            s[k] *= np.float32(0.99)
            s[k] += np.float32(0.01) * g * g
            root = np.sqrt(s[k] * np.float32(1 / (1 - 0.99**self.t)))
            root += np.float32(1e-8)
            p[k] = p[k] - np.float32(rate / (1 - 0.9**self.t)) * m[k] / root


def passed(tokens: DataFrame, model: Attention) -> dict[str, np.ndarray]:
    """The weights after a pass over all windows of the learned texts.

    Each task goes on from the same weights through the windows of its texts, PASS_BATCH a step; the tasks'
    weights are averaged on Spark, slice by slice, by the windows they saw. So the steps taken grow
    with the texts, and what reaches the driver does not. Without a window the weights stay.
    """
    names, shapes = list(model.p), {k: x.shape for k, x in model.p.items()}

    def walked(batches):
        own = Attention(model.input_of, model.leaf_of, model.log_share, {k: x.copy() for k, x in model.p.items()})
        adam, seen = _Adam(own), 0
        context, first = WINDOW - STEP, np.arange(WINDOW) < WINDOW - STEP
        # What no step has taken yet: embeddings behind their context, leaves (-1 beyond a text), numbers of the windows in their text.
        before, leaves, number = np.full(context, own.input_of[END], np.intp), np.zeros(0, np.int32), np.zeros(0, np.int64)

        def go_on(at: int, n: int) -> None:
            targets = leaves[at * STEP : (at + n) * STEP]
            unseen = (number[at : at + n] == 0)[:, None] & first
            adam.move(own.along(before[at * STEP : (at + n) * STEP + context], STEP, unseen, targets, targets >= 0)[1], PASS_RATE)

        for _, ids, per_text in _runs(batches):
            more, numbers, where = laid_out(ids, per_text, own.input_of)
            leaf = np.full(len(more) - context, -1, np.int32)
            leaf[where] = own.leaf_of.take(ids)
            before, leaves, number = (np.concatenate(x) for x in ((before, more[context:]), (leaves, leaf), (number, numbers)))
            whole = len(number) // PASS_BATCH * PASS_BATCH
            for at in range(0, whole, PASS_BATCH * PASS_SHARE):
                go_on(at, PASS_BATCH)
                seen += PASS_BATCH
            before, leaves, number = before[whole * STEP :], leaves[whole * STEP :], number[whole:]
        if len(number) >= PASS_BATCH // 4:  # fewer say too little for a step
            go_on(0, len(number))
            seen += len(number)
        if seen:
            flat = np.concatenate([own.p[k].ravel() for k in names]).astype("<f4")
            slices = [flat[at : at + SLICE].tobytes() for at in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(slices))), pa.array(slices, pa.binary()), pa.array(np.full(len(slices), seen))], ["at", "weights", "n"]
            )

    def averaged(table_: pa.Table) -> pa.Table:
        n = table_.column("n").to_numpy().astype(np.float64)
        each = np.stack([np.frombuffer(w, "<f4") for w in table_.column("weights").to_pylist()]).astype(np.float64)
        order = np.lexsort(each.T[:4])  # summed alike however the rows came
        mean = (each[order] * n[order, None]).sum(axis=0) / n.sum()
        return pa.table({"at": table_.column("at")[:1], "weights": pa.array([mean.astype("<f4").tobytes()], pa.binary())})

    each = tokens.filter("learned").select("row", "ids").mapInArrow(walked, "at bigint, weights binary, n bigint")
    found = each.groupBy("at").applyInArrow(averaged, "at bigint, weights binary").toArrow().sort_by("at")
    if not found.num_rows:
        return model.p
    flat = np.frombuffer(b"".join(found.column("weights").to_pylist()), "<f4")
    ends = np.cumsum([int(np.prod(shapes[k])) for k in names])
    return {k: x.reshape(shapes[k]).copy() for k, x in zip(names, np.split(flat, ends[:-1]))}


def _smoothed(n: np.ndarray, whole: np.ndarray, kinds: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Witten-Bell shares: n of a row's whole, and as much for `otherwise` as the row has kinds."""
    return (n + kinds * otherwise) / (whole + kinds)


def trained(tokens: DataFrame, counts: np.ndarray, n_texts: int, seed: int) -> Attention:
    """The model of the learned texts: transitions counted over all of them, attention weights by Adam.

    STEPS * BATCH windows at most, drawn from all whole texts, start the weights; a pass over all
    windows, in the tasks that hold them, goes on from there. Windows held back from the
    start fit the weight of the transitions, each without its own count in them.
    """
    model = Attention.new(counts, seed)
    if not n_texts:
        return model
    gathered = stored(context(tokens, model, STEPS * BATCH / (counts.sum() / STEP + n_texts)), "context")
    drawn = gathered.filter("window IS NOT NULL").select("key", "window").toArrow()
    order = np.argsort(drawn.column("key").to_numpy(), kind="stable")  # alike however the rows are dealt
    lines = np.frombuffer(b"".join(drawn.column("window").to_pylist()), "<i2").reshape(-1, WINDOW + STEP)[order]
    held = np.arange(len(lines)) % HELD == HELD - 1
    learnt = np.flatnonzero(~held)
    rng, adam = np.random.default_rng(seed), _Adam(model)
    for t in range(1, STEPS + 1 if len(learnt) else 1):
        adam.step(lines[learnt[rng.integers(0, len(learnt), BATCH)]], 0.01 * (1 - t / (STEPS + 1)) + 1e-4)
    model.p = passed(tokens, model)

    leaves = TOP + GROUPS
    found = gathered.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((OWN + GROUPS) * leaves)
    n[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape(-1, leaves)
    whole, kinds = n.sum(axis=1), np.maximum((n > 0).sum(axis=1), 1)
    mass = np.bincount(model.leaf_of, counts + 0.1, minlength=leaves)
    mass /= mass.sum()
    alone, without, tables = [], [], model.tables()
    for some in np.array_split(lines[held], max(1, held.sum() // 4_096)):
        unseen, valid = some[:, :WINDOW] < 0, some[:, WINDOW:] >= 0
        flat = np.where(unseen, model.input_of[END], some[:, :WINDOW])
        before, leaf = flat[:, WINDOW - STEP :][valid], some[:, WINDOW:][valid].astype(np.int64)
        alone.append(np.exp(model.log_leaf(model.in_windows(flat, unseen)[valid], leaf)))
        own = n[before, leaf]
        kinds_ = np.maximum(kinds[before] - (own == 1), 1)
        without.append(_smoothed(np.maximum(own - 1, 0), np.maximum(whole[before] - 1, 0), kinds_, mass[leaf]))
    alone, without = np.concatenate(alone), np.concatenate(without)
    model.trust = 0.5
    for _ in range(50 if len(alone) else 0):
        follows = model.trust * without
        model.trust = float(np.clip(np.mean(follows / (follows + (1 - model.trust) * alone)), 1e-3, 1 - 1e-3))
    model.follows = _smoothed(n, whole[:, None], kinds[:, None], mass[None, :]).astype(np.float32)
    return model


def score(docs: DataFrame, training: DataFrame | Column, tokenizer: str = TOKENIZER, seed: int = 31) -> DataFrame:
    """Scores of every whole text by the model and by a word unigram base, learned from `training`.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score, a row per row of
    `docs`. Word counts cover all of `training`. The words frequent enough to be at most FREQUENT
    travel to the tasks; the counts of all others meet the documents in a join on a 64-bit hash
    of the word, of which no word can have more than one in FREQUENT tokens. The shares of the
    subword ids and what follows each id cover all of `training`, every text whole; the attention
    weights start from windows drawn from all of it and go on through every window.
    Every text is tokenised once, its ids are stored for all passes. `training` is a table or, where
    the texts to learn from are among `docs`, a condition on their columns.

    A null or empty text is its end alone. Without training rows every count is 0, and the model
    is left as it starts. Repeated rows score alike; other columns are not read.
    """
    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column("word")).view(np.int64)), batch.column("n")], ["word", "held"])

    own, learns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), isinstance(training, Column)
    if learns:
        learning = docs.filter(training).select("text")
        both = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", training.alias("learned"), F.lit(True).alias("scored"))
    else:
        learning = training.select("text")
        taught = training.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(True).alias("learned"), F.lit(False).alias("scored"))
        both = own.withColumns({"learned": F.lit(False), "scored": F.lit(True)}).unionByName(taught)
    tokens = tokenised(both, tokenizer)
    counts = stored(word_counts(learning), "counts")
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_ends = learning.count()
    n_tokens, types = n_words + n_ends, distinct + (n_ends > 0)
    floor = np.log10(n_tokens + 0.1 * (types + 1))
    frequent = counts.filter(F.col("n") * FREQUENT >= n_tokens)
    frequent = frequent.mapInArrow(hashed, "word bigint, held bigint").toArrow()
    keys = frequent.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, known = keys[order], frequent.column("held").to_numpy().astype(np.float64)[order]
    model = trained(tokens, id_counts(tokens), n_ends, seed)
    end_base = np.log10(n_ends + 0.1) - floor

    def looked_up(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = hashes(strings)
        if not len(keys):
            return own, np.zeros(len(own), bool), np.zeros(len(own))
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        held = keys[at] == own
        return own, held, np.where(held, known[at], 0.0)

    def looked(batches):
        for batch in batches:
            for part in portions(batch, limit=2 << 20):
                codes, counts_, strings = words(part.column("text"))
                own, held, n = looked_up(strings)
                base = np.where(held, np.log10(n + 0.1) - floor, 0.0)
                rows, of = _row_ids(part), np.repeat(np.arange(len(counts_)), counts_)
                whole = pa.StructArray.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts_ + 1),
                        pa.array(sums(held[codes].astype(np.float64), counts_).astype(np.int64) + (n_ends > 0)),
                        pa.array(sums(base[codes], counts_) + end_base),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score"],
                )
                none = pa.nulls(len(rows), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows), pa.array(np.zeros(len(rows), np.int32)), whole, none], ROWS)
                rare = ~held[codes]
                types_ = max(len(strings), 1)
                pair, n = np.unique(of[rare] * types_ + codes[rare], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[pair // types_]), pa.array(own[pair % types_].view(np.int64)), pa.array(n.astype(np.int32)),
                        pa.nulls(len(pair), whole.type), pa.nulls(len(pair), pa.float64()),
                    ],
                    ROWS,
                )

    def scored(batches):
        tables = model.tables()
        for rows, ids, per_text in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(model.log10(ids, per_text, tables))], ["row", "score"])

    # A row per text with what the task knew of its words, under a word number of its own and no count, a
    # row per rare word of it, and one with its score.
    doc = "struct<doc_id: bigint, n_tokens: bigint, n_known: bigint, base_score: double>"
    rows = own.mapInArrow(looked, f"row bigint, word bigint, n int, doc {doc}, score double")
    scores = tokens.filter("scored").select("row", "ids").mapInArrow(scored, "row bigint, score double")
    scores = scores.select("row", F.col("row").alias("word"), F.lit(0).alias("n"), F.lit(None).cast(doc).alias("doc"), "score")

    totals = counts.mapInArrow(hashed, "word bigint, held bigint")
    held = F.coalesce("held", F.lit(0))
    known_n = F.when(held > 0, F.col("n")).otherwise(0) + F.coalesce("doc.n_known", F.lit(0))
    base = F.col("n") * (F.log10(held + 0.1) - F.lit(float(floor))) + F.coalesce("doc.base_score", F.lit(0.0))
    met = rows.join(totals, "word", "left").unionByName(scores.withColumn("held", F.lit(None).cast("bigint")))
    each = met.groupBy("row").agg(
        F.max("doc.doc_id").alias("doc_id"), F.sum("doc.n_tokens").alias("n_tokens"), F.sum(known_n).alias("n_known"),
        F.sum(base).alias("base_score"), F.max("score").alias("score"), F.count("doc").alias("copies"),
    )
    # Rows alike in id and text were added up; they part again.
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    part = lambda name: (F.col(name) / F.col("copies")).cast("bigint").alias(name)
    return each.select(
        "doc_id", part("n_tokens"), part("n_known"), F.lit(int(n_tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"), "score",
    )


def op8_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, remainder(F.col("doc_id"), 10) != 0)
    held_out = (remainder(F.col("doc_id"), 10) == 0).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
