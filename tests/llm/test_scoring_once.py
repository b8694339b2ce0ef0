"""A word is encoded once, and a slot looked up once, however many portions and windows hold it."""

import numpy as np
import pyarrow as pa

from claimflow.llm import scoring
from claimflow.llm.tokens import encoder


def test_words_of_all_portions_are_encoded_once(monkeypatch):
    rng, own = np.random.default_rng(1), encoder(scoring.TOKENIZER)
    known = [f"{a}{b}" for a in ("storm", "flood", "Hail", "zürich", "\U0001f600x") for b in range(400)]
    texts = [" ".join(rng.choice(known, 4_000)) for _ in range(250)] + [None, "", " \t", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    asked, words = [], own.words
    monkeypatch.setattr(own, "words", lambda w: (asked.append(len(w)), words(w))[1])
    parts = list(scoring._streams(batch, scoring.TOKENIZER))
    assert len(parts) > 3 and sum(asked) == len(known) + 1  # each portion's words anew before
    ids, counts = np.concatenate([ids for _, ids, _ in parts]), np.concatenate([n for *_, n in parts])
    plain = [[i for w in (t or "").lower().split() for i in own.short.encode_ordinary(" " + w)] + [scoring.END] for t in texts]
    assert counts.tolist() == list(map(len, plain)) and ids.tolist() == [i for run in plain for i in run]


class _Here:
    """Runs the pass's function over batches in this process."""

    def __init__(self, batches):
        self.batches = batches

    def filter(self, *_):
        return self

    select = filter

    def mapInArrow(self, made, _):
        self.found = pa.Table.from_batches(list(made(iter(self.batches))))
        return self

    def groupBy(self, _):
        return self

    def applyInArrow(self, *_):
        return self

    def toArrow(self):
        return self.found


def test_the_pass_steps_over_every_window_and_looks_a_slot_up_once(monkeypatch):
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 60, 400)
    ids = np.minimum(rng.pareto(0.7, counts.sum()) * 5, 5_000).astype(np.int64)
    runs = np.split(ids.astype("<u2"), np.cumsum(counts)[:-1])
    rows = [pa.RecordBatch.from_arrays([pa.array(np.arange(len(some))), pa.array([r.tobytes() for r in some], pa.binary())], ["row", "ids"]) for some in (runs[:150], runs[150:151], runs[151:])]
    model = scoring.Attention.new(np.bincount(ids, minlength=scoring.IDS).astype(float), 1)
    monkeypatch.setattr(scoring, "PASS_BATCH", 128)
    lines = scoring._drawn_lines(ids, counts, model, slice(None))
    plain = scoring._Adam(scoring.Attention(model.input_of, model.leaf_of, model.log_share, {k: x.copy() for k, x in model.p.items()}))
    taken = [lines[at : at + 128] for at in range(0, len(lines), 128)]
    for some in taken if len(taken[-1]) >= 32 else taken[:-1]:
        plain.step(some, scoring.PASS_RATE)
    looked, along = [], scoring.Attention.along
    monkeypatch.setattr(scoring.Attention, "along", lambda self, flat, *rest: (looked.append(len(flat)), along(self, flat, *rest))[1])
    found = scoring.passed(_Here(rows), model)
    for name, x in plain.model.p.items():
        assert np.allclose(found[name], x, atol=2e-3), name
        assert not np.allclose(model.p[name], x, atol=2e-3), name
    assert sum(looked) <= scoring.STEP * len(lines) + (scoring.WINDOW - scoring.STEP) * len(looked)  # WINDOW a window before
