"""The pass that trains the attention weights takes every window."""

import numpy as np
from pyspark.sql import functions as F

from claimflow.llm import scoring


def test_every_window_is_in_the_pass(spark, monkeypatch):
    words = "storm flood roof claim paid hail water car theft fire glass".split()
    text = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.col("id") * 7 + i * i, F.lit(11)) + 1).cast("int")) for i in range(90)])
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(True).alias("learned"), F.lit(True).alias("scored"))
    tokens = scoring.tokenised(docs, scoring.TOKENIZER).coalesce(1)
    model = scoring.Attention.new(scoring.id_counts(tokens), 1)
    before = {k: x.copy() for k, x in model.p.items()}
    after = scoring.passed(tokens, model)
    assert any(not np.array_equal(before[k], after[k]) for k in before)


def _batch(n, seed=3):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.pareto(0.7, 9 * n) * 5, scoring.IDS - 2).astype(np.int64)
    model = scoring.Attention.new(np.bincount(ids, minlength=scoring.IDS).astype(float), seed)
    lines = scoring._drawn_lines(ids, np.full(n // 8, 72), model, slice(0, n))
    unseen, valid = lines[:, : scoring.WINDOW] < 0, lines[:, scoring.WINDOW :] >= 0
    return model, (np.where(unseen, 0, lines[:, : scoring.WINDOW]), unseen, np.where(valid, lines[:, scoring.WINDOW :], 0), valid)


def test_gradients_of_neighbouring_and_of_single_windows():
    model, batch = _batch(64)
    model.p["d"] += np.linspace(-1, 0, scoring.WINDOW, dtype=np.float32)
    mixed = np.random.default_rng(1).permutation(64)
    for some in (np.arange(64), mixed):  # windows that follow each other, and windows that do not
        args = [x[some] for x in batch]
        _, g = model.step(*args)
        for name, x in model.p.items():
            at = np.unravel_index(np.abs(g[name]).argmax(), x.shape)
            kept, losses = x[at], []
            for move in (1e-2, -1e-2):
                x[at] = kept + np.float32(move)
                losses.append(model.step(*args)[0])
            x[at] = kept
            assert np.isclose((losses[0] - losses[1]) / 2e-2, g[name][at], rtol=0.05, atol=2e-4), name


def test_a_step_adds_up_what_windows_share_before_it_goes_to_the_embeddings(monkeypatch):
    model, batch = _batch(1_024)
    added, plain = [], scoring._added
    monkeypatch.setattr(scoring, "_added", lambda total, at, rows: (added.append(at.size), plain(total, at, rows)))
    model.step(*batch)
    assert added and sum(added) < 1.1 * scoring.STEP * 1_024  # WINDOW rows a window without that
