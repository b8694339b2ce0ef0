"""What tokenising, a training step and scoring move in memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from claimflow.llm import scoring, tokens
from test_whole_pass import _batch


def test_words_are_encoded_together_with_the_ids_each_has_alone(monkeypatch):
    encoder, rng = tokens.encoder(scoring.TOKENIZER), random.Random(1)
    letters = "abcXYZ01'.,-\u0085 　 \x1c\x1fé日\U0001f600<|endoftext|>tsd"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    plain = [w for w in words if not w[-1].isspace()]
    each = {w: encoder.short.encode_ordinary(" " + w) for w in words}
    calls = []

    class Counted:
        def __getattr__(self, name):
            return lambda *a, **k: (calls.append(name), getattr(short, name)(*a, **k))[1]

    short = encoder.short
    monkeypatch.setattr(encoder, "short", Counted())
    for asked, most in ((words, len(words) - len(plain) + 1), (plain, 1), ([], 0)):
        calls.clear()
        ids, lengths = encoder.words(pa.array(asked, pa.string()))
        assert lengths.tolist() == [len(each[w]) for w in asked]
        assert ids.tolist() == [i for w in asked for i in each[w]]
        assert len(calls) <= most


def test_a_step_holds_the_attention_of_few_windows_at_once():
    model, batch = _batch(1_024)
    model.step(*batch)
    tracemalloc.start()
    model.step(*batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # 30 MB with that of all windows


def test_scoring_looks_up_embeddings_not_pairs_of_them():
    model, _ = _batch(64)
    assert sum(x.nbytes for x in model.tables()) < 2 << 20  # 16 MB for the weights of all pairs
    counts = np.array([40_000])
    tracemalloc.start()
    model.log10(np.arange(40_000) % 3_000, counts, model.tables())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # 47 MB with larger blocks and their pairs
