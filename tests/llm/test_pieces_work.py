"""Units are taken apart in Arrow, beginnings of pieces are found in few looks, and the draws stay as they were."""

import hashlib

import numpy as np
import pyarrow as pa

from claimflow.llm import pieces


def test_arrow_texts_give_the_draws_of_the_former_code():
    model, rng = pieces.lattice(pieces.MODEL), np.random.default_rng(6)
    letters = list("abcdehilnorst日本é▁\U0001f600\n   ")
    texts = ["".join(rng.choice(letters, n).tolist()) for n in (1, 5, 60, 600, 3000)] + ["", " ", "  a", " b ", "a" * 700]
    keys = np.arange(len(texts))
    ids, counts = model.sample(pa.array(texts), keys, 9)
    assert hashlib.sha256(ids.astype("<i4").tobytes() + counts.astype("<i8").tobytes()).hexdigest()[:16] == "b25f7ff20aa4bb8e"
    assert model.decode(ids, counts) == texts
    with_null = model.sample(pa.array([*texts[:-1], None]), keys, 9)
    assert with_null[1].tolist() == [*counts[:-1], 0] and (with_null[0] == ids[: counts[:-1].sum()]).all()
    assert [len(x) for x in model.sample(pa.array([None, ""], pa.string()), keys[:2], 9)] == [0, 2]


def test_only_hashes_behind_their_place_look_on(monkeypatch):
    model = pieces.Lattice(pieces.MODEL)
    known, looked = model.prefixes, []

    class Counted:
        def __len__(self):
            return len(known)

        def __getitem__(self, at):
            looked.append(np.size(at))
            return known[at]

    other = known + np.uint64(1)
    other = other[~np.isin(other, known)]
    monkeypatch.setattr(model, "prefixes", Counted())
    assert (model._place(known) == np.arange(len(known))).all()
    assert sum(looked) < 1.5 * len(known)  # one look each, and one more for those that share a slot
    assert (known[model._place(other)] != other).all()
    assert (known[model._place(np.array([0, 2**64 - 1], np.uint64))] == known[[0, -1]]).all()
