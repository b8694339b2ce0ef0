"""Vector codes: pruned search against every entry, rounds against plain k-means, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from claimflow.llm import codebooks


def nearest(rows, entries):
    found = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
    return found.argmin(1), found.min(1)


@pytest.mark.parametrize("spread", [3, 40, 5000])
def test_balls_find_the_nearest(spread):
    """Small spreads make ties and equal entries."""
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, (60, 5))
    rows = rng.integers(-spread, spread, (4000, 5))
    codes, best = codebooks.Balls.around(entries, np.ones(60, bool)).assign(rows, None)
    want = nearest(rows, entries)
    assert (codes == want[0]).all() and (best == want[1]).all()
    for _ in range(4):
        moved = rng.random(60) < 0.3
        entries = np.where(moved[:, None], entries + rng.integers(-2, 3, entries.shape), entries)
        codes, best = codebooks.Balls.around(entries, moved).assign(rows, codes)
        want = nearest(rows, entries)
        assert (codes == want[0]).all() and (best == want[1]).all()


def test_stable_cores_are_left_out(monkeypatch):
    """Well apart balls compare nothing in a second round."""
    rng = np.random.default_rng(0)
    entries = np.arange(20)[:, None] * np.full(4, 10_000)
    rows = entries[rng.integers(0, 20, 500)] + rng.integers(-9, 9, (500, 4))
    balls = codebooks.Balls.around(entries, np.ones(20, bool))
    codes, _ = balls.assign(rows, None)
    monkeypatch.setattr(codebooks, "apart", lambda *_: pytest.fail("compared"))
    assert (balls.assign(rows, codes)[0] == codes).all()


def plain(vectors: list[tuple[int, list[float]]]):
    """Every round over every entry, in Python's whole numbers."""
    rows = {i: [math.floor(1024 * x) for x in v] for i, v in vectors}
    ids, width = sorted(rows), len(next(iter(rows.values())))
    codes, error, books = {i: "" for i in ids}, dict.fromkeys(ids, 0), []
    for p in range(4):
        own = {i: rows[i][width * p // 4 : width * (p + 1) // 4] for i in ids}
        book = [own[i] for i in ids[:256]]
        find = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
        for _ in range(4):
            at = {i: find(own[i], book)[1] for i in ids}
            for k in range(len(book)):
                members = [own[i] for i in ids if at[i] == k]
                if members:
                    book[k] = [sum(c) // len(members) for c in zip(*members)]
        for i in ids:
            d, k = find(own[i], book)
            codes[i] += f"{k:02x}"
            error[i] += d
        books += [str(x) for c in book for x in c]
    return codes, error, hashlib.sha256(",".join(books).encode()).hexdigest()


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 30])).tolist()) for i in range(400)]
    frame = spark.createDataFrame([(i, v, i % 3) for i, v in vectors], "vec_id long, embedding array<double>, label int").repartition(5)
    codes, error, sha = plain(vectors)
    got = codebooks.codes(frame).collect()
    assert {r["vec_id"]: r["code"] for r in got} == codes and {r["vec_id"]: r["error"] for r in got} == error
    assert {r["codebooks_sha256"] for r in got} == {sha}
    for label in range(3):
        assert {r["label_error"] for r in got if r["vec_id"] % 3 == label} == {sum(e for i, e in error.items() if i % 3 == label)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5] * 8, None), (2, [0.25] * 8, 1), (2, [0.25] * 8, 1), (3, None, 1), (4, [1.0, None] * 4, 1), (5, [nan] * 8, 1), (6, [inf] * 8, 2),
        (None, [0.4] * 8, None), (7, [0.0] * 8, 2), (8, [], 2), (9, [1.0, 2.0, 3.0], 2), (10, [1e30, -1e30] * 4, 3), (11, [-0.0001] * 8, 3),
    ]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    got = codebooks.codes(frame).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["1", "2", "2", "None", "7", "8", "9", "10", "11"])
    by_id = {r["vec_id"]: r for r in got}
    assert by_id[8]["code"] == "00000000" and by_id[8]["error"] == 0
    assert by_id[9]["error"] == 0 and by_id[9]["codebooks_sha256"] == hashlib.sha256(b"1024,2048,3072").hexdigest()
    assert by_id[1]["label_error"] == by_id[1]["error"] + by_id[None]["error"]
    assert codebooks.codes(frame.limit(0)).count() == 0
    assert len({r["codebooks_sha256"] for r in got if r["vec_id"] not in (8, 9)}) == 1
