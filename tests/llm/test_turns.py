"""Conversation repair against trying out all edits, and on rows that go wrong easily."""

import hashlib
import itertools
import random
import re

import pytest

from claimflow.llm import turns

GRAMMAR = re.compile(r"(s?(ua)+)?")
COLUMNS = "conv_id long, turn long, role string, text string, score double, audit string, cost int"


def by_trial(rows: list[tuple[str, str, str]]) -> tuple[int, str, str]:
    """The cheapest edits of (role, text, fault) rows of all that there are, ASCII-least, and what they leave."""
    options = []
    for role, text, fault in rows:
        dear = 1 if fault == "truncated" else 0
        own = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            own.append((dear, "K", [f"{role}:{text}"]))
            own += [(2 + dear, "R", [f"{x}:{text}"]) for x in ("user", "assistant")]
        options.append(own)
    inserts = [(0, "", []), *((2, "I", [x + ":"]) for x in ("user", "assistant")), (4, "II", ["user:", "assistant:"]), (4, "II", ["assistant:", "user:"])]
    best = None
    for choice in itertools.product(*(y for own in options for y in (inserts, own)), inserts):
        lines = [x for c in choice for x in c[2]]
        if GRAMMAR.fullmatch("".join(x[0] for x in lines)):
            one = (sum(c[0] for c in choice), "".join(c[1] for c in choice), "\n".join(lines))
            best = one if best is None else min(best, one)
    return best


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(turns.SPACES)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def random_rows(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", " ", "uncle"], ["Yes.", "No", " ", "Why? ", "a.b", "Go!"]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def repaired(rows) -> tuple:
    one = turns.Conversation(7, True)
    for i, row in enumerate(rows):
        one.add(i, *row)
    return one.row()


def test_against_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = faults_of(random_rows(rng, rng.randrange(0, 4)))
        cost, audit, text = by_trial(rows)
        got = repaired(rows)
        assert got[6:8] == (cost, audit) and got[9] == text
        assert got[8] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("span", [1, 2, 3, 5])
def test_spans_change_nothing(span, monkeypatch):
    """A conversation cut into spans is repaired as one that is aligned at once."""
    rng = random.Random(span)
    for _ in range(25):
        rows = faults_of(random_rows(rng, rng.randrange(1, 16)))
        monkeypatch.setattr(turns, "SPAN", 16)
        whole = repaired(rows)
        monkeypatch.setattr(turns, "SPAN", span)
        assert repaired(rows) == whole


def test_odd_rows(spark):
    long = [(8, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(3000)]
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (1, 1, "assistant", "Ho."),
        (2, None, None, None), (2, None, "user", "So?"),
        (None, 4, "assistant", "x"), (None, 9, "user", ""),
        (3, -(1 << 63), "", "."), (3, (1 << 63) - 1, "system", "a" * 100_000 + "."),
        *long,
    ]
    frame = spark.createDataFrame([(*r, 0.0, "x", 1) for r in rows], COLUMNS).repartition(4)
    got = {r["conv_id"]: r for r in turns.repairs(frame).collect()}
    assert set(got) == {1, 2, 3, 8, None}
    assert got[1]["audit"] == "KKD" and got[1]["duplicate"] == 1 and got[1]["repaired"] == "user:Hi.\nassistant:Ho."
    assert got[2]["gaps"] == 0 and got[2]["blank"] == 1 and got[2]["audit"] in ("DDD", "DKI")
    assert got[None]["gaps"] == 4 and got[None]["blank"] == 1
    assert got[3]["gaps"] == turns.MOST
    assert got[8]["cost"] == 0 and got[8]["audit"] == "K" * 3000
    assert turns.repairs(frame.limit(0)).count() == 0


def test_all_rows_absent(spark):
    """A conversation whose rows are all dropped is listed with zeros."""
    frame = spark.createDataFrame([(i, 0, "user", "Hi.") for i in range(60)], "conv_id long, turn long, role string, text string")
    hurt = turns.damaged(frame)
    gone = {r[0] for r in hurt.filter("absent").collect()}
    got = {r["conv_id"]: r for r in turns.repairs(hurt).collect()}
    assert gone and set(got) == set(range(60))
    for i in gone:
        assert got[i]["audit"] == "" and got[i]["cost"] == 0 and got[i]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
