"""Sampled segmentations over a piece lattice, and lossless decoding (operator 6)."""

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.text import mixed, portions, spans, starts_of, sums, table, task_state
from claimflow.llm.tokens import located

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Piece probabilities follow their rank r in the model as 1 / (r + FLAT); a byte has that of the last rank.
FLAT = 20.0
# Places that all units are walked through side by side; beyond, where few are so long, each goes on alone.
LONG = 256
# First bits of a hash that lead to its place among the beginnings of pieces.
SLOT_BITS = 20
ENCODED = "doc_id bigint, ids array<int>"


def _points(units: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of units of these sizes, 0 for a space mark behind the first place; UTF-8 widths; where units end."""
    points = np.frombuffer(units.encode("utf-32-le"), np.uint32).astype(np.uint64)
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    opens = np.zeros(len(points), bool)
    opens[starts_of(sizes)] = True
    return np.where((points == ord(SPACE)) & ~opens, np.uint64(0), points), wide, np.cumsum(sizes)


class Lattice:
    """The pieces of a model file with their probabilities, and the lattices of units of text.

    A unit is a space with what follows it up to the next space. Pieces with a space inside lie
    outside the lattice, so a text's lattice is the chain of its units'. A character without a
    piece of its own, and a literal U+2581, goes by its bytes.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=located(path))
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        held = {i: model.id_to_piece(i) for i in plain}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_log_p = -np.log(len(plain) + FLAT)
        self.text_of = {i: p.replace(SPACE, " ").encode() for i, p in held.items()} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.log_p = np.zeros(n)
        self.log_p[plain] = -np.log(np.arange(len(plain)) + FLAT)
        # Every beginning of a piece as a hash, with the piece that ends there or -1.
        kept = {i: p for i, p in held.items() if SPACE not in p[1:]}
        points, _, ends = _points("".join(kept.values()), np.array(list(map(len, kept.values()))))
        begin = np.concatenate([[0], ends[:-1]])
        numbers, key, prefixes, self.longest = np.array(list(kept)), np.zeros(len(kept), np.uint64), {}, int((ends - begin).max())
        for length in range(1, self.longest + 1):
            inside = begin + length <= ends
            numbers, key, begin, ends = numbers[inside], key[inside], begin[inside], ends[inside]
            key = mixed(key ^ points[begin + length - 1])
            for k, i, whole in zip(key.tolist(), numbers.tolist(), (begin + length == ends).tolist()):
                if whole or k not in prefixes:
                    prefixes[k] = i if whole else -1
        self.prefixes = np.array(sorted(prefixes), np.uint64)
        self.piece_at = np.array([prefixes[int(k)] for k in self.prefixes], np.int64)
        edges = np.searchsorted(self.prefixes, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
        self.crowded = int(np.diff(edges, append=len(self.prefixes)).max())
        self.slots = np.minimum(edges, len(self.prefixes) - 1).astype(np.int32)

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where each hash is among the beginnings, if it is one: its slot's first place, and on from there."""
        at = self.slots[(key >> np.uint64(64 - SLOT_BITS)).view(np.int64)]
        behind, last = np.flatnonzero(self.prefixes[at] < key), len(self.prefixes) - 1
        for _ in range(self.crowded - 1):
            if not len(behind):
                break
            at[behind] = np.minimum(at[behind] + 1, last)
            behind = behind[self.prefixes[at[behind]] < key[behind]]
        return at

    def arcs(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the units: first character, length, id; -1 where a character goes by its bytes."""
        active, key = np.arange(len(points)), np.zeros(len(points), np.uint64)
        room = ends - active
        alone = np.ones(len(points), bool)
        found = []
        for length in range(1, self.longest + 1):
            key = mixed(key ^ points[active + (length - 1)])
            at = self._place(key)
            goes_on = np.flatnonzero(self.prefixes[at] == key)
            active, key, room, piece = active[goes_on], key[goes_on], room[goes_on], self.piece_at[at[goes_on]]
            whole = np.flatnonzero(piece >= 0)
            found.append((active[whole], np.full(len(whole), length), piece[whole]))
            if length == 1:
                alone[active[whole]] = False
            inside = np.flatnonzero(room > length)
            active, key, room = active[inside], key[inside], room[inside]
        bare = np.flatnonzero(alone)
        found.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def sample(self, texts: pa.Array | list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each text drawn by its probability: ids one after the other, ids per text.

        Forward filtering sums, over all distinct units at once, the probabilities of the ways to
        each position. Then the units as they occur are drawn backwards, side by side: an arc
        into a position is taken by its share of that sum. Draw t of a text's unit u is a hash of
        seed, key, u and t, so a text with its key always gets the same segmentation.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.split_pattern(texts.filter(pc.greater(pc.binary_length(texts), 0)), " ")
        per_text = np.zeros(len(texts), np.int64)
        per_text[pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        code, unit = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if not len(code):
            return np.zeros(0, np.int32), per_text
        units = SPACE + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(unit)], pa.int32()), unit.cast(pa.string())), SPACE)[0].as_py()
        sizes = pc.utf8_length(unit).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        points, wide, unit_ends = _points(units, sizes)
        unit_of = np.repeat(np.arange(len(unit)), sizes)
        first, length, piece = self.arcs(points, unit_ends[unit_of])
        # Positions: one before each character of a unit and one behind the last.
        head = first + unit_of[first] + length
        by_end = np.argsort(head, kind="stable")
        first, length, piece, head = (x[by_end] for x in (first, length, piece, head))
        tail, log_p = head - length, np.where(piece >= 0, self.log_p[piece], wide[first] * self.byte_log_p)
        opens = starts_of(sizes + 1)
        forward = self._forward(tail, head, log_p, opens, head - opens[unit_of[first]], len(points) + len(unit))
        upto = np.cumsum(np.exp(forward[tail] + log_p - forward[head]))
        each = np.bincount(head, minlength=len(points) + len(unit))
        ends_at = np.cumsum(each)
        upto -= np.concatenate([[0.0], upto])[(ends_at - each)[head]]  # of each arc and those before it
        opens = ends_at - each  # arcs into a position follow each other
        base = mixed(np.repeat(mixed(keys.astype(np.uint64) ^ mixed(np.full(1, seed, np.uint64))), per_text) + spans(per_text).astype(np.uint64))
        left = sizes[code]
        where = starts_of(sizes + 1)[code] + left
        # Of the units that are not through: their numbers, places, what is left of them, and the first numbers of their draws.
        active, drawn, turn, draws = np.arange(len(code)), [], 0, base
        while len(active) and turn < LONG:
            u = (mixed(draws + np.uint64(turn)) >> np.uint64(11)) * 2.0**-53
            arc = opens[where]
            beyond = np.flatnonzero(each[where] > 1)
            while len(beyond):  # on to the next arc while the share up to this one is passed
                beyond = beyond[upto[arc[beyond]] <= u[beyond]]
                beyond = beyond[arc[beyond] + 1 < ends_at[where[beyond]]]
                arc[beyond] += 1
            drawn.append((active, arc))
            size = length[arc]
            on = np.flatnonzero(left > size)
            active, draws, where, left = active[on], draws[on], where[on] - size[on], left[on] - size[on]
            turn += 1
        turns = [np.full(len(a), t) for t, (a, _) in enumerate(drawn)]
        for k, one in enumerate(active.tolist()):  # what is left of long units, arc by arc
            arcs = self._drawn_on(int(where[k]), int(left[k]), draws[k], turn, opens, ends_at, upto, length)
            drawn.append((np.full(len(arcs), one), np.array(arcs, np.int64)))
            turns.append(turn + np.arange(len(arcs)))
        occurrence, arc = np.concatenate([a for a, _ in drawn]), np.concatenate([b for _, b in drawn])
        taken = np.bincount(occurrence, minlength=len(code))
        turn_of = np.concatenate(turns)
        ordered = np.empty(len(arc), np.int64)
        ordered[starts_of(taken)[occurrence] + taken[occurrence] - 1 - turn_of] = arc
        n = np.where(piece[ordered] >= 0, 1, wide[first[ordered]])
        out = np.repeat(piece[ordered], n).astype(np.int32)
        bare = out < 0
        if bare.any():
            data = np.frombuffer(units.encode(), np.uint8)
            at = np.repeat(starts_of(wide)[first[ordered]], n) + spans(n)
            out[bare] = self.byte_ids[data[at[bare]]]
        per_unit = sums(n.astype(np.float64), taken)
        return out, sums(per_unit, per_text).astype(np.int64)

    @staticmethod
    def _drawn_on(now: int, left: int, base: np.uint64, turn: int, opens, ends_at, upto, length) -> list[int]:
        """The arcs drawn from here back to the unit's begin; draws, sums and bounds as in `sample`."""
        u = ((mixed(base + np.arange(turn, turn + left, dtype=np.uint64)) >> np.uint64(11)) * 2.0**-53).tolist()
        low = now - left
        begins, stops = opens[low : now + 1].tolist(), ends_at[low : now + 1].tolist()
        first = begins[1] if left else 0
        shares, sizes = upto[first : stops[-1]].tolist(), length[first : stops[-1]].tolist()
        out, at = [], left
        for draw in u:
            arc, stop = begins[at], stops[at]
            while arc + 1 < stop and shares[arc - first] <= draw:
                arc += 1
            out.append(arc)
            at -= sizes[arc - first]
            if not at:
                return out
        return out

    @staticmethod
    def _forward(tail, head, log_p, opens, local, positions: int) -> np.ndarray:
        """Log of the summed probability of all ways to each position, position after position of the units.

        Arcs come in order of their heads; `local` is a head's place in its unit.
        """
        forward = np.full(positions, -np.inf)
        forward[opens] = 0.0
        local = np.minimum(local, LONG + 1).astype(np.uint16)  # sorted by their digits, since they are short
        order = np.argsort(local, kind="stable")
        tail, head, log_p = tail[order], head[order], log_p[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(local)[1:])])
        for begin, end in zip(bounds[:-1][:LONG].tolist(), bounds[1:][:LONG].tolist()):
            own = head[begin:end]
            ways = forward[tail[begin:end]] + log_p[begin:end]
            new = np.flatnonzero(np.diff(own, prepend=-1))
            top = np.maximum.reduceat(ways, new)
            n = np.diff(new, append=len(own))
            forward[own[new]] = top + np.log(np.add.reduceat(np.exp(ways - np.repeat(top, n)), new))
        if len(bounds) > LONG + 1:
            Lattice._forward_on(forward, tail[bounds[LONG] :], head[bounds[LONG] :], log_p[bounds[LONG] :])
        return forward

    @staticmethod
    def _forward_on(forward: np.ndarray, tail: np.ndarray, head: np.ndarray, log_p: np.ndarray) -> None:
        """The same for the positions beyond LONG, of which few units have any: way by way."""
        order = np.argsort(head, kind="stable")
        heads, tails, chances = head[order].tolist(), tail[order].tolist(), log_p[order].tolist()
        known = dict(zip(tails, forward[tail[order]].tolist()))
        at, n = 0, len(heads)
        while at < n:
            here, ways = heads[at], []
            while at < n and heads[at] == here:
                ways.append(known[tails[at]] + chances[at])
                at += 1
            top = max(ways)
            known[here] = top + math.log(sum([math.exp(w - top) for w in ways]))
            forward[here] = known[here]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids; the space that encoding put before each is taken away."""
        parts = list(map(self.text_of.__getitem__, ids.tolist()))
        ends = np.cumsum(counts).tolist()
        return [b"".join(parts[end - n : end])[1:].decode() for end, n in zip(ends, counts.tolist())]


def lattice(path: str) -> Lattice:
    return task_state("lattice_" + re.sub(r"\W", "_", path), lambda: Lattice(path))


def _encoded(part: pa.RecordBatch, model: Lattice, seed: int) -> tuple[np.ndarray, np.ndarray]:
    keys = pc.fill_null(part.column("doc_id"), -1).to_numpy(zero_copy_only=False)
    return model.sample(part.column("text"), keys, seed)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, path: str = MODEL, seed: int = 29) -> DataFrame:
    """A sampled segmentation of every whole text: doc_id and ids.

    Forward filtering sums the probabilities of all segmentations; backward sampling draws one
    by its probability, seeded by the row's id. The same row with the same seed gets the same
    ids on any cluster. A null or empty text has no ids; a null id counts as -1. Repeated rows
    get equal ids; an empty table gives no rows; other columns are not read.
    """

    def encoded(batches):
        model = lattice(path)
        for batch in batches:
            for part in portions(batch, limit=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(*_encoded(part, model, seed))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encoded, ENCODED)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """The texts of encoded rows: doc_id and text. Null or no ids give the empty text."""

    def decoded(batches):
        model = lattice(path)
        for batch in batches:
            ids = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = model.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(decoded, "doc_id bigint, text string")


def encode_checked(docs: DataFrame, path: str = MODEL, seed: int = 29) -> DataFrame:
    """As `encode`, with `lossless`: whether decoding the ids gave the text back, null as empty."""

    def checked(batches):
        model = lattice(path)
        for batch in batches:
            for part in portions(batch, limit=2 << 20):
                ids, counts = _encoded(part, model, seed)
                back = pa.array(model.decode(ids, counts), pa.string())
                same = pc.equal(back, pc.fill_null(part.column("text"), ""))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, counts), same], ["doc_id", "ids", "lossless"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(checked, ENCODED + ", lossless boolean")


def op6_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_checked(table(spark, sf_dir, "documents"))
