"""Repair of conversation structure by target alignment (operator 11)."""

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.text import remembered, table

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Rows aligned at once. A longer conversation is a chain of such spans.
SPAN = 16
# Where a repaired conversation may stand: before all, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
MOST = (1 << 63) - 1
REPAIRS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string, repaired string"
)


def _targets(state: int, length: int) -> list[str]:
    """The strings of this length that may follow `state` in `s?(ua)*`, whole pairs or not."""
    turns = ("au" if state == USER else "ua") * (length // 2 + 1)
    strings = [turns[:length]]
    if state == START and length:
        strings.append("s" + turns[: length - 1])
    return strings


def _least(apart: int) -> int:
    """The least cost of edits that make `apart` more rows than targets even."""
    return DELETE * apart if apart >= 0 else -INSERT * apart


def align(rows: tuple[str, ...], target: str, most: int, closed: bool) -> tuple[int, str] | None:
    """The cheapest edits that turn `rows` into `target`, at `most` this dear: cost and audit.

    A row is its role's initial and a mark: `!` has to be deleted, `.` is truncated, `-` neither.
    Edit distances are filled from the end, in the band of cells whose distance from both corners
    `most` can pay for; going forward, the least letter that stays on a cheapest way is taken, so the
    audit is the ASCII-least. Unless `closed`, no insertion may follow the last row.
    """
    n, m = len(rows), len(target)
    if _least(n - m) > most:
        return None
    never = most + 1
    below = [never] * (m + 2)
    costs = [below] * (n + 1)
    for i in range(n, -1, -1):
        here = [never] * (m + 2)
        for j in range(m, -1, -1):
            if _least(i - j) + _least(n - i - m + j) > most:
                continue
            best = 0 if i == n and j == m else never
            if j < m and target[j] != "s" and (i < n or closed):
                best = here[j + 1] + INSERT
            if i < n:
                initial, mark = rows[i]
                best = min(best, below[j] + DELETE)
                if j < m and mark != "!" and (initial == target[j] or target[j] != "s"):
                    best = min(best, below[j + 1] + (KEEP if initial == target[j] else REROLE) + (TRUNCATED if mark == "." else 0))
            here[j] = best
        costs[i] = below = here
    if costs[0][0] > most:
        return None
    letters, i, j = [], 0, 0
    while i < n or j < m:
        left = costs[i][j]
        if i < n and costs[i + 1][j] + DELETE == left:
            letters.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or closed) and costs[i][j + 1] + INSERT == left:
            letters.append("I")
            j += 1
        else:
            letters.append("K" if rows[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return costs[0][0], "".join(letters)


def spanned(rows: tuple[str, ...], state: int, last: bool) -> dict[int, tuple[int, str]]:
    """For each standing after the rows, the cheapest edits and their ASCII-least audit.

    Targets are tried from the length of the rows outwards; the cheapest cost so far bounds the
    band of the next, and the lengths that can still pay.
    """
    found: dict[int, tuple[int, str]] = {}
    dearest = DELETE * len(rows) + 2 * INSERT
    for length in sorted(range(2 * len(rows) + 3), key=lambda x: (abs(x - len(rows)), x)):
        for target in _targets(state, length):
            after = AFTER[target[-1]] if target else state
            if last and after not in FINAL:
                continue
            most = min((c for s, (c, _) in found.items() if last or s == after), default=dearest)
            one = align(rows, target, most, last)
            if one and (after not in found or one < found[after]):
                found[after] = one
    if last:
        best = min(found.values())
        return {s: x for s, x in found.items() if x == best}
    return found


def rewritten(audit: str, rows: list[tuple[str, str]], state: int) -> list[str]:
    """The `role:text` of what the edits leave."""
    out, own = [], iter(rows)
    for letter in audit:
        due = "a" if state == USER else "u"
        if letter == "I":
            out.append(NAMES[due] + ":")
            state = AFTER[due]
            continue
        role, text = next(own)
        if letter == "D":
            continue
        kept = letter == "K"
        out.append((role if kept else NAMES[due]) + ":" + text)
        state = AFTER[role[0]] if kept else AFTER[due]
    return out


@dataclass
class Way:
    """The cheapest repair so far that ends in one standing."""

    cost: int = 0
    rank: int = 0
    parts: tuple | None = None
    digest: object = field(default_factory=hashlib.sha256)
    any_row: bool = False


class Conversation:
    """Takes one conversation's rows in order and holds one span of them, a few counts and the audits."""

    def __init__(self, conv_id, whole: bool):
        self.conv_id, self.whole = conv_id, whole
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.before = None
        self.turns = 0
        self.held: list[tuple[str, str]] = []
        self.marks: list[str] = []
        self.ways = {START: Way()}

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if len(self.held) == SPAN:
            self._step(last=False)
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.held.append((role, text))
        mark = "!" if fault in ("blank", "duplicate") else "." if fault else "-"
        self.marks.append((initial if initial in ("s", "u", "a") else "?") + mark)

    def _step(self, last: bool) -> None:
        """One more span: every way goes on into every standing, of which the cheapest, then least, stays."""
        rows, chosen = tuple(self.marks), {}
        for state, way in self.ways.items():
            for after, (cost, audit) in remembered("spans", (rows, state, last), lambda: spanned(rows, state, last)).items():
                chosen[after] = min(chosen.get(after, (MOST,)), (way.cost + cost, way.rank, audit, state))
        if last:
            best = min(x[:3] for x in chosen.values())
            chosen = {s: x for s, x in chosen.items() if x[:3] == best}
        order = sorted({x[1:3] for x in chosen.values()})
        ways = {}
        for after, (cost, rank, audit, state) in chosen.items():
            came = self.ways[state]
            lines = rewritten(audit, self.held, state)
            digest = came.digest.copy()
            if lines:
                digest.update((("\n" if came.any_row else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            ways[after] = Way(cost, order.index((rank, audit)), (came.parts, audit, lines if self.whole else None), digest, came.any_row or bool(lines))
        self.ways, self.held, self.marks = ways, [], []

    def row(self) -> tuple:
        self._step(last=True)
        way = next(iter(self.ways.values()))
        audits, lines, parts = [], [], way.parts
        while parts:
            parts, audit, own = parts
            audits.append(audit)
            lines.append(own)
        repaired = "\n".join(x for own in reversed(lines) for x in own) if self.whole else None
        gaps = 0 if self.high is None else min(self.high - self.low + 1 - self.turns, MOST)
        return (self.conv_id, gaps, *self.counts.values(), way.cost, "".join(reversed(audits)), way.digest.hexdigest(), repaired)


def repairs(rows: DataFrame, whole: bool = True) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits to `(s?(ua)+)?` and what they leave.

    `rows` has conv_id, turn, role and text; a null role or text counts as one space, and rows are
    taken by turn (nulls first), then role, then text. Where a column `absent` is true the row is
    none, but its conversation is listed. A row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated. `repaired`, the `role:text` lines left, is null unless `whole`.

    Rows with a null conv_id are one conversation; one without rows has zeros, an empty audit and the
    hash of the empty text; an empty table gives no rows; other columns are not read. All of a
    conversation goes through one task, as the hash over its text needs, but as a sorted stream: a
    span of SPAN rows is held at a time, whatever the length of the conversation or of its audit's
    ways (one for each standing, exact to the ties), so a hot conversation costs time and no memory.
    """
    text = F.coalesce("text", F.lit(" "))
    trimmed = F.rtrim(text, F.lit(SPACES))
    kept = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        (trimmed == "").alias("is_blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("is_cut"),
        (F.col("absent") if "absent" in rows.columns else F.lit(False)).alias("absent"),
    )
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "absent").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("is_blank"), "blank").when(earlier > 1, "duplicate").when(F.col("is_cut"), "truncated").otherwise("")
    seen = kept.repartition("conv_id").withColumn("fault", fault)
    ordered = seen.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def repaired(batches):
        at, out = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "absent")]
            for conv_id, turn, role, words, why, absent in zip(*columns):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        out.append(at.row())
                    at = Conversation(conv_id, whole)
                if not absent:
                    at.add(turn, role, words, why)
            if out:
                yield _batch(out)
                out = []
        if at is not None:
            yield _batch([*out, at.row()])

    return ordered.select("conv_id", "turn", "role", "text", "fault", "absent").mapInArrow(repaired, REPAIRS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in REPAIRS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in REPAIRS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _as_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The faults of the contract, by crc32 of `conv_id:turn` modulo 20; dropped rows are `absent`."""
    part = F.pmod(F.crc32(F.concat(_as_text("conv_id"), F.lit(":"), _as_text("turn")).cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(part == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(part <= 1, "").when(part == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (part == 0).alias("absent"),
        F.explode(F.when(part == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    found = repairs(damaged(table(spark, sf_dir, "conversations")), whole=False)
    return found.drop("repaired")


# The alignment as a walk over the grammar's standings, row by row: another way to the same rows.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([CAST(b AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)
), source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[CAST(1 + (xor(c, x) & 255) AS INTEGER)])), 4294967295) % 20 AS part
  FROM source, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN part = 1 THEN '' WHEN part = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (SELECT unnest([1, 2]) AS copy) WHERE part <> 0 AND (copy = 1 OR part = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged
), marked AS (
  SELECT *, trimmed = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    right(trimmed, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS initial FROM placed
), judged AS (
  SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, blank OR again AS must_go,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM marked
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), moves(p, q, dear, letters, lines) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
    (2, 2, 4, 'II', ['assistant:', 'user:']), (3, 3, 4, 'II', ['user:', 'assistant:'])
), steps AS (
  SELECT r.conv_id, r.pos, m.p, e.q, m.dear + e.dear AS dear, m.letters || e.letter AS letters, list_concat(m.lines, e.lines) AS lines
  FROM judged r, moves m, LATERAL (
    SELECT m.q AS q, 3 AS dear, 'D' AS letter, CAST([] AS VARCHAR[]) AS lines
    UNION ALL SELECT CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CAST(truncated AS INTEGER), 'K', [role || ':' || text]
      WHERE NOT must_go AND (initial = 's' AND m.q = 0 OR initial = 'u' AND m.q <> 2 OR initial = 'a' AND m.q = 2)
    UNION ALL SELECT CASE WHEN m.q = 2 THEN 3 ELSE 2 END, 2 + CAST(truncated AS INTEGER), 'R',
        [CASE WHEN m.q = 2 THEN 'assistant' ELSE 'user' END || ':' || text]
      WHERE NOT must_go AND initial <> CASE WHEN m.q = 2 THEN 'a' ELSE 'u' END) e
), walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT w.conv_id, w.pos + 1, s.q, min(w.cost + s.dear),
    arg_min(w.audit || s.letters, {'c': w.cost + s.dear, 'a': w.audit || s.letters}),
    arg_min(list_concat(w.lines, s.lines), {'c': w.cost + s.dear, 'a': w.audit || s.letters})
  FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1 AND s.p = w.state
  GROUP BY w.conv_id, w.pos + 1, s.q
), ended AS (
  SELECT w.conv_id, min(w.cost + m.dear) AS cost, arg_min(w.audit || m.letters, {'c': w.cost + m.dear, 'a': w.audit || m.letters}) AS audit,
    arg_min(list_concat(w.lines, m.lines), {'c': w.cost + m.dear, 'a': w.audit || m.letters}) AS lines
  FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN moves m ON m.p = w.state AND m.q IN (0, 3)
  WHERE w.pos = coalesce(c.n, 0) GROUP BY w.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
