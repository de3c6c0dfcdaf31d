"""Repair of conversation structure with the cheapest edits, by a dynamic program over shared edit strings.

A repaired conversation is empty or one optional system turn and then user and assistant in turns (by the first letters of
their roles). Rows are kept, given another role, deleted, or empty rows inserted. The program knows four states
(nothing yet, after a system row, after a user row, after an assistant row) and holds for each the cheapest edits of the rows so
far, of equal ones the least string. Edit strings are paths in one tree: a node is an edit and points to the node before it, to
ancestors at distances of powers of two, and carries a rolling hash of its path. Two strings of equal cost are compared by
their longest common prefix, found by lifting both nodes while hashes differ, and the prefix is then compared sign by sign up to
the node that both share, so a collision cannot decide. Of two strings of equal cost and rows neither begins with the other
(what is longer has more inserts and costs more), so the lesser stays the lesser whatever follows.

Rows of a conversation lie in one task in order and are streamed: states that can no longer win are dropped, and edits that all
remaining states share are settled, so that neither texts nor nodes of a long conversation pile up. What grows with a conversation
is 16 bytes of digest for each distinct row (for repeats) and the audit string that is asked for. A conversation is not split: the
digest over its repaired text can only be made in one sequence.

Nulls: a null role or text is one space; null turns come first; rows without a conversation are a conversation of their own. Rows of one turn
come by role, then text. Repeated rows are repeats. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import small_batches

# Costs of the edits, and what a truncated row that stays adds.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
#: By state: the state after a user or assistant row.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_LEGAL = {"su", "ua", "au"}
_WHITE = " \t\n\x0b\x0c\r"
_BASE, _PRIME = 0x1F3D5B79, (1 << 61) - 1
_SETTLE = 64
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Edits:
    """Edit strings as paths of a tree; node 0 is the empty string."""

    def __init__(self) -> None:
        self.sign, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, before: int, sign: str) -> int:
        node, up = len(self.sign), [before]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.sign.append(sign)
        self.depth.append(self.depth[before] + 1)
        self.hash.append((self.hash[before] * _BASE + ord(sign)) % _PRIME)
        self.up.append(tuple(up))
        return node

    def lifted(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node = self.up[node][k]
            steps -= 1 << k
        return node

    def _apart(self, a: int, b: int, same: Callable[[int, int], bool]) -> tuple[int, int]:
        """The first nodes on two paths of equal depth that are not the same."""
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and not same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        shared = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, self.depth[a] - shared), self.lifted(b, self.depth[b] - shared)
        order = self.depth[a] - self.depth[b]
        if self.hash[x] != self.hash[y]:
            x, y = self._apart(x, y, lambda p, q: self.hash[p] == self.hash[q])
        while x != y:  # the least deep difference decides; without a collision there is one at most
            if self.sign[x] != self.sign[y]:
                order = -1 if self.sign[x] < self.sign[y] else 1
            x, y = self.up[x][0], self.up[y][0]
        return order < 0

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that lies on the paths of all."""
        first = nodes[0]
        for other in nodes[1:]:
            depth = min(self.depth[first], self.depth[other])
            first, other = self.lifted(first, self.depth[first] - depth), self.lifted(other, self.depth[other] - depth)
            if first != other:
                first = self.up[self._apart(first, other, int.__eq__)[0]][0]
        return first

    def between(self, top: int, node: int) -> str:
        """The signs below ``top`` down to ``node``."""
        out = []
        while node != top:
            out.append(self.sign[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Repair:
    """One conversation; ``take(edit, turn, role, text)`` gets each settled edit in order."""

    def __init__(self, take: Callable[[str, int | None, str, str], None]):
        self.take, self.edits, self.best = take, Edits(), {_EMPTY: (0, 0)}
        self.pending: deque[tuple[int | None, str, str]] = deque()
        self.state, self.seen, self.before, self.rows = _EMPTY, set(), None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = None
        self._insert()

    def _offer(self, into: dict, state: int, cost: int, node: int, sign: str) -> bool:
        held = into.get(state)
        if held and held[0] < cost:
            return False
        node = self.edits.add(node, sign)
        if held and held[0] == cost and not self.edits.less(node, held[1]):
            return False
        into[state] = (cost, node)
        return True

    def _insert(self) -> None:
        """Inserts after the edits so far, until none makes a state cheaper."""
        todo = list(self.best)
        while todo:
            state = todo.pop()
            cost, node = self.best[state]
            if self._offer(self.best, _NEXT[state], cost + INSERT, node, "I"):
                todo.append(_NEXT[state])

    def _drop(self) -> None:
        """Leave out states from which every continuation costs more than the same one from another state."""
        cost = {s: c for s, (c, _) in self.best.items()}
        user, assistant = cost[_USER], cost[_ASSISTANT]
        limits = {_EMPTY: min(assistant, user + INSERT) + DELETE, _SYSTEM: min(assistant, user + INSERT),
                  _USER: assistant + INSERT, _ASSISTANT: user + INSERT}
        self.best = {s: x for s, x in self.best.items() if x[0] <= limits[s]}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in _LEGAL
        self.before = role[:1]
        bare, key = text.rstrip(_WHITE), xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
        repeated = key in self.seen
        self.seen.add(key)
        blank, cut = not bare, bool(bare) and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut and not repeated
        self.pending.append((turn, role, text))
        into: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(into, state, cost + DELETE, node, "D")
            if blank or repeated:
                continue
            stays = cost + TRUNCATED * cut
            then = _NEXT[state]
            if role[:1] == "s" and state == _EMPTY:
                self._offer(into, _SYSTEM, stays, node, "K")
            elif role[:1] == _ROLES[then][0]:
                self._offer(into, then, stays, node, "K")
            self._offer(into, then, stays + RENAME, node, "R")
        self.best = into
        self._insert()
        self._drop()
        self.rows += 1
        if self.rows % _SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        """Hand on the edits that all states share and go on with a tree of the others."""
        root = self.edits.shared([node for _, node in self.best.values()])
        self._apply(self.edits.between(0, root))
        old, self.edits, known = self.edits, Edits(), {root: 0}
        for state, (cost, node) in self.best.items():
            path = []
            while node not in known:
                path.append(node)
                node = old.up[node][0]
            for x in reversed(path):
                known[x] = self.edits.add(known[node], old.sign[x])
                node = x
            self.best[state] = (cost, known[node])

    def _apply(self, signs: str) -> None:
        for sign in signs:
            turn, role, text = (None, "", "") if sign == "I" else self.pending.popleft()
            if sign != "D":
                first = sign == "K" and role[:1] == "s"
                self.state = _SYSTEM if first else _NEXT[self.state]
                role = role if sign == "K" else _ROLES[self.state]
            self.take(sign, turn, role, text)

    def finish(self) -> tuple[int, ...]:
        """The figures of ``SUMMARY``."""
        (cost, node), *other = [self.best[s] for s in (_EMPTY, _ASSISTANT) if s in self.best]
        for c, n in other:
            if c < cost or c == cost and self.edits.less(n, node):
                cost, node = c, n
        self._apply(self.edits.between(0, node))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows damaged by the checksum of conversation and turn; dropped ones stay as not present."""
    part = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    rows = turns.select(
        turns["conv_id"], turns["turn"].cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(part("role")).alias("role"),
        F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text")).alias("text"),
        (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return rows.select("conv_id", "turn", "role", "text", "present", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("col")


def _in_order(turns: DataFrame, present: str | None) -> DataFrame:
    small_batches(turns)
    part = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(c)
    there = turns[present] if present else F.lit(True)
    rows = turns.select("conv_id", turns["turn"].cast("bigint").alias("turn"), part("role"), part("text"), there.alias("present"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Repair], end: Callable[[object, Repair], None]) -> Iterator[None]:
    """Stream the rows through one ``Repair`` for each conversation; yields after each batch."""
    current, run = None, None
    for batch in batches:
        for conv, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
            if run is None or conv != current:
                if run is not None:
                    end(current, run)
                current, run = conv, begin(conv)
            if present:
                run.add(turn, role, text)
        yield
    if run is not None:
        end(current, run)
        yield


def _kind(turns: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return turns.schema["conv_id"].dataType.simpleString(), to_arrow_type(turns.schema["conv_id"].dataType)


def repair(turns: DataFrame, present: str | None = None) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id, position, edit, turn, role, text``; an inserted row has no turn.

    ``present`` names a boolean column; rows where it is false only keep their conversation known.
    """
    name, arrow = _kind(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def begin(conv: object) -> Repair:
            at = 0

            def take(edit: str, turn: int | None, role: str, text: str) -> None:
                nonlocal at
                if edit != "D":
                    out.append((conv, at, edit, turn, role, text))
                    at += 1
            return Repair(take)

        for _ in _conversations(batches, begin, lambda _, r: r.finish()):
            columns = list(zip(*out)) or [()] * 6
            out.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))],
                names=["conv_id", "position", "edit", "turn", "role", "text"])

    return _in_order(turns, present).mapInArrow(run, f"conv_id {name}, position bigint, edit string, turn bigint, role string, text string")


def assess(turns: DataFrame, present: str | None = None) -> DataFrame:
    """One row for each conversation: the figures of ``SUMMARY``, ``audit`` and ``repaired_sha256``."""
    name, arrow = _kind(turns)
    kinds = [arrow, *[pa.int64()] * len(SUMMARY), pa.string(), pa.string()]
    names = ["conv_id", *SUMMARY, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        audit: list[str] = []
        digest, between = hashlib.sha256(), b""

        def begin(_: object) -> Repair:
            nonlocal digest, between
            audit.clear()
            digest, between = hashlib.sha256(), b""

            def take(edit: str, turn: int | None, role: str, text: str) -> None:
                nonlocal between
                audit.append(edit)
                if edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            return Repair(take)

        def end(conv: object, run: Repair) -> None:
            out.append((conv, *run.finish(), "".join(audit), digest.hexdigest()))

        for _ in _conversations(batches, begin, end):
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return _in_order(turns, present).mapInArrow(run, f"conv_id {name}, " + ", ".join(f"{c} bigint" for c in SUMMARY) + ", audit string, repaired_sha256 string")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _then(state: str, cost: str, sign: str, line: str = "''", when: str = "true") -> str:
    return f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000000 END, 'e': {state}.e || '{sign}', 't': {state}.t || {line}}}"


def _after_row() -> str:
    """The four states after a row, as SQL; each holds cost, edits and repaired text."""
    kept, named = "chr(10) || r.role || ':' || r.text", lambda who: f"chr(10) || '{who}:' || r.text"
    gone = {x: _then(x, str(DELETE), "D") for x in ("p.s0", "p.s1", "p.s2", "p.s3")}
    stays, renamed = f"{TRUNCATED} * r.cut", f"{TRUNCATED} * r.cut + {RENAME}"
    user = [o for x in ("p.s0", "p.s1", "p.s3") for o in (
        _then(x, stays, "K", kept, "r.open AND r.initial = 'u'"), _then(x, renamed, "R", named("user"), "r.open"))]
    assistant = [_then("p.s2", stays, "K", kept, "r.open AND r.initial = 'a'"), _then("p.s2", renamed, "R", named("assistant"), "r.open")]
    return f"""{gone['p.s0']} AS d0, {_least(gone['p.s1'], _then('p.s0', stays, 'K', kept, "r.open AND r.initial = 's'"))} AS d1,
      {_least(gone['p.s2'], *user)} AS d2, {_least(gone['p.s3'], *assistant)} AS d3"""


def _inserted(before: str) -> str:
    """States after any inserts, as SQL over ``d0 .. d3`` and the rows of ``before``."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    return f"""SELECT n, i, d0 AS s0, d1 AS s1, u AS s2, {_least('d3', _then('u', str(INSERT), 'I', assistant))} AS s3 FROM (
      SELECT *, {_least('d2', *[_then(x, str(INSERT), 'I', user) for x in ('d0', 'd1', 'd3')])} AS u FROM ({before}))"""


_START = "{'c': %d, 'e': '', 't': ''}"
_HAS, _END = r"'[^\x20\x09-\x0D]'", r"'[\x20\x09-\x0D]+$'"

#: The same program over whole strings, row by row; the checksum is computed bit by bit.
SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS n, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS kind FROM raw),
damaged AS (SELECT n, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM summed WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM damaged),
r AS MATERIALIZED (SELECT *, not (blank OR again) AS open, CAST(late AND NOT again AS INT) AS cut FROM (
    SELECT n, i, turn, role, text, initial, NOT regexp_matches(text, {_HAS}) AS blank,
      row_number() OVER (PARTITION BY n, role, text ORDER BY i) > 1 AS again,
      regexp_matches(text, {_HAS}) AND right(regexp_replace(text, {_END}, ''), 1) NOT IN ('.', '!', '?') AS late,
      lag(initial) OVER (PARTITION BY n ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS wrong FROM numbered)),
p AS (
  {_inserted(f"SELECT DISTINCT n, CAST(0 AS BIGINT) AS i, {_START % 0} AS d0, {_START % 10**9} AS d1, {_START % 10**9} AS d2, {_START % 10**9} AS d3 FROM r")}
  UNION ALL
  {_inserted(f"SELECT p.n, r.i, {_after_row()} FROM p JOIN r ON r.n = p.n AND r.i = p.i + 1")}),
done AS (SELECT n, arg_max({_least('s0', 's3')}, i) AS best FROM p GROUP BY n),
figures AS (SELECT n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS BIGINT)) AS blank,
  sum(CAST(again AND NOT blank AS BIGINT)) AS duplicate, sum(cut) AS truncated, sum(CAST(wrong AS BIGINT)) AS illegal FROM r GROUP BY n)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.e, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT n, conv_id FROM raw) LEFT JOIN done USING (n) LEFT JOIN figures USING (n)"""
