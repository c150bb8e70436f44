"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``, with an audit of the edits.

A row's fault is blank (no visible character), duplicate (role and text seen earlier in the conversation) or truncated
(the last visible character is not ``.``, ``!`` or ``?``). Keep costs 0, Rerole (to user or assistant) 3, Delete 4 and
is required for blank and duplicate rows, Insert of an empty user or assistant row 3; a truncated row that stays adds 3.
Of the cheapest edits those count whose letters (K, R, D, I) in order are ASCII-least.

Dynamic programme over the rows with four states: nothing yet, after s, after u, after a. Each state holds the last
node of its audit; nodes share their prefixes, and carry binary-lifting ancestors and a rolling hash. Two audits of
equal cost are compared by their longest common prefix, found by lifting both while the hashes differ; the letters
before it are compared as well, so a hash collision cannot decide. (Audits of equal cost after the same row are never
one the beginning of the other, since the longer would have more inserts, so the order of prefixes is that of wholes.)

Letters that all states have in common are settled: they are passed on, with their rows, and forgotten. A conversation
is read in order as a stream, sorted on disk; memory holds the rows that are not settled. An audit is a function of the whole conversation
in order and its digest of all its texts, so one conversation's rows pass through one task.

Defined results: a NULL role or text is one space; rows are ordered by turn (NULL first), then role and text; an empty
role has no initial and is never kept; NULL conversation ids are one conversation; gaps ignore NULL turns; other
columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlake.llm.common import BLANK, NOT_BLANK

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
SETTLE = 64  # rows after which settled letters are looked for
_BASE, _PRIME = 0x2545F4914F6CDD1D, (1 << 61) - 1


class Node:
    """One edit at the end of an audit. ``up[k]`` is the ancestor 2^k steps before."""

    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, parent: Node | None, letter: str, prime: int = _PRIME):
        self.letter = letter
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(letter)) % prime
        up, k = [parent], 0
        while len(up[k].up) > k:
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def at(self, depth: int) -> Node:
        """The ancestor at a depth."""
        node, gap = self, self.depth - depth
        while gap:
            k = gap.bit_length() - 1
            node, gap = node.up[k], gap - (1 << k)
        return node

    def letters(self, top: Node) -> list[str]:
        """The letters after ``top``, an ancestor, in order."""
        out, node = [], self
        while node is not top:
            out.append(node.letter)
            node = node.up[0]
        return out[::-1]


def _same(x: Node, y: Node) -> bool:
    """Whether two nodes of one depth end equal audits: letter by letter until they share a node."""
    while x is not y:
        if x.letter != y.letter:
            return False
        x, y = x.up[0], y.up[0]
    return True


def less(x: Node, y: Node) -> bool:
    """Whether the audit that ends in ``x`` is ASCII-less than the one that ends in ``y``."""
    short = min(x.depth, y.depth)
    a, b = x.at(short), y.at(short)
    if a is b or (a.hash == b.hash and _same(a, b)):
        return x.depth < y.depth
    if a.hash != b.hash:
        p, q = a, b
        for k in reversed(range(len(p.up))):
            # hashes that differ prove a difference at or before these ancestors
            if k < len(p.up) and p.up[k].hash != q.up[k].hash:
                p, q = p.up[k], q.up[k]
        before, other = p.up[0], q.up[0]
        if p.letter != q.letter and (before is other or _same(before, other)):
            return p.letter < q.letter
    # two audits with one hash: find the first difference by walking
    first = None
    while a is not b:
        if a.letter != b.letter:
            first = (a.letter, b.letter)
        a, b = a.up[0], b.up[0]
    return first[0] < first[1] if first else x.depth < y.depth


def fork(x: Node, y: Node) -> Node:
    """The last node that two audits share."""
    short = min(x.depth, y.depth)
    x, y = x.at(short), y.at(short)
    if x is y:
        return x
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k] is not y.up[k]:
            x, y = x.up[k], y.up[k]
    return x.up[0]


class Layer:
    """Cost and last node of the best audit for each state that can be reached."""

    def __init__(self, prime: int = _PRIME):
        self.prime = prime
        self.root = Node(None, "")
        self.best = {EMPTY: (0, self.root)}
        self._insert()

    def _offer(self, into: dict, state: int, cost: int, parent: Node, letter: str) -> bool:
        old = into.get(state)
        if old is not None and old[0] < cost:
            return False
        node = Node(parent, letter, self.prime)
        if old is not None and old[0] == cost and not less(node, old[1]):
            return False
        into[state] = (cost, node)
        return True

    def _insert(self) -> None:
        todo = deque(self.best)
        while todo:
            state = todo.popleft()
            cost, node = self.best[state]
            for initial in "ua":
                to = NEXT[initial].get(state)
                if to is not None and self._offer(self.best, to, cost + INSERT, node, "I"):
                    todo.append(to)

    def row(self, initial: str, fault: str | None) -> None:
        into: dict[int, tuple[int, Node]] = {}
        stays = fault not in ("blank", "duplicate")
        more = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            self._offer(into, state, cost + DELETE, node, "D")
            if not stays:
                continue
            to = NEXT.get(initial, {}).get(state)
            if to is not None:
                self._offer(into, to, cost + more, node, "K")
            for other in "ua":
                to = NEXT[other].get(state)
                if to is not None:
                    self._offer(into, to, cost + more + REROLE, node, "R")
        self.best = into
        self._insert()
        # what can follow "nothing yet" or "s" can follow an assistant row, once a kept s is deleted: they lost
        done = into[ASSISTANT][0] if ASSISTANT in into else None
        if done is not None:
            if EMPTY in into and done + DELETE < into[EMPTY][0]:
                del into[EMPTY]
            if SYSTEM in into and done < into[SYSTEM][0]:
                del into[SYSTEM]

    def settled(self) -> str:
        """Letters that all states share; they are forgotten here."""
        nodes = [n for _, n in self.best.values()]
        top = nodes[0]
        for n in nodes[1:]:
            top = fork(top, n)
        out = "".join(top.letters(self.root))
        new = {id(top): Node(None, "")}
        for state, (cost, node) in self.best.items():
            chain = []
            while id(node) not in new:
                chain.append(node)
                node = node.up[0]
            for old in reversed(chain):
                new[id(old)] = Node(new[id(node)], old.letter, self.prime)
                node = old
            self.best[state] = (cost, new[id(node)])
        self.root = new[id(top)]
        return out

    def end(self) -> tuple[int, str]:
        """Cost of the whole and the letters not settled before."""
        final = [self.best[s] for s in (EMPTY, ASSISTANT) if s in self.best]
        cost, node = final[0]
        for c, n in final[1:]:
            if c < cost or (c == cost and less(n, node)):
                cost, node = c, n
        return cost, "".join(node.letters(self.root))


class Conversation:
    """Rows of one conversation in order; ``sink`` takes its repaired rows: edit, role, text."""

    def __init__(self, conv, sink, settle: int = SETTLE):
        self.conv, self.sink, self.layer = conv, sink, Layer()
        self.pending: deque[tuple[str, str]] = deque()
        self.settle = self.check = settle
        self.audit: list[str] = []
        self.user_next = True
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last = self.low = self.high = self.turn = None
        self.turns = 0

    def row(self, turn, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        self.pending.append((role, text))
        self.layer.row(initial, fault)
        if len(self.pending) >= self.check:
            self._write(self.layer.settled())
            self.check = max(self.settle, 2 * len(self.pending))

    def _write(self, letters: str) -> None:
        self.audit.append(letters)
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.pending.popleft()
            if letter == "D":
                continue
            if letter != "K":
                role = "user" if self.user_next else "assistant"
            self.user_next = role[:1] != "u"
            self.sink(letter, role, text)

    def end(self) -> dict:
        cost, letters = self.layer.end()
        self._write(letters)
        gaps = self.high - self.low + 1 - self.turns if self.high is not None else 0
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.audit)}


# ---- Spark --------------------------------------------------------------------------------------


def fault(text: Column, earlier: Column) -> Column:
    """The first fault of a row, NULL if it has none."""
    visible = F.regexp_replace(text, BLANK, "")
    return (
        F.when(~F.regexp_like(text, F.lit(NOT_BLANK)), "blank")
        .when(earlier, "duplicate")
        .when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "truncated")
    )


def marked(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and fault of each row."""
    one = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    same = Window.partitionBy("conv_id", "role", F.md5("text"), F.length("text")).orderBy(F.col("turn").asc_nulls_first())
    return one.withColumn("fault", fault(F.col("text"), F.row_number().over(same) > 1))


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _stream(rows: DataFrame, schema: str, fields: list[tuple[str, pa.DataType]], work) -> DataFrame:
    """Rows of each conversation in order through ``work(conv, rows) -> output tuples``; conversations stay whole."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").eqNullSafe("duplicate"))
    key = rows.schema["conv_id"].dataType.simpleString()
    out_schema = pa.schema([("conv_id", _KINDS[key]), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, size = None, [], 0

        def packed():
            columns = list(zip(*out)) or [[]] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if state is None or state.conv != row[0]:
                    if state is not None:
                        state.close()
                    state = work(row[0], out.append)
                state.row(*row[1:])
            if out:
                yield packed()
                out.clear()
        if state is not None:
            state.close()
            yield packed()

    return ordered.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, f"conv_id {key}, {schema}")


class _Rows:
    def __init__(self, conv, put):
        self.conv, self.at = conv, -1
        self.of = Conversation(conv, self._add)
        self.put = put

    def _add(self, letter, role, text):
        self.at += 1
        self.put((self.conv, self.at, letter, role, text))

    def row(self, *row):
        self.of.row(*row)

    def close(self):
        self.of.end()


class _Audit:
    def __init__(self, conv, put):
        self.conv, self.put = conv, put
        self.sha, self.first = hashlib.sha256(), True
        self.of = Conversation(conv, self._add)

    def _add(self, letter, role, text):
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def row(self, *row):
        self.of.row(*row)

    def close(self):
        self.put((self.conv, *self.of.end().values(), self.sha.hexdigest()))


def repaired(rows: DataFrame, **columns: str) -> DataFrame:
    """The repaired conversations: conv_id, place, edit (K, R or I), role, text."""
    fields = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    return _stream(marked(rows, **columns), "place long, edit string, role string, text string", fields, _Rows)


def audits(rows: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [*((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    schema = ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    return _stream(marked(rows, **columns), schema, fields, _Audit)
