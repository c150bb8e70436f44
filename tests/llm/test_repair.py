"""Conversation repair against exhaustive search and a plain model; edge rows through Spark."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from textlake.llm import repair as R

GOAL = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """The least (cost, audit) over all edits, with at most two inserts in a gap."""
    gaps = [("", 0, "")] + [("I" * n, 3 * n, "".join(p)) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    choices = []
    for initial, fault in rows:
        extra = 3 if fault == "truncated" else 0
        one = [("D", 4, "")]
        if fault not in ("blank", "duplicate"):
            one += [("K", extra, initial or "?"), ("R", 3 + extra, "u"), ("R", 3 + extra, "a")]
        choices.append(one)
    best = None
    for pick in itertools.product(*choices):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            parts = [filled[0], *itertools.chain(*zip(pick, filled[1:]))]
            if GOAL.fullmatch("".join(p[2] for p in parts)):
                found = (sum(p[1] for p in parts), "".join(p[0] for p in parts))
                best = found if best is None else min(best, found)
    return best


def model(rows):
    """The same by tuples of cost and whole audit."""
    best = {0: (0, "")}

    def insert(b):
        for _ in range(2):
            for state, (cost, audit) in list(b.items()):
                for i in "ua":
                    to = R.NEXT[i].get(state)
                    if to is not None:
                        b[to] = min(b.get(to, (1 << 60, "")), (cost + 3, audit + "I"))
        return b

    best = insert(best)
    for initial, fault in rows:
        new = {}
        extra = 3 if fault == "truncated" else 0
        for state, (cost, audit) in best.items():
            options = [(state, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                options += [(R.NEXT.get(initial, {}).get(state), cost + extra, "K")] + [(R.NEXT[i].get(state), cost + 3 + extra, "R") for i in "ua"]
            for to, c, letter in options:
                if to is not None:
                    new[to] = min(new.get(to, (1 << 60, "")), (c, audit + letter))
        best = insert(new)
    return min(best[s] for s in (0, 3) if s in best)


def audit(rows, settle=64, prime=R._PRIME):
    out = []
    talk = R.Conversation(1, lambda *r: out.append(r), settle)
    talk.layer = R.Layer(prime)
    for n, (initial, fault) in enumerate(rows):
        talk.row(n, initial, str(n), fault)
    end = talk.end()
    assert GOAL.fullmatch("".join(role[:1] for _, role, _ in out))
    assert [e for e, _, _ in out] == [e for e in end["audit"] if e != "D"]
    return end["cost"], end["audit"]


def random_rows(rnd, n):
    return [(rnd.choice("suaauxua"), rnd.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_against_exhaustive_search():
    rnd = random.Random(1)
    for n in (0, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = random_rows(rnd, n)
        assert audit(rows) == exhaustive(rows), rows


@pytest.mark.parametrize("settle", [1, 5, 1000])
@pytest.mark.parametrize("prime", [R._PRIME, 2, 7, 101])
def test_against_the_model(settle, prime):
    """Small primes make most hashes collide; the audits stay the same."""
    rnd = random.Random(settle + prime)
    for _ in range(60):
        rows = random_rows(rnd, rnd.randrange(40))
        assert audit(rows, settle, prime) == model(rows), rows


def test_long_conversations_settle():
    rnd = random.Random(3)
    rows = random_rows(rnd, 4000)
    talk = R.Conversation(1, lambda *r: None)
    most = 0
    for n, (initial, fault) in enumerate(rows):
        talk.row(n, initial, "", fault)
        most = max(most, len(talk.pending))
    assert most < 300
    assert (talk.end()["cost"], "".join(talk.audit)) == model(rows)


def test_order_of_audits():
    root = R.Node(None, "")

    def chain(text, start=root):
        for c in text:
            start = R.Node(start, c)
        return start

    rnd = random.Random(5)
    shared = chain("KDKR")
    for _ in range(200):
        a, b = ("".join(rnd.choice("DIKR") for _ in range(rnd.randrange(6))) for _ in range(2))
        for x, y in ((chain(a, shared), chain(b, shared)), (chain("KDKR" + a), chain(b, shared))):
            assert R.less(x, y) == (a < b)


ROWS = [
    (1, 0, "user", "Hi there.", "x"),
    (1, 1, "assistant", "Yes!", "x"),
    (1, 1, "assistant", "Yes!", "x"),
    (1, 3, "user", " \n", None),
    (1, 4, "assistant", "cut", None),
    (2, None, None, None, None),
    (2, None, "user", "first.", None),
    (2, 5, "", "no role.", None),
    (3, None, "system", "only.", None),
    (None, 2, "assistant", "A. " * 40_000, None),
    (None, 1, "user", "B" * 100_000 + "?", None),
    (4, 7, "user", "same.", None),
    (4, 9, "user", "same.", None),
    (4, 9, "assistant", "late.", None),
]
SCHEMA = "conv_id long, turn int, role string, text string, fault string"


def plain(rows):
    """Everything ``audits`` returns, from the definitions."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text, _ in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marks = set(), []
        for _, role, text in mine:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            marks.append("blank" if not visible else "duplicate" if (role, text) in seen else None if visible[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, edits = model([(role[:1], f) for (_, role, _), f in zip(mine, marks)])
        kept, left, user = [], list(mine), True
        for e in edits:
            _, role, text = (None, "", "") if e == "I" else left.pop(0)
            if e == "D":
                continue
            role = role if e == "K" else "user" if user else "assistant"
            user = role[:1] != "u"
            kept.append(f"{role}:{text}")
        turns = [t for t, _, _ in mine if t is not None]
        initials = [role[:1] for _, role, _ in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            edits,
            hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def test_edge_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = {r[0]: tuple(r[1:]) for r in R.audits(df).collect()}
    assert got == plain(ROWS)


def test_repaired_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    texts = {}
    for r in sorted(R.repaired(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = plain(ROWS)
    for conv, all_ in want.items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == all_[-1]


def test_empty_and_random_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.audits(empty).collect() == [] and R.repaired(empty).collect() == []
    rnd = random.Random(9)
    rows = [(rnd.randrange(40), rnd.randrange(9), rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["", "a", "b.", "c!"]), None) for _ in range(400)]
    got = {r[0]: tuple(r[1:]) for r in R.audits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
    named = spark.createDataFrame(rows, SCHEMA).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("who"), F.col("text").alias("said"))
    again = R.audits(named, conv_col="c", turn_col="t", role_col="who", text_col="said")
    assert {r[0]: tuple(r[1:]) for r in again.collect()} == got
