"""Fingerprints against a plain model of consistent weighted sampling, and its collision rates; edge rows."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from textlake.llm import sampling as S

BITS = (1 << 64) - 1


def h64(*values):
    """Spark's xxhash64 of words, longs (int) and ints (wrapped in a tuple)."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def weights(text, size=5):
    w = words(text)
    return Counter(h64(*w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def fingerprint(text, registers=64):
    bag = weights(text)
    if not bag:
        return ""
    total, cells = sum(bag.values()), []
    for k in range(registers):
        best = None
        for term, s in bag.items():
            h1, h2 = h64(term, (k,)) & BITS, h64(term, (k + registers,)) & BITS
            u = [((h >> shift & (1 << 25) - 1) + 0.5) / (1 << 25) for h in (h1, h2) for shift in (0, 32)]
            beta = ((h1 >> 25 & 127) * 128 + (h1 >> 57) + 0.5) / 16384
            r, lc = -math.log(u[0] * u[1]), math.log(-math.log(u[2] * u[3]))
            q = math.floor(math.log(s) / r + beta)
            la = lc - r * (q - beta + 1)
            h2 = h2 - (1 << 64) if h2 >> 63 else h2
            packed = (int((la + 80) * (1 << 24)) << 32) + (h64(h2, q) & 0xFFFFFFFF)
            if la <= math.log(S.FAR / total):
                best = packed if best is None else min(best, packed)
        cells.append("----" if best is None else f"{best & 0xFFFF:04x}")
    return "".join(cells)


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def prose(rnd, n):
    return " ".join(rnd.choice(["Un", "do", "tre", "fo", "fif", "sek", "sep", "ot"]) for _ in range(n))


def corpus(seed=1):
    rnd = random.Random(seed)
    docs = [(i, prose(rnd, rnd.randrange(1, 60))) for i in range(20)]
    return docs + [(20, None), (21, ""), (22, " \n\t"), (23, docs[3][1]), (24, docs[3][1].upper()), (25, "a b a b a b a b a b a b"), (None, "no id here at all today"), (-4, "naïve café 日本語 тест " * 3), (26, "one"), (27, "two three")]


def expected(docs):
    """All rows, from the definitions; repeated rows go on to their copy."""
    def signed(t, i):
        return h64(t or "", (1 if i is None else 0,))

    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), signed(*d[::-1])))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other = fingerprint(text), fingerprint(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, fingerprint(after))))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_task", [S.PER_TASK, 300])
def test_equals_the_model(spark, per_task):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, n int").repartition(3)
    got = sorted((tuple(r) for r in S.fingerprints(df, per_task=per_task).collect()), key=str)
    assert got == expected(docs)


def test_repeated_rows(spark, monkeypatch):
    """Rows of one id and text, few or many of them, each have a row; other rows keep their neighbours."""
    docs = [(1, "alpha beta gamma delta epsilon zeta")] * 5 + [(1, "other words under the same id"), (2, "the last of them is here"), (None, "x y z")] + [(None, None)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = expected(docs)
    assert sorted((tuple(r) for r in S.fingerprints(df).collect()), key=str) == want
    monkeypatch.setattr(S, "HOT_KEYS", 2)
    monkeypatch.setattr(S, "LEAST_HOT", 2)
    assert sorted((tuple(r) for r in S.fingerprints(df).collect()), key=str) == want


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert S.fingerprints(spark.createDataFrame([], schema)).collect() == []
    one = S.fingerprints(spark.createDataFrame([(1, "abcdef ghi")], schema)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdef abc").hexdigest()
    long = "word%d " * 3
    text = " ".join(f"w{i}" for i in range(30_000))
    got = S.fingerprints(spark.createDataFrame([(1, text), (2, text + long)], schema)).collect()
    assert all(len(r.fingerprint) == 256 and "-" not in r.fingerprint for r in got) and got[0].near_next > 0.9


def test_collisions_follow_generalised_jaccard(spark):
    """The share of equal registers, over many registers, is the similarity of the weighted shingles."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(40)}" for _ in range(200)]
    pairs = []
    for part in (0.0, 0.1, 0.3, 0.6):
        edited = [f"x{rnd.randrange(9)}" if rnd.random() < part / 5 else w for w in base]
        pairs.append((" ".join(base) + " a b c d e" * 4, " ".join(edited) + " a b c d e" * (1 + int(10 * part))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    both = df.select("i", S.words(F.col("a")).alias("left"), S.words(F.col("b")).alias("right"))
    got = S.sampled(S.counted(both, ["i"]), ["i"], registers=1024).select("i", S.likeness(F.col("left"), F.col("right"), 1024).alias("x")).collect()
    for r in got:
        a, b = (weights(t) for t in pairs[r.i])
        true = sum(min(a[t], b[t]) for t in a | b) / sum(max(a[t], b[t]) for t in a | b)
        assert abs(r.x - true) < 4 * math.sqrt(true * (1 - true) / 1024) + 0.005


def test_native(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    plan = S.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
