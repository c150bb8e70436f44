"""Exact copies and mixing: edge rows against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textlake.llm import common, exact, mixing

SCHEMA = "doc_id long, text string, source string, row string, size string"
LONG = "abc. " * 30_000
ROWS = [
    (1, "a b\tc", "s1", "x", "y"),
    (2, "abc", None, None, None),
    (3, "a  b  c", "s1", "x", "y"),
    (3, "a  b  c", "s1", "x", "y"),
    (4, None, "s2", None, None),
    (5, "", "s2", None, None),
    (6, " \n\x0b", "s2", None, None),
    (7, LONG, "s3", None, None),
    (8, LONG.replace(" ", ""), "s3", None, None),
    (9, LONG[:-5] + "abd. ", "s3", None, None),
    (None, "only a NULL id", "s3", None, None),
    (None, "onlyaNULL id", "s3", None, None),
    (10, "a b", "s4", None, None),
    (11, "a b", "s4", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[plain(t)].append((i, t or ""))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept = 0
        for i, t in members:
            mine = (i, len(t)) == (keep[0], len(keep[1])) and not kept
            kept += mine
            out.append((i, keep[0], len(members), mine, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_classes(docs, bits):
    got = exact.classes(docs, bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


def test_exact_drop_keeps_columns(docs):
    got = exact.drop_duplicates(docs)
    assert got.columns == docs.columns
    want = [(i, sha) for i, _, _, kept, sha in brute(ROWS) if kept]
    assert sorted(((r["doc_id"], hashlib.sha256(plain(r["text"]).encode()).hexdigest()) for r in got.collect()), key=str) == sorted(want, key=str)


def beyond(df, small, on, how="left", most_rows=0):
    return common.join_small(df, small, on, how, 0)


def test_large_key_tables(docs, monkeypatch):
    monkeypatch.setattr(exact, "join_small", beyond)
    test_exact_classes(docs, 64)
    test_exact_drop_keeps_columns(docs)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_join_small_beyond_its_limit(spark, how):
    df = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.col("id").cast("int")).alias("a"), (F.col("id") % 3).alias("b"), F.lit("text").alias("text"))
    small = spark.range(0, 2000, 5).select(F.col("id").alias("a"), (F.col("id") % 2).alias("b"), F.struct("id").alias("more"))
    want, got = df.join(small, ["a", "b"], how), beyond(df, small, ["a", "b"], how)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "bitmap" in plan
    assert beyond(df, small.limit(0), ["a", "b"], how).count() == df.join(small.limit(0), ["a", "b"], how).count()


def test_chunks_cover_the_text(spark):
    texts = [LONG, "x" * 10_000, "\n".join("αβγ δε" for _ in range(900)), "", "😀" * 700]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact.chunks(exact.normalised(F.col("t"))).alias("c"))
    for t, c in df.collect():
        assert "".join(c) == plain(t) and all(len(x) <= exact.MOST for x in c)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.classes(none).collect() == [] and exact.drop_duplicates(none).collect() == []
    assert mixing.plan(none).collect() == [] and mixing.mix(none).collect() == []


def levels(sizes, weights, budget=1.5, cap=2.0):
    """Share by weight, cap, share the excess again until none is above."""
    left, target, open_ = budget * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total >= cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[5], [0, 0], [10, 10, 10, 10], [1, 100, 5, 7, 0, 30], [1000, 1, 1], [3, 3, 900, 4, 4, 2]])
def test_targets(spark, sizes):
    df = mixing.cycled_weights(spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long"))
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(levels(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_plan_and_mix(docs):
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(ROWS)
    by_source = defaultdict(int)
    for _, t, s, *_ in ROWS:
        by_source[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in by_source if s is not None)) + [None]
    target = dict(zip(names, levels([by_source[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    source_of = {i: s for i, _, s, *_ in ROWS}
    for r in plan:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == by_source[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan(docs.repartition(2)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in plan)


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    got = mixing.plan(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    for r in got.collect():
        assert abs(r["t"] - r["g"]) < 0.05 * r["g"]
