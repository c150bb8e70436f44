"""Ranked search against brute force, with small blocks and shards; edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlake.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    all_ = [(i, Counter(terms(t))) for i, t in docs]
    all_ = [(i, c) for i, c in all_ if c]
    n_docs, n_terms = len(all_), sum(sum(c.values()) for _, c in all_)
    df = Counter(t for _, c in all_ for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in queries.items():
        scored = []
        for i, c in all_:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed=2, n=400, topics=8):
    """Documents of a few topics with words of their own, common words, and edge rows."""
    rnd = random.Random(seed)
    docs = []
    for i in range(n):
        topic = i % topics
        words = [f"t{topic}w{int(rnd.expovariate(0.2))}" for _ in range(rnd.randrange(3, 30))] + [f"c{int(rnd.expovariate(0.4))}" for _ in range(rnd.randrange(20))]
        rnd.shuffle(words)
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, " .,; "), (None, docs[3][1]), (None, docs[3][1]), (7, docs[7][1]), (1003, "ÄÖ日本語 straße t1w1 ÄÖ"), (1004, "t1w1 " * 30_000)]
    items = [(j, " ".join(f"t{j % topics}w{w}" for w in rnd.sample(range(12), 6)) + " c0 C1 unseen") for j in range(30)]
    return docs, items + [(50, None), (51, "--"), (52, "äö ÄÖ STRASSE straße"), (3, "c2 c3")]


@pytest.mark.parametrize("block, postings", [(128, 250_000), (4, 500), (1, 2000)])
def test_equals_brute_force(spark, block, postings):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x", 5) for r in docs], "doc_id long, text string, terms string, n int").repartition(5)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, term string")
    got = rows(L.ranked(d, q, k=7, block=block, postings=postings))
    assert got == brute(docs, items, 7)


def test_whole_index_serves_any_query(spark):
    """Without a vocabulary every term is listed, and one index answers several query tables."""
    docs, items = corpus(seed=4, n=150)
    index = L.build(spark.createDataFrame(docs, "doc_id long, text string"), block=8, postings=1000)
    for some in (items[:5], items[5:]):
        asked = L.query_terms(spark.createDataFrame(some, "item_id long, text string"), "item_id", "text")
        found = L.search(index, asked, 9, first=3).withColumnRenamed("item", "item_id")
        assert rows(found) == brute(docs, some, 9)


def test_empty_tables(spark):
    docs, items = corpus(n=20)
    none_d, none_q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some_d, some_q = spark.createDataFrame(docs, none_d.schema), spark.createDataFrame(items, none_q.schema)
    for d, q in ((none_d, some_q), (some_d, none_q), (none_d, none_q), (spark.createDataFrame([(1, None)], none_d.schema), some_q)):
        assert L.ranked(d, q).collect() == []


def test_blocks_are_clustered_and_skipped():
    """On topical documents a list's blocks hold one topic each, and bounds leave most blocks out."""
    rnd = random.Random(1)
    texts = [" ".join(["all"] + [f"t{i % 10}w{rnd.randrange(20)}" for _ in range(20)]) for i in range(600)]
    p = L._profile(pa.array(texts), None)
    table = pa.table({"shard": pa.array(np.zeros(600, np.int32)), "doc_id": pa.array(range(600)), "n": p.field("n"), "terms": p.field("terms"), "tf": p.field("tf")})
    index = L._index_shard(600, 600 * 21, 16)(table)
    shard = L.Shard(index)
    every = int(L._profile(pa.array(["all"]), None).field("terms")[0].values[0].as_py())
    at = int(np.searchsorted(shard.hashes, every))
    lo, hi = shard.block_range[at : at + 2]
    members = [shard.members[shard.member_ptr[b] : shard.member_ptr[b + 1]] for b in range(lo, hi)]
    assert sorted(np.concatenate(members)) == list(range(600)) and max(map(len, members)) <= 16
    pure = sum(max(Counter(int(d) % 10 for d in m).values()) for m in members) / 600
    assert pure > 0.5  # one topic in ten by chance
    # summaries are upper bounds, tight to one step
    for b in range(lo, hi):
        places, _ = shard.entries(shard.members[shard.member_ptr[b] : shard.member_ptr[b + 1]])
        true = np.zeros(len(shard.hashes), np.int64)
        np.maximum.at(true, shard.ids[places], shard.impact[places])
        said = np.zeros(len(shard.hashes), np.int64)
        said[shard.top_ids[shard.top_ptr[b] : shard.top_ptr[b + 1]]] = L.STEP * shard.top[shard.top_ptr[b] : shard.top_ptr[b + 1]]
        assert (said >= true).all() and (said - true < L.STEP).all()
    # a query whose heaviest term is the common one has to go through its blocks
    wanted = L._profile(pa.array(["all t3w1 t3w2 t3w3"]), None).field("terms")[0].values.to_numpy()
    weights = np.where(wanted == every, 3000, 2900)
    best, score = shard.query(wanted, weights, 0, 5)
    assert shard.skipped > 0 and all(int(d) % 10 == 3 for d in best)
    weight = dict(zip(wanted.tolist(), weights.tolist()))
    exact = []
    for d in range(600):
        a, b = shard.ptr[d : d + 2]
        exact.append(sum(weight.get(int(h), 0) * int(r) for h, r in zip(shard.hashes[shard.ids[a:b]], shard.impact[a:b])))
    assert score.tolist() == sorted(exact, reverse=True)[:5]


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(40)] + [(90, "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame([(1, "same other")], "item_id long, text string")
    assert rows(L.ranked(d, q, k=10, block=3, postings=10)) == brute(docs, [(1, "same other")], 10)
    assert L.ranked(d, q, k=10).agg(F.max("rank")).first()[0] == len(brute(docs, [(1, "same other")], 10))
