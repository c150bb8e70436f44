"""Quality and toxicity: held-out accuracy on the labelled tables, and edge rows."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlake.llm import quality, toxicity, training

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def outcome(df, labels, label):
    got = df.where("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    return {(r[0], r[1]): r[2] for r in got}


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    got = outcome(quality.classify(docs, labels), labels, "quality")
    assert (got.get((1, 1), 0) + got.get((0, 0), 0)) / sum(got.values()) > 0.98


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    got = outcome(toxicity.classify(docs, labels), labels, "toxic")
    assert (got.get((1, 1), 0) + got.get((0, 0), 0)) / sum(got.values()) > 0.97
    assert got.get((1, 1), 0) > 0.8 * (got.get((1, 1), 0) + got.get((1, 0), 0))


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    docs, labels = docs.where("doc_id < 600"), labels.where("doc_id < 600")
    flipped = labels.withColumn("quality", F.when(training.held_out("doc_id", 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "Fine words stand here.\nAnd more of them."), (4, "Fine words stand here.\nAnd more of them."), (5, "x"), (None, "### $$$ ###"), (6, "word " * 60_000), (7, "a\n" * 3000), (8, "\r\n\r\nline\r\n")]


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_rows(spark, tables, module, label):
    docs = spark.createDataFrame([(i, t, "a", 1.0) for i, t in ROWS], "doc_id long, text string, id string, score double").repartition(2)
    plain = tables[0].where("doc_id < 800").select("doc_id", "text")
    both = plain.where("doc_id > 10").unionByName(docs.select("doc_id", "text"))
    got = module.classify(both, tables[1].where("doc_id > 10")).collect()
    assert len(got) == both.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    small = {}
    for r in got:
        if r["doc_id"] is None or r["doc_id"] <= 8:
            small.setdefault(r["doc_id"], set()).add(r["score"])
    assert set(small) == {i for i, _ in ROWS} and all(len(s) == 1 for s in small.values())
    if module is quality:
        assert small[1] == small[2] == small[3] == {0.0}
        assert set(quality.accepted(docs, tables[1]).columns) == set(docs.columns)
    else:
        assert small[1] == small[2] == small[3]
    # no labels of two kinds, no rows
    one = tables[1].where(f"{label} = 0 AND doc_id < 100")
    assert module.classify(docs, one).count() == len(ROWS)
    assert module.classify(docs.limit(0), tables[1].limit(0)).collect() == []


def brute_marginals(chain, doc, bins):
    e = chain.potentials(doc, bins)
    out = np.zeros(len(doc))
    for d in np.unique(doc):
        at = np.flatnonzero(doc == d)
        total = 0.0
        for states in itertools.product((0, 1), repeat=len(at)):
            s = sum(e[i] for i, x in zip(at, states) if x) + chain.start[0] * states[0] + sum(chain.step[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(s)
            out[at] += np.exp(s) * np.array(states)
        out[at] /= total
    return out


def test_forward_backward_against_enumeration():
    texts = pa.array(["one two.\nTHREE!!\nfour four four\nfive", "", "x", "a b\n\nc d e\n###"])
    doc, size, bins = quality.lines(texts)
    rng = np.random.default_rng(0)
    chain = quality.Chain()
    chain.weight[:] = rng.normal(size=chain.weight.shape)
    chain.start[:] = 0.3
    chain.step[:] = rng.normal(size=(2, 2))
    assert chain.marginals(doc, bins) == pytest.approx(brute_marginals(chain, doc, bins))
    assert size.sum() == sum(len(x) for t in texts.to_pylist() for x in t.split("\n") if x)


def pairs_only(n, noise, seed=1):
    """Texts of one word of each of two pairs among neutral ones; which words meet decides, no word by itself does."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.integers(0, 2, 2)
        words = [("alder", "birch")[a], ("copper", "silver")[b], *(f"w{k}" for k in rng.integers(0, 300, noise))]
        rows.append((i, " ".join(rng.permutation(words)), int(a == b)))
    return rows


@pytest.mark.parametrize("noise", [0, 12])
def test_pairs_are_learned(spark, noise):
    rows = spark.createDataFrame(pairs_only(1500, noise), "doc_id long, text string, toxic int")
    got = toxicity.classify(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).where("held_out").join(rows, "doc_id").collect()
    assert len(got) > 200 and sum(r["predicted"] == r["toxic"] for r in got) > 0.9 * len(got)
    # without factors the same words tell nothing
    machine = toxicity.fit(rows, rows.select("doc_id", "toxic"), ~training.held_out("doc_id", 5, 0))
    machine.factor[:] = 0
    doc, bucket = toxicity.terms(pa.array([r["text"] for r in got]))
    plain = machine.probabilities(doc, bucket, len(got)) >= 0.5
    assert sum(p == r["toxic"] for p, r in zip(plain, got)) < 0.65 * len(got)


def sample_of(rng, n_docs, used):
    doc, bucket = zip(*[(d, b) for d in range(n_docs) for b in sorted(rng.choice(used, rng.integers(0, 6), replace=False))])
    return np.array(doc), np.array(bucket)


def explicit(machine, buckets):
    """The machine's value by an explicit sum over pairs."""
    at = [machine.place[b] for b in buckets if machine.place[b] >= 0]
    pairs = sum(float(machine.factor[i].astype(float) @ machine.factor[j].astype(float)) for i, j in itertools.combinations(at, 2))
    return float(machine.bias[0]) + sum(float(machine.weight[i]) for i in at) + pairs


def machine_of(rng, used):
    machine = toxicity.Machine(used, scale=0.7)
    machine.weight[:] = rng.normal(size=len(used))
    machine.bias[:] = 0.3
    return machine


def test_pair_sum_against_double_sum():
    rng = np.random.default_rng(5)
    used = np.array([3, 17, 40, 99, 512, 7000, 200_000])
    machine = machine_of(rng, used[:-1])  # the last is not in use
    doc, bucket = sample_of(rng, 50, used)
    value = machine.sums(*machine.rows(doc, bucket, 50))[1]
    assert value == pytest.approx([explicit(machine, bucket[doc == d]) for d in range(50)], abs=1e-4)
    again = np.concatenate([doc, doc])  # repeated terms, in any order, count once
    p = machine.probabilities(again[::-1], np.concatenate([bucket, bucket])[::-1], 50)
    assert p == pytest.approx(1 / (1 + np.exp(-value.astype(float))))


def test_gradient_against_differences():
    rng = np.random.default_rng(6)
    used = np.array([3, 17, 40, 99, 512])
    machine = machine_of(rng, used)
    doc, bucket = sample_of(rng, 30, used)
    row, count = machine.rows(doc, bucket, 30)
    off = rng.normal(size=30).astype(np.float32)
    met, by_weight, by_factor = machine.pulls(off, machine.sums(row, count)[0], doc, row, np.argsort(row, kind="stable"))
    assert list(met) == sorted(set(row))
    total = lambda: sum(float(o) * explicit(machine, bucket[doc == d]) for d, o in enumerate(off))
    for k, i in enumerate(met):
        for values, at, slope in [(machine.weight, (i,), by_weight[k]), *[(machine.factor, (i, f), by_factor[k, f]) for f in range(toxicity.FACTORS)]]:
            kept = values[at]
            values[at] = kept + 0.25
            above = total()
            values[at] = kept - 0.25
            assert (above - total()) / 0.5 == pytest.approx(slope, abs=1e-3)  # the value is linear in each of them
            values[at] = kept


def test_bounded_sample(spark):
    rows = spark.createDataFrame(pairs_only(300, 12), "doc_id long, text string, toxic int")
    some = toxicity.fit(rows, rows.select("doc_id", "toxic"), F.lit(True), entries=2000)
    assert some is not None
    assert toxicity.fit(rows, rows.select("doc_id", "toxic"), F.lit(True), entries=1) is None  # one document, one label


def test_quality_holds_the_lines_of_a_piece_at_once():
    rng = random.Random(6)
    texts = pa.array(["\n".join(" ".join(f"w{rng.randrange(10**5)}" for _ in range(10)) for _ in range(100)) for _ in range(1300)] + [None, ""])
    chain = quality.Chain()
    chain.weight[:] = np.random.default_rng(6).normal(size=chain.weight.shape)
    quality.scores(texts[:2], chain)
    tracemalloc.start()
    got = quality.scores(texts, chain)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 8 << 20
    assert peak < 80 << 20
    assert got.tolist() == [quality.scores(texts[i : i + 1], chain)[0] for i in range(len(texts))]
