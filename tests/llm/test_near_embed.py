"""Near duplicates of texts and of embeddings against all-pairs comparison."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from textlake.llm import common, components, embed, near


def union(n_links, nodes):
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in n_links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(70)] + [(900, 1000 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union(links, {i for pair in links for i in pair})
    assert got == {i: r for i, r in want.items() if i in got}
    assert all(i in got for a, b in links if a != b for i in (a, b))


def test_components_of_nothing(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))


def corpus():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, i = [], 0
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 150]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i, rng.choice([" ", "\n", "  "]).join(copy)))
            i += 1
    rows += [(100, None), (101, ""), (102, " \t"), (103, "One two"), (104, "one  TWO"), (104, "one two"), (105, "la " * 5000), (106, "la " * 4000), (None, "one two")]
    return rows


def test_near_groups(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, seq string, keep string, node long").repartition(3)
    sets = [shingles(t) for _, t in rows]
    at = range(len(rows))
    links = [(a, b) for a in at for b in range(a) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8 - 1e-12]
    order = sorted(at, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rank = {k: n for n, k in enumerate(order)}
    root = union([(rank[a], rank[b]) for a, b in links], range(len(rows)))
    size = Counter(root.values())
    want = sorted((str(rows[k][0]), str(rows[order[root[rank[k]]]][0]), size[root[rank[k]]]) for k in at)
    got = near.classes(df).collect()
    assert sorted((str(r["doc_id"]), str(r["group_id"]), r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(size)
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(rows[order[r]][0]) for r in size)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    test_near_groups(spark)


def test_large_key_tables(spark, monkeypatch):
    monkeypatch.setattr(near, "join_small", lambda df, small, on, how="left", most_rows=0: common.join_small(df, small, on, how, 0))
    test_near_groups(spark)


def test_similarity_is_probability_jaccard():
    rng = random.Random(2)
    for _ in range(50):
        x, y = (Counter(rng.choices(range(12), k=rng.randrange(1, 30))) for _ in range(2))
        cells = [np.array(sorted(c)) for c in (x, y)]
        got = near.similarity(cells[0], np.array([x[i] for i in cells[0]]), cells[1], np.array([y[i] for i in cells[1]]))
        assert got == pytest.approx(jaccard(x, y))


def test_sketch_estimates_without_bias():
    rng = np.random.default_rng(1)
    found = []
    x, y = {1: 3, 2: 1, 3: 2, 4: 1}, {1: 1, 2: 2, 3: 2, 9: 4}
    for _ in range(60):
        salt = rng.integers(1, 2**62)
        doc = np.array([0] * 4 + [1] * 4)
        h = np.array([*x, *y], np.uint64) * np.uint64(salt | 1)
        s = near.prob_min_hash(doc, h, np.array([*x.values(), *y.values()], float), 2)
        found.append((s[0] == s[1]).mean())
    assert np.mean(found) == pytest.approx(jaccard(Counter(x), Counter(y)), abs=0.03)


def test_near_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near.classes(none).collect() == [] and near.drop_near_duplicates(none).collect() == []


def vectors():
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, 1, None):
        base = rng.normal(size=(12, 16))
        for b in base:
            for noise in (0, 0, 0.02, 0.2, 0.35):
                rows.append((i, [float(v) for v in b + noise * rng.normal(size=16)], label))
                i += 1
    rows += [(i, None, 0), (i + 1, [], 0), (i + 2, [0.0] * 16, 0), (i + 3, [None] + [1.0] * 15, 0), (i + 4, [float("nan")] * 16, 0), (i + 5, [float("inf")] * 16, 0)]
    rows += [(i + 6, [1.0, 2.0], 0), (i + 7, [10.0, 20.0], 0), (i + 7, [10.0, 20.0], 0), (None, [1.0, 2.1], 0), (i + 8, [1e-30, 2e-30], 0), (i + 9, [1.0, 2.0], None)]
    return rows


def test_embeddings(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, g, 7) for i, v, g in rows], "vec_id long, embedding array<double>, label int, row int").repartition(4)
    ok = [v is not None and g is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) for _, v, g in rows]

    def cosine(a, b):
        a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= 0.93
    ]
    n = Counter(k for pair in links for k in pair)
    root = union(links, range(len(rows)))
    least = defaultdict(list)
    for k, r in root.items():
        least[r].append(rows[k][0])
    want = sorted(str((rows[k][0], n[k], min((i for i in least[root[k]] if i is not None), default=None))) for k in range(len(rows)))
    got = embed.duplicates(df).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert links


def test_embeddings_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 4)
    monkeypatch.setattr(embed, "CHUNK", 3)
    test_embeddings(spark)


def test_embeddings_in_hash_tables(spark, monkeypatch):
    """Groups larger than a bucket meet through keys."""
    monkeypatch.setattr(embed, "BUCKET", 8)
    assert embed.tables_for(60)[0] == 3
    test_embeddings(spark)


def test_planted_links_at_the_threshold(spark):
    """Twenty thousand pairs a little above 0.93, and as many a little below, in a few labels; each has its one link or none."""
    rng = np.random.default_rng(12)
    n = 20_000
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.935, n)
    cosine[n // 2 :] = rng.uniform(0.925, 0.9299, n - n // 2)
    b = cosine[:, None] * a + np.sqrt(1 - cosine**2)[:, None] * b
    table = pd.DataFrame({"vec_id": np.arange(2 * n), "embedding": [v.tolist() for v in np.concatenate([a, b])], "label": np.tile(np.arange(n) % 3, 2)})
    got = embed.duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).toPandas().sort_values("vec_id")
    want = np.tile(np.arange(n) < n // 2, 2).astype(int)
    assert (got["n_links"].to_numpy() == want).all()
    assert (got["component_id"].to_numpy() == np.where(want == 1, np.arange(2 * n) % n, np.arange(2 * n))).all()


def test_embeddings_of_nothing(spark):
    assert embed.duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.05 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    codes, factor = embed.encode(x, 11)
    found, error = embed.estimate(codes, factor, y, 11)
    gap = found - x @ y.T
    assert abs(np.diag(gap).mean()) < 0.01 and abs(gap.mean()) < 0.01
    assert (np.abs(gap) < embed.SIGMAS * error[:, None]).all()


def test_recall_at_the_threshold():
    bits, tables = embed.tables_for(10**8)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    turn = embed.rotation(64, bits * tables, 11)
    same = ((a.astype(np.float32) @ turn >= 0) == (b.astype(np.float32) @ turn >= 0)).reshape(len(a), tables, bits).all(axis=2).any(axis=1)
    assert bits == 11 and same.all()


def test_sketches_hold_a_piece_of_the_text_at_once():
    rng = random.Random(4)
    texts = pa.array([" ".join(str(rng.randrange(10**6)) for _ in range(1000)) for _ in range(1300)])
    near.sketches(texts[:2])
    tracemalloc.start()
    got = near.sketches(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 8 << 20
    assert peak < 64 << 20
    assert got.to_pylist() == [near.sketches(texts[i : i + 1])[0].as_py() for i in range(len(texts))]
