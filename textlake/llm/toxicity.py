"""Toxicity of documents: a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits, and their first ``HEADS`` bytes, which stand for the stems of
inflected words; a document is the set of its terms, hashed to ``BUCKETS`` buckets.
The machine adds a weight per bucket and, for every pair of buckets present, the product of their factor vectors,
which learns combinations (an insult with a mention of a group) that no sum of single weights can express. The pair sum
costs one pass: half of (sum of factors)^2 minus the sum of squared factors.

Fitting sees a bounded sample (``SAMPLE`` documents of at most ``training.MAX_CHARS`` characters and ``ENTRIES`` buckets in
all) on the driver, as bucket numbers only. It has two stages. The first fits the buckets whose document rates in the two
classes differ by ``DEVIATIONS`` standard errors or more. The second goes on from there with every bucket of ``LEAST``
documents or more, in mini-batches, so that terms which tell something only together are learned as well. A fifth of the
sample, chosen at random, decides: the second stage counts only if it lowers the loss there by ``DEVIATIONS`` standard
errors, and takes as many passes as did best. Where single terms say it all, thousands of neutral ones only add noise, and
the first stage stands.

Defined results: a NULL, empty or blank text has no terms and scores as the bias alone does; texts are taken whole;
order and repetition of terms do not matter; equal texts score equally; without labels of both kinds every text scores
0; other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textlake.llm import bytetext as bt, training
from textlake.llm.common import written

BUCKETS = 1 << 18
SAMPLE = 8_000
ENTRIES = 16_000_000  # pairs of a document and a bucket in the sample
FACTORS = 8
PASSES, PATIENCE = 12, 4  # of the second stage: at most, and without a gain
BATCH = 256  # documents summed at a time
HEADS = (3, 4, 5, 6)
LEAST = 4
DEVIATIONS = 3.0
_TERM = np.zeros(256, bool)
_TERM[48:58] = True
_TERM[97:123] = True
_TERM[128:] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every term of a column of texts."""
    data, off = bt.raw(pc.utf8_lower(texts))
    start, end, doc = bt.spans(_TERM[data], off)
    found = bt.hash_spans(data, start, end, HEADS)
    kinds = [bt.mix(h + np.uint64(k)) for k, h in enumerate(found)]
    return np.tile(doc, len(kinds)), (np.concatenate(kinds) % np.uint64(BUCKETS)).astype(np.int64)


def _distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc.astype(np.int64) * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))


def _weights(y: np.ndarray) -> np.ndarray:
    """Weights of documents, halfway to balanced classes."""
    return np.where(y > 0, np.sqrt((len(y) - y.sum()) / max(1.0, y.sum())), 1.0)


class Machine:
    """Weights and factors of the buckets in use; ``place`` maps a bucket to its row, or -1.

    Documents are given as ``doc`` (numbers in order) and ``bucket``, distinct pairs.
    """

    def __init__(self, used: np.ndarray, seed: int = 3, scale: float = 0.05):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.bias = np.zeros(1, np.float32)
        self.weight = np.zeros(len(used), np.float32)
        self.factor = np.random.default_rng(seed).normal(0, scale, (len(used), FACTORS)).astype(np.float32)

    def widened(self, used: np.ndarray) -> Machine:
        """This machine with rows for ``used``, which includes its own; new ones start with small factors."""
        out = Machine(used, seed=4, scale=0.01)
        old = np.flatnonzero(self.place >= 0)
        out.bias[:] = self.bias
        out.weight[out.place[old]], out.factor[out.place[old]] = self.weight[self.place[old]], self.factor[self.place[old]]
        return out

    def rows(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the buckets in use, document by document, and their number for each document."""
        row = self.place[bucket]
        return row[row >= 0], np.bincount(doc[row >= 0], minlength=n)

    def sums(self, row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document: the sum of its factor vectors, and the machine's value."""
        has = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[has]
        sums, linear = np.zeros((len(count), FACTORS), np.float32), np.zeros(len(count), np.float32)
        if len(has):
            sums[has] = np.add.reduceat(self.factor[row], first)
            linear[has] = np.add.reduceat((self.weight - 0.5 * (self.factor**2).sum(axis=1))[row], first)
        return sums, self.bias[0] + linear + 0.5 * (sums**2).sum(axis=1)

    def pulls(self, off: np.ndarray, sums: np.ndarray, doc: np.ndarray, row: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that occur, and the sums of ``off`` times the derivative of the value by their weights and factors.

        ``order`` sorts ``row``; the derivative by a factor vector is the sum of the document's other ones.
        """
        if len(row) == 0:
            return row, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32)
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        met = row[order][first]
        both = np.column_stack([off, off[:, None] * sums])
        total = np.add.reduceat(both[doc[order]], first)
        return met, total[:, 0], total[:, 1:] - total[:, :1] * self.factor[met]

    def probabilities(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        row = self.place[bucket]
        row, count = self.rows(*_distinct(doc[row >= 0], bucket[row >= 0]), n)
        end = np.concatenate([[0], np.cumsum(count)])
        parts = [self.sums(row[end[k] : end[min(n, k + BATCH)]], count[k : k + BATCH])[1] for k in range(0, n, BATCH)]
        return _sigmoid(np.concatenate(parts)) if parts else np.zeros(0)

    def fit(self, doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 3e-5) -> Machine:
        """The first stage: all documents in every round, moments of the gradient for its steps."""
        row, count = self.rows(doc, bucket, len(y))
        doc, order = np.repeat(np.arange(len(y)), count), np.argsort(row, kind="stable")
        weigh = _weights(y)
        weigh /= weigh.sum()
        parts = [self.bias, self.weight, self.factor]
        m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for k in range(1, rounds + 1):
            sums, value = self.sums(row, count)
            off = ((y - _sigmoid(value)) * weigh).astype(np.float32)
            met, by_weight, by_factor = self.pulls(off, sums, doc, row, order)
            g = [off.sum(keepdims=True), -decay * self.weight, -decay * self.factor]
            g[1][met] += by_weight
            g[2][met] += by_factor
            for p, d, m1, v1 in zip(parts, g, m, v):
                m1[:] = 0.9 * m1 + 0.1 * d
                v1[:] = 0.99 * v1 + 0.01 * d * d
                p += rate * (m1 / (1 - 0.9**k)) / (np.sqrt(v1 / (1 - 0.99**k)) + 1e-8)
        return self

    def passes(self, doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, rate: float = 0.02, seed: int = 6) -> Iterator[int]:
        """The second stage: each step goes once through the documents, in mini-batches, with steps by row; yields its number."""
        row, count = self.rows(doc, bucket, len(y))
        end = np.cumsum(count)
        weigh = _weights(y)
        weigh /= weigh.mean()
        rng = np.random.default_rng(seed)
        seen = np.full((2, len(self.weight)), 1e-6, np.float32)
        for done in range(1, PASSES + 1):
            mixed = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                docs = mixed[lo : lo + BATCH]
                size = count[docs]
                here = np.repeat(np.arange(len(docs)), size)
                part = row[np.arange(len(here)) + np.repeat(end[docs] - np.cumsum(size), size)]
                sums, value = self.sums(part, size)
                off = ((y[docs] - _sigmoid(value)) * weigh[docs] / len(docs)).astype(np.float32)
                met, by_weight, by_factor = self.pulls(off, sums, here, part, np.argsort(part, kind="stable"))
                seen[0, met] += by_weight**2
                seen[1, met] += (by_factor**2).mean(axis=1)
                self.bias += rate * off.sum()
                self.weight[met] += rate * by_weight / np.sqrt(seen[0, met])
                self.factor[met] += rate * by_factor / np.sqrt(seen[1, met])[:, None]
            yield done

    def losses(self, doc: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = np.clip(self.probabilities(doc, bucket, len(y)), 1e-4, 1 - 1e-4)
        return -np.log(np.where(y > 0, p, 1 - p)) * _weights(y)


def telling(n: np.ndarray, n1: np.ndarray, docs: int, docs1: int) -> np.ndarray:
    """Whether the rates of buckets in the two classes differ clearly; ``n`` documents have a bucket, ``n1`` of them toxic."""
    rate = n / docs
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / (docs - docs1) + 1 / docs1))
    z = np.abs(n1 / docs1 - (n - n1) / (docs - docs1)) / error
    return (n >= LEAST) & (z >= DEVIATIONS)


def chosen(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the first stage, and those of the second."""
    n, n1 = np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, y[doc], BUCKETS)
    return np.flatnonzero(telling(n, n1, len(y), int(y.sum()))), np.flatnonzero(n >= LEAST)


def _taken(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.cumsum(keep) - 1)[doc[keep[doc]]], bucket[keep[doc]], y[keep]


def passes_needed(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> int:
    """How many passes of the second stage lower the loss of a fifth of the documents, which is not fitted, most clearly."""
    aside = np.random.default_rng(9).permutation(len(y)) % 5 == 0
    fitted, others = _taken(doc, bucket, y, ~aside), _taken(doc, bucket, y, aside)
    if min(len(np.unique(fitted[2])), len(np.unique(others[2]))) < 2:
        return 0
    first, every = chosen(*fitted)
    machine = Machine(first).fit(*fitted)
    before = machine.losses(*others)
    machine = machine.widened(every)
    best, least = 0, before.mean()
    for done in machine.passes(*fitted):
        gain = before - machine.losses(*others)
        if before.mean() - gain.mean() < least and gain.mean() > DEVIATIONS * gain.std() / np.sqrt(len(gain)):
            best, least = done, before.mean() - gain.mean()
        if done >= best + PATIENCE:
            break
    return best


def fitted(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> Machine:
    """Both stages on documents given as distinct pairs of ``doc`` (in order) and ``bucket``."""
    first, every = chosen(doc, bucket, y)
    machine = Machine(first).fit(doc, bucket, y)
    passes = passes_needed(doc, bucket, y)
    if passes:
        machine = machine.widened(every)
        for done in machine.passes(doc, bucket, y):
            if done == passes:
                break
    return machine


def buckets(text: Column) -> Column:
    """Distinct buckets of a text, as array of int."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for _, part in bt.slices(texts):
                doc, bucket = _distinct(*terms(part))
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                out += [bucket[a:b].astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE, max_chars: int = training.MAX_CHARS, entries: int = ENTRIES) -> Machine | None:
    """Fit on a bounded sample of labelled rows; None if it does not hold both labels."""
    rows = training.labelled(docs, labels, label, keep, id_col, text_col, sample, max_chars)
    rows = written(rows.select("id", "y", buckets(F.col("text")).alias("b")), "sample")
    # id hash and size of at most ``sample`` documents, in the order of the sample
    sizes = rows.orderBy(F.xxhash64("id"), "id").select(F.xxhash64("id").alias("h"), F.size("b").alias("n")).toArrow()
    within = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), entries, "right"))
    if within < len(sizes):
        rows = rows.where(F.xxhash64("id") <= F.lit(sizes["h"][max(0, within - 1)].as_py()))
    counts = rows.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    used = np.zeros(BUCKETS, bool)
    used[counts.select("bucket").toArrow()["bucket"].to_numpy()] = True  # one row per bucket at most

    def narrowed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([b[used[b]] for b in (np.asarray(x.values) for x in lists)], pa.list_(pa.int32()))

    table = rows.orderBy("id").select("y", F.arrow_udf(narrowed, "array<int>")("b").alias("b")).toArrow()
    y, lists = table["y"].to_numpy().astype(float), table["b"].combine_chunks()
    if len(np.unique(y)) < 2:
        return None
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(lists.value_lengths()))
    return fitted(doc, np.asarray(lists.flatten()), y)


def score(text: Column, model) -> Column:
    """The probability that a text is toxic; ``model``: a broadcast ``Machine``, or None."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros(len(texts))
            for first, part in bt.slices(texts):
                if model is not None:
                    out[first : first + len(part)] = model.value.probabilities(*terms(part), len(part))
            yield pa.array(out)

    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", parts: int = 5, part: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Fitted on rows that are not held out."""
    model = fit(docs, labels, ~training.held_out(id_col, parts, part), id_col, text_col, label)
    model = model and docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col).alias("doc_id"), training.held_out(id_col, parts, part).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
