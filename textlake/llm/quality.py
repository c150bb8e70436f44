"""Quality of documents: a linear-chain conditional random field labels every line good or bad.

A line is described by bins of its shape (length, word lengths, shares of letters, capitals, digits and symbols,
repeated words, repeated lines) and by those of the lines before and after it. Two states, one weight per bin and a
2 x 2 transition make the chain. Forward and backward passes run for all documents of a batch at once; with two states
each is a recursion on one log-odds number. The score of a document is the average of its lines' probabilities of
being good, weighted by line length.

Fitting maximises the likelihood of the lines' labels, all lines of a labelled document having its label, on a bounded
sample (``training.SAMPLE`` documents of at most ``training.MAX_CHARS`` characters), on the driver.

Defined results: a NULL, empty or blank text has no lines and scores 0; texts and lines are taken whole, whatever their
length; equal texts score equally; blank lines are no part of the chain; other columns of the input are kept by
``accepted``; without labels of both kinds every text with lines scores 1; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlake.llm import bytetext as bt, training
from textlake.llm.common import fresh
from textlake.workers import tidy

_SHARES = np.array([0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
_MEANS = np.array([1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14, 20])
BINS = 17
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in b"#$%&*@^~<>{}[]\\/=+_`|"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EXCLAIM = np.zeros(256, bool)
_EXCLAIM[[33, 63]] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46, 59, 58]] = True
FEATURES = 14
PIECE = 1 << 20  # bytes of text whose lines a task holds at once; a longer text is taken alone


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines that are not blank, of a column of texts: document number, length in bytes, bins (lines x FEATURES)."""
    data, off = bt.raw(texts)
    w_from, w_to, w_doc = bt.spans(~bt.SPACE[data], off)
    start, end, doc = bt.spans((data != 10) & (data != 13), off)
    of = np.searchsorted(start, w_from, "right") - 1
    words = np.bincount(of, minlength=len(start))
    some = words > 0
    number = np.cumsum(some) - 1
    of, start, end, doc, words = number[of], start[some], end[some], doc[some], words[some]
    n = len(start)
    if n == 0:
        return doc, end - start, np.zeros((0, FEATURES), np.int64)
    size = end - start
    h = bt.hash_spans(data, w_from, w_to)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=total[1:])
        return total[end] - total[start]

    letters, upper = share(_LETTER), share(_UPPER)
    cells = np.zeros((n, FEATURES))
    cells[:, 0] = upper / np.maximum(letters, 1)
    cells[:, 1] = letters / size
    cells[:, 2] = share(_DIGIT) / size
    cells[:, 3] = share(_SYMBOLS) / size
    cells[:, 4] = share(_EXCLAIM) / size
    cells[:, 5] = share(_STOP) / words
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    cells[:, 6] = np.bincount(of, same, n) / words
    owner = bt.mix(h + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    cells[:, 7] = np.bincount(of[np.unique(owner, return_index=True)[1]], minlength=n) / words
    odd = (_SYMBOLS | _EXCLAIM)[data[w_to - 1]]
    cells[:, 8] = np.bincount(of, odd, n) / words
    line = bt.mix(bt.hash_spans(data, start, end) + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, which, times = np.unique(line, return_inverse=True, return_counts=True)
    in_doc = np.bincount(doc, minlength=len(off) - 1)[doc]
    cells[:, 9] = (times[which] - 1) / np.maximum(in_doc - 1, 1)
    bins = np.empty((n, FEATURES), np.int64)
    bins[:, :10] = np.searchsorted(_SHARES, cells[:, :10], "left")
    bins[:, 10] = np.searchsorted(_MEANS, np.bincount(of, w_to - w_from, n) / words, "left")
    bins[:, 11] = np.minimum(np.log2(words).astype(np.int64), BINS - 1)
    bins[:, 12] = np.minimum(np.log2(size).astype(np.int64), BINS - 1)
    bins[:, 13] = np.where(_STOP[data[end - 1]], 0, np.where(_EXCLAIM[data[end - 1]], 1, np.where(_SYMBOLS[data[end - 1]], 2, np.where(_LETTER[data[end - 1]], 3, 4))))
    return doc, size, bins + np.arange(FEATURES) * BINS


class Chain:
    """Weights: per bin for the line itself, the one before and the one after; two start terms; transitions."""

    def __init__(self):
        self.weight = np.zeros((3, FEATURES * BINS))
        self.start = np.zeros(1)
        self.step = np.zeros((2, 2))

    def potentials(self, doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
        e = self.weight[0][bins].sum(axis=1)
        if len(doc) > 1:
            inner = doc[1:] == doc[:-1]
            e[1:][inner] += self.weight[1][bins[:-1][inner]].sum(axis=1)
            e[:-1][inner] += self.weight[2][bins[1:][inner]].sum(axis=1)
        return e

    def passes(self, doc: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the forward and backward messages of every line."""
        s = self.step
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        count = np.diff(np.append(first, len(doc)))
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")  # with more than t lines
        a, b = np.empty(len(doc)), np.zeros(len(doc))
        for t, k in enumerate(alive):
            at = first[:k] + t
            if t == 0:
                a[at] = e[at] + self.start[0]
            else:
                p = a[at - 1]
                a[at] = e[at] + np.logaddexp(s[0, 1], p + s[1, 1]) - np.logaddexp(s[0, 0], p + s[1, 0])
        for t in range(len(alive) - 1, 0, -1):
            at = first[: alive[t]] + t
            q = e[at] + b[at]
            b[at - 1] = np.logaddexp(s[1, 0], s[1, 1] + q) - np.logaddexp(s[0, 0], s[0, 1] + q)
        return a, b

    def marginals(self, doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
        a, b = self.passes(doc, self.potentials(doc, bins))
        return 1 / (1 + np.exp(-np.clip(a + b, -500, 500)))

    def fit(self, doc: np.ndarray, bins: np.ndarray, good: np.ndarray, rounds: int = 120, decay: float = 0.02, rate: float = 0.1) -> Chain:
        """``good``: the label of every line (0 or 1). Gradient steps of Adam on the averaged log-likelihood, documents weighing equally."""
        n_docs = len(np.unique(doc))
        weigh = 1.0 / np.bincount(doc)[doc] / n_docs
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        head = np.flatnonzero(np.diff(doc, prepend=-1))
        parts = [self.weight, self.start, self.step]
        m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        width = FEATURES * BINS
        for k in range(1, rounds + 1):
            e = self.potentials(doc, bins)
            a, b = self.passes(doc, e)
            off = (good - 1 / (1 + np.exp(-np.clip(a + b, -500, 500)))) * weigh
            g = [np.zeros_like(p) for p in parts]
            for which, (x, y) in enumerate(((bins, off), (bins[inner], off[inner + 1]), (bins[inner + 1], off[inner]))):
                g[0][which] = np.bincount(x.ravel(), np.repeat(y, FEATURES), width)
            g[1][0] = off[head].sum()
            q = e[inner + 1] + b[inner + 1]
            z = np.stack([np.full(len(inner), self.step[0, 0]), self.step[0, 1] + q, self.step[1, 0] + a[inner], self.step[1, 1] + a[inner] + q])
            z = np.exp(z - z.max(axis=0))
            z = z / z.sum(axis=0) * weigh[inner]
            seen = np.zeros((2, 2))
            np.add.at(seen, (good[inner].astype(int), good[inner + 1].astype(int)), weigh[inner])
            g[2][:] = seen - z.sum(axis=1).reshape(2, 2)
            for p, d, m1, v1 in zip(parts, g, m, v):
                d = d - decay * p / max(n_docs, 1)
                m1[:] = 0.9 * m1 + 0.1 * d
                v1[:] = 0.99 * v1 + 0.01 * d * d
                p += rate * (m1 / (1 - 0.9**k)) / (np.sqrt(v1 / (1 - 0.99**k)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = training.SAMPLE, max_chars: int = training.MAX_CHARS) -> Chain | None:
    """Fit on a bounded sample of labelled rows; None if it does not hold both labels."""
    rows = training.labelled(docs, labels, label, keep, id_col, text_col, sample, max_chars).orderBy("id").select("y", "text").toArrow()
    y = np.asarray(rows["y"].combine_chunks(), dtype=float)
    if len(np.unique(y)) < 2:
        return None
    found = [(doc + first, bins) for first, part in bt.slices(rows["text"].combine_chunks()) for doc, _, bins in [lines(part)]]
    doc = np.concatenate([d for d, _ in found])
    return Chain().fit(doc, np.concatenate([b for _, b in found]), y[doc])


def scores(texts: pa.Array, chain: Chain | None) -> np.ndarray:
    """The scores of a column of texts."""
    out = np.zeros(len(texts))
    for first, part in bt.slices(texts, PIECE):
        doc, size, bins = lines(part)
        p = chain.marginals(doc, bins) if chain is not None else np.ones(len(doc))
        total = np.bincount(doc, size, len(part))
        out[first : first + len(part)] = np.bincount(doc, size * p, len(part)) / np.maximum(total, 1)
    return np.clip(out, 0, 1)


def score(text: Column, model) -> Column:
    """The score of a text, from 0 to 1; ``model``: a broadcast ``Chain``, or None."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tidy():
            chain = model.value if model is not None else None
            for texts in batches:
                yield pa.array(scores(texts, chain))

    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", parts: int = 3, part: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Fitted on rows that are not held out."""
    model = fit(docs, labels, ~training.held_out(id_col, parts, part), id_col, text_col, label)
    model = model and docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col).alias("doc_id"), training.held_out(id_col, parts, part).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", parts: int = 3, part: int = 1) -> DataFrame:
    """The documents that score 0.5 or more, with the columns they came with."""
    model = fit(docs, labels, ~training.held_out(id_col, parts, part), id_col, text_col, label)
    model = model and docs.sparkSession.sparkContext.broadcast(model)
    mark = fresh("score")
    return docs.withColumn(mark, score(F.col(text_col), model)).where(F.col(mark) >= 0.5).drop(mark)
