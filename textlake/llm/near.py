"""Near duplicates: ProbMinHash sketches of weighted word shingles, banding, exact verification, components.

The words of a text (lower-cased runs without ASCII white space) give shingles of five words, weighted by how often
they occur; a text of one to four words has one shingle. Every shingle is a Poisson process whose rate is its weight
and whose arrivals fall on the sketch's registers at random; a register keeps the shingle of its earliest arrival, and
a shingle stops once its next arrival is later than all registers' (early termination). Two sketches agree in a
register with a probability equal to the probability Jaccard similarity of the texts, which for unweighted shingles is
the Jaccard similarity.

Sixteen bands of four registers make candidates: at similarity 0.8 a pair is missed with probability 2e-4. Candidates
are verified exactly. First every member of a bucket is compared with the bucket's smallest member only. Buckets whose
members are not then all in one component go to tasks that compare members of different components, blocks of them
for large buckets; the sketches first rule out pairs that are five standard errors below the threshold. Tasks return links
that join components, at most one per member, never all pairs.

Defined results: a NULL or blank text links with nothing; texts of equal word sequences are in one group; a group is
a component of links of similarity >= ``threshold``; its smallest id stays (of rows with that id, one; a NULL id is
larger than all others); other columns of the input, whatever their names, are kept by ``drop_near_duplicates``; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlake.llm import bytetext as bt
from textlake.llm.common import BLANK, join_small, written
from textlake.llm.components import connected
from textlake.workers import tidy

SHINGLE = 5
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
PIECE = 1 << 20  # bytes of text whose shingles a task holds at once; a longer text is taken alone
BLOCK = 512  # members of a bucket compared in one task


def sequence(text: Column) -> Column:
    """A digest of the word sequence; NULL for texts without words."""
    plain = F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", " ")))
    return F.when(plain != "", F.md5(plain))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a column of texts: document number, 64-bit hash and count, documents in order."""
    h, doc = bt.words(texts)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, len(doc)))  # words of each document that has any
    n = np.maximum(1, count - size + 1)
    total = int(n.sum())
    owner = np.repeat(np.arange(len(first)), n)
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    left = (first + count)[owner] - at
    s = np.zeros(total, np.uint64)
    for k in range(size):
        word = np.where(k < left, h[np.minimum(at + k, len(h) - 1)], np.uint64(0)) if total else s
        s = bt.mix(s * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k + 1))
    owner = doc[first][owner] if total else owner
    key = bt.mix(s + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, index, counts = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(index)
    return owner[index[order]], s[index[order]], counts[order]


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Sketches (n_docs x registers, 16 bits of the winning shingle) of the documents' weighted shingles."""
    best = np.full(n_docs * registers, np.inf)
    won = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        draw = bt.mix(h + np.uint64(step * 0xA0761D6478BD642F & (1 << 64) - 1))
        time = time - np.log(bt.unit(draw)) / weight
        place = doc * registers + (bt.mix(draw + np.uint64(1)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, place, time)
        wins = best[place] == time
        won[place[wins]] = h[wins]
        latest = best.reshape(n_docs, registers).max(axis=1)
        on = time < latest[doc]
        doc, h, weight, time = doc[on], h[on], weight[on], time[on]
    return (bt.mix(won + np.uint64(7)) & np.uint64(0xFFFF)).astype(np.uint16).reshape(n_docs, registers)


def sketches(texts: pa.Array) -> pa.Array:
    """The sketches of a column of texts as binary (little-endian 16-bit registers); NULL for texts without words."""
    out = []
    for _, part in bt.slices(texts, PIECE):
        doc, h, counts = shingles(part)
        has = np.unique(doc)
        rows = prob_min_hash(np.searchsorted(has, doc), h, counts.astype(float), len(has)).astype("<u2")
        found = [None] * len(part)
        for k, d in enumerate(has):
            found[d] = rows[k].tobytes()
        out += found
    return pa.array(out, pa.binary())


def sketch(text: Column) -> Column:
    """The sketch of a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tidy():
            for texts in batches:
                yield sketches(texts)

    return F.arrow_udf(run, "binary")(text)


def shingle_set(text: Column) -> Column:
    """Distinct shingles of a text: sorted 32-bit hashes and their counts, as binary."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tidy():
            for texts in batches:
                hashes, weights = [], []
                for _, part in bt.slices(texts, PIECE):
                    doc, h, counts = shingles(part)
                    ends = np.searchsorted(doc, np.arange(len(part) + 1))
                    for a, b in zip(ends[:-1], ends[1:]):
                        ids, at = np.unique((h[a:b] >> np.uint64(32)).astype("<u4"), return_inverse=True)
                        hashes.append(ids.tobytes())
                        weights.append(np.bincount(at, counts[a:b], len(ids)).astype("<u4").tobytes())
                yield pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())], ["ids", "counts"])

    return F.arrow_udf(run, "struct<ids:binary,counts:binary>")(text)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets given as sorted ids and weights."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(both) == 0:
        return 0.0
    if len(a) == x.sum() and len(b) == y.sum():
        return len(both) / (len(a) + len(b) - len(both))
    p, q = x[i].astype(float), y[j].astype(float)
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    ratio = q / p
    only_a, only_b = x.sum() - p.sum(), y.sum() - q.sum()
    # the sum over all shingles of max(x_j / x_i, y_j / y_i): those of smaller ratio count by x, the others by y
    before = np.searchsorted(ratio, ratio, "left")
    low = np.concatenate([[0.0], np.cumsum(p)])[before] + only_a
    high = q.sum() - np.concatenate([[0.0], np.cumsum(q)])[before] + only_b
    return float((1.0 / (low / p + high / q)).sum())


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("ids").alias("ids_a"), F.col("counts").alias("counts_a"))
    two = sets.select(F.col("node").alias("b"), F.col("ids").alias("ids_b"), F.col("counts").alias("counts_b"))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for ids_a, counts_a, ids_b, counts_b in batches:
            yield pa.array(
                [
                    similarity(*(np.frombuffer(v.as_buffer(), "<u4") for v in row)) >= threshold
                    for row in zip(ids_a, counts_a, ids_b, counts_b)
                ],
                pa.bool_(),
            )

    alike = F.arrow_udf(run, "boolean")("ids_a", "counts_a", "ids_b", "counts_b")
    return pairs.join(two, "b").join(one, "a").where(alike).select("a", "b")


def _within(threshold: float):
    """Compare a block of a bucket with itself or another; return links between components that were apart."""
    spread = 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    least = int(np.ceil((threshold - spread) * REGISTERS))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        band = int(rows["band"].iat[0])
        cells = np.stack([np.frombuffer(s, "<u2") for s in rows["sketch"]])
        keys = np.stack([np.frombuffer(s, "<u8") for s in rows["sketch"]])
        ids = [np.frombuffer(v, "<u4") for v in rows["ids"]]
        counts = [np.frombuffer(v, "<u4") for v in rows["counts"]]
        group = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        two_sided = rows["i"].iat[0] != rows["j"].iat[0]
        links = []
        for k in range(len(rows) - 1):
            apart = group[k + 1 :] != group[k]
            if two_sided:
                apart &= side[k + 1 :] != side[k]
            other = np.flatnonzero(apart) + k + 1
            if len(other) == 0:
                continue
            other = other[(cells[other] == cells[k]).sum(axis=1) >= least]
            other = other[~(keys[other, :band] == keys[k, :band]).any(axis=1)]  # those met in an earlier band
            for j in other:
                if group[j] != group[k] and similarity(ids[k], counts[k], ids[j], counts[j]) >= threshold:
                    links.append((node[k], node[j]))
                    group[group == group[j]] = group[k]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The narrow table of rows (doc_id, seq, row) and the groups: seq, keep (doc_id, row), group_id, group_size.

    ``seq`` is the digest of the word sequence; the groups hold every sequence that occurs more than once or is linked.
    """
    light = written(
        docs.select(F.col(id_col).alias("doc_id"), sequence(F.col(text_col)).alias("seq"), sketch(F.col(text_col)).alias("sketch")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "sketches",
    )
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    seqs = light.where("seq IS NOT NULL").groupBy("seq").agg(first.alias("least"), F.count("*").alias("n"), F.min("sketch").alias("sketch"))
    seqs = written(seqs.withColumn("node", F.col("least.row")), "sequences")
    links = _links(docs, seqs, text_col, threshold)
    roots = connected(links)
    whole = seqs.select("node", "seq", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("least").alias("keep"), F.sum("n").alias("group_size")).where("group_size > 1")
    found = whole.join(least, "root").select("seq", F.struct("keep.doc_id", "keep.row").alias("keep"), "group_size")
    return light.drop("sketch"), written(found, "groups")


def _links(docs: DataFrame, seqs: DataFrame, text_col: str, threshold: float) -> DataFrame:
    width = ROWS * 2
    bands = seqs.select("node", "least", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.substring("sketch", k * width + 1, width).alias("key")) for k in range(BANDS)])).alias("b"))
    bands = bands.select("node", "least", "b.band", "b.key")
    buckets = bands.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("least").alias("least")).where("members > 1")
    buckets = buckets.select("band", "key", "members", F.col("least.row").alias("leader"))
    member = written(bands.drop("least").join(buckets, ["band", "key"]), "members")
    stars = written(member.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    # texts of candidates only; their shingles are made once
    wanted = written(member.select("node").distinct().join(seqs.select("node", "seq"), "node"), "wanted")
    texts = join_small(docs.select(sequence(F.col(text_col)).alias("seq"), F.col(text_col).alias("text")), wanted, ["seq"], "inner", 1_000_000)
    one = texts.groupBy("node").agg(F.min_by("text", F.length("text")).alias("text"))
    sets = written(one.select("node", shingle_set(F.col("text")).alias("set")).select("node", "set.ids", "set.counts"), "sets")
    sure = written(_verified(stars, sets, threshold), "verified")
    roots = connected(sure)
    # buckets that are not yet one component
    placed = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "key")
    torn = join_small(placed.where("members > 2"), written(torn, "open"), ["band", "key"], "left_semi", 1_000_000)
    rest = written(torn.select("band", "key", "node", "root", "members"), "torn")
    rest = rest.join(seqs.select("node", "sketch"), "node").join(sets, "node")
    n_blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    rest = rest.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = rest.select(
        "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "node", "root", "sketch", "ids", "counts"
    )
    more = tasks.groupBy("band", "key", "i", "j").applyInPandas(_within(threshold), "a long, b long")
    return sure.unionByName(written(more, "joined"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, group_id (smallest doc_id of its group), group_size, kept."""
    light, found = groups(docs, id_col, text_col, threshold)
    return light.join(found, "seq", "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("group_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with the columns it came with; documents outside every group pass on from their scan."""
    light, found = groups(docs, id_col, text_col, threshold)
    kept = found.join(light.select("row", F.col("seq").alias("kept_seq")), found["keep.row"] == F.col("row")).select(
        "seq", F.struct("keep.doc_id", "kept_seq").alias("keep")
    )
    whole = docs.select(sequence(F.col(text_col)).alias("seq"), F.col(id_col).alias("id"), F.struct("*").alias("whole"))
    met = join_small(whole, written(kept, "kept"), ["seq"], "left", 1_000_000)
    alone = met.where(F.col("keep").isNull()).select("whole")
    stays = F.col("id").eqNullSafe(F.col("keep.doc_id")) & (F.col("seq") == F.col("keep.kept_seq"))
    first = met.where(stays).groupBy("seq").agg(F.min_by("whole", F.col("whole")[text_col]).alias("whole")).select("whole")
    return alone.unionByName(first).select("whole.*")
