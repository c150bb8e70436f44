"""Ranked lexical search: posting lists in geometric blocks with coordinatewise-maximum summaries, skipped on exact bounds.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; they are told apart by a 64-bit hash
of bytes and length. With N documents that have a term, L terms in all, n of one document, a document's length factor
is m = 50 + (50 n N) div L and a term that occurs tf times has the impact r = (10^9 tf) div (1000 tf + 20 m). A query's term
weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document's score is the sum of w r over the query's terms.

``build`` deals the documents out over shards of a bounded number of postings, and writes for each shard its term
dictionary, its documents (terms and impacts), and the blocks of its posting lists. A list of more than ``BLOCK``
documents is clustered: leaders are spread over the documents in order of a sign code of random projections, every
document joins the leader whose code is nearest, and large clusters are cut. A block's summary is the largest impact
of every term among its documents, in steps of 4096 rounded up (a bitmap of the terms, a byte for each). Shorter lists are one block, bounded by the list's maximum.

``search`` meets each shard with the queries. A query's lists are read from the rarest on. A list's blocks are skipped
only where the summary's bound is below the k-th best score known; once the bounds of all lists left add up to less, the
rest is skipped. Other blocks' documents are scored exactly. A few shards are searched first, and their k-th best
scores start the search of all others, so the result is exact: every document is skipped by a bound or scored.

Defined results: NULL or term-free texts have no row in any result and count nowhere; a query without terms has no
result; queries of one id are one query of all their terms; equal scores by id (NULL last); rows that repeat an id are
documents of their own; other columns play no part; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlake.llm import bytetext as bt
from textlake.llm.common import written

TOP = 50
BLOCK = 128  # documents of a block
POSTINGS = 250_000  # of a shard, about
STEP = 4096  # of a summary's maxima
MARKS = 20  # bits of a term's hash by which texts are read for the vocabulary
NO_ID = np.iinfo(np.int64).max
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
INDEX = "shard int, kind int, at int, doc_id long, ids array<int>, vals array<int>, hashes array<long>, members array<int>, present binary, top binary"
DICTIONARY, DOCUMENT, BLOCKS = 0, 1, 2


# ---- terms --------------------------------------------------------------------------------------


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every term, in order."""
    data, off = bt.raw(texts)
    data = _LOWER[data]
    starts, ends, doc = bt.spans(_INSIDE[data], off)
    return bt.hash_spans(data, starts, ends).astype(np.int64), doc


def profile(text: Column, marks: np.ndarray | None = None) -> Column:
    """Number of terms of a text, and its distinct terms with their counts; with ``marks``, those marked in it only."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_profile(part, marks) for _, part in bt.slices(texts)] or [_profile(texts, marks)]
            yield pa.concat_arrays(parts)

    return F.arrow_udf(run, "struct<n:long,terms:array<long>,tf:array<int>>")(text)


def _profile(texts: pa.Array, marks: np.ndarray | None) -> pa.StructArray:
    h, doc = terms(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    if marks is not None:
        keep = marks[h.view(np.uint64) >> np.uint64(64 - MARKS)]
        h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(h))).astype(np.int32)
    off = np.searchsorted(doc[first], np.arange(len(texts) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(v)) for v in (h[first], tf)]
    return pa.StructArray.from_arrays([pa.array(n), *lists], ["n", "terms", "tf"])


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, term: each distinct term of each query."""
    both = items.select(F.col(id_col).alias("item"), profile(F.col(text_col))["terms"].alias("terms"))
    return both.select("item", F.explode("terms").alias("term")).distinct()


# ---- index --------------------------------------------------------------------------------------


class Lists:
    """A shard in memory: documents by terms (CSR) and terms by documents (CSC)."""

    def __init__(self, hashes: np.ndarray, doc_ids: np.ndarray, ptr: np.ndarray, ids: np.ndarray, impact: np.ndarray):
        self.hashes, self.doc_ids, self.ptr, self.ids, self.impact = hashes, doc_ids, ptr, ids, impact
        doc = np.repeat(np.arange(len(doc_ids), dtype=np.int32), np.diff(ptr))
        order = np.argsort(ids, kind="stable")
        self.list_ptr = np.searchsorted(ids[order], np.arange(len(hashes) + 1))
        self.list_docs = doc[order]
        self.most = np.zeros(len(hashes), np.int64)
        np.maximum.at(self.most, ids, impact)

    def docs(self, term: int) -> np.ndarray:
        return self.list_docs[self.list_ptr[term] : self.list_ptr[term + 1]]

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries, and where each document begins among them."""
        count = self.ptr[docs + 1] - self.ptr[docs]
        begin = np.cumsum(count) - count
        return np.arange(int(count.sum())) - np.repeat(begin - self.ptr[docs], count), begin

    def codes(self, bits: int = 32, chunk: int = 4096) -> np.ndarray:
        """Signs (-1 or 1) of random projections of the documents."""
        noise = bt.mix(self.hashes.view(np.uint64) + np.uint64(17))
        signs = ((noise[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
        out = np.empty((len(self.doc_ids), bits), np.float32)
        for lo in range(0, len(out), chunk):
            docs = np.arange(lo, min(lo + chunk, len(out)))
            at, begin = self.entries(docs)
            out[docs] = np.add.reduceat(signs[self.ids[at]] * self.impact[at].astype(np.float32)[:, None], begin, axis=0)
        return np.where(out >= 0, np.float32(1), np.float32(-1))


def _blocks(docs: np.ndarray, codes: np.ndarray, block: int) -> list[np.ndarray]:
    """Cluster a list's documents by their codes; clusters of more than ``block`` are cut."""
    n = -(-len(docs) // block)
    own = codes[docs]
    order = np.lexsort(own.T)
    leaders = own[order[np.linspace(0, len(docs) - 1, n).astype(np.int64)]]
    near = np.argmax(own @ leaders.T, axis=1)
    order = np.lexsort((order.argsort(), near))
    cuts = np.flatnonzero(np.diff(near[order])) + 1
    parts = np.split(docs[order], cuts)
    return [p[i : i + block] for p in parts for i in range(0, len(p), block)]


def _index_shard(n_docs: int, n_terms: int, block: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        column = lambda c: rows.column(c).combine_chunks()
        term, tf = column("terms"), column("tf")
        ptr = np.concatenate([[0], np.cumsum(np.asarray(term.value_lengths()))]).astype(np.int64)
        hashes, ids = np.unique(np.asarray(term.flatten()), return_inverse=True)
        n = np.asarray(column("n"))
        m = 50 + (50 * n * n_docs) // n_terms
        tf = np.asarray(tf.flatten()).astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(ptr)))
        doc_ids = column("doc_id")
        lists = Lists(hashes, np.arange(len(n)), ptr, ids, impact)
        at, members, present, top = [], [], [], []
        codes = lists.codes()
        slot = np.zeros(len(hashes), np.int64)
        for t in np.flatnonzero(np.diff(lists.list_ptr) > block):
            for part in _blocks(lists.docs(t), codes, block):
                places, _ = lists.entries(part)
                slot[:] = 0
                np.maximum.at(slot, ids[places], impact[places])
                found = np.flatnonzero(slot)
                at.append(t), members.append(part)
                present.append(np.packbits(slot > 0).tobytes()), top.append((-(-slot[found] // STEP)).astype(np.uint8).tobytes())
        docs = pa.table(
            {
                "shard": pa.array(np.full(len(n), shard, np.int32)),
                "kind": pa.array(np.full(len(n), DOCUMENT, np.int32)),
                "at": pa.array(np.arange(len(n), dtype=np.int32)),
                "doc_id": doc_ids,
                "ids": pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(ids.astype(np.int32))),
                "vals": pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(impact.astype(np.int32))),
                "hashes": pa.nulls(len(n), pa.list_(pa.int64())),
                "members": pa.nulls(len(n), pa.list_(pa.int32())),
                "present": pa.nulls(len(n), pa.binary()),
                "top": pa.nulls(len(n), pa.binary()),
            }
        )
        k = len(at)
        blocks = pa.table(
            {
                "shard": pa.array(np.full(k, shard, np.int32)),
                "kind": pa.array(np.full(k, BLOCKS, np.int32)),
                "at": pa.array(np.array(at, np.int32)),
                "doc_id": pa.nulls(k, pa.int64()),
                "ids": pa.nulls(k, pa.list_(pa.int32())),
                "vals": pa.nulls(k, pa.list_(pa.int32())),
                "hashes": pa.nulls(k, pa.list_(pa.int64())),
                "members": pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(0, np.int32), *members]).astype(np.int32)),
                ),
                "present": pa.array(present, pa.binary()),
                "top": pa.array(top, pa.binary()),
            }
        )
        head = pa.table(
            {
                "shard": pa.array([shard], pa.int32()),
                "kind": pa.array([DICTIONARY], pa.int32()),
                "at": pa.array([0], pa.int32()),
                "doc_id": pa.nulls(1, pa.int64()),
                "ids": pa.nulls(1, pa.list_(pa.int32())),
                "vals": pa.nulls(1, pa.list_(pa.int32())),
                "hashes": pa.array([hashes], pa.list_(pa.int64())),
                "members": pa.nulls(1, pa.list_(pa.int32())),
                "present": pa.nulls(1, pa.binary()),
                "top": pa.nulls(1, pa.binary()),
            }
        )
        return pa.concat_tables([head, docs, blocks])

    return run


class Index:
    """An index table with the facts a search needs: N and L, number of shards, document counts of terms."""

    def __init__(self, table: DataFrame, n_docs: int, n_terms: int, shards: int, counts: DataFrame):
        self.table, self.n_docs, self.n_terms, self.shards, self.counts = table, n_docs, n_terms, shards, counts


def build(docs: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, postings: int = POSTINGS) -> Index:
    """Index all documents. With ``vocabulary`` (a column ``term`` of hashes) only its terms get posting lists.

    The texts are read for the vocabulary by 2^20 marks, whatever its size; a few other terms are listed as well.
    """
    marks = None
    if vocabulary is not None:
        marks = np.zeros(1 << MARKS, bool)  # at most 2^20 rows reach the driver
        marks[np.asarray(vocabulary.select(F.shiftrightunsigned("term", 64 - MARKS).alias("m")).distinct().toArrow().column("m"))] = True
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), profile(F.col(text_col), marks).alias("p"))
    rows = written(rows.select("doc_id", "p.*", F.monotonically_increasing_id().alias("row")), "profiles")
    sums = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 0
    shards = max(1, -(-(sums["postings"] or 0) // postings))
    counts = written(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "counts")
    dealt = rows.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    table = dealt.groupBy("shard").applyInArrow(_index_shard(n_docs, n_terms, block), INDEX)
    return Index(written(table, "index"), n_docs, n_terms, shards, counts)


# ---- search -------------------------------------------------------------------------------------


class Shard(Lists):
    """A shard read back from the index table, ready for queries."""

    def __init__(self, rows: pa.Table):
        kind = np.asarray(rows.column("kind"))
        part = lambda k: rows.filter(pa.array(kind == k))
        flat = lambda t, c: np.asarray(t.column(c).combine_chunks().flatten())
        ends = lambda t, c: np.concatenate([[0], np.cumsum(np.asarray(t.column(c).combine_chunks().value_lengths()))]).astype(np.int64)
        docs = part(DOCUMENT).sort_by("at")
        self.null_id = np.asarray(docs.column("doc_id").is_null())
        super().__init__(flat(part(DICTIONARY), "hashes"), np.asarray(docs.column("doc_id").fill_null(NO_ID)), ends(docs, "ids"), flat(docs, "ids"), flat(docs, "vals").astype(np.int64))
        blocks = part(BLOCKS).sort_by("at")
        at = np.asarray(blocks.column("at"))
        self.block_range = np.searchsorted(at, np.arange(len(self.hashes) + 1))
        self.member_ptr, self.members = ends(blocks, "members"), flat(blocks, "members")
        bits = np.frombuffer(b"".join(blocks.column("present").to_pylist()), np.uint8).reshape(len(at), -1) if len(at) else np.zeros((0, 1), np.uint8)
        row, self.top_ids = np.nonzero(np.unpackbits(bits, axis=1))
        self.top_ptr = np.searchsorted(row, np.arange(len(at) + 1))
        self.top = np.frombuffer(b"".join(blocks.column("top").to_pylist()), np.uint8).astype(np.int64)
        self.weights = np.zeros(len(self.hashes), np.int64)
        self.skipped = self.scored = 0

    def query(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (numbers, scores) of score above 0 and at least ``floor``."""
        at = np.minimum(np.searchsorted(self.hashes, terms), len(self.hashes) - 1)
        known = (self.hashes[at] == terms) & (weights > 0)
        at, weights = at[known], weights[known]
        order = np.argsort(-weights, kind="stable")
        at, weights = at[order], weights[order]
        self.weights[at] = weights
        left = np.cumsum((self.most[at] * weights)[::-1])[::-1]
        seen = np.zeros(len(self.doc_ids), bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = max(1, floor)
        for t, bound in zip(at, left):
            if bound < low:
                break
            for docs in self._candidates(t, lambda: low):
                docs = docs[~seen[docs]]
                if len(docs) == 0:
                    continue
                seen[docs] = True
                places, begin = self.entries(docs)
                got = np.add.reduceat(self.impact[places] * self.weights[self.ids[places]], begin)
                self.scored += len(docs)
                keep = got >= low
                best, score = np.concatenate([best, docs[keep]]), np.concatenate([score, got[keep]])
                if len(best) > k:
                    first = np.lexsort((self.doc_ids[best], -score))[:k]
                    best, score = best[first], score[first]
                    low = max(low, int(score[-1]))
        self.weights[at] = 0
        return best, score

    def _candidates(self, t: int, low) -> Iterator[np.ndarray]:
        """The documents of a list, without the blocks that the bound rules out; best bounds first."""
        lo, hi = self.block_range[t], self.block_range[t + 1]
        if lo == hi:
            yield self.docs(t)
            return
        a, b = self.top_ptr[lo], self.top_ptr[hi]
        bounds = STEP * np.add.reduceat(self.top[a:b] * self.weights[self.top_ids[a:b]], self.top_ptr[lo:hi] - a)
        order = np.argsort(-bounds, kind="stable")
        for i in range(0, len(order), 4):
            open_ = [j for j in order[i : i + 4] if bounds[j] >= low()]
            self.skipped += len(order[i : i + 4]) - len(open_)
            if open_:
                yield np.concatenate([self.members[self.member_ptr[lo + j] : self.member_ptr[lo + j + 1]] for j in open_])


def _search_shard(k: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        nothing = index.num_rows == 0 or asked.num_rows == 0
        shard = None if nothing else Shard(index)
        who, ids, null, scores = [], [], [], []
        for i in range(0 if nothing else asked.num_rows):
            terms, weights = (np.asarray(asked.column(c)[i].values) for c in ("terms", "weights"))
            best, score = shard.query(terms, weights, asked.column("floor")[i].as_py(), k)
            who.append(np.full(len(best), i)), ids.append(shard.doc_ids[best]), null.append(shard.null_id[best]), scores.append(score)
        join = lambda v, kind: np.concatenate(v).astype(kind) if v else np.zeros(0, kind)
        item = asked.column("item").take(pa.array(join(who, np.int64)))
        return pa.table({"item": item, "doc_id": pa.array(join(ids, np.int64), mask=join(null, bool)), "score": pa.array(join(scores, np.int64))})

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = TOP, first: int = 16) -> DataFrame:
    """``queries`` (item, term) to item, rank, doc_id, score: the k best documents of each.

    Queries travel to the shards (their terms and weights only); of a shard at most k documents per query come back.
    One shard in ``first`` is searched before the others.
    """
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asked = queries.join(index.counts, "term").select("item", F.struct("term", weight.alias("w")).alias("t"))
    asked = asked.groupBy("item").agg(F.array_sort(F.collect_list("t")).alias("t"))
    asked = written(asked.select("item", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), F.lit(0).cast("long").alias("floor")), "asked")
    kind = queries.schema["item"].dataType.simpleString()
    head = -(-index.shards // first)

    def over(lo: int, hi: int, rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        shards = index.table.where((F.col("shard") >= lo) & (F.col("shard") < hi))
        found = shards.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(_search_shard(k), f"item {kind}, doc_id long, score long")
        return written(found, name)

    hits = over(0, head, asked, "first_hits")
    if head < index.shards:
        floors = _best(hits, k).where(F.col("rank") == k).select(F.col("item").alias("of"), F.col("score").alias("least"))
        raised = asked.join(floors, F.col("item").eqNullSafe(F.col("of")), "left").withColumn("floor", F.coalesce("least", "floor")).drop("of", "least")
        hits = hits.unionByName(over(head, index.shards, raised, "hits"))
    return _best(hits, k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", **index) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score. The index covers the items' terms."""
    asked = written(query_terms(items, item_id, item_text), "query_terms")
    found = search(build(docs, asked, doc_id, doc_text, **index), asked, k)
    return found.withColumnRenamed("item", "item_id")
