"""Near duplicates among embeddings: binary codes of randomly rotated vectors decide which pairs are computed exactly.

A unit vector o is turned by random orthonormal columns into ``bits`` numbers; their signs, scaled, are the code x,
and <x, o> is stored with it. <x, q> / <x, o> estimates <o, q> without bias for any q, with a standard error of
sqrt((1 - <x, o>^2) / <x, o>^2 / (bits - 1)); a pair is computed exactly, in double precision, unless its estimate
lies six standard errors below the threshold. No pair is accepted on an estimate.

All pairs of a group (label and dimension) meet as long as no group has more than ``BUCKET`` distinct vectors: then no
link is lost. Beyond, pairs are looked for in buckets of about that size: further rotations give every vector one key per
table, and vectors meet where a key is equal. Key length follows the size of the largest group, and the number of tables
follows from it, so that a pair exactly at the threshold is missed with probability ``miss`` at every size (closer
pairs far less). Equal vectors are one class before that. Buckets are compared in blocks; tasks return counts per vector
and the links that join components, never pairs.

Defined results: a NULL label, or a vector that is NULL, empty, zero or has NULL, NaN or infinite components, links with
nothing; vectors of different dimensions do not link; rows that repeat an id are vectors of their own; other columns
of the input, whatever their names, play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlake.llm.common import written
from textlake.llm.components import connected

THRESHOLD = 0.93
MISS = 1e-9
BUCKET = 65_536  # members of a bucket, about, if vectors lie evenly
BLOCK = 4096
CHUNK = 256  # rows of a block whose estimates are held at a time
SIGMAS = 6.0


def tables_for(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for a largest group of so many vectors."""
    same = 1 - math.acos(threshold) / math.pi  # of one bit of two vectors at the threshold
    bits = max(0, math.ceil(math.log2(max(1, largest) / BUCKET)))
    if bits == 0:  # one bucket: the whole group
        return 0, 1
    return bits, math.ceil(math.log(miss) / math.log(1 - same**bits))


@functools.lru_cache(8)
def rotation(dim: int, columns: int, seed: int) -> np.ndarray:
    """``columns`` random directions (dim x columns), orthonormal in runs of ``dim``, or rows orthonormal if one run holds all."""
    rng = np.random.default_rng([seed, dim, columns])
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-columns // dim))]
    return np.concatenate(runs, axis=1)[:, :columns].astype(np.float32)


def code_frame(dim: int, seed: int) -> np.ndarray:
    """Orthonormal columns from dim to ``bits`` dimensions, as dim x bits."""
    return _frame(dim, max(256, -(-dim // 8) * 8), seed)


@functools.lru_cache(8)
def _frame(dim: int, bits: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, dim, bits, 1])
    return np.linalg.qr(rng.standard_normal((bits, dim)))[0].T.astype(np.float32)


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x bits / 8 bytes) and the stored products <x, o> of unit vectors."""
    turned = unit.astype(np.float32) @ code_frame(unit.shape[1], seed)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, factor: np.ndarray, unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (vectors coded x unit vectors) and the standard error of each coded vector."""
    frame = code_frame(unit.shape[1], seed)
    signs = np.unpackbits(codes, axis=1, count=frame.shape[1]).astype(np.float32) * 2 - 1
    found = signs @ (unit.astype(np.float32) @ frame).T / np.sqrt(frame.shape[1]) / factor[:, None]
    return found, np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(frame.shape[1] - 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _coder(bits: int, tables: int, seed: int):
    power = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            keys, codes, factors = [None] * len(rows), [None] * len(rows), [None] * len(rows)
            size = np.asarray(rows.value_lengths())
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                unit = _unit(np.asarray(rows.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), dim))
                found = np.zeros((len(at), tables), np.int64)
                if bits:
                    side = (unit.astype(np.float32) @ rotation(int(dim), bits * tables, seed) >= 0).reshape(len(at), tables, bits)
                    found = (side * power).sum(axis=2)
                code, factor = encode(unit, seed)
                for k, i in enumerate(at):
                    keys[i], codes[i], factors[i] = found[k], code[k].tobytes(), float(factor[k])
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.float64()]
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((keys, codes, factors), kinds)], ["keys", "code", "factor"])

    return F.arrow_udf(run, "struct<keys:array<bigint>,code:binary,factor:double>")


def _compare(threshold: float, seed: int):
    """Compare a block of a bucket with itself or another: (node, links, root) of nodes that have links."""
    schema = pa.schema([(name, pa.int64()) for name in ("node", "links", "root")])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node").combine_chunks()
        n, table = rows.num_rows, rows["table"][0].as_py()
        flat = lambda name: np.asarray(rows[name].combine_chunks().flatten()).reshape(n, -1)
        node, side, copies = (rows[c].to_numpy() for c in ("node", "side", "copies"))
        unit = _unit(flat("vector").astype(np.float64))
        keys = flat("keys")[:, :table]
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(n, -1)
        factor = rows["factor"].to_numpy()
        one, two = rows["i"][0].as_py(), rows["j"][0].as_py()
        first, second = np.flatnonzero(side == one), np.flatnonzero(side == two)
        links, root = np.zeros(n, np.int64), np.arange(n)
        for lo in range(0, len(first), CHUNK):
            some = first[lo : lo + CHUNK]
            open_ = _open(codes, factor, unit, some, second, threshold, seed)
            if one == two:
                open_ &= second[None, :] > some[:, None]
            a, b = np.nonzero(open_)
            for k in range(0, len(a), 1 << 16):
                i, j = some[a[k : k + (1 << 16)]], second[b[k : k + (1 << 16)]]
                new = ~(keys[i] == keys[j]).any(axis=1)  # not met in an earlier table
                i, j = i[new], j[new]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[near], j[near]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                _join(root, i, j)
        found = np.flatnonzero(links)
        return pa.table([node[found], links[found], node[root[found]]], schema=schema) if len(found) else schema.empty_table()

    return run


def _open(codes, factor, unit, a: np.ndarray, b: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """Pairs (a x b) that the estimates, each from either side's code, leave open."""
    one, error = estimate(codes[a], factor[a], unit[b], seed)
    open_ = one + SIGMAS * error[:, None] >= threshold
    other, error = estimate(codes[b], factor[b], unit[a], seed)
    return open_ | (other + SIGMAS * error[:, None] >= threshold).T


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of linked rows; ``root`` leads every row to the smallest of its component."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root[:] = root[root]


def duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", threshold: float = THRESHOLD, miss: float = MISS, seed: int = 11) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    v = F.col("vector")
    usable = F.col("grp").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(group_col).alias("grp"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), v))
    rows = rows.withColumns({"h1": F.when(v.isNotNull(), F.xxhash64(F.lit(1), v)), "h2": F.when(v.isNotNull(), F.xxhash64(F.lit(2), v))})
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    same = rows.where("vector IS NOT NULL").groupBy("grp", "h1", "h2", "vector").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min("row").alias("node")
    )
    same = written(same, "classes")
    largest = same.groupBy("grp", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, miss)
    coded = written(
        same.select("node", "grp", "copies", "vector", _coder(bits, tables, seed)("vector").alias("c")).select("node", "grp", "copies", "vector", "c.*"), "codes"
    )
    found = _tasks(coded).groupBy("grp", "dim", "table", "key", "i", "j").applyInArrow(_compare(threshold, seed), "node long, links long, root long")
    found = written(found, "links")
    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = same.join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").where("copies > 1 OR links > 0").select(
        "grp", "h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = rows.drop("vector").join(placed, ["grp", "h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tasks(coded: DataFrame) -> DataFrame:
    """Members of shared buckets, dealt to pairs of blocks."""
    bands = coded.select("node", "grp", F.size("vector").alias("dim"), F.posexplode("keys").alias("table", "key"))
    buckets = bands.groupBy("grp", "dim", "table", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = bands.join(buckets, ["grp", "dim", "table", "key"]).withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "dim", "table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"))
    return met.join(coded, "node")
