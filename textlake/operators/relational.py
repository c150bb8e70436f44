"""Joins, set operations and reconciliation of several sources."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textlake.sinks import new_version


BITMAP_BITS = 1 << 27  # at most, of a key bitmap: 16 MB
_PAGE = 32_768  # bits of one bitmap row, by Spark's bitmap functions


def key_bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The hashed keys as a bitmap of ``bits`` bits, in rows ``(page, bitmap)`` of 4 KB: a Bloom filter of one hash."""
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def maybe_among(df: DataFrame, key: str, bitmap: DataFrame, bits: int, name: str = "_maybe") -> DataFrame:
    """Add ``name``: false where the key is surely none of the bitmap's. The bitmap is broadcast, ``bits`` / 8 bytes at most."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    probed = df.withColumn("page", F.floor(place / _PAGE).cast("bigint") + 1).join(F.broadcast(bitmap), "page", "left")
    at = (place % _PAGE).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return probed.withColumn(name, F.coalesce(bit, F.lit(False)) & F.col(key).isNotNull()).drop("page", "bitmap")


def not_covered(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None, prefilter: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other``; a NULL in ``other`` covers nothing.

    The keys are made distinct, which needs the same shuffle as the join and keeps a frequent key of
    ``other`` from filling one task. With ``prefilter``, for a ``df`` of wide rows most of which are not covered, a bitmap of
    the keys (16 bits each, ``BITMAP_BITS`` at most) lets rows that are surely absent pass in their scan; only the
    others are shuffled. That scans ``df`` twice, and the keys are written first.
    """
    keys = other.select(F.col(other_key or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    if not prefilter:
        return df.join(keys, key, "left_anti")
    spark, kind = df.sparkSession, df.schema[key].dataType
    keys = keys.select(F.col(key).cast(kind).alias(key))  # one type, one hash
    keys = spark.read.schema(keys.schema).parquet(new_version(keys, "keys"))
    bits = min(BITMAP_BITS, max(_PAGE, 1 << (16 * keys.count()).bit_length()))
    marked = maybe_among(df, key, key_bitmap(keys, key, bits), bits)
    surely = marked.where(~F.col("_maybe")).drop("_maybe")
    return surely.unionByName(marked.where("_maybe").drop("_maybe").join(keys, key, "left_anti")).select(*df.columns)


def either_join(
    left: DataFrame,
    right: DataFrame,
    primary: tuple[Column, Column],
    fallback: list[tuple[Column, Column]],
    keep_left=None,
    keep_right=None,
) -> DataFrame:
    """Inner join on ``primary`` keys OR all ``fallback`` keys, each matching pair once.

    An OR in a join condition forces all pairs to be compared. Here each side of the OR is an
    equi-join of its own, and the second one drops the pairs the first one has.
    """
    named_l = {f"_l{i}": l for i, (l, _) in enumerate([primary, *fallback])}
    named_r = {f"_r{i}": r for i, (_, r) in enumerate([primary, *fallback])}
    keep_left, keep_right = keep_left or left.columns, keep_right or right.columns
    clash = set(keep_left) & set(keep_right)
    if clash:
        raise ValueError(f"rename the columns both sides have: {sorted(clash)}")
    lhs = left.withColumns(named_l).select(*keep_left, *named_l)
    rhs = right.withColumns(named_r).select(*keep_right, *named_r)
    first = F.col("_l0") == F.col("_r0")
    second = functools.reduce(
        lambda a, b: a & b, [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(1, len(fallback) + 1)]
    )
    by_first = lhs.join(rhs, first)
    by_second = lhs.join(rhs, second & ~F.coalesce(first, F.lit(False)))
    return by_first.unionByName(by_second).select(*keep_left, *keep_right)


def either_matched(left: DataFrame, right: DataFrame, primary: tuple[Column, Column], fallback: list[tuple[Column, Column]]) -> DataFrame:
    """Rows of ``left`` that ``either_join`` pairs with some row of ``right``; the pairs are not made."""
    both = [primary, *fallback]
    names = [f"_k{i}" for i in range(len(both))]
    marked = left.withColumns({n: l for n, (l, _) in zip(names, both)})
    known = right.select(*[r.alias(n) for n, (_, r) in zip(names, both)])
    for n, on in enumerate(([names[0]], names[1:])):
        marked = marked.join(known.select(*on, F.lit(True).alias(f"_m{n}")).dropna().distinct(), on, "left")
    return marked.where("_m0 OR _m1").select(*left.columns)


def coalesce_sources(
    sources: list[DataFrame | Callable[[list[DataFrame]], DataFrame]],
    key: str,
    stage: bool = False,
    keys: list[DataFrame | None] | None = None,
) -> DataFrame:
    """Rows of the first source, then rows of each later one whose key no earlier source has.

    Each source is needed twice: for its rows and for its keys. ``keys`` may give a cheaper table of a source's keys.
    ``stage`` writes a source first, so that the second use reads the key column of a file instead of computing
    the source again. A source given as a function gets the key tables of the earlier ones and leaves out their keys
    itself: before it attaches wide columns, which then are not shuffled for it.
    """
    keys = keys or [None] * len(sources)
    taken: list[DataFrame] = []
    covers: list[DataFrame] = []
    for source, own in zip(sources, keys):
        if callable(source):
            source = source(list(covers))
        else:
            for earlier in covers:
                source = not_covered(source, earlier, key)
        if stage and own is None and len(taken) < len(sources) - 1:
            source = source.sparkSession.read.parquet(new_version(source, "source"))
        taken.append(source)
        covers.append((source if own is None else own).select(key))
    return functools.reduce(DataFrame.unionByName, taken)


def resolve_id_list(
    df: DataFrame, list_col: str, names: DataFrame, id_col: str, name_col: str, out: str = "names"
) -> DataFrame:
    """Replace a comma list of ids by a comma list of names, in list order, row by row.

    Ids without a name vanish; a list without any name gives NULL. Output: all columns of ``df``
    with ``list_col`` replaced by ``out``. Each distinct list is resolved once, so rows need no key, and
    a list that many rows share does not multiply.
    """
    lists = df.where(F.col(list_col).isNotNull()).groupBy(F.col(list_col).alias("_list")).agg(F.count("*").alias("_n"))
    ids = lists.select("_list", F.posexplode(F.split("_list", ",")).alias("_pos", "_id"))
    named = ids.join(names.select(F.col(id_col).alias("_id"), F.col(name_col).alias("_name")), "_id")
    found = named.groupBy("_list").agg(F.sort_array(F.collect_list(F.struct("_pos", "_name"))).alias("_found"))
    found = found.select("_list", F.array_join(F.col("_found._name"), ",").alias(out))
    return df.join(found, F.col(list_col) == F.col("_list"), "left").drop("_list", list_col)
