"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from textlake.operators.relational import BITMAP_BITS, key_bitmap, maybe_among
from textlake.session import scratch_path

BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]+"


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and read back if an executor is lost.

    Rows of a table written this way keep their values (ids made by a function included) however often it is read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", most_rows: int = 100_000) -> DataFrame:
    """Equi-join (inner, left_semi or left) with a table that is usually small: counted first and broadcast up to ``most_rows``.

    A larger one is joined by sort-merge, which adaptive execution splits at hot keys. Before that a bitmap of its keys
    (16 bits each, 16 MB at most) is looked up in the scan of ``df``: rows whose key is surely absent are not shuffled;
    a left join passes them on from a second scan. ``small`` should be cheap to read several times (written to a
    table) and of narrow rows: keys, digests, ids. All forms give the same rows.
    """
    if small.limit(most_rows + 1).count() <= most_rows:
        return df.join(F.broadcast(small), on, how)
    hashed, maybe = fresh("hash"), fresh("maybe")
    keys = small.select(F.xxhash64(*[F.col(c).cast(df.schema[c].dataType) for c in on]).alias(hashed))
    bits = min(BITMAP_BITS, 1 << max(15, (16 * small.count()).bit_length()))
    marked = maybe_among(df.withColumn(hashed, F.xxhash64(*on)), hashed, key_bitmap(keys, hashed, bits), bits, maybe).drop(hashed)
    met = marked.where(maybe).drop(maybe).join(small.hint("merge"), on, how)
    if how != "left":
        return met
    return met.unionByName(marked.where(~F.col(maybe)).drop(maybe), allowMissingColumns=True)


def share(*values: Column) -> Column:
    """A number in [0, 1) that depends on the values only: 52 bits of an MD5, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("\0")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
