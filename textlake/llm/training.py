"""Labelled rows for fitting, and the split by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 4000
MAX_CHARS = 30_000


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> DataFrame:
    """A bounded sample for fitting: label and text of at most ``sample`` labelled documents of at most ``max_chars``.

    The rows come in the order of a hash of the id, so the sample is spread over the table and reruns agree. Ids with a
    NULL or contradictory label are left out. Labels are used here and nowhere else.
    """
    known = labels.where(F.col(label).isNotNull() & keep).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("other"))
    known = known.where("y = other").select("id", "y")
    short = docs.where(F.coalesce(F.char_length(text_col), F.lit(0)) <= max_chars).select(F.col(id_col).alias("id"))
    picked = known.join(short.distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.char_length("text"), F.lit(0)) <= max_chars)
    # at most ``sample`` ids and labels
    return rows.join(F.broadcast(picked), "id").dropDuplicates(["id"])
