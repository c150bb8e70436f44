"""Counts, histograms and top-n reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlake.functions.scalars import _col, weighted_score

# fixed values: upper bounds of the popularity histogram; the first bucket also holds its lower end
POPULARITY_EDGES = (0, 10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000, 500000)
PRICE_PER_1K_TOKENS = 0.0001


def catalog_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def origin_counts(df: DataFrame, key: str, known: DataFrame, known_key: str | None = None) -> DataFrame:
    """How many rows have their key in ``known`` and how many do not; NULL keys count in neither."""
    marks = known.select(F.col(known_key or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    flagged = df.select(key).join(marks.withColumn("_in", F.lit(True)), key, "left")
    return flagged.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_in").isNotNull()).alias("from_first"),
        F.count_if(F.col("_in").isNull() & F.col(key).isNotNull()).alias("from_other"),
    )


def range_histogram(df: DataFrame, col: str, edges=POPULARITY_EDGES, wide: bool = True) -> DataFrame:
    """Counts per half-open range ``(lo, hi]``, the first one closed, in one pass.

    Values above the last edge, below the first, or NULL are not counted.
    """
    c = F.col(col)
    ranges = list(zip(edges[:-1], edges[1:]))
    named = [f"in_range_{lo}_{hi}" for lo, hi in ranges]
    cells = [
        F.count_if(((c >= lo) if i == 0 else (c > lo)) & (c <= hi)).alias(name)
        for i, ((lo, hi), name) in enumerate(zip(ranges, named))
    ]
    counted = df.agg(*cells)
    if wide:
        return counted
    rows = F.array(
        *[
            F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(name).alias("n"))
            for (lo, hi), name in zip(ranges, named)
        ]
    )
    return counted.select(F.inline(rows))


def top_groups(df: DataFrame, c, n: int = 5, name: str = "grp") -> DataFrame:
    """Row counts of the ``n`` largest group values."""
    return df.groupBy(_col(c).alias(name)).agg(F.count("*").alias("n")).orderBy(F.col(name).desc()).limit(n)


def token_count(c) -> Column:
    """Word-like tokens: runs of word characters or single other symbols."""
    return F.regexp_count(_col(c), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))


def token_cost(df: DataFrame, text: str, tokenizer=token_count, price_per_1k: float = PRICE_PER_1K_TOKENS) -> DataFrame:
    """Total tokens and estimated price. ``tokenizer`` maps a text column to a count column."""
    total = F.coalesce(F.sum(tokenizer(F.col(text)).cast("bigint")), F.lit(0))
    return df.agg(total.alias("tokens")).withColumn("est_price", F.col("tokens") * price_per_1k / 1000)


def weighted_top(df: DataFrame, rating: str, votes: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows with the highest ``rating * log10(votes)``; ``tie`` orders equal scores."""
    return df.orderBy(weighted_score(rating, votes).desc_nulls_last(), F.col(tie)).limit(n)


def resolve_k(c, default: int = 20, lo: int = 1, hi: int = 200) -> Column:
    """NULL becomes ``default``; other values are clamped to ``lo..hi``."""
    return F.least(F.greatest(F.coalesce(_col(c), F.lit(default)), F.lit(lo)), F.lit(hi))
