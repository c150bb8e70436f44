"""Mixing sources to target weights.

Tokens (words, or any size column) are added up per source; from the weights each source gets a target; target / size
is the source's repetition rate, and a document is taken floor(rate) times plus once more with the probability of the
fraction, decided by a hash of its id and a seed. Only DataFrame functions run.

Defined results: a NULL text has size 0; a NULL source is a source of its own and comes last; sources of size 0 get
target 0 and rate 0; rows that share id and text are decided alike, and each counts; an empty table gives an empty
table; a second run gives the same rows. Columns of the input are kept by ``mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlake.llm.common import NOT_BLANK, fresh, join_small, share, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_BLANK)), F.lit(0)).cast("long")


def cycled_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Give the sources, by code point with NULL last, the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return sizes.withColumn("weight", given)


def targets(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """Add ``target``: budget x all sizes, shared by weight; a target stops at cap x size, the excess is shared again.

    The end of that resharing is a level L with target = min(cap x size, L x weight). Sources are put in the order
    of cap x size / weight; those before the first one that L of the rest does not fill are at their cap. One row per
    source: the windows run over as many rows as there are sources, which aggregation has already made small.
    """
    s = sizes.withColumn("full", F.lit(float(cap)) * F.col("source_size")).withColumn(
        "fills_at", F.when(F.col("weight") > 0, F.col("full") / F.col("weight")).otherwise(F.lit(float("inf")))
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_place", F.row_number().over(order))
        .withColumn("_budget", F.lit(float(budget)) * F.sum("source_size").over(everything))
        .withColumn("_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("_level", F.when(F.col("_left") > 0, F.greatest(F.lit(0.0), F.col("_budget") - F.col("_used")) / F.col("_left")))
    )
    # at the first source not filled, the level of the rest is final
    level = F.min(F.when(F.col("fills_at") >= F.col("_level"), F.struct("_place", "_level"))).over(everything)
    s = s.withColumn("_final", level.getField("_level"))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("full"), F.coalesce(F.col("_final") * F.col("weight"), F.col("full")))
    )
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", weigh=cycled_weights, budget: float = BUDGET, cap: float = CAP, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, taken (copies x size)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (word_count(F.col(text_col)) if size is None else size).alias("size"))
    return _planned(rows, weigh, budget, cap, seed).select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _planned(rows: DataFrame, weigh, budget: float, cap: float, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size, more) with source_size, target, rate and copies.

    The aggregation sends one row per source and task. Documents are never shuffled by source: the per-source table
    is broadcast after a count of its rows.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = written(targets(weigh(sizes), budget, cap), "sources").withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    both = join_small(rows, known.select("_key", "source_size", "target"), ["_key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = both.withColumn("rate", rate)
    once_more = (share(F.col("doc_id"), F.lit(seed)) < F.col("rate") - F.floor("rate")).cast("long")
    return both.withColumn("copies", F.floor("rate").cast("long") + once_more).drop("_key")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weigh=cycled_weights, budget: float = BUDGET, cap: float = CAP, seed: int = 7) -> DataFrame:
    """The mixture itself: every document as many times as the plan says, with the columns it came with."""
    whole = fresh("row")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.struct("*").alias(whole))
    taken = _planned(rows, weigh, budget, cap, seed).where(F.col("copies") > 0)
    return taken.select(whole, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(f"{whole}.*")
