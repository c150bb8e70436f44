"""Connected components of a link table by alternating large-star and small-star steps.

A node with many links never meets in one task as a group: every step is an aggregation (one row per node and task)
and an equi-join, which adaptive execution can split. Only the number of links that changed reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlake.llm.common import written


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to one row per node: node, root (smallest node that it is linked with, directly or not)."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # large star: the larger neighbours of a node move to its smallest neighbour
        pairs = _both(links)
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = pairs.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), "links")
        if new.join(links, ["a", "b"], "left_anti").isEmpty() and links.join(new, ["a", "b"], "left_anti").isEmpty():
            break
        links = new
    # every link now leads to the root of its component
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
