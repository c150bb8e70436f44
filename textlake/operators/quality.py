"""Data-quality checks that return the violations as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from textlake.sinks import materialize


class QualityError(ValueError):
    """A check that must hold did not."""


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def null_violations(df: DataFrame, cols) -> DataFrame:
    """One row per column that holds NULLs, with their count; one pass over the data."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n")) for i, c in enumerate(cols)])
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    return counted.select(F.inline(pairs)).where(F.col("n") > 0)


def bound_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per row and failed rule; a rule that is NULL counts as failed."""
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda x: x.isNotNull(),
    )
    return df.withColumn("rule", F.explode(failed))


def observed(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df`` with counts that are taken while it is written or read, and a call that gives them once that is done.

    Put it last before the write, so that a retried task counts once.
    """
    watch = Observation()
    names = list(counts)
    seen = df.observe(watch, *[counts[n].alias(n) for n in names])

    def get() -> dict[str, int]:
        found = watch.get  # nothing is observed where the optimizer knows that there are no rows
        return {n: found.get(n) or 0 for n in names}

    return seen, get


def write_checked(df: DataFrame, path: str, not_null=(), rules: dict[str, Column] | None = None, unique: str | None = None, message: str = "no rows") -> tuple[DataFrame, DataFrame]:
    """Write ``df`` and check it in the same pass: ``(table, report)``, the report as (check, column, n).

    NULLs per column and failed rules (a rule that is NULL counts as failed) come from the writing tasks; only a
    ``unique`` key takes a pass of its own, over that column of the written table. A result without rows is an error:
    nothing stays at ``path`` then.
    """
    spark, rules = df.sparkSession, rules or {}
    counts = {"rows": F.count(F.lit(1))}
    counts |= {f"null {c}": F.count_if(F.col(c).isNull()) for c in not_null}
    counts |= {f"rule {name}": F.count_if(~F.coalesce(ok, F.lit(False))) for name, ok in rules.items()}
    seen, get = observed(df, counts)
    table = materialize(seen, path)
    found = get()
    if not found["rows"]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        raise QualityError(message)
    lines = [("rows", None, found["rows"])] + [(*name.split(" ", 1), n) for name, n in found.items() if name != "rows"]
    report = spark.createDataFrame(lines, "check string, column string, n long")
    if unique:
        twice = unique_violations(table, unique).agg(F.lit("unique").alias("check"), F.lit(unique).alias("column"), F.count("*").alias("n"))
        report = report.unionByName(twice)
    return table, report


def require_rows(df: DataFrame, message: str = "no rows") -> DataFrame:
    """Raise unless ``df`` has a row."""
    if df.isEmpty():
        raise QualityError(message)
    return df


def require_unique(df: DataFrame, key: str) -> DataFrame:
    hits = unique_violations(df, key).limit(5).collect()
    if hits:
        raise QualityError(f"duplicate {key}: {[r[0] for r in hits]}")
    return df
