"""Table and file writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textlake.session import scratch_path


def materialize(df: DataFrame, path: str, partition_by=None) -> DataFrame:
    """Write a full rebuild of a table and return it read back.

    Spark refuses a ``path`` that ``df`` itself reads; use ``new_version`` for such a table.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def new_version(df: DataFrame, name: str = "table") -> str:
    """Write ``df`` to a fresh folder below the shared one and return its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def export_catalog(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _array_cols(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns are written as JSON text."""
    flat = df.withColumns({c: F.to_json(c) for c in _array_cols(df.schema)})
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back what ``export_csv`` wrote."""
    arrays = _array_cols(schema)
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in arrays else f.dataType) for f in schema])
    raw = (
        spark.read.schema(flat)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return raw.withColumns({c: F.from_json(c, schema[c].dataType) for c in arrays})
