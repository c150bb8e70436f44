"""Incremental folder ingestion: new CSV files become keyed upserts, exactly once.

A micro-batch binds the columns of its files by name and writes its rows to a folder of its own, named by the query
and the batch, so a retried batch overwrites itself and a query that lost its checkpoint overwrites nothing. Of the
rows of a key the one from the latest file counts, whichever batch brought it, so reading files again changes
nothing. ``compact`` replaces the history by one table, from which later reads start. The cost of a batch is that
of its new files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from textlake.operators.merge import dedup
from textlake.sources.files import read_csv_by_name

_CORRUPT, _FILE, _TIME = "_corrupt", "_file", "_modified"
STATUS = "file string, status string, reason string, good_rows bigint, bad_rows bigint"


def _write_batch(schema: T.StructType, key: str, target: str, quarantine: str, status: str | None, multi_line: bool):
    names = schema.names

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        place = f"run={query}/batch={batch_id}"
        files = [r["path"] for r in batch.select("path").collect()]  # at most max_files
        if not files:
            return
        rows, unbound = read_csv_by_name(spark, files, schema, multi_line, _CORRUPT)
        if rows is None:
            rows = spark.createDataFrame([], T.StructType([*schema, T.StructField(_CORRUPT, T.StringType()), T.StructField(_FILE, T.StringType()), T.StructField(_TIME, T.TimestampType())]))
        rows = rows.persist()
        fits = F.col(_CORRUPT).isNull() & F.col(key).isNotNull()
        left_out = rows.where(~fits).select(F.col(_FILE).alias("file"), F.col(_CORRUPT).alias("record"))
        whole = spark.createDataFrame([(f, None) for f in sorted(unbound)], "file string, record string")
        left_out.unionByName(whole).write.mode("overwrite").parquet(f"{quarantine}/{place}")
        # of two files with a key the later one counts; within a file duplicates collapse first
        fresh = dedup(rows.where(fits), key, [_TIME, _FILE], keep="last").select(*names, _TIME, _FILE)
        fresh.write.mode("overwrite").parquet(f"{target}/{place}")
        if status:
            counted = rows.groupBy(F.col(_FILE).alias("file")).agg(F.count_if(fits).alias("good_rows"), F.count_if(~fits).alias("bad_rows"))
            known = spark.createDataFrame([(f, unbound.get(f)) for f in sorted({*files, *unbound})], "file string, reason string")
            known = known.join(counted, "file", "left").na.fill(0, ["good_rows", "bad_rows"])
            state = F.when(F.col("reason").isNotNull(), "bad").when(F.col("good_rows") > 0, "imported").when(F.col("bad_rows") > 0, "failed").otherwise("empty")
            known.select("file", state.alias("status"), "reason", "good_rows", "bad_rows").write.mode("overwrite").parquet(f"{status}/{place}")
        rows.unpersist()

    return write


def ingest_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    key: str,
    target: str,
    quarantine: str,
    checkpoint: str,
    max_files: int = 1000,
    status: str | None = None,
    multi_line: bool = True,
) -> None:
    """Load the CSV files that arrived since the last run, then stop.

    ``checkpoint`` remembers which files were read. Rows that do not fit ``schema`` or lack the key go
    to ``quarantine`` with their file's path; a file whose header does not bind goes there as a whole, without records. ``status`` gets one
    row per file: imported, failed (no row fits), empty or bad (with the reason).
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"))
    )
    query = (
        stream.writeStream.foreachBatch(_write_batch(schema, key, target, quarantine, status, multi_line))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _history(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    kept = T.StructType([*schema, T.StructField(_TIME, T.TimestampType()), T.StructField(_FILE, T.StringType())])
    return spark.read.schema(kept).option("recursiveFileLookup", True).parquet(target)


def _latest(history: DataFrame, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(_TIME).desc(), F.col(_FILE).desc()))
    return history.withColumn("_rn", rank).where(F.col("_rn") == 1).drop("_rn")


def read_merged(spark: SparkSession, target: str, schema: T.StructType, key: str) -> DataFrame:
    """The table as of the last batch: per key the row of the latest file."""
    return _latest(_history(spark, target, schema), key).select(*schema.names)


def compact(spark: SparkSession, target: str, schema: T.StructType, key: str) -> DataFrame:
    """Replace the history below ``target`` by the merged table; later batches add to it.

    The new table is written before the folders it stands for are removed. A reader that meets both, also after a
    failure in between, sees the same rows. Run it while no batch is being written.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    system = root.getFileSystem(conf)
    old = [f.getPath() for f in system.listStatus(root)]
    _latest(_history(spark, target, schema), key).write.parquet(f"{target}/run=compact-{uuid.uuid4().hex}/batch=0")
    for path in old:
        system.delete(path, True)
    return read_merged(spark, target, schema, key)
