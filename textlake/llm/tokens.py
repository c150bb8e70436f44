"""Token counts of documents in flat token files, by a vectorised search for separators.

A token file holds unsigned integers without an index; a separator id ends each document. Files are cut into blocks of
equal size whatever documents they cut through. A task reads its block's byte range and finds the separators with one
vectorised comparison. A prefix scan over the blocks of a file (separators before the block, place of the last one)
stitches documents that cross block borders. Only narrow block rows are scanned in order; documents are not.

Defined results: an empty document counts 0; tokens after a file's last separator are a document with ``ended`` false;
an empty file has no documents; a missing file or one whose size is no multiple of the token size is an error; repeated
paths are read once; a token id that the type cannot hold, or that is the separator, is an error; a NULL text writes an empty document; other columns play no part; an empty table writes no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlake.llm.common import written
from textlake.session import scratch_path

BLOCK_TOKENS = 1 << 20
SEPARATOR = 50256


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Encode the texts into flat files in the shared folder, one per task: path, ordinal, doc_id of every document.

    The returned table is written first, so it names the files of the attempts that succeeded and no others.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    most = np.iinfo(dtype).max
    if not 0 <= separator <= most:
        raise ValueError(f"the separator {separator} does not fit {dtype}")
    end = np.array([separator], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer.value.build()
        path, out, ordinal = f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                system, place = _open(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
            for text in batch.column("text"):
                ids = np.frombuffer(t.encode(text.as_py()), "<u4")
                if len(ids) and ids.max() > most:
                    raise ValueError(f"token id {ids.max()} does not fit {dtype}")
                if (ids == separator).any():
                    raise ValueError(f"the separator {separator} is a token id")
                out.write(ids.astype(dtype).tobytes() + end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id")], ["path", "ordinal", "doc_id"]
            )
            ordinal += n
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"path string, ordinal long, doc_id {kind}"), "manifest")


def file_sizes(path: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for paths in batches:
            sizes = []
            for p in paths.to_pylist():
                system, place = _open(p)
                info = system.get_file_info(place)
                if not info.is_file:
                    raise FileNotFoundError(p)
                sizes.append(info.size)
            yield pa.array(sizes, pa.int64())

    return F.arrow_udf(run, "bigint")(path)


def count_tokens(files: DataFrame, path_col: str = "path", separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the token files: path, ordinal (place in its file), n_tokens, ended."""
    spark = files.sparkSession
    width = np.dtype(dtype).itemsize
    sized = files.select(F.col(path_col).alias("path")).distinct().withColumn("bytes", file_sizes(F.col("path")))
    sized = written(sized, "files")
    span = block_tokens * width
    blocks = sized.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / span))).alias("block"))
    # one task for some blocks of any files: a large file is read by many
    blocks = blocks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block")

    def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for paths, sizes, numbers in batches:
            out = []
            for path, size, block in zip(paths.to_pylist(), sizes.to_pylist(), numbers.to_pylist()):
                if size % width:
                    raise ValueError(f"{path}: {size} bytes are no whole number of tokens")
                system, place = _open(path)
                with system.open_input_file(place) as f:
                    data = np.frombuffer(f.read_at(min(span, size - block * span), block * span), dtype)
                out.append(np.flatnonzero(data == separator) + block * block_tokens)
            yield pa.array(out, pa.list_(pa.int64()))

    ends = written(blocks.withColumn("ends", F.arrow_udf(read, "array<bigint>")("path", "bytes", "block")), "separators")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last")).select(
        "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry")
    )
    found = ends.where(F.size("ends") > 0).join(carried, ["path", "block"])
    closed = found.select("path", "first", "carry", "ends", F.posexplode("ends").alias("k", "end")).select(
        "path",
        (F.col("first") + F.col("k")).alias("ordinal"),
        (F.col("end") - F.when(F.col("k") == 0, F.col("carry")).otherwise(F.element_at("ends", F.greatest("k", F.lit(1)))) - 1).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    last = ends.groupBy("path").agg(F.max("bytes").alias("bytes"), F.sum(F.size("ends")).alias("ordinal"), F.max(F.try_element_at("ends", F.lit(-1))).alias("last"))
    left = F.floor(F.col("bytes") / width) - 1 - F.coalesce("last", F.lit(-1))
    tail = last.select("path", F.col("ordinal").cast("long"), left.cast("long").alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return closed.withColumn("ordinal", F.col("ordinal").cast("long")).unionByName(tail)


def document_tokens(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the documents as token files and count them back: doc_id, n_tokens."""
    manifest = write_token_files(docs, tokenizer, id_col, text_col, separator, dtype)
    counts = count_tokens(manifest, "path", separator, dtype, block_tokens)
    return manifest.join(counts, ["path", "ordinal"], "left").select("doc_id", "n_tokens")
