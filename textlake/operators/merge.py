"""Keyed merges: each returns ``(merged table, one-row counts table)``.

Targets hold one row per key. Incoming rows are reduced to one per key first, with a rank filter that
Spark applies before the shuffle too, so a key that fills much of the batch sends few rows. The reduced
rows, each with a mark of whether the target has its key, are written once; the merge and the counts
``inserted``, ``matched`` and ``rejected`` (rows without a key, which are not merged) read them. The joins
are left, semi and anti joins, which AQE can split, unlike a full outer join.
"""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textlake.operators.quality import observed, require_unique
from textlake.session import checkpointed
from textlake.sinks import new_version

_HIT = "_matched"


def _orders(order_by, keep: str) -> list[Column]:
    cols = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return [c.asc_nulls_first() for c in cols] if keep == "first" else [c.desc_nulls_last() for c in cols]


def dedup(df: DataFrame, key: str, order_by=None, keep: str = "first") -> DataFrame:
    """One row per key: the ``first`` or ``last`` by ``order_by``, or ``error`` on any duplicate.

    Remaining columns break ties, so the choice does not depend on how rows arrive.
    """
    if keep == "error":
        require_unique(df, key)
        return df
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first, last or error, not {keep!r}")
    rest = [c for c in df.columns if c != key]
    order = (_orders(order_by, keep) if order_by is not None else []) + [F.col(c).asc_nulls_first() for c in rest]
    if not order:
        return df.distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") == 1).drop("_rn")


def stage_distinct(incoming: DataFrame) -> DataFrame:
    return incoming.distinct()


def _staged(target: DataFrame, incoming: DataFrame, key: str, order_by, keep: str, cols=None) -> tuple[DataFrame, DataFrame]:
    """The change set, written: one row per key, marked when the target has the key; and the counts."""
    rows = incoming.select(key, *[c for c in incoming.columns if c != key])
    fresh = dedup(rows.where(F.col(key).isNotNull()), key, order_by, keep)
    keyless = rows.where(F.col(key).isNull())
    cols = cols or target.columns
    marks = target.select(key, F.lit(True).alias(_HIT))
    marked = fresh.select(*cols).join(marks, key, "left").select(*cols, F.col(_HIT).isNotNull().alias(_HIT))
    all_rows = marked.unionByName(keyless.select(*cols, F.lit(None).cast("boolean").alias(_HIT)))
    spark, hit = incoming.sparkSession, F.col(_HIT)
    # counted in the pass that writes the rows
    watched, counts = observed(all_rows, {"inserted": F.count_if(~hit), "matched": F.count_if(hit), "rejected": F.count_if(hit.isNull())})
    staged = spark.read.schema(all_rows.schema).parquet(new_version(watched, "changes"))
    counts = spark.createDataFrame([tuple(counts().values())], "inserted long, matched long, rejected long")
    return staged.where(F.col(_HIT).isNotNull()), counts


def _updated(target: DataFrame, known: DataFrame, key: str, update_cols, extra: dict | None = None) -> DataFrame:
    """Rows of the target, ``update_cols`` from ``known`` where it has the key."""
    new = {c: F.col(f"_new_{c}") for c in update_cols} | (extra or {})
    changes = known.select(key, F.lit(True).alias(_HIT), *[F.col(c).alias(f"_new_{c}") for c in update_cols])
    return target.join(changes, key, "left").select(
        *[F.when(F.col(_HIT), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns]
    )


def merge_ignore(target: DataFrame, incoming: DataFrame, key: str, order_by=None):
    """Existing rows win; unknown keys are appended."""
    staged, counts = _staged(target, incoming, key, order_by, "first")
    return target.unionByName(staged.where(~F.col(_HIT)).drop(_HIT)), counts


def merge_partial(target: DataFrame, incoming: DataFrame, key: str, update_cols, order_by=None, keep: str = "first"):
    """On a known key only ``update_cols`` change, NULLs included; new keys bring all columns."""
    staged, counts = _staged(target, incoming, key, order_by, keep)
    updated = _updated(target, staged.where(_HIT), key, update_cols)
    return updated.unionByName(staged.where(~F.col(_HIT)).drop(_HIT)), counts


def merge_full(target: DataFrame, incoming: DataFrame, key: str, order_by=None, keep: str = "first"):
    """On a known key every other column changes."""
    staged, counts = _staged(target, incoming, key, order_by, keep)
    untouched = target.join(staged.where(_HIT).select(key), key, "left_anti")
    return untouched.unionByName(staged.drop(_HIT)), counts


def merge_replace(target: DataFrame, incoming: DataFrame, key: str, order_by):
    """Row-by-row replacement in ``order_by`` order: the last row of a key stays."""
    return merge_full(target, incoming, key, order_by, keep="last")


def number_rows(df: DataFrame, key: str, start: Column | int = 0, name: str = "id") -> DataFrame:
    """Consecutive numbers in key order, starting after ``start``.

    Keys are range-sorted and written once; each partition then adds its own offset. The table of
    offsets has one row per partition, so it is broadcast.
    """
    keys = checkpointed(df.select(key).repartitionByRange(key).sortWithinPartitions(key))
    keys = keys.select(
        key,
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"),
    )
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    start = F.lit(start) if isinstance(start, int) else start
    numbered = keys.join(F.broadcast(offsets), "_part").select(
        key, (start + F.col("_before") + F.col("_pos") + 1).cast("bigint").alias(name)
    )
    return df.join(numbered, key)


def reserve_ids(spark: SparkSession, ledger: str, owner: str, n: int, floor: int = 0) -> int:
    """The first of ``n`` ids, all above ``floor``, that belong to ``owner`` alone.

    ``ledger`` is a folder of reservations, one small file each, named by its place in their order. A reservation is made by
    creating the next file, which fails if another writer has just done so; then the one after is tried. The folder has to
    be in a store where creating a file that exists fails for sure (a local disk only does for one driver). An owner that
    comes again, after a failure, gets the ids it has. Ids reserved and not used leave a gap.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(ledger)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)

    def entry(place: int) -> dict | None:
        path = jvm.org.apache.hadoop.fs.Path(folder, f"{place:020d}")
        if not fs.exists(path):
            return None
        for _ in range(50):  # another writer may not have closed it yet
            text = jvm.org.apache.commons.io.IOUtils.toString(file := fs.open(path), "UTF-8")
            file.close()
            if text:
                return json.loads(text)
            time.sleep(0.1)
        raise RuntimeError(f"reservation {path.toString()} was never finished")

    place, last = 0, floor
    while True:
        while (held := entry(place)) is not None:
            if held["owner"] == owner:
                if held["n"] < n:
                    raise ValueError(f"{owner} has reserved {held['n']} ids and asks for {n}")
                return held["start"]
            last = max(last, held["start"] + held["n"] - 1)
            place += 1
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"{place:020d}"), False)
        except Py4JJavaError as e:
            if "exist" not in str(e.java_exception).lower():
                raise
            continue
        out.write(json.dumps({"owner": owner, "start": last + 1, "n": n}).encode())
        out.close()
        return last + 1


def merge_audited(
    target: DataFrame,
    incoming: DataFrame,
    key: str,
    cols,
    now,
    id_col: str = "id",
    created_col: str = "created_at",
    updated_col: str = "updated_at",
    order_by=None,
    ledger: str | None = None,
    owner: str | None = None,
):
    """Upsert with a surrogate id and audit times.

    A known key keeps its id and creation time and gets ``cols`` and ``now``; a new key gets the next
    ids in key order. Writers whose merges into one target overlap name a common ``ledger`` and each an ``owner`` of its
    own: their ids come from ranges reserved there before anything is written, so they never share one.
    """
    stamp = F.lit(now).cast(target.schema[updated_col].dataType)
    staged, counts = _staged(target, incoming.select(key, *cols, *_names(order_by, key, cols)), key, order_by, "first", [key, *cols])
    updated = _updated(target, staged.where(_HIT), key, cols, {updated_col: stamp})
    last = target.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    if ledger is not None:
        if not owner:
            raise ValueError("a ledger needs the name of an owner")
        inserted = counts.first()["inserted"]
        last = reserve_ids(target.sparkSession, ledger, owner, inserted, int(last)) - 1 if inserted else last
    added = number_rows(staged.where(~F.col(_HIT)).drop(_HIT), key, int(last), id_col)
    added = added.withColumns({created_col: stamp, updated_col: stamp}).select(
        *[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    )
    return updated.unionByName(added), counts


def _names(order_by, key: str, cols) -> list[str]:
    """Order columns that are not selected already."""
    names = [order_by] if isinstance(order_by, str) else [c for c in order_by or () if isinstance(c, str)]
    return [c for c in names if c != key and c not in cols]
