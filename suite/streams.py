from pyspark.sql import functions as F

from suite.registry import query, table
from textlake import schemas
from textlake.session import scratch_path
from textlake.streaming import ingest as I, throttle as T

_LIMIT, _HOURS = 3, 6
_ROWS = 50_000  # of a file, and so of a trigger

_THROTTLE = f"""
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
run AS (
  SELECT user_id, event_id, rn, true AS admitted, [t] AS log FROM ev WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, len(kept) < {_LIMIT}, CASE WHEN len(kept) < {_LIMIT} THEN list_append(kept, t) ELSE kept END
  FROM (SELECT ev.user_id, ev.event_id, ev.rn, ev.t, list_filter(run.log, lambda x: x >= ev.t - {_HOURS * 3_600_000_000}) AS kept
        FROM run JOIN ev ON ev.user_id = run.user_id AND ev.rn = run.rn + 1))
SELECT user_id, event_id, admitted FROM run
"""


@query(_THROTTLE)
def throttle_batch(spark, sf):
    return T.throttle(table(spark, sf, "events"), "user_id", "ts", "event_id", _LIMIT, _HOURS * 3600)


def _run_stream(spark, source, path, start=T.throttle_stream, **more):
    """Run a stream of events to its end and return the decisions; the session's settings are put back.

    Every trigger opens and commits every partition of the state, so there are as many as cores, whatever the session's shuffles have.
    """
    setting = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
    }
    before = {k: spark.conf.get(k, None) for k in setting}
    for k, v in setting.items():
        spark.conf.set(k, v)
    try:
        decided = start(source, "user_id", "ts", "event_id", _LIMIT, _HOURS * 3600, **more)
        run = (
            decided.writeStream.format("parquet")
            .option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(decided.schema).parquet(f"{path}/out")


def _one_file_a_trigger(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@query(_THROTTLE)
def throttle_stream(spark, sf):
    """The events in files of bounded rows by time, one file a trigger."""
    path = scratch_path(spark, "throttle")
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    T.write_in_order(events, "ts", "event_id", f"{path}/in", _ROWS)
    return _run_stream(spark, _one_file_a_trigger(spark, events, path), path)


_TIMELESS = "event_id % 50 = 7"


@query(
    _THROTTLE.replace("FROM events)", f"FROM events WHERE NOT ({_TIMELESS}))")
    + f" UNION ALL SELECT user_id, event_id, NULL FROM events WHERE {_TIMELESS}"
)
def throttle_timeless(spark, sf):
    """Some events have no time: they are returned without a decision."""
    events = table(spark, sf, "events").withColumn("ts", F.expr(f"CASE WHEN {_TIMELESS} THEN NULL ELSE ts END"))
    return T.throttle(events, "user_id", "ts", "event_id", _LIMIT, _HOURS * 3600)


@query(_THROTTLE.replace("ORDER BY ts, event_id", "ORDER BY event_id % 3 = 0, ts, event_id"))
def throttle_late(spark, sf):
    """A third of the events arrives after all others, up to the whole span late; none is lost."""
    path = scratch_path(spark, "late")
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    for late in (False, True):
        T.write_in_order(events.where((F.col("event_id") % 3 == 0) == F.lit(late)), "ts", "event_id", f"{path}/in", _ROWS)
        decided = _run_stream(spark, _one_file_a_trigger(spark, events, path), path)
    return decided


@query(
    _THROTTLE.replace("FROM events)", f"FROM events WHERE NOT ({_TIMELESS}))")
    + f" UNION ALL SELECT user_id, event_id, NULL FROM events WHERE {_TIMELESS}"
)
def throttle_shuffled(spark, sf):
    """Events in files by a hash of their id, so in no order of time: decided in the order of event time; some have none."""
    path = scratch_path(spark, "shuffled")
    events = table(spark, sf, "events").select("user_id", "event_id", F.expr(f"CASE WHEN {_TIMELESS} THEN NULL ELSE ts END").alias("ts"))
    events.repartition(4, F.xxhash64("event_id")).write.option("maxRecordsPerFile", _ROWS).parquet(f"{path}/in")
    # the newest event of all makes the others' buckets pass
    span = events.agg(F.max("ts").alias("ts"), F.date_diff(F.max("ts"), F.min("ts")).alias("days")).first()
    lateness = f"{(span['days'] or 0) + 1} days"
    last = events.agg((F.max("ts") + F.make_dt_interval(F.lit(2 * (span["days"] or 0) + 9))).alias("ts"))
    last = last.select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast("long").alias("event_id"), "ts")
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    more = dict(start=T.throttle_event_time, lateness=lateness, bucket_s=86_400)
    _run_stream(spark, source(), path, **more)
    last.select(*events.columns).write.mode("append").parquet(f"{path}/in")
    return _run_stream(spark, source(), path, **more).where("event_id <> -1")


_DROP = schemas.ddl("title string, status string, price string")


@query("""
SELECT 'order "' || o_orderkey || '", one' AS title, CASE WHEN o_orderstatus = 'O' THEN 'again' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(o_totalprice * 100 + 100 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR) END AS price
FROM orders
""")
def ingest_stream(spark, sf):
    """Orders dropped as CSV files in two runs; the second one updates the open orders."""
    base = scratch_path(spark, "ingest")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit('order "'), F.col("o_orderkey").cast("string"), F.lit('", one')).alias("title"),
        F.col("o_orderstatus").alias("status"), cents.cast("string").alias("price"), (cents + 100).cast("string").alias("later"),
    )
    later = rows.where("status = 'O'").select("title", F.lit("again").alias("status"), F.col("later").alias("price"))
    for batch in (rows.select("title", "status", "price"), later):
        batch.write.mode("append").option("header", True).option("escape", '"').csv(f"{base}/drop")
        I.ingest_folder(spark, f"{base}/drop", _DROP, "title", f"{base}/table", f"{base}/bad", f"{base}/seen")
    return I.read_merged(spark, f"{base}/table", _DROP, "title")


@query("""
SELECT 'row' AS what, CAST(o_orderkey AS VARCHAR) AS title, o_orderstatus AS status, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS price
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'file', o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'bad' ELSE 'imported' END,
  CASE WHEN o_orderstatus = 'P' THEN 'no column price' ELSE CAST(count(*) AS VARCHAR) END FROM orders GROUP BY o_orderstatus
""")
def ingest_by_name(spark, sf):
    """Files with their columns in another order, with one too many and with one missing; and what became of each file."""
    base = scratch_path(spark, "named")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("price"), F.lit("x").alias("extra"),
    )
    for status, columns in (("O", ["price", "title", "status"]), ("F", ["extra", "status", "price", "title"]), ("P", ["title", "status"])):
        part = rows.where(F.col("status") == status).select(*columns)
        # some files of a status, each of bounded rows
        part.repartitionByRange(2, "title").write.option("header", True).option("maxRecordsPerFile", _ROWS).csv(f"{base}/drop/{status}")
    I.ingest_folder(spark, f"{base}/drop/*", _DROP, "title", f"{base}/table", f"{base}/bad", f"{base}/seen", status=f"{base}/status")
    merged = I.read_merged(spark, f"{base}/table", _DROP, "title").select(F.lit("row").alias("what"), "title", "status", "price")
    files = spark.read.schema(I.STATUS).option("recursiveFileLookup", True).parquet(f"{base}/status")
    files = files.groupBy(F.regexp_extract("file", "/drop/(.)/", 1).alias("title"), "status", "reason").agg(F.sum("good_rows").alias("good_rows"))
    files = files.select(F.lit("file").alias("what"), "title", "status", F.coalesce("reason", F.col("good_rows").cast("string")).alias("price"))
    return merged.unionByName(files)
