"""Sliding-log throttle: admit an event if fewer than N admitted ones lie in the window before it.

Each decision depends on earlier ones of the same key, so the work is sequential per key. The batch form
still spreads a dominant key: rows are range-sorted by (key, time), every partition is one chunk, and a
chunk only needs the last N admitted times of the chunk before it when both hold the same key.
"""

from __future__ import annotations

import bisect
import logging
import re
import time
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textlake.session import checkpointed

logger = logging.getLogger("textlake")

LIMIT, WINDOW_S = 30, 60  # fixed values: the default allowance
SHARDS = 64  # groups of keys that share a state: each is called once a trigger, so not far more than there are cores
NO_KEY = -1  # the group of the rows without a key
TOGETHER = 20_000  # rows of a group from which its next bucket is decided by itself


def admit(times: np.ndarray, log: deque, limit: int, window: int) -> np.ndarray:
    """Decide a time-ordered run of one key; ``log`` holds the admitted times in order and is updated.

    Entries strictly older than ``t - window`` drop out; rejected events are not logged. Events older than the
    log's newest entry are decided against the entries that are left.
    """
    joined = np.concatenate([np.fromiter(log, np.int64, len(log)), times])
    in_order = not log or not len(times) or times[0] >= log[-1]
    if in_order and (len(joined) <= limit or (joined[limit:] - joined[:-limit] > window).all()):
        log.extend(times[-limit:].tolist())  # never more than the limit in any window
        while len(log) > limit or log and log[0] < log[-1] - window:
            log.popleft()
        return np.ones(len(times), bool)
    out = np.zeros(len(times), bool)
    for i, t in enumerate(times.tolist()):
        while log and log[0] < t - window:
            log.popleft()
        if len(log) < limit:
            if log and t < log[-1]:
                bisect.insort(log, t)
            else:
                log.append(t)
            out[i] = True
    return out


def _runs(batch: pa.RecordBatch):
    """Consecutive rows of one key in a sorted batch: ``(key, from, to)``."""
    if not batch.num_rows:
        return
    codes = batch.column(0).dictionary_encode()
    index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1, [len(index)]]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield None if index[lo] < 0 else codes.dictionary[int(index[lo])].as_py(), lo, hi


def throttle(
    df: DataFrame, key: str, ts: str, event_id: str, n: int = LIMIT, window_s: float = WINDOW_S, partitions: int | None = None
) -> DataFrame:
    """``(key, event_id, admitted)`` for every row, in ``(ts, event_id)`` order per key; without a time ``admitted`` is NULL.

    The sorted log is checkpointed, so its partitions stay put between the passes below. A pass per
    chunk returns its last key and log; only a chunk that lies wholly inside one key, follows another within
    the window, and whose predecessor's log changed, is done again, and only its rows are read for that. The
    driver sees one row per chunk. A key without a quiet window across m chunks can take m passes.
    """
    window = int(window_s * 1_000_000)
    timeless = df.where(F.col(ts).isNull()).select(key, event_id, F.lit(None).cast("boolean").alias("admitted"))
    log = df.where(F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(event_id).alias("_id")
    )
    order = ["_key", "_t", "_id"]
    spread = [partitions, *order] if partitions else order  # without a number AQE merges small ranges
    log = checkpointed(log.repartitionByRange(*spread).sortWithinPartitions(*order))

    arrow_key = to_arrow_type(df.schema[key].dataType)
    key_type, id_type = df.schema[key].dataType, df.schema[event_id].dataType
    summary = T.StructType(
        [
            T.StructField("chunk", T.IntegerType()),
            T.StructField("first", key_type),
            T.StructField("last", key_type),
            T.StructField("log", T.ArrayType(T.LongType())),
            T.StructField("from", T.LongType()),
            T.StructField("to", T.LongType()),
        ]
    )

    def last_logs(starts: dict, only: set | None):
        def run(batches):
            chunk = TaskContext.get().partitionId()
            if only is not None and chunk not in only:
                return
            first, current, state, empty = None, None, deque(starts.get(chunk, ())), True
            begins = ends = None
            for batch in batches:
                times = batch.column(1).to_numpy(zero_copy_only=False)
                if batch.num_rows:
                    begins, ends = int(times[0]) if begins is None else begins, int(times[-1])
                for k, lo, hi in _runs(batch):
                    if empty:
                        first, empty = k, False
                    elif k != current:
                        state = deque()
                    current = k
                    admit(times[lo:hi], state, n, window)
            if not empty:
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([chunk], pa.int32()),
                        "first": pa.array([first], arrow_key),
                        "last": pa.array([current], arrow_key),
                        "log": pa.array([list(state)], pa.list_(pa.int64())),
                        "from": pa.array([begins], pa.int64()),
                        "to": pa.array([ends], pa.int64()),
                    }
                )

        rows = log if only is None else log.where(F.spark_partition_id().isin(sorted(only)))
        return {r["chunk"]: r for r in rows.mapInArrow(run, summary).collect()}

    chunks = last_logs({}, None)
    ordered = sorted(chunks)
    # a chunk that begins more than a window after the one before needs nothing of it
    follows = {
        b: a
        for a, b in zip(ordered, ordered[1:])
        if chunks[a]["last"] == chunks[b]["first"] and chunks[b]["from"] - chunks[a]["to"] <= window
    }
    starts: dict[int, list[int]] = {}
    passes = 1
    while True:
        fresh = {b: chunks[a]["log"] for b, a in follows.items()}
        changed = {b for b in follows if fresh[b] != starts.get(b)}
        starts = fresh
        again = {b for b in changed if chunks[b]["first"] == chunks[b]["last"]}
        if not again:
            break
        chunks |= last_logs(starts, again)
        passes += 1
    logger.info("%d chunks, %d passes", len(ordered), passes)

    out = T.StructType(
        [T.StructField(key, key_type), T.StructField(event_id, id_type), T.StructField("admitted", T.BooleanType())]
    )

    def decide(batches):
        current, state, begun = None, deque(starts.get(TaskContext.get().partitionId(), ())), False
        for batch in batches:
            times = batch.column(1).to_numpy(zero_copy_only=False)
            ok = np.zeros(batch.num_rows, bool)
            for k, lo, hi in _runs(batch):
                if begun and k != current:
                    state = deque()
                current, begun = k, True
                ok[lo:hi] = admit(times[lo:hi], state, n, window)
            columns = [batch.column(0), batch.column(2), pa.array(ok)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, event_id, "admitted"])

    return log.mapInArrow(decide, out).unionByName(timeless)


def write_in_order(df: DataFrame, ts: str, event_id: str, path: str, rows: int) -> None:
    """Add events to a folder in files of at most ``rows`` rows, by time, for a stream with ``maxFilesPerTrigger``.

    A file source reads files by modification time, so the new ones get times in the order of their ranges.
    """
    begun = int(time.time() * 1000)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def parts():
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return {n: m for n in names if (m := re.match(r"part-(\d+)-.*?(?:-c(\d+))?\.", n))}

    old = parts()
    ordered = df.repartitionByRange(ts, event_id).sortWithinPartitions(ts, event_id)
    ordered.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)
    new = {n: (int(m[1]), int(m[2] or 0)) for n, m in parts().items() if n not in old}
    for i, name in enumerate(sorted(new, key=new.get)):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, name), begun + 10 * i, -1)


def _decide(rows: pd.DataFrame, key: str, logs: tuple, limit: int, window: int) -> tuple[np.ndarray, tuple]:
    """Decisions on the rows of a group, all with a time, in the order of time and id (none last), and the logs after them.

    Logs are the keys, the number of times of each, and the times in order. Keys that come to no more than ``limit`` in any window,
    as most do, are decided together; the others one by one.
    """
    known, sizes, before = logs
    kept, codes, names = _coded(known, rows[key])
    at, ids = rows["event_micros"].to_numpy().astype(np.int64), rows["event_id"]
    if not pd.api.types.is_integer_dtype(ids):
        ids = pd.Series(pd.factorize(ids, sort=True)[0])
        ids = ids.mask(ids < 0, len(ids))
    by_time = np.lexsort((ids.to_numpy(), rows["no_id"].to_numpy(bool), at, codes))
    code, t = np.concatenate([np.repeat(kept, sizes), codes[by_time]]), np.concatenate([before, at[by_time]])
    order = np.argsort(code, kind="stable")  # of each key its log, then its rows
    code, t, new = code[order], t[order], order >= len(before)
    alone = np.full(len(names), limit < 1)
    alone[code[1:][(code[1:] == code[:-1]) & (t[1:] < t[:-1])]] = True  # rows older than the log
    rest = max(0, len(code) - limit)
    alone[code[limit:][(code[limit:] == code[:rest]) & (t[limit:] - t[:rest] <= window)]] = True
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    ends = np.append(starts[1:], len(code))
    since = np.where(np.logical_or.reduceat(new, starts), t[ends - 1] - window, t[starts])  # a log without new rows stays
    ok, left = np.ones(len(code), bool), (t >= np.repeat(since, ends - starts)) & ~alone[code]
    sizes = np.add.reduceat(left, starts, dtype=int)
    times, place = [t[left]], [np.repeat(np.arange(len(starts)), sizes)]
    for i in np.flatnonzero(alone[code[starts]]):
        first = starts[i] + int((~new[starts[i] : ends[i]]).sum())
        log = deque(t[starts[i] : first].tolist())
        ok[first : ends[i]] = admit(t[first : ends[i]], log, limit, window)
        sizes[i] = len(log)
        times.append(np.array(log, np.int64))
        place.append(np.full(len(log), i))
    times = np.concatenate(times)[np.argsort(np.concatenate(place), kind="stable")]
    decided = np.zeros(len(rows), bool)
    decided[by_time[order[new] - len(before)]] = ok[new]
    return decided, ([names[c] for c in code[starts][sizes > 0]], sizes[sizes > 0], times)


def _coded(known: list, keys: pd.Series) -> tuple[np.ndarray, np.ndarray, list]:
    """Numbers of the keys known and of the rows' keys, and the keys by their numbers; NULL is the last."""
    kind = keys.dtype if pd.api.types.is_integer_dtype(keys) else object
    values = np.empty(len(known) + len(keys), kind)
    values[: len(known)], values[len(known) :] = known, keys.to_numpy() if kind != object else keys.astype(object).to_numpy()
    codes, names = pd.factorize(values)
    codes = np.where(codes < 0, len(names), codes)
    return codes[: len(known)], codes[len(known) :], [*names.tolist(), None]


class _Logs:
    """The admitted times of the keys of one shard as one state value: keys, numbers of times, times."""

    def __init__(self, handle: StatefulProcessorHandle, key_type: str):
        self.state = handle.getValueState("logs", f"keys array<{key_type}>, sizes array<int>, times array<bigint>")

    def read(self) -> tuple:
        keys, sizes, times = self.state.get() or ([], [], [])
        return list(keys), np.array(sizes, int), np.array(times, np.int64)

    def write(self, logs: tuple) -> None:
        keys, sizes, times = logs
        self.state.update((keys, sizes.tolist(), times.tolist()))


def _still(logs: tuple, since: int) -> tuple:
    """The logs whose newest time is not before ``since``."""
    keys, sizes, times = logs
    stay = times[np.cumsum(sizes) - 1] >= since if len(keys) else np.zeros(0, bool)
    return [k for k, s in zip(keys, stay) if s], sizes[stay], times[np.repeat(stay, sizes)]


class _SlidingLog(StatefulProcessor):
    """The admitted times of the keys of a shard, kept between micro-batches, at will until a window has passed."""

    def __init__(self, key: str, key_type: str, event_id: str, n: int, window: int, expires: bool):
        self.key, self.key_type, self.event_id, self.n, self.window, self.expires = key, key_type, event_id, n, window, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.logs = handle, _Logs(handle, self.key_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        timed = batch["event_micros"].notna().to_numpy()
        admitted = np.full(len(batch), None, dtype=object)
        if timed.any():
            ok, logs = _decide(batch if timed.all() else batch[timed], self.key, self.logs.read(), self.n, self.window)
            admitted[timed] = ok.tolist()
            self.logs.write(logs)
            if self.expires:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self._wake(logs)
        yield _decided(batch, self.key, self.event_id, admitted, key[0])

    def _wake(self, logs: tuple) -> None:
        _, sizes, times = logs
        if len(sizes):
            self.handle.registerTimer((int(times[np.cumsum(sizes) - 1].min()) + self.window) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        logs = _still(self.logs.read(), timerValues.getCurrentWatermarkInMs() * 1000 - self.window)
        self.logs.write(logs)
        self._wake(logs)
        return iter([])

    def close(self) -> None:
        pass


def _decided(rows: pd.DataFrame, key: str, event_id: str, admitted, shard: int) -> pd.DataFrame:
    ids, none = rows["event_id"], rows["no_id"].to_numpy(bool)
    if none.any():
        ids = ids.astype(object).mask(none, None)
    keys = rows[key] if shard != NO_KEY else pd.Series(None, dtype=object, index=rows.index)
    return pd.DataFrame({key: keys, event_id: ids, "admitted": pd.Series(admitted, dtype=object, index=rows.index)})


def _listed(values: pd.Series, gone: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A column's values in that order as plain ones, None where they are gone."""
    if pd.api.types.is_integer_dtype(values) and not gone.any():
        return values.to_numpy()[order]
    return values.astype(object).where(~gone, None).to_numpy()[order]


class _EventTimeLog(StatefulProcessor):
    """Events of the keys of a shard wait in state, in blocks by bucket of time, until the watermark has passed their bucket.

    Blocks are written as they come and never rewritten; a bucket is read, ordered and decided once, small ones that are ready
    together at once. A shard has one timer, for its first bucket.
    """

    def __init__(self, key: str, key_type: str, event_id: str, id_type: str, n: int, window: int, bucket: int):
        self.key, self.key_type, self.event_id, self.id_type = key, key_type, event_id, id_type
        self.n, self.window, self.bucket = n, window, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.logs = handle, _Logs(handle, self.key_type)
        block = f"keys array<{self.key_type}>, times array<bigint>, ids array<{self.id_type}>"
        self.waiting = handle.getMapState("waiting", "bucket bigint, block bigint", block)
        self.blocks = handle.getValueState("blocks", "n bigint, first bigint")

    def _timer(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block, first = self.blocks.get() or (0, None)
        due = first
        for batch in rows:  # one Arrow batch at a time
            times = batch["event_micros"].to_numpy(np.int64)
            order = np.argsort(times // self.bucket, kind="stable")
            times, buckets = times[order], times[order] // self.bucket
            keys = _listed(batch[self.key], batch[self.key].isna().to_numpy(), order)
            ids = _listed(batch["event_id"], batch["no_id"].to_numpy(bool), order)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else []
            for lo, hi in zip(cuts, cuts[1:]):
                b = int(buckets[lo])
                self.waiting.updateValue((b, block), (keys[lo:hi].tolist(), times[lo:hi].tolist(), ids[lo:hi].tolist()))
                block, first = block + 1, b if first is None else min(b, first)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(self._timer(due))
            self.handle.registerTimer(self._timer(first))
        self.blocks.update((block, first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        found = sorted(self.waiting.keys())
        ready = [(b, block) for b, block in found if (b + 1) * self.bucket <= passed]
        if ready:
            logs, held = self.logs.read(), ([], [], [])
            for i, (b, block) in enumerate(ready):
                for into, values in zip(held, self.waiting.getValue((b, block))):
                    into += values
                if len(found) > len(ready):
                    self.waiting.removeKey((b, block))
                last = i + 1 == len(ready)
                if last or len(held[0]) >= TOGETHER and ready[i + 1][0] > b:
                    keys, times, ids = held
                    none = [v is None for v in ids]
                    rows = pd.DataFrame({self.key: _plainest(keys), "event_micros": np.array(times, np.int64), "no_id": none, "event_id": _plainest(ids)})
                    ok, logs = _decide(rows, self.key, logs, self.n, self.window)
                    yield _decided(rows, self.key, self.event_id, ok.tolist(), key[0])
                    # all events to come are of later buckets
                    logs, held = _still(logs, (b + 1) * self.bucket - self.window), ([], [], [])
            if len(found) == len(ready):
                self.waiting.clear()
            self.logs.write(logs)
        first = found[len(ready)][0] if len(found) > len(ready) else None
        if first is not None:
            self.handle.registerTimer(self._timer(first))
        self.blocks.update((self.blocks.get()[0], first))

    def close(self) -> None:
        pass


def _plainest(values: list) -> pd.Series:
    """Whole numbers as such where none is NULL, other values as objects."""
    whole = all(type(v) is int for v in values)
    return pd.Series(values, dtype="int64" if whole else object)


def _sharded(stream: DataFrame, key: str, event_id: str, at, shards: int) -> DataFrame:
    """Shard, key, id and time. Rows without a key have a shard of their own, ``NO_KEY``. Whole numbers are never NULL, as an Arrow
    batch holds rows of several shards, and one NULL in it would make floats of all its keys or ids."""
    shard = F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(shards))).cast("int")

    def named(c):
        kind = stream.schema[c].dataType
        return F.coalesce(c, F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.col(c)

    return stream.select(
        shard.alias("_shard"), named(key).alias(key), named(event_id).alias("event_id"), F.col(event_id).isNull().alias("no_id"),
        at.alias("event_time"), F.unix_micros(at).alias("event_micros"),
    )


def throttle_event_time(
    stream: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    n: int = LIMIT,
    window_s: float = WINDOW_S,
    lateness: str = "10 minutes",
    bucket_s: float | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """The decisions of ``throttle`` on a stream, in the order of event time whatever the order of arrival.

    Events wait until the watermark, ``lateness`` behind the newest event, has passed the bucket of ``bucket_s`` seconds
    (``window_s`` by default) that they lie in; then the bucket is decided as a whole. Keys share ``shards`` groups, so state is
    called once a group and bucket, not once a key; a task holds one Arrow batch, or one bucket of one group, in memory. Events that come later than ``lateness`` are dropped, and the last ones of a stream
    wait for a newer event. Events without a time get NULL at once. Needs the RocksDB state store.
    """
    window, bucket = int(window_s * 1_000_000), max(1, int((bucket_s or window_s) * 1_000_000))
    at = F.col(ts).cast("timestamp")
    timed = _sharded(stream.where(at.isNotNull()), key, event_id, at, shards)
    out = T.StructType([stream.schema[key], stream.schema[event_id], T.StructField("admitted", T.BooleanType())])
    kinds = [stream.schema[c].dataType.simpleString() for c in (key, event_id)]
    processor = _EventTimeLog(key, kinds[0], event_id, kinds[1], n, window, bucket)
    decided = timed.withWatermark("event_time", lateness).groupBy("_shard").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime"
    )
    timeless = stream.where(at.isNull()).select(key, event_id, F.lit(None).cast("boolean").alias("admitted"))
    return decided.unionByName(timeless)


def throttle_stream(
    stream: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    n: int = LIMIT,
    window_s: float = WINDOW_S,
    lateness: str | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """The decisions of ``throttle`` on a stream, in the order of arrival of its micro-batches and of time within them.

    Every event is decided, late ones too, against the admitted times that lie in the window before it or later;
    events without a time get NULL. State per key is at most ``n`` times and stays. With ``lateness`` a watermark drops
    the state of quiet keys, and then also drops events that are later than it: ask for it only where such events
    cannot come. Keys share ``shards`` groups, so state is called once a group and trigger, not once a key; a trigger rewrites
    the logs of the groups it has rows of. The rows of one group in a micro-batch are sorted in one task, so bound what one trigger reads: files of
    bounded rows (``write_in_order``) and ``maxFilesPerTrigger``. Needs the RocksDB state store.
    """
    window = int(window_s * 1_000_000)
    at = F.col(ts).cast("timestamp")
    rows = _sharded(stream, key, event_id, at, shards).withColumn("event_micros", F.col("event_micros").cast("double"))
    if lateness is not None:
        rows = rows.withWatermark("event_time", lateness)
    out = T.StructType([stream.schema[key], stream.schema[event_id], T.StructField("admitted", T.BooleanType())])
    return rows.groupBy("_shard").transformWithStateInPandas(
        statefulProcessor=_SlidingLog(key, stream.schema[key].dataType.simpleString(), event_id, n, window, lateness is not None),
        outputStructType=out,
        outputMode="append",
        timeMode="none" if lateness is None else "eventTime",
    )
