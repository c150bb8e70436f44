import collections
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textlake import schemas
from textlake.streaming import ingest as I, throttle as T

START = datetime(2024, 1, 1)
SCHEMA = "client string, event_id long, ts timestamp"


def expected(rows, n, window):
    logs, out = collections.defaultdict(list), {}
    for client, event, ts in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        log = [t for t in logs[client] if t >= ts - timedelta(seconds=window)]
        out[event] = len(log) < n
        logs[client] = log + [ts] if out[event] else log
    return out


def events(seed, n, hot=0.5, span=3000):
    """One client sends ``hot`` of the events, in bursts without a quiet window."""
    rnd = random.Random(seed)
    clients = ["hot" if rnd.random() < hot else rnd.choice(["a", "b", None]) for _ in range(n)]
    return [(c, i, START + timedelta(seconds=rnd.randrange(span))) for i, c in enumerate(clients)]


def decided(df):
    rows = [(r.event_id, r.admitted) for r in df.collect()]
    out = dict(rows)
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed, hot, n, window, parts", [(1, 0.5, 3, 60, 8), (2, 1.0, 2, 100, 12), (3, 0.0, 5, 30, 4), (4, 0.9, 1, 7, 6)])
def test_throttle(spark, seed, hot, n, window, parts):
    rows = events(seed, 800, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert decided(T.throttle(df, "client", "ts", "event_id", n, window, partitions=parts)) == expected(rows, n, window)


def test_throttle_edges(spark):
    at = [0, 0, 10, 60, 61, 121]
    rows = [("a", i, START + timedelta(seconds=s)) for i, s in enumerate(at)]
    got = decided(T.throttle(spark.createDataFrame(rows, SCHEMA), "client", "ts", "event_id", 2, 60))
    # the entry exactly one window old still counts; rejected events are not logged
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_gaps_make_chunks_independent(spark, caplog):
    """One client with nearly all events in bursts that a quiet window parts: one more pass at most, however many chunks."""
    rows = [("hot" if i % 20 else "b", i, START + timedelta(seconds=i // 50 * 1000 + i % 50)) for i in range(2000)]
    with caplog.at_level("INFO", logger="textlake"):
        got = decided(T.throttle(spark.createDataFrame(rows, SCHEMA), "client", "ts", "event_id", 3, 60, partitions=30))
    assert got == expected(rows, 3, 60)
    assert int(caplog.records[-1].getMessage().split()[2]) <= 3


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(events(9, 300), key=lambda r: (r[2], r[1]))
    rows = [(c or "none", e, t) for c, e, t in rows]
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    for part in (rows[:100], rows[100:200], rows[200:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        run = (
            T.throttle_stream(stream, "client", "ts", "event_id", 3, 60)
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        assert run.awaitTermination(120)
    assert decided(spark.read.parquet(str(tmp_path / "out"))) == expected(rows, 3, 60)


def test_triggers_are_bounded_and_in_order(spark, tmp_path, monkeypatch):
    """The stream queries read a hot key's events a bounded number at a time, in order of time."""
    from suite import streams

    rows = [(c or "none", e, t) for c, e, t in events(11, 700, hot=0.7)]
    sf = str(tmp_path / "sf")
    random.Random(2).shuffle(rows)
    spark.createDataFrame(rows, "user_id string, event_id long, ts timestamp").repartition(5).write.parquet(f"{sf}/events.parquet")
    read = []
    plain = streams._run_stream

    def watched(session, source, path):
        out = plain(session, source, path)
        read[:] = [pq.read_metadata(f).num_rows for f in (tmp_path / path.rpartition("/")[2]).glob("in/*.parquet")]
        read.append(len(list((tmp_path / path.rpartition("/")[2]).glob("state/commits/[0-9]*"))))
        return out

    monkeypatch.setattr(streams, "_run_stream", watched)
    monkeypatch.setattr(streams, "_ROWS", 150)
    monkeypatch.setattr(streams, "scratch_path", lambda _, name: str(tmp_path / name))
    for query, late in ((streams.throttle_stream, False), (streams.throttle_late, True)):
        got = decided(query(spark, sf))
        first = [r for r in rows if not (late and r[1] % 3 == 0)]
        want = expected(first, streams._LIMIT, streams._HOURS * 3600)
        assert len(got) == 700 and {e: got[e] for e in want} == want
        *sizes, triggers = read
        assert sum(sizes) == 700 and max(sizes) <= 150 and triggers >= len(sizes) >= 5


def test_ingest(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    args = (spark, str(drop), schemas.PLOTS_B, "title", *(str(tmp_path / d) for d in ("table", "bad", "seen")))
    head = "title,summary,plot,external_links\n"

    def table():
        return {r.title: (r.summary, r.plot) for r in I.read_merged(spark, args[4], schemas.PLOTS_B, "title").collect()}

    (drop / "1.csv").write_text(head + 'A,s,"line 1\nline ""2""",l\nB,s1,p,l\nB,s1,p,l\n')
    (drop / "2.csv").write_text("title,summary,plot\nX,s,p\n")
    (drop / "3.csv").write_text("")
    I.ingest_folder(*args)
    first = {"A": ("s", 'line 1\nline "2"'), "B": ("s1", "p")}
    assert table() == first
    I.ingest_folder(*args)
    assert table() == first
    (drop / "4.csv").write_text(head + "B,s2,,l\nC,s,p,l\n")
    I.ingest_folder(*args)
    want = {**first, "B": ("s2", None), "C": ("s", "p")}
    assert table() == want
    bad = spark.read.option("recursiveFileLookup", True).parquet(args[5]).collect()
    assert {(r.file.rsplit("/", 1)[1], r.record) for r in bad} == {("2.csv", None)}
    compacted = I.compact(spark, args[4], schemas.PLOTS_B, "title")
    assert {r.title for r in compacted.collect()} == set(want) and table() == want
    assert len(list((tmp_path / "table").iterdir())) == 1
    # a lost checkpoint reads all files again and changes nothing; columns bind by name
    (drop / "5.csv").write_text("plot,more,external_links,title,summary\np9,x,l9,A,s9\n")
    lost = (*args[:6], str(tmp_path / "seen2"))
    I.ingest_folder(*lost, status=str(tmp_path / "status"))
    assert table() == {**want, "A": ("s9", "p9")}
    found = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "status")).collect()
    got = {r.file.rsplit("/", 1)[1]: (r.status, r.reason, r.good_rows, r.bad_rows) for r in found}
    assert got["1.csv"][0] == got["4.csv"][0] == got["5.csv"][0] == "imported"
    assert got["2.csv"] == ("bad", "no column external_links", 0, 0)
    assert len(got) == len(found) == 4


def test_event_time_whatever_the_arrival(spark, tmp_path):
    """Shuffled files, small Arrow batches, ties and rows without a time: the decisions are those of the batch."""
    rows = events(11, 400, 0.6, span=1200)
    rnd = random.Random(2)
    rnd.shuffle(rows)
    folder = tmp_path / "in"
    for k in range(0, 400, 100):
        spark.createDataFrame(rows[k : k + 100] + [("a", 1000 + k, None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = T.throttle_event_time(source, "client", "ts", "event_id", 3, 60, "25 minutes", bucket_s=45)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return decided(spark.read.schema(out.schema).parquet(str(tmp_path / "out")))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        early = run()
        want = expected(rows, 3, 60)
        assert {e: v for e, v in early.items() if v is None} == {1000 + k: None for k in range(0, 400, 100)}
        assert len(early) < 404
        spark.createDataFrame([("z", -1, START + timedelta(hours=3))], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        late = run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {e: v for e, v in late.items() if v is not None} == want


def test_keys_share_state_groups(spark, tmp_path):
    """Many keys, some NULL, ids beyond 2^53 and NULL ids: a trigger has at most ``shards`` state rows, the decisions stay."""
    big = (1 << 60) + 1
    rows = [(None if k % 40 == 0 else f"c{k % 40}", None if k == 77 else big + k, START + timedelta(seconds=3 * k)) for k in range(400)]
    for part in range(4):
        spark.createDataFrame(rows[100 * part : 100 * part + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = T.throttle(spark.createDataFrame(rows, SCHEMA), "client", "ts", "event_id", 2, 300).collect()
    shown = lambda found: sorted(map(str, found))
    newest = spark.createDataFrame([("last", 0, START + timedelta(days=2))], SCHEMA).coalesce(1)
    for n, (start, more) in enumerate([(T.throttle_stream, {}), (T.throttle_stream, {"lateness": "2 hours"}), (T.throttle_event_time, {"lateness": "2 hours"})]):
        if n == 2:
            newest.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
        out = start(source, "client", "ts", "event_id", 2, 300, shards=3, **more)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / f"out{n}")).option("checkpointLocation", str(tmp_path / f"state{n}")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.schema(out.schema).parquet(str(tmp_path / f"out{n}")).where("client IS NULL OR client <> 'last'")
        assert shown(got.collect()) == shown(want)
        if n == 0:
            assert all(p["stateOperators"][0]["numRowsTotal"] <= 4 for p in query.recentProgress)


@pytest.mark.parametrize("name", ["throttle_stream", "throttle_late", "throttle_shuffled"])
def test_state_has_a_partition_per_core(spark, tmp_path, monkeypatch, name):
    """A trigger opens every partition of the state: as many as cores, whatever the session's shuffles have; settings are put back."""
    from suite import streams

    rows = [(c or "none", e, t) for c, e, t in events(5, 200)]
    spark.createDataFrame(rows, "user_id string, event_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streams, "scratch_path", lambda _, kind: str(tmp_path / kind))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    try:
        assert len(decided(getattr(streams, name)(spark, str(tmp_path)))) == 200
        assert spark.conf.get("spark.sql.shuffle.partitions") == "19"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    folder = {"throttle_stream": "throttle", "throttle_late": "late", "throttle_shuffled": "shuffled"}[name]
    state = (tmp_path / folder / "state" / "state" / "0").iterdir()
    assert len([p for p in state if p.name.isdigit()]) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("keys", ["whole", "text", "none"])
def test_keys_of_a_group_are_decided_together(monkeypatch, keys):
    """Logs and decisions are those of each key by itself, over triggers with late rows and ties; keys within the limit are not run one by one."""
    rnd = random.Random(3)
    named = {"whole": lambda k: k, "text": lambda k: f"k{k}", "none": lambda k: None}[keys]
    kind = {"whole": "int64", "text": object, "none": float}[keys]
    plain = T.admit
    for limit, window in ((1, 3), (2, 10), (3, 30)) * 20:
        logs, own = ([], np.zeros(0, int), np.zeros(0, np.int64)), collections.defaultdict(collections.deque)
        for begin in range(0, 80, 20):
            rows = [(rnd.randrange(4), begin + rnd.randrange(-15, 40), rnd.random() < 0.1, rnd.randrange(9)) for _ in range(20)]
            frame = pd.DataFrame({"k": pd.Series([named(r[0]) for r in rows], dtype=kind), "event_micros": [float(r[1]) for r in rows], "no_id": [r[2] for r in rows], "event_id": [r[3] for r in rows]})
            got, logs = T._decide(frame, "k", logs, limit, window)
            mine = collections.defaultdict(list)
            for row in sorted(zip(rows, got.tolist()), key=lambda r: r[0][1:]):
                mine[named(row[0][0])].append((row[0][1], row[1]))
            for k, all_of_it in mine.items():
                times, ok = zip(*all_of_it)
                # rows that tie in time and id may change places
                assert sorted(zip(times, ok)) == sorted(zip(times, plain(np.array(times), own[k], limit, window).tolist()))
            ends = np.cumsum(logs[1]).tolist()
            assert {k: logs[2][hi - n : hi].tolist() for k, n, hi in zip(logs[0], logs[1], ends)} == {k: list(v) for k, v in own.items() if v}
    monkeypatch.setattr(T, "admit", None)
    quiet = pd.DataFrame({"k": range(1000), "event_micros": 0.0, "no_id": False, "event_id": range(1000)})
    got, logs = T._decide(quiet, "k", ([], np.zeros(0, int), np.zeros(0, np.int64)), 1, 5)
    assert got.all() and logs[0] == list(range(1000))


def test_a_group_waits_with_one_timer(spark, tmp_path):
    """Events of many buckets in a trigger: one timer a group, and each bucket is decided when the watermark has passed it."""
    rows = [(f"c{k % 5}", k, START + timedelta(hours=k)) for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = T.throttle_event_time(source, "client", "ts", "event_id", 2, 40_000, "1 hour", bucket_s=3600, shards=1)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = decided(spark.read.schema(out.schema).parquet(str(tmp_path / "out")))
    want = expected(rows, 2, 40_000)
    assert got == {k: want[k] for k in got} and 50 <= len(got) < 60
    made = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in run.recentProgress]
    assert max(made) == 1


def test_whole_keys_beside_rows_without_one(spark, tmp_path):
    """NULL keys in the same Arrow batch as large whole ones: keys and decisions are those of the batch form, over triggers."""
    big = (1 << 60) + 1
    rows = [(None if k % 7 == 0 else big + k % 5, k, START + timedelta(seconds=3 * k)) for k in range(300)]
    kind = "client long, event_id long, ts timestamp"
    for part in range(3):
        spark.createDataFrame(rows[100 * part : 100 * part + 100], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(str, T.throttle(spark.createDataFrame(rows, kind), "client", "ts", "event_id", 2, 300).collect()))
    for n, (start, more) in enumerate([(T.throttle_stream, {}), (T.throttle_event_time, {"lateness": "2 hours"})]):
        if n == 1:
            spark.createDataFrame([(-1, -1, START + timedelta(days=2))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = start(source, "client", "ts", "event_id", 2, 300, shards=3, **more)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / f"out{n}")).option("checkpointLocation", str(tmp_path / f"state{n}")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.schema(out.schema).parquet(str(tmp_path / f"out{n}")).where("event_id >= 0").collect()
        assert sorted(map(str, got)) == want
