"""Streams against plain loops: batches in several orders, late events, restarts, replays, a kill between table and ledger."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.sources.store import new_path
from tessera.streaming import delta, events

SCHEMA = "path long, ts timestamp, id long, size long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log(n=300, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(6), START + timedelta(seconds=rng.randrange(4000)), i, rng.randrange(9)) for i in range(n)]


def loop(rows, gap):
    out, last = set(), {}
    for path, ts, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if path not in last or (ts - last[path]).total_seconds() >= gap:
            out.add((path, i))
            last[path] = ts
    return out


def bursts(rows, quiet):
    out, open_ = set(), {}
    for path, ts, _, size in sorted(rows, key=lambda r: (r[1], r[3])):
        b = open_.get(path)
        if b and (ts - b[1]).total_seconds() <= quiet:
            b[1], b[2], b[3] = ts, b[2] + 1, size
        else:
            if b:
                out.add((path, b[0], b[1], b[2], b[3]))
            open_[path] = [ts, ts, 1, size]
    return out | {(p, *b) for p, b in open_.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def replay(spark, parts, rows_of, clock=datetime(2030, 1, 1, tzinfo=timezone.utc)):
    """Each part arrives and is streamed by a run of its own; the last moves the time on."""
    folder, out, at = new_path(spark, "t-log"), new_path(spark, "t-out"), new_path(spark, "t-check")
    for part in [*parts, [(-1, clock, -1, 0)]]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        events.drain(rows_of(events.source(spark, [folder], SCHEMA, 1)), events.append_once(out), at)
    return spark.read.parquet(out).where("path >= 0")


def test_debounce_of_a_stream_equals_the_table_and_a_loop(spark):
    rows = log()
    late = sorted(rows, key=lambda r: r[1].timestamp() + random.Random(r[2]).randrange(500))  # up to 500 seconds out of order
    want = loop(rows, 120)
    whole = events.debounced(frame(spark, rows), "path", "ts", "id", 120)
    assert {(r.path, r.id) for r in whole.collect()} == want
    got = replay(spark, [late[:90], late[90:200], late[200:]], lambda s: events.debounced(s, "path", "ts", "id", 120, "10 minutes"))
    assert {(r.path, r.id) for r in got.collect()} == want and got.count() == len(want)


def test_bursts_of_a_stream_equal_the_table_and_a_loop(spark):
    rows = sorted(log(200, 2), key=lambda r: r[1])
    want = bursts(rows, 60)
    tuples = lambda df: {(r.path, r.started.astimezone(timezone.utc), r.ended.astimezone(timezone.utc), r.n_events, r.size) for r in df.collect()}
    plain = lambda s: events.settled(s, "path", "ts", "size", "60 seconds")
    gone = {(p, a, b, n, s) for p, a, b, n, s in want}
    assert tuples(plain(frame(spark, [*rows, (None, START, 1, 1), (1, None, 1, 1)]))) == gone
    got = replay(spark, [rows[:70], rows[70:]], plain)
    assert tuples(got) == gone and got.count() == len(gone)


def test_state_goes_when_the_gap_is_over(spark):
    folder, at = new_path(spark, "t-log"), new_path(spark, "t-check")
    for k in range(4):  # each file's paths are new
        frame(spark, [(100 * k + i, START + timedelta(hours=k), i, 1) for i in range(20)]).coalesce(1).write.mode("append").parquet(folder)
    s = events.debounced(events.source(spark, [folder], SCHEMA, 1), "path", "ts", "id", 60, "1 minute")
    q = s.writeStream.foreachBatch(lambda df, n: df.count() and None).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 40


def test_keys_share_states(spark):
    """Three thousand keys that wait are no more states than there are buckets; keys of one bucket, equal times and missing ids stay apart."""
    folder, at = new_path(spark, "t-log"), new_path(spark, "t-check")
    frame(spark, [(k, START + timedelta(seconds=k), k, 1) for k in range(3000)]).coalesce(1).write.parquet(folder)
    found = []
    s = events.debounced(events.source(spark, [folder], SCHEMA, 1), "path", "ts", "id", 60, "2 hours")
    q = s.writeStream.foreachBatch(lambda df, n: found.append(df.count())).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= events.BUCKETS
    rows = [(p - 3, t, i, s) for p, t, i, s in log(200, 5)] + [(2, START, i, 1) for i in (7, -7)]
    parts = sorted(rows, key=lambda r: r[1])
    got = replay(spark, [parts[:80], parts[80:], [(2, START + timedelta(days=1), None, 1)]], lambda e: events.debounced(e, "path", "ts", "id", 120, buckets=2).where("path <> -1 or id <> -1").withColumn("path", F.col("path") + 3))
    want = {(p + 3, i) for p, i in loop(rows, 120)} | {(5, None)}
    assert {(r.path, r.id) for r in got.collect()} == want and got.count() == len(want)


ROUTES = {"all": lambda: F.lit(True), "even": lambda: F.col("id") % 2 == 0}
CHUNKS = "id long, source string, version int, body string"


def content(spark, root):
    return {name: sorted(tuple(r) for r in delta.collection(spark, root, name, CHUNKS).select("id", "source", "version", "body").collect()) for name in ROUTES}


def batch(spark, rows):
    return spark.createDataFrame(rows, CHUNKS)


BATCHES = [
    [(i, f"s{i % 5}", 1, "a") for i in range(40)] + [(99, None, 1, "x"), (None, "s1", 1, "x")],
    [(i, "s1", 1, "old") for i in range(100, 106)] + [(i, "s1", 2, "new") for i in range(102, 104)] + [(102, "s1", 2, "new")],
    [(7, "s9", 1, "moved")],
]


def want_of(batches):
    rows = {}
    for b in batches:
        b = [r for r in b if r[0] is not None and r[1] is not None]
        top = {}
        for _, s, v, _ in b:
            top[s] = max(top.get(s, 0), v)
        rows = {k: r for k, r in rows.items() if r[1] not in top}
        rows |= {r[0]: r for r in b if r[2] == top[r[1]]}
    return {"all": sorted(rows.values()), "even": sorted(r for r in rows.values() if r[0] % 2 == 0)}


def test_batches_replace_their_sources_once(spark):
    root, routes = new_path(spark, "t-delta"), {n: f() for n, f in ROUTES.items()}
    took = [delta.apply(batch(spark, BATCHES[n]), n, root, "source", "id", "version", routes) for n in (0, 1, 1, 0)]
    assert took == [True, True, False, False]
    assert content(spark, root) == want_of(BATCHES[:2])


def test_a_batch_that_was_killed_before_the_ledger_is_done_again(spark, monkeypatch):
    root, routes = new_path(spark, "t-delta"), {n: f() for n, f in ROUTES.items()}
    delta.apply(batch(spark, BATCHES[0]), 0, root, "source", "id", "version", routes)
    put, calls = delta.put, []

    def dies(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("killed")
        put(*a)

    monkeypatch.setattr(delta, "put", dies)
    with pytest.raises(RuntimeError):
        delta.apply(batch(spark, BATCHES[1]), 1, root, "source", "id", "version", routes)
    monkeypatch.setattr(delta, "put", put)
    assert delta.apply(batch(spark, BATCHES[1]), 1, root, "source", "id", "version", routes)
    assert content(spark, root) == want_of(BATCHES[:2])


def test_a_source_that_loses_all_rows_and_an_empty_batch(spark):
    root, routes = new_path(spark, "t-delta"), {"even": F.col("id") % 2 == 0}
    delta.apply(batch(spark, [(2, "s", 1, "a")]), 0, root, "source", "id", "version", routes)
    delta.apply(batch(spark, [(3, "s", 2, "b")]), 1, root, "source", "id", "version", routes)
    delta.apply(batch(spark, []), 2, root, "source", "id", "version", routes)
    assert delta.collection(spark, root, "even", CHUNKS).count() == 0 and delta.ledger(spark, root).count() == 3
