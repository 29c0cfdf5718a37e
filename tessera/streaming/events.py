"""File events: keyed state with timers, the same rows from a stream as from a table.

``settled`` gives one row for each burst of a key's events, when nothing more has come for ``quiet`` seconds: what was written last is then stable.
``debounced`` lets an event of a key through if ``gap`` seconds have passed since the last one that went through. Both wait for the watermark, so events that come
within ``lateness`` out of order count in their own order; state holds the events of that time and one number a key, and goes when the gap is over. The keys of a bucket
are one state, so a batch calls Python once a bucket, not once a key.
``append_once`` makes a sink that may be given a batch again after a failure. Nothing is lost on a restart: what waits is in the checkpoint.

Events without a time or a key take no part; equal times go by ``id``; repeated events are events of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import ship

#: States that a debounced stream's keys are dealt over.
BUCKETS = 1024


def settled(events: DataFrame, key: str, ts: str, size: str, quiet: str, lateness: str = "10 minutes") -> DataFrame:
    """(key, started, ended, n_events, size): each burst of a key, with the size of its latest event (the largest of equally late ones)."""
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    e = e.withWatermark(ts, lateness) if events.isStreaming else e
    g = e.groupBy(key, F.session_window(ts, quiet).alias("_w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"), F.max(F.struct(ts, size)).alias("_last"))
    return g.select(key, "started", "ended", "n_events", F.col(f"_last.{size}").alias(size))


def _let_through(rows: np.ndarray, last: dict[int, int], gap: int) -> tuple[np.ndarray, dict[int, int]]:
    """Of rows (key, at, none, id), which are put in order, those that go through, and when a key's last one did; without an id (none is 1) comes last."""
    rows = rows[:, np.lexsort(rows[::-1])]
    through = np.zeros(rows.shape[1], bool)
    starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0][:1] - 1))
    for key, start, end in zip(rows[0][starts].tolist(), starts.tolist(), [*starts[1:].tolist(), rows.shape[1]]):
        before = last.get(key)
        for i, at in enumerate(rows[1, start:end].tolist(), start):
            if before is None or at - before >= gap:
                through[i] = True
                before = at
        last[key] = before
    return rows[:, through], last


def debounced(events: DataFrame, key: str, ts: str, id_col: str, gap: float, lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, id): the events that go through, ``key`` and ``id`` as long. A stream's keys share ``buckets`` states, as many in each run of a checkpoint."""
    ship(events.sparkSession)
    wait = int(gap * 1_000_000)
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(id_col).cast("long").alias("id"))
    e = e.withColumns({"at": F.unix_micros("ts"), "none": F.col("id").isNull().cast("long"), "id": F.coalesce("id", F.lit(0).cast("long"))})
    names, kinds = ["key", "at", "none", "id"], "key long, none long, id long"
    named = lambda df: df.select(F.col("key").alias(key), F.when(F.col("none") == 0, F.col("id")).alias(id_col))
    frame = lambda r: pd.DataFrame({"key": r[0], "none": r[2], "id": r[3]})
    if not events.isStreaming:
        return named(e.groupBy("key").applyInPandas(lambda pdf: frame(_let_through(pdf[names].to_numpy("int64").T, {}, wait)[0]), kinds))

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = (np.frombuffer(x, "<i8").reshape(n, -1) for n, x in zip((2, 4), state.get if state.exists else (b"", b"")))
        rows = np.concatenate([held, *(p[names].to_numpy("int64").T for p in parts)], axis=1)
        line = state.getCurrentWatermarkMs() * 1000
        ripe = rows[1] <= line
        ready, held = rows[:, ripe], rows[:, ~ripe]
        through, last = _let_through(ready, dict(zip(*last.tolist())), wait)
        # a gap that is over no longer matters
        last = [(k, a) for k, a in last.items() if a + wait > line]
        if not last and not held.shape[1]:
            if state.exists:
                state.remove()
        else:
            state.update((np.array(last, "<i8").reshape(-1, 2).T.tobytes(), held.astype("<i8").tobytes()))
            due = int(held[1].min()) if held.shape[1] else max(a for _, a in last) + wait
            state.setTimeoutTimestamp(max(due // 1000 + 1, line // 1000 + 1))
        if through.shape[1]:
            yield frame(through)

    s = e.withWatermark("ts", lateness).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        step, kinds, "last binary, held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return named(s)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of one folder a batch: a batch that comes again replaces its own folder."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def drain(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a streaming table over what its source has now; what it keeps waiting is in ``checkpoint`` for the next run."""
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def source(spark: SparkSession, folders: list[str], schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files of some folders."""
    s = None
    for f in folders:
        one = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f)
        s = one if s is None else s.unionByName(one)
    return s
