"""Queries over replayed streams and incremental tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.base import fixture, query
from ..plans.fixtures import CHUNKS
from ..sources.store import new_path
from ..sources.tables import table
from ..streaming import delta, events

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
_FAR = "2100-01-01 00:00:00"


def _replayed(spark, d, rows):
    """The events as files of a folder, streamed in two runs of one checkpoint; a late last event moves the watermark past all others."""
    folder, out, at = new_path(spark, "events"), new_path(spark, "streamed"), new_path(spark, "checkpoint")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ranges = max(4, min(spark.sparkContext.defaultParallelism, 500))  # one batch takes up to 1,000 files
    e.repartitionByRange(ranges, "ts", "event_id").write.parquet(f"{folder}/log")
    clock = e.limit(1).select("event_id", F.lit(_FAR).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), "event_type", "value", "props")
    clock.limit(0).write.parquet(f"{folder}/clock")
    run = lambda: events.drain(rows(events.source(spark, [f"{folder}/log", f"{folder}/clock"], _EVENTS)), events.append_once(out), at)
    run()
    clock.write.mode("append").parquet(f"{folder}/clock")
    run()
    return spark.read.parquet(out).drop("batch").where("user_id >= 0")


@query("""WITH b AS (SELECT user_id, ts, value, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000, true) AS new FROM events),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT * FROM b ORDER BY user_id, ts))
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n_events, arg_max(value, (ts, value)) AS size FROM s GROUP BY user_id, burst""")
def streamed_bursts(spark, d):
    """What was last written of each key once an hour has been quiet."""
    r = _replayed(spark, d, lambda e: events.settled(e, "user_id", "ts", "value", "1 hour"))
    return r.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n_events", F.col("value").alias("size"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, t, k FROM e WHERE k = 1 UNION ALL SELECT user_id, event_id, t, k FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.k) AS r FROM w JOIN e ON e.user_id = w.user_id AND e.k > w.k AND e.t - w.t >= 21600000000) WHERE r = 1)
SELECT user_id, event_id FROM w""")
def streamed_debounce(spark, d):
    """An event goes through six hours after the last that did; state, timers and a restart give the rows of the table."""
    return _replayed(spark, d, lambda e: events.debounced(e, "user_id", "ts", "event_id", 6 * 3600))


def _routes():
    return {"all": F.lit(True), "ratio": F.col("section_type") == "ratio", "facts": F.col("section_type") == "facts"}


def _batches(spark, d):
    """All chunks; newer versions of every fifth case, without its odd chunks; a batch with an old and a new version of every seventh case."""
    c = fixture(spark, d, CHUNKS).select("chunk_id", F.concat(F.lit("case "), F.col("case_no").cast("string")).alias("source"), "case_no", "section_type", F.lit(0).alias("version"))
    kind = F.when(F.col("chunk_id") % 2 == 0, "ratio").otherwise("facts")
    fifth = c.where("case_no % 5 = 0 and chunk_id % 2 = 0").withColumns({"version": F.lit(1), "section_type": F.lit("facts")})
    seventh = c.where("case_no % 7 = 0")
    return [c, fifth, seventh.withColumn("version", F.lit(1)).unionByName(seventh.where("chunk_id % 3 > 0").withColumns({"version": F.lit(2), "section_type": kind}))]


@query(f"""WITH c AS ({CHUNKS}), b AS (SELECT chunk_id, case_no, section_type, 0 AS version FROM c WHERE case_no % 5 <> 0 AND case_no % 7 <> 0 UNION ALL SELECT chunk_id, case_no, 'facts', 1 FROM c WHERE case_no % 5 = 0 AND case_no % 7 <> 0 AND chunk_id % 2 = 0
UNION ALL SELECT chunk_id, case_no, CASE WHEN chunk_id % 2 = 0 THEN 'ratio' ELSE 'facts' END, 2 FROM c WHERE case_no % 7 = 0 AND chunk_id % 3 > 0),
k AS (SELECT 'all' AS collection, * FROM b UNION ALL SELECT section_type, * FROM b WHERE section_type IN ('ratio', 'facts'))
SELECT collection, case_no, version, count(*) AS n, sum(chunk_id)::BIGINT AS ids FROM k GROUP BY 1, 2, 3""")
def delta_collections(spark, d):
    """Three batches, given twice, an earlier one again after a later one."""
    root = new_path(spark, "delta")
    found = _batches(spark, d)
    for n in (0, 1, 1, 2, 0, 2):
        delta.apply(found[n], n, root, "source", "chunk_id", "version", _routes())
    schema = "chunk_id long, source string, case_no long, section_type string, version int"
    out = None
    for name in _routes():
        one = delta.collection(spark, root, name, schema).select(F.lit(name).alias("collection"), "case_no", "version", "chunk_id")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("collection", "case_no", "version").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))
