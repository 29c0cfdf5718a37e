"""Incremental state: manifests, key checks, slices, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skip_decision(inputs: DataFrame, manifest: DataFrame, outputs: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, decision): skip only if the recorded hash is equal and the output is there."""
    m = manifest.select(key, F.col(digest).alias("_old"))
    o = outputs.select(key).distinct().withColumn("_there", F.lit(True))
    d = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(digest), "changed").when(F.col("_there").isNull(), "output missing").otherwise("skip")
    return inputs.join(m, key, "left").join(o, key, "left").select(key, d.alias("decision"))


def duplicate_reason(rows: DataFrame, order: str, keys: list[tuple[str, str]]) -> DataFrame:
    """The first key, in order, that an earlier row has too; blank keys never count."""
    out, reason = rows, None
    for k, (name, col) in enumerate(keys):
        w = Window.partitionBy(col).orderBy(order)
        blank = F.col(col).isNull() | (F.col(col).cast("string") == "")
        out = out.withColumn(f"_d{k}", ~blank & (F.row_number().over(w) > 1))
        reason = F.when(F.col(f"_d{k}"), name) if reason is None else reason.when(F.col(f"_d{k}"), name)
    return out.withColumn("reason", reason).drop(*[f"_d{k}" for k in range(len(keys))])


def slice_completion(built: DataFrame, stored: DataFrame, index: str, key: str, content: str, size: int) -> DataFrame:
    """(slice, rows, done): a slice is done if every row is stored with equal content."""
    s = stored.select(key, F.col(content).alias("_stored"))
    j = built.join(s, key, "left").withColumn("slice", F.floor(F.col(index) / size).cast("long"))
    return j.groupBy("slice").agg(F.count("*").alias("rows"), F.bool_and(F.coalesce(F.col("_stored") == F.col(content), F.lit(False))).alias("done"))


def upsert(stored: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Rows of the sources in ``new`` are replaced by the new rows."""
    return stored.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def seen_reason(rows: DataFrame, seen: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """``reason``: the first key, in order, whose value ``seen`` has; nulls never count."""
    out, reason = rows, F.lit(None).cast("string")
    for k, (_, col) in enumerate(keys):
        s = seen.select(F.col(col)).where(F.col(col).isNotNull()).distinct().withColumn(f"_s{k}", F.lit(True))
        out = out.join(s, col, "left")
    for k, (name, _) in reversed(list(enumerate(keys))):
        reason = F.when(F.col(f"_s{k}"), name).otherwise(reason)
    return out.withColumn("reason", reason).drop(*[f"_s{k}" for k in range(len(keys))])


def pruned(manifest: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Entries whose key still exists."""
    return manifest.join(existing.select(key).distinct(), key, "left_semi")


def deleted(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def path_key(url: Column) -> Column:
    """The last three parts of a URL."""
    return F.substring_index(url, "/", -3)


def object_url(root: str, year: Column, path: Column) -> Column:
    """Address of an object; null for a blank path."""
    return F.when(F.trim(path) != "", F.concat_ws("/", F.lit(root), year, path))


def cache_stats(log: DataFrame, prefix: str, hit: Column, item: str, alive: Column) -> DataFrame:
    """Hits, misses (unknown counts as a miss) and live items of each prefix."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    h = F.coalesce(hit, F.lit(False))
    return log.groupBy(F.col(prefix).alias("prefix")).agg(n(h).alias("hits"), n(~h).alias("misses"), F.countDistinct(F.when(alive, F.col(item))).alias("items"))


def cache_key(prefix: str, **arguments: Column) -> Column:
    """prefix:md5 of the arguments as JSON, in order of name."""
    return F.concat(F.lit(prefix + ":"), F.md5(F.to_json(F.struct(*[arguments[k].alias(k) for k in sorted(arguments)]))))


def remaining(built: DataFrame, stored: DataFrame, index: str, key: str, content: str, size: int) -> DataFrame:
    """Rows of the slices that are not done, with their slice: what a run that was stopped has still to do."""
    done = slice_completion(built, stored, index, key, content, size).where("done").select("slice")
    return built.withColumn("slice", F.floor(F.col(index) / size).cast("long")).join(done, "slice", "left_anti")


def resume_plan(built: DataFrame, stored: DataFrame, index: str, key: str, content: str, size: int, per_second: float = 4.0) -> DataFrame:
    """One row: rows in all, reused and to do, the first to do, slices to do, and seconds needed and spared at ``per_second`` rows."""
    s = slice_completion(built, stored, index, key, content, size)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("rows")).otherwise(0)), F.lit(0)).cast("long")
    t = s.agg(
        n(F.lit(True)).alias("total"), n(F.col("done")).alias("reused"), n(~F.col("done")).alias("to_do"), (F.min(F.when(~F.col("done"), F.col("slice"))) * size).alias("first_to_do"),
        F.coalesce(F.sum(F.when(F.col("done"), 0).otherwise(1)), F.lit(0)).cast("long").alias("slices_to_do"))
    seconds = lambda c: F.bround(F.col(c) / per_second).cast("long")
    return t.withColumns({"seconds": seconds("to_do"), "seconds_spared": seconds("reused")})


def resume(built: DataFrame, stored: DataFrame, index: str, key: str, content: str, size: int, path: str) -> None:
    """Store what remains, one folder a slice; folders of slices that are done stay as they are, so a run may stop and start again at any time."""
    todo = remaining(built, stored, index, key, content, size)
    todo.repartition("slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)


def provenance_status(recorded: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): a recorded file may be ok, changed or missing; one that is there without a record is unrecorded."""
    f = found.select(key, F.col(digest).alias("_now"), F.lit(True).alias("_there"))
    j = recorded.select(key, F.col(digest).alias("_then"), F.lit(True).alias("_known")).join(f, key, "full")
    status = F.when(F.col("_known").isNull(), "unrecorded").when(F.col("_there").isNull(), "missing").when(F.col("_then").eqNullSafe(F.col("_now")), "ok").otherwise("changed")
    return j.select(key, status.alias("status"))
