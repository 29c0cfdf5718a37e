"""Incremental indexing: batches of chunks into collections, each batch once.

A collection is a table of files, partitioned by a bucket of the source. A batch replaces all rows of its sources, whatever earlier batches held of them, so giving it again changes
nothing; only the buckets of its sources are read and written. The ledger names the batches that are through: they are skipped when they come again, also after later ones.
A run that is killed between the two writes does its batch once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.nested import existing
from ..sources.store import written

BUCKETS = 32


def _bucket(source: str) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int").alias("bucket")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(batch): the batches that are through."""
    return existing(spark, f"{root}/ledger", "batch long")


def collection(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return existing(spark, f"{root}/{name}", f"{schema}, bucket int")


def latest(chunks: DataFrame, source: str, version: str) -> DataFrame:
    """Of a batch that holds a source in several versions, the rows of its newest one."""
    last = chunks.groupBy(source).agg(F.max(version).alias("_v"))
    return chunks.join(last, source).where(F.col(version).eqNullSafe(F.col("_v"))).drop("_v")


def put(chunks: DataFrame, root: str, name: str, source: str, id_col: str, sources: DataFrame) -> None:
    """Replace the rows of ``sources`` in a collection by ``chunks``, one row an id."""
    spark = chunks.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    touched = [r.bucket for r in sources.select(_bucket(source)).distinct().collect()]  # at most BUCKETS numbers
    old = collection(spark, root, name, schema).where(F.col("bucket").isin(touched)).join(sources, source, "left_anti")
    new = chunks.dropDuplicates([id_col]).withColumn("bucket", _bucket(source))
    # written apart first: a table cannot be read and replaced in one go; buckets that hold no row any more are emptied by the same commit
    rows = written(old.join(new.select(id_col), id_col, "left_anti").select(*new.columns).unionByName(new), "delta")
    full = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most BUCKETS numbers
    rows.repartition("bucket", F.pmod(F.xxhash64(id_col), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{name}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for b in set(touched) - full:
        p = fs_path(f"{root}/{name}/bucket={b}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def apply(batch: DataFrame, number: int, root: str, source: str, id_col: str, version: str, routes: dict[str, Column]) -> bool:
    """Take a batch into every collection of ``routes`` (name: which chunks it holds); False if the ledger has it. Chunks without a source or an id take no part."""
    spark = batch.sparkSession
    if ledger(spark, root).where(F.col("batch") == number).count():
        return False
    chunks = latest(written(batch.where(F.col(source).isNotNull() & F.col(id_col).isNotNull()), "batch"), source, version)
    sources = written(chunks.select(source).distinct(), "sources")
    for name, held in routes.items():
        put(chunks.where(F.coalesce(held, F.lit(False))), root, name, source, id_col, sources)
    spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return True


def sink(root: str, source: str, id_col: str, version: str, routes: dict[str, Column]) -> Callable[[DataFrame, int], None]:
    """``apply`` as the sink of a stream."""
    return lambda df, n: apply(df, n, root, source, id_col, version, routes) and None
