"""Reading inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Values of a partition column that become a literal filter; beyond, the join prunes.
MOST_VALUES = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON files below a folder; records that do not parse land in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)


def binaries(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modified, size, sha256, is_pdf) of files."""
    from pyspark.sql import functions as F

    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def store_by(df: DataFrame, path: str, by: str, deals: int = 4) -> None:
    """Write a table partitioned by a column; values that ``df`` has replace what the table held of them, all others stay.

    A value's rows are dealt over ``deals`` tasks, so a frequent value is not one task's.
    """
    from pyspark.sql import functions as F

    rows = df.withColumn("_deal", F.pmod(F.xxhash64(*[c for c in df.columns if c != by]), F.lit(deals))).repartition(by, "_deal").drop("_deal")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stored_by(spark: SparkSession, path: str, schema: str, by: str, wanted: DataFrame | None = None) -> DataFrame:
    """A table that ``store_by`` wrote; with ``wanted`` only the partitions of its values of ``by``, which Spark prunes at run time.

    ``wanted`` is a small table that some filter made; its distinct values are broadcast to the scan, other partitions are not listed for reading.
    """
    from pyspark.sql import functions as F

    t = spark.read.schema(schema).parquet(path)
    if wanted is None:
        return t
    values = wanted.select(by).distinct()
    few = [r[0] for r in values.limit(MOST_VALUES + 1).collect()]  # bounded
    return t.where(F.col(by).isin(few)) if len(few) <= MOST_VALUES else t.join(values, by, "left_semi")


def build_if_changed(df: DataFrame, path: str, schema: str, by: str) -> list:
    """Write the partitions whose number of rows or content differs from what is stored, and leave the others; the values that were written.

    Content is compared by a sum of row hashes, so no row moves for it.
    """
    from pyspark.sql import functions as F

    from .nested import existing

    spark = df.sparkSession
    rest = [c for c in df.columns if c != by]
    digest = lambda t: t.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).alias("h"))
    now, then = digest(df), digest(existing(spark, path, schema).select(*df.columns)).withColumnsRenamed({"n": "n0", "h": "h0"})
    changed = now.join(then, by, "left").where(F.col("n0").isNull() | (F.col("n") != F.col("n0")) | (F.col("h") != F.col("h0"))).select(by)
    values = sorted(r[0] for r in changed.collect())  # a value a partition
    if values:
        store_by(df.where(F.col(by).isin(values)), path, by)
    return values
