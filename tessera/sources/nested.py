"""Nested documents, and tables that may not be there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def valid(docs: DataFrame) -> DataFrame:
    """Documents with metadata and at least one page."""
    return docs.where(F.col("metadata").isNotNull() & (F.size("pages") > 0))


def flatten(docs: DataFrame) -> DataFrame:
    """One row a chunk, with its page number and its place: the columns of the document but ``pages``."""
    rest = [c for c in docs.columns if c != "pages"]
    pages = valid(docs).select(*rest, F.inline("pages"))
    chunks = pages.select(*rest, "page_number", F.posexplode("chunks").alias("chunk_index", "_chunk"))
    return chunks.select(*rest, "page_number", "chunk_index", "_chunk.*")


def on_one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", " "))


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or no rows where nothing has been written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def collection_name(corpus: str, strategy: str, model: str) -> str:
    return f"exp_{corpus}_{strategy}_{model}"


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrite a table, or with ``by`` only the partitions that ``df`` has; the commit protocol shows readers all or nothing."""
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else w).parquet(path)
